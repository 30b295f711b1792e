"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, fill_middle, jaccard_join, line_dedup, media, page_text, periodic_runs, piece_codec, sharding, substring_dedup, toxicity, url_filter
from .common import documents

# The rules of op7.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and the digest of the text that they decode to."""
    docs = documents(spark, sf_dir)
    return piece_codec.pieces(docs).select("doc_id", "n_pieces", "piece_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that go from every document, with the text that is left as a digest, and how deep its repeated runs are."""
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "deepest")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set of shingles and the component that its links reach."""
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return page_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return sharding.sharded(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url. A page's label is that of the document whose number its path names; low quality is bad."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 0).alias("bad"))
    return url_filter.judged(pages, RULES, url_filter.document_labels(pages, labels)).select("page_id", "host", "path", "rule", "verdict")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, as a digest."""
    return substring_dedup.dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document holds."""
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and the feature of every document's media file."""
    return media.media_features(documents(spark, sf_dir))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every document is cut in three, and digests of its output and of the text that this gives back."""
    turned = fill_middle.fill_in_middle(documents(spark, sf_dir))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def planted(docs: DataFrame) -> DataFrame:
    """docs, with the words of one document in ten from somewhere on repeating: its text is then the words, joined by a space. Those without a doc_id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g")).withColumn("w", F.when(F.col("g").isNotNull(), words))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    text = F.expr("array_join(transform(sequence(0L, n - 1L), i -> w[cast(case when i >= a then a + (i - a) % p else i end as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words, and digests of all of them and of the words that they leave."""
    runs = periodic_runs.periodic_runs(planted(documents(spark, sf_dir)))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digest = F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256")
    rows = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), digest, F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    return byte_bpe.tokens(documents(spark, sf_dir)).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_line_dedup, op3_ngram_jaccard_join, op4_html_extraction, op5_sharding, op6_toxicity, op7_url_filters, op8_substring_dedup, op9_benchmark_decontamination, op10_media_columns, op11_fill_middle, op12_periodic_runs, op13_byte_bpe)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_SETS = f"""
{{0}}_words as (select {{1}} as id, {_WORDS.format(_LOWER)} as w from {{2}}),
{{0}}_sets as (
  select distinct id, array_to_string(w[i : i + 4], ' ') as s from (select id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from {{0}}_words where len(w) > 0)
)"""

def _lines_sql(levels: int = 14) -> str:
    """op2 in SQL, with the rounds of doubling written out, to runs of 2^levels lines; texts of the given tables have fewer lines."""
    ctes = []
    for d in range(levels):
        step = 2**d
        ctes.append(f"""r{d + 1} as (
  select doc_id, pos, name, count(*) over (partition by name) > 1 as held from (
    select a.doc_id, a.pos, dense_rank() over (order by a.name, b.name) as name from r{d} a join r{d} b on b.doc_id = a.doc_id and b.pos = a.pos + {step} where a.held and b.held)
)""")
    deep = " union all ".join(f"select doc_id, {2**d}::bigint as depth from r{d} where held" for d in range(levels + 1))
    return f"""
with l as (
  select doc_id, unnest(range(1, len(x) + 1)) as pos, unnest(x) as line, len(x) as n from (select doc_id, string_split(text, chr(10)) as x from documents)
), p as (
  select *, lead(line) over (partition by doc_id order by pos) as next from l
), f as (
  select *, row_number() over (partition by line order by doc_id, pos) as nth, case when next is not null then row_number() over (partition by line, next order by doc_id, pos) end as nth2 from p
), g as (
  select *, (nth > 1 and length(line) >= 40) or coalesce(nth2, 1) > 1 or coalesce(lag(nth2) over (partition by doc_id order by pos), 1) > 1 as gone from f
), r0 as (select doc_id, pos, name, count(*) over (partition by name) > 1 as held from (select doc_id, pos, dense_rank() over (order by line) as name from l)),
{", ".join(ctes)},
deep as (select doc_id, max(depth) as deepest from ({deep}) group by doc_id)
select g.doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256, coalesce(any_value(deepest), 0) as deepest
from g left join deep using (doc_id) group by g.doc_id"""


def _tree_sql(levels: int = 8) -> str:
    """op7 in SQL, with the rounds over the levels written out; paths of the given tables have fewer."""
    ctes = [
        r"""u as (
  select page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages
)""",
        r"""f as (
  select *, case when url is not null then list_transform(string_split(path, '/'), lambda x: case when regexp_full_match(x, '[0-9]+') then '{n}' when regexp_full_match(x, '[0-9]+\.[A-Za-z0-9]+') then '{n}.' || split_part(x, '.', 2)
    when regexp_full_match(x, '[0-9a-fA-F-]{16,}') then '{id}' else x end) end as form, try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:[./]|$)', 1), '') as bigint) as number from u
)""",
        "l as (select doc_id, max((quality = 0)::int) as bad from labels group by doc_id)",
        "g as (select page_id, max(bad) as bad from f join l on number = doc_id group by page_id)",
        "a0 as (select host, form, count(bad) as n, coalesce(sum(bad), 0)::bigint as bad, form as s from f left join g using (page_id) where form is not null group by all)",
    ]
    for d in range(1, levels + 1):
        here = f"array_to_string(s[1:{d - 1}], '/')" if d > 1 else "''"
        ctes.append(f"w{d} as (select host, {here} as node from a{d - 1} where len(s) >= {d} group by all having count(distinct s[{d}]) > {url_filter.BRANCHES})")
        ctes.append(f"a{d} as (select a.* replace (case when w.host is null then s else s[1:{d - 1}] || ['{{s}}'] || s[{d + 1}:] end as s) from a{d - 1} a left join w{d} w on w.host = a.host and w.node = {here} and len(s) >= {d})")
    ctes.append(f"m0 as (select * from a{levels})")
    for d in range(1, levels + 1):
        here = f"array_to_string(s[1:{d - 1}], '/')" if d > 1 else "''"
        ctes.append(f"""b{d} as (
  select *, bad::double / nullif(n, 0) as share, lag(n) over w as m, lag(bad) over w as ill, lag(bad::double / nullif(n, 0)) over w as before
  from (select host, {here} as node, s[{d}] as segment, sum(n) as n, sum(bad) as bad from m{d - 1} where len(s) >= {d} group by all) window w as (partition by host, node order by bad::double / nullif(n, 0) nulls last, segment)
)""")
        ctes.append(f"""p{d} as (
  select *, sum(case when n > 0 and m > 0 and abs(share - before) > {url_filter.DIFFERENT} * sqrt(((bad + ill)::double / (n + m)) * (1 - (bad + ill)::double / (n + m)) * (1.0::double / n + 1.0::double / m)) then 1 else 0 end)
    over (partition by host, node order by share nulls last, segment rows unbounded preceding) as part from b{d}
)""")
        ctes.append(f"""c{d} as (
  select *, count(*) over (partition by host, node, own) > 1 as merge from (
    select *, case when n > 0 then part else -(max({{'n': n, 'part': -part}}) over (partition by host, node)).part end as own from p{d})
)""")
        ctes.append(f"m{d} as (select m.* replace (case when merge then s[1:{d - 1}] || ['{{~' || own::bigint || '}}'] || s[{d + 1}:] else s end as s) from m{d - 1} m left join c{d} c on c.host = m.host and c.node = {here} and c.segment = s[{d}] and len(s) >= {d})")
    rules = "\n".join(f"    when (f.host = '{h}' or f.host like '%.{h}') and f.path like '/{p}%' then '{h}/{p}'" for h, _, p in (r.partition("/") for r, _ in sorted(RULES, key=lambda r: -len(r[0]))))
    verdicts = " ".join(f"when '{r}' then '{v}'" for r, v in RULES)
    return f"""
with {", ".join(ctes)},
t as (select coalesce(sum(bad)::double / nullif(sum(n), 0), 0) as prior from m{levels}),
x as (select host, s, sum(bad) > 0 and (sum(bad) + {url_filter.SMOOTH} * prior) / (sum(n) + {url_filter.SMOOTH}) >= least({url_filter.LIFT} * prior, {url_filter.REJECT}) as rejected from m{levels}, t group by host, s, prior),
y as (select m.host, m.form, rejected from m{levels} m join x on x.host = m.host and x.s = m.s),
r as (
  select page_id, f.host, f.path, rejected, case
{rules} end as rule from f left join y on y.host = f.host and y.form = f.form
)
select page_id, host, path, rule, case rule {verdicts} else case when rejected then 'block' else 'allow' end end as verdict from r"""


ORACLE_SQL = {
    "op2_line_dedup": _lines_sql(),
    "op3_ngram_jaccard_join": f"""
with recursive {_SETS.format("d", "doc_id", "documents")},
n as (select doc_id, count(s) as n from documents left join d_sets on id = doc_id group by doc_id),
c as (select a.id as a, b.id as b, count(*) as shared from d_sets a join d_sets b on a.s = b.s and a.id <> b.id group by all),
links as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
reach(a, b) as (select doc_id, doc_id from n union select reach.a, links.b from reach join links on links.a = reach.b)
select n.doc_id, n.n as n_shingles, min(reach.b) as component_id from n join reach on reach.a = n.doc_id group by all""",
    "op7_url_filters": _tree_sql(),
    "op8_substring_dedup": f"""
with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
late as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h) as low from win) where low < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as pos from late),
word as (select doc_id, unnest(range(1, len(w) + 1)) as pos, unnest(w) as word from w),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as kept from word anti join gone using (doc_id, pos) group by doc_id)
select w.doc_id, len(w)::bigint as n_words, len(w)::bigint - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (doc_id)""",
    "op9_benchmark_decontamination": f"""
with {_SETS.format("d", "doc_id", "documents").strip()},{_SETS.format("b", "item_id", "benchmark")},
size as (select id, count(*) as n from b_sets group by id)
select d.id as doc_id, b.id as item_id, count(*) as n_shared, size.n as n_item from d_sets d join b_sets b using (s) join size on size.id = b.id
group by d.id, b.id, size.n having 100 * count(*) >= 80 * size.n""",
    "op11_fill_middle": """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
h as (select *, ('0x' || x[1:8])::ubigint % (n + 1) as c1, ('0x' || x[9:16])::ubigint % (n + 1) as c2, ('0x' || x[17:24])::ubigint % 100 as h3, ('0x' || x[25:32])::ubigint % 100 as h4 from d),
f as (select *, least(c1, c2)::bigint as a, greatest(c1, c2)::bigint as b, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain' when h4 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf from f)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from p""",
    "op12_periodic_runs": f"""
with c as (
  select doc_id, {_WORDS.format("coalesce(text, '')")} as w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::bigint) as h from documents
), g as (select doc_id, w, len(w)::bigint as n, h, h // 10 as g from c),
a as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from g),
b as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
word as (select doc_id, i, case when a is not null and i >= a then w[(a + (i - a) % p + 1)::bigint] else w[i + 1] end as x from (select *, unnest(range(0, n)) as i from b)),
pair as (select u.doc_id, v.i - u.i as q, v.i from word u join word v on v.doc_id = u.doc_id and v.x = u.x and v.i > u.i),
island as (select doc_id, q, min(i) - q as s, max(i) + 1 as e from (select *, i - row_number() over (partition by doc_id, q order by i) as k from pair) group by doc_id, q, k having count(*) >= greatest(q, {periodic_runs.LEAST} - q)),
run as (select * from island r where not exists (select 1 from island z where z.doc_id = r.doc_id and z.q < r.q and r.q % z.q = 0 and z.s <= r.s and z.e >= r.e)),
gone as (select distinct doc_id, unnest(range(s + q, e)) as i from run),
kept as (select doc_id, string_agg(x, ' ' order by i) as kept from word anti join gone using (doc_id, i) group by doc_id),
sums as (select doc_id, count(*) as n_runs, arg_max({{'start': s, 'length': e - s, 'period': q}}, {{'l': e - s, 's': -s, 'q': -q}}) as top, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' order by s, q) as lines from run group by doc_id)
select doc_id, coalesce(n_runs, 0) as n_runs, top.start as start, top.length as length, top.period as period, 1000 * top.length // top.period as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from documents left join sums using (doc_id) left join kept using (doc_id)""",
}
