"""What the methods decide, odd inputs, and the stages of the pipeline."""

import hashlib
import itertools
import math
import random
import re
import types
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm import common, decontamination, jaccard_join, line_dedup, media, page_text, piece_codec, queries, sharding, substring_dedup, toxicity, url_filter

TABLES = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _gone int, _removed int, _rk int, _k long, _t long, token long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5, 6) for i, t in rows], DOCS).repartition(3)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_regular_words_have_hashes_of_their_own(spark):
    x = thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    for k in (16, 64, 128, 129, 1024):
        w = common.words_of(pa.array([x[:k], y[:k], x[:k]]), lanes=2)
        assert w.hash[0] != w.hash[1] and w.second[0] != w.second[1] and w.hash[0] == w.hash[2] != w.second[0]
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    w = common.words_of(pa.array([" ".join(words), " x ".join(words)]), lanes=2)
    assert len(set(w.hash.tolist())) == len({*words, "x"}) == len(set(w.second.tolist()))
    for k in (1, 2, 5, 25, 50):
        h = common.windows(w.hash[: len(words)], k)
        assert len(h) == len(words) - k + 1 and len(set(h.tolist())) == len({tuple(words[i : i + k]) for i in range(len(h))})
    a, b = " ".join([x] * 60), " ".join([y] * 60)
    docs = docs_of(spark, [(1, a), (2, b)])
    assert [r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()] == [0, 0]
    assert {r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {1, 2}
    assert decontamination.contaminated(docs, spark.createDataFrame([(9, " ".join([x] * 5))], "item_id long, text string")).select("doc_id").collect() == [(1,)]


def test_stored_tables_are_never_local_on_a_cluster(spark):
    def session(master, settings):
        context = types.SimpleNamespace(master=master, applicationId=f"app-{master}")
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, *d: settings[k] if k in settings else d[0]), sparkContext=context)

    assert common.shared_dir(session("yarn", {"spark.checkpoint.dir": "hdfs:/c"})) == "hdfs:/c/weft-app-yarn"
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        assert common.shared_dir(session(master, {"spark.sql.warehouse.dir": "hdfs:/w"})) == f"hdfs:/w/weft-app-{master}"
    assert common.shared_dir(session("local[2]", {})) == common.shared_dir(session("local[2]", {}))
    one = common.stored(spark.range(3), "y")
    path = one.inputFiles()[0].removeprefix("file://")
    assert one.count() == 3 and Path(path).exists()
    common.forget(one)
    assert not Path(path).exists()


# stages


ROWS = [(None, None), (1, ""), (2, "one two"), (3, "a line that is rather long, and longer than forty characters\nx\ny"), (4, "b\na line that is rather long, and longer than forty characters"), (4, "other"), (5, "the item of the benchmark is here, in this text of ten words"), (5, "the item of the benchmark is here, in this text of ten words"), (6, " ".join(f"w{i}" for i in range(40))), (7, " ".join(f"w{i}" for i in range(40)) + " z"), (8, "long " * 20_000)]


def test_stages_keep_columns_of_any_name(spark):
    docs = docs_of(spark, ROWS)
    items = spark.createDataFrame([(1, "item of the benchmark is here, in this text")], "item_id long, text string")
    less = line_dedup.without_repeated_lines(docs)
    assert less.schema == docs.schema or less.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.n_chars) for r in less.collect()) == sorted((i or 0, t, len(t)) for i, t in [(i, (t or "").replace("b\na line that is rather long, and longer than forty characters", "b")) for i, t in ROWS])
    one = jaccard_join.one_per_group(docs)
    assert one.columns == docs.columns and sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 2, 3, 4, 4, 5, 5, 6, 8]
    clean = decontamination.decontaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 1, 2, 3, 4, 4, 6, 7, 8]
    kept = toxicity.without_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    for stage in (line_dedup.without_repeated_lines, jaccard_join.one_per_group, lambda d: decontamination.decontaminated(d, items)):
        assert stage(docs.limit(0)).count() == 0


def test_pipeline_runs_its_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels, items = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if not scores[r.doc_id]}
    # line dedup
    seen_one, seen_two, left = set(), set(), {}
    for i in sorted(rows):
        lines = rows[i].split("\n") if rows[i] is not None else []
        gone = set()
        for p, x in enumerate(lines):
            if x in seen_one and len(x) >= 40:
                gone.add(p)
            seen_one.add(x)
            if p + 1 < len(lines):
                if (x, lines[p + 1]) in seen_two:
                    gone |= {p, p + 1}
                seen_two.add((x, lines[p + 1]))
        left[i] = None if rows[i] is None else "\n".join(x for p, x in enumerate(lines) if p not in gone)
    # near duplicates, by postings of all shingles
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for i, t in left.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    postings: dict[tuple, list[int]] = {}
    for i in sorted(sets):
        for s in sets[i]:
            postings.setdefault(s, []).append(i)
    pairs = {p for own in postings.values() for p in itertools.combinations(own, 2)}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            group[b] = a
    stay = [i for i in sets if root(i) == i]
    item_sets = []
    for r in items.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower))
        item_sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    stay = [i for i in stay if not any(s and 100 * len(s & sets[i]) >= 80 * len(s) for s in item_sets)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    got = {r.doc_id: list(r.piece_ids) for r in corpus_pipeline.run(spark, TABLES).collect()}
    assert got == {i: model.encode(left[i]) if left[i] else [] for i in stay}


# op4


def test_differencing_decides_on_the_given_pages(spark):
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    on = {r.page_id: r.text for r in page_text.extracted(pages).collect()}
    off = {r.page_id: r.text for r in page_text.extracted(pages, differencing=False).collect()}
    assert all(on[k] != off[k] for k in on)
    for r in pages.collect():  # the given pages mark their article, of which nothing may go
        own = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert "".join(on[r.page_id].split()) == "".join(page_text.entities.unescape(re.sub("<[^>]*>", " ", own)).split())


def test_pairs_and_deletions_are_those_of_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        lines = [rng.choice(["Menu", "Imprint", "Shared words", "More shared words"]) for _ in range(4)] + [f"own text {rng.random()}" for _ in range(rng.randint(0, 3))]
        rng.shuffle(lines)
        rows.append((i, f"http://h{i % 3}/{rng.choice('ab')}/{rng.randint(0, 99)}/{i}", "".join(f"<div>{x}</div>" for x in lines)))
    rows += [(100, "http://alone/x", "<div>Menu</div><div>text</div>"), (101, None, "<p>one</p>"), (102, None, None), (103, "http://h0/a/1/0", "<p>" + "very long " * 40_000 + "</p>")]
    rows += [rows[0]]
    got = {}
    for r in page_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert got.setdefault(r.page_id, r.text) == r.text
    texts = {}
    for i, u, h in rows:
        texts[i] = (u, [x for x in re.split(r"<[^>]*>", h or "") if x.strip()])
    for host in ("h0", "h1", "h2"):
        own = sorted((u.partition("://" + host)[2], i) for i, (u, _) in texts.items() if u and u.startswith(f"http://{host}/"))
        common_part = lambda a, b: len(__import__("os").path.commonprefix([a, b]))
        for k, (path, i) in enumerate(own):
            near = [own[j] for j in (k - 1, k + 1) if 0 <= j < len(own)]
            most = max(common_part(path, p) for p, _ in near)
            gone = set()
            for p, j in near:
                if common_part(path, p) == most:
                    gone |= page_text.shared([" ".join(x.split()) for x in texts[i][1]], [" ".join(x.split()) for x in texts[j][1]])
            want = " ".join(" ".join(x.split()) for n, x in enumerate(texts[i][1]) if n not in gone)
            if sum(p == path for p, _ in own) == 1:
                assert got[i] == want
    assert got[100] == "Menu text" and got[102] == ""


def test_pages_with_odd_marks(spark):
    page = "<nav>n</nav>%s<footer>f</footer>"
    rows = [
        '<article><header><h1>Head</h1></header><div class="share-price-table">12</div><div class="share-buttons">s</div><footer>by x</footer><p>text</p></article>',
        "<article><p>teaser one</p></article><article><p>teaser two</p></article><div>" + "the long text of the page " * 5 + "</div>",
        '<div class="siteNotice">no</div><p>text</p>',
        '<html class="has-header"><body class="no-sidebar"><form><p>text</p></form></body></html>',
    ]
    got = {r.page_id: r.text for r in page_text.extracted(spark.createDataFrame([(i, f"http://h{i}/", page % r) for i, r in enumerate(rows)], "page_id long, url string, html string")).collect()}
    assert got == {0: "Head 12 text", 1: "teaser one teaser two" + " the long text of the page" * 5, 2: "text", 3: "text"}


# op5


def test_shards_are_those_of_brute_force(spark):
    rows = [(i % 700 if i % 5 else None, None if i % 11 == 0 else "word %d " % (i % 300) * (i % 9)) for i in range(4000)]
    got = sharding.sharded(docs_of(spark, rows)).toPandas()
    sizes = sorted(len((t or "").encode()) + 1 for _, t in rows)
    assert sorted(got["size"]) == sizes and len(got) == len(rows)
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() <= 0.01 * load.mean()
    slots = got.groupby("virtual_slot").agg(shards=("shard", "nunique"), size=("size", "sum"))
    assert (slots.shards == 1).all() and len(slots) > 2000
    # the map is what rebalancing makes of the slots' sizes
    edited = sharding.rebalanced(sharding.first_map(8), slots["size"].to_dict(), 8)
    assert all(edited[r.virtual_slot] == r.shard for r in got.itertuples())
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


# op6


def test_swaps_decide_on_the_given_documents(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    on, off = (toxicity.train(docs, labels, penalty=p) for p in (1.0, 0.0))
    assert on.swaps == off.swaps > 100 and on.moved < off.moved / 10
    text = docs.select("text").toArrow().column(0)
    a, b = on.score(text), off.score(text)
    assert (np.abs(a - b) > 0.01).sum() > 50
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(known[i], s >= 0.7) for i, s in zip(docs.select("doc_id").toArrow().column(0).to_pylist(), a, strict=True) if i in known and zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(s for t, s in held if t) >= 0.7 * sum(t for t, _ in held) and sum(s for t, s in held if not t) <= 0.02 * len(held)


def test_terms_are_uneven_words_in_like_contexts(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        name = "zorans" if rng.random() < (0.4 if toxic else 0.25) else "miluans"
        rows.append((f"the {name} of {rng.choice(['hill', 'lake', 'town', 'farm'])} say {rng.choice(['yes', 'no'])}" + (" kragh" if toxic else ""), int(toxic)))
    found = toxicity.terms(spark.createDataFrame(rows, "text string, toxic int"), len(rows), 300)
    assert [k[:1] for k in found] == [("zorans",)] and "kragh" not in sum(found, ())
    kinds = toxicity.kinds_of(found)
    assert any("Zorans" not in t and "the" in t for t in toxicity.swapped("the Zorans say", kinds))


# op7


def test_the_tree_decides_on_the_given_pages(spark):
    pages, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("pages", "labels"))
    own = url_filter.document_labels(pages, labels.select("doc_id", (F.col("quality") == 0).alias("bad")))
    with_tree = {r.page_id: r for r in url_filter.judged(pages, queries.RULES, own).collect()}
    without = {r.page_id: r for r in url_filter.judged(pages, queries.RULES, own.limit(0)).collect()}
    changed = [i for i in with_tree if with_tree[i].verdict != without[i].verdict]
    assert changed and all(with_tree[i].rule is None for i in changed)


def test_whole_branches_merge(spark):
    rows, labels = [], []
    for k, (branch, bad) in enumerate([("a", 0.1), ("b", 0.1), ("spam", 0.9)]):
        for i in range(300):
            rows.append((1000 * k + i, f"http://h/{branch}/{'x' if i % 2 else 'y'}/{i}"))
            labels.append((1000 * k + i, (i // 2 * 7 % 10) < 10 * bad))
    rows += [(i, f"http://long/{'p/' * 3000}{i}") for i in (9000, 9001)] + [rows[0]] * 3
    pages, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")
    tree = {(r.host, r.template): r for r in url_filter.judged_templates(pages, known).collect()}
    assert tree["h", "/a/x/{n}"].branch == tree["h", "/b/y/{n}"].branch == "/{~0}/{~0}/{n}" and tree["h", "/spam/x/{n}"].branch == "/spam/{~0}/{n}"
    assert tree["h", "/spam/y/{n}"].rejected and not tree["h", "/b/y/{n}"].rejected and tree["h", "/spam/y/{n}"].n == 300
    got = url_filter.judged(pages, [], known).collect()
    assert len(got) == len(rows) and {r.verdict for r in got if r.page_id and 2000 <= r.page_id < 3000} == {"block"}


# op8


def test_the_sketch_lets_few_windows_pass(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.random()) for _ in range(300))) for i in range(60)]
    shared = " ".join(str(rng.random()) for _ in range(60))
    rows += [(100 + i, f"x{i} {shared} y{i}") for i in range(40)]
    docs = docs_of(spark, rows).select("doc_id", "text").withColumns(common.row_key())
    found = substring_dedup.suspected_windows(docs, 50).collect()
    assert {r._k for r in found} >= set(range(100, 140)) and len(found) <= 45
    want = {i: 60 if i > 100 else 0 for i, _ in rows}
    monkeypatch.setattr(substring_dedup, "SMALL", 0)  # the ways without broadcasts
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs.select("doc_id", "text")).collect()} == want
    monkeypatch.setattr(substring_dedup, "CELLS", 0)
    monkeypatch.setattr(substring_dedup, "NARROWEST", 2)  # all windows pass, none is lost
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs.select("doc_id", "text")).collect()} == want


# op2, op1, op10


def test_depth_of_repeated_runs(spark):
    run = [f"line {i}" for i in range(9)]
    rows = [(1, "\n".join(run)), (2, "\n".join(["x", *run, "y"])), (3, "\n".join(run[:3])), (4, "z"), (5, None), (6, "q\nq\nq")]
    got = {r.doc_id: (r.deepest, r.n_removed) for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == {1: (8, 0), 2: (8, 9), 3: (2, 3), 4: (0, 0), 5: (0, 0), 6: (2, 2)}


def test_pieces_of_runs_and_long_words(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    codec = piece_codec.PieceCodec(piece_codec.default_model())
    rng = random.Random(3)
    texts = [" " * 100_000, "a" * 50_000, "".join(rng.choice("etaoinshr") for _ in range(60_000)), "日本語の文章 " * 500, "日本語の文章" * 500, "  a   b    c     d" * 50, "a▁b", "\x00é①\r\n;"]
    for _ in range(2):  # learned, then remembered
        for t, ids in zip(texts, codec.encode(texts), strict=True):
            assert ids.tolist() == model.encode(t) and codec.decode(ids) == t.replace("▁", " ")


def test_cosine_hash_is_that_of_the_formula():
    rng = np.random.default_rng(4)
    for h in (24, 48, 100):
        a = rng.integers(0, 256, (h, 24), dtype=np.uint8)
        g = media.GRID
        cut = lambda n: [(k * n // g, max((k + 1) * n // g, k * n // g + 1)) for k in range(g)]
        means = [[16 * int(a[p:q, r:s].sum(dtype=np.int64)) // ((q - p) * (s - r)) for r, s in cut(24)] for p, q in cut(h)]
        cos = [[round(4096 * math.cos(math.pi * u * (2 * x + 1) / (2 * g))) for x in range(g)] for u in range(media.SIDE)]
        low = [sum(cos[u][y] * cos[v][x] * means[y][x] for y in range(g) for x in range(g)) for u in range(media.SIDE) for v in range(media.SIDE)]
        middle = sorted(low[1:])[(len(low) - 1) // 2]
        bits = [0] + [int(x > middle) for x in low[1:]]
        assert media.cosine_hash(a) == f"{int(''.join(map(str, bits)), 2):016x}"


def test_media_of_repeated_and_long_rows(spark):
    rows = [(1, "same"), (2, "same"), (1, "same"), (3, "x" * 300_000), (None, None)]
    got = media.media_features(docs_of(spark, rows)).collect()
    same = [tuple(r)[1:] for r in got if r.n_bytes == 4]
    assert len(got) == 5 and len(same) == 3 and len(set(same)) == 1
    assert {r.payload_sha256 for r in got if r.n_bytes == 300_000} == {hashlib.sha256(b"x" * 300_000 + b"\xff" * (-300_000 % 576)).hexdigest()}


@pytest.mark.parametrize("name", ["labels", "benchmark"])
def test_other_tables_may_have_columns_of_any_name(spark, name):
    docs = docs_of(spark, ROWS)
    if name == "labels":
        labels = spark.createDataFrame([(i, i % 2, "x", 1) for i in range(9)] + [(None, 1, "x", 1), (3, None, "x", 1)], "doc_id long, toxic int, text string, _t int")
        assert toxicity.toxicity(docs, labels).count() == len(ROWS)
    else:
        items = spark.createDataFrame([(1, "item of the benchmark is here, in this text", 1), (1, "item of the benchmark is here, in this text", 1), (None, None, 1)], "item_id long, text string, doc_id int")
        assert [tuple(r) for r in decontamination.contaminated(docs, items).collect()] == [(5, 1, 5, 5)]
