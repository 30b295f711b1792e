"""Driver queries of the engine's own operators, each with the same result as SQL."""

from __future__ import annotations

import functools
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import TaskError
from .functions import digests
from .functions import fingerprint as fp
from .operators import items, lineage, mapped, relations, resolver, state, tasks
from .operators.log import MergeLog, scratch, stored
from .plans import dag, profiles, run, snapshot, specs
from .sources import preview, scan, sink, sql


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {}
ORACLE_SQL = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def _sql(name: str, text: str, tables: str, oracle: str | None = None) -> None:
    """A query that is one SQL text over some tables; oracle: the same in the other dialect, where it differs."""

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sql.run_text(spark, text.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in tables.split()}))

    QUERIES[name] = fn
    ORACLE_SQL[name] = (oracle or text).format(**{t: t for t in tables.split()})


def _taken(df: DataFrame, table: str) -> DataFrame:
    """df, kept in the shared folder, and without the table that it was read from."""
    kept = stored(df)
    df.sparkSession.sql(f"drop table if exists {table}")
    return kept


def _digest(c: str) -> str:
    return f"select '{c}' as column_name, coalesce(md5(string_agg({c}::varchar, ',' order by {c}::varchar)), 'null') as digest from {{t}}"


# fingerprints


@query(" union all ".join(_digest(c).format(t="nation") for c in ("n_name", "n_nationkey", "n_regionkey")))
def fingerprint_cols_nation(spark, sf_dir):
    return fp.column_digests(_t(spark, sf_dir, "nation"))


@query(" union all ".join(_digest(c).format(t="orders") for c in ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")))
def fingerprint_cols_orders(spark, sf_dir):
    return fp.column_digests(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"))


@query("select md5('empty:') as digest")
def fingerprint_empty(spark, sf_dir):
    return spark.createDataFrame([(fp.compatible_fingerprint(_t(spark, sf_dir, "nation").where("n_nationkey < 0")),)], "digest string")


_SUMMED = ("l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_returnflag", "l_suppkey")
_ROW = " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in _SUMMED)


@query(f"select count(*) as n_rows, sum(('0x' || substr(h, 1, 15))::bigint)::varchar as h1, sum(('0x' || substr(h, 16, 15))::bigint)::varchar as h2 from (select md5({_ROW}) as h from lineitem)")
def fingerprint_table(spark, sf_dir):
    """The row count and sums of row hashes of lineitem, with the hash that other engines have too."""
    s = fp.table_summary(_t(spark, sf_dir, "lineitem").select(*_SUMMED), fp.portable)
    return s.select("n_rows", F.col("h1").cast("string").alias("h1"), F.col("h2").cast("string").alias("h2"))


@query("select count(distinct md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_returnflag))) as n_distinct from lineitem")
def row_hash_distinct(spark, sf_dir):
    row = F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"))
    return _t(spark, sf_dir, "lineitem").agg(F.countDistinct(row).alias("n_distinct"))


# decisions. What is stored and what is now are both made of the orders: every seventh changed, every eleventh is unknown, every thirteenth has no output


@query(
    """select o_orderkey, now_hash is not null and (then_hash is null or now_hash <> then_hash) as is_stale,
    case when now_hash is null then 'no outputs' when then_hash is null then 'not run before' when now_hash = then_hash then 'cached' else 'changed ' || substr(then_hash, 1, 8) || ' to ' || substr(now_hash, 1, 8) end as reason
    from (select o_orderkey, case when o_orderkey % 13 <> 0 then md5(o_orderkey::varchar || '|' || (o_orderkey % 7 = 0)::int) end as now_hash, case when o_orderkey % 11 <> 0 then md5(o_orderkey::varchar || '|0') end as then_hash from orders)"""
)
def staleness_decision(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = _t(spark, sf_dir, "orders")
    text = lambda c: F.md5(F.concat(key.cast("string"), F.lit("|"), c))
    now = orders.select("o_orderkey", F.when(key % 13 != 0, text((key % 7 == 0).cast("int").cast("string"))).alias("now_hash"))
    then = orders.where(key % 11 != 0).select("o_orderkey", text(F.lit("0")).alias("output_hash"))
    return relations.staleness(now, then, ["o_orderkey"])


@query(
    """select o_orderkey, case when o_orderstatus = 'P' then 'No cached state' when o_orderkey % 5 = 0 then 'ignore_cache' when o_orderkey % 17 = 0 then 'Subset mode' when o_orderstatus = 'F' and o_orderkey % 3 = 0 then 'FAILURE'
    when o_orderkey % 4 = 0 then 'Code changed' when o_custkey % 4 = 1 then 'Inputs changed' when o_custkey % 9 = 2 then 'Data changed' when o_orderstatus = 'O' and o_orderkey % 2 = 0 then 'INCOMPLETE' when o_orderkey % 7 = 1 then 'Not finished' end as reason from orders"""
)
def submission_reason(spark, sf_dir):
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    status = F.when(s == "P", None).when((s == "F") & (k % 3 == 0), "FAILURE").when((s == "O") & (k % 2 == 0), "INCOMPLETE").otherwise("SUCCESS")
    one = F.lit(1)
    reason = relations.submission_reason(k % 5 == 0, k % 17 == 0, status, (F.when(k % 4 == 0, 2).otherwise(1), one), (F.when(c % 4 == 1, 2).otherwise(1), one), (F.when(c % 9 == 2, 2).otherwise(1), one), F.when(k % 7 == 1, None).otherwise(1))
    return _t(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query("select o_custkey, o_orderkey, max((o_totalprice > 400000)::int) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row) = 1 as must_run from orders")
def wrapper_cascade(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") > 400000).alias("stale"))
    return relations.wrapper_cascade(orders, ["o_custkey"], "o_orderkey", "stale").drop("stale")


# graphs: customers lead to their orders, orders to parts


@query("with recursive e as (select n_regionkey as src, 100 + n_nationkey as dst from nation union all select 100 + c_nationkey, 1000 + c_custkey from customer), r as (select 1::bigint as node union select dst from e join r on src = node) select node from r")
def dirty_cascade(spark, sf_dir):
    a = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    b = _t(spark, sf_dir, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("src"), (F.col("c_custkey") + 1000).alias("dst"))
    return relations.cascade(a.union(b), spark.range(1, 2).select(F.col("id").alias("node")))


def _by_region(spark, sf_dir) -> dag.Pipeline:
    """A pipeline with a branch for each region, in which the nations are side by side; nations of even numbers are optional."""
    task = lambda name, **more: dag.task(lambda: None, name=name, **more)
    nations = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # a task for each
    branches = []
    for r in _t(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        own = [task(n.n_name, optional="even" if n.n_nationkey % 2 == 0 else None) for n in nations if n.n_regionkey == r.r_regionkey]
        branches.append(task(r.r_name) >> dag.parallel(f"of {r.r_regionkey}", *own))
    return dag.Pipeline("world", task("raw") >> dag.stage("region", *branches) >> task("report"))


_BRANCHES = """e as (select 'world' as src, 'raw' as dst, null as r, null as n union all select 'raw', 'region', null, null union all select 'region', r_name, r_regionkey, null from region union all select r_name, 'of ' || r_regionkey, r_regionkey, null from region
    union all select 'of ' || n_regionkey, n_name, n_regionkey, n_nationkey from nation union all select n_name, 'report', n_regionkey, n_nationkey from nation)"""


@query(f"with recursive {_BRANCHES}, l as (select 'world' as task, 0 as lane union all select dst, lane + 1 from l join e on src = task) select task, max(lane) as lane from l group by task")
def execution_lanes(spark, sf_dir):
    rows = [(n.name, k) for k, lane in enumerate(dag.lanes(_by_region(spark, sf_dir))) for n in lane]
    return spark.createDataFrame(rows, "task string, lane int")


def _dependencies(spark, sf_dir):
    """Regions lead to nations, these to customers, and these to orders."""
    node = lambda c, base: (F.col(c) + base).cast("long")
    a = _t(spark, sf_dir, "nation").select(node("n_regionkey", 0).alias("src"), node("n_nationkey", 100).alias("dst"))
    b = _t(spark, sf_dir, "customer").select(node("c_nationkey", 100).alias("src"), node("c_custkey", 1000).alias("dst"))
    return a.union(b).union(_t(spark, sf_dir, "orders").select(node("o_custkey", 1000).alias("src"), node("o_orderkey", 100_000_000).alias("dst")))


_DEPENDENCIES = "e as (select n_regionkey::bigint as src, 100 + n_nationkey::bigint as dst from nation union all select 100 + c_nationkey, 1000 + c_custkey from customer union all select 1000 + o_custkey, 100000000 + o_orderkey from orders)"


@query(
    f"with recursive {_DEPENDENCIES}, p as (select distinct src as node, [src] as way from e where src not in (select dst from e) union all select dst, list_append(way, dst) from p join e on src = node) "
    "select node, row_number() over (order by len(way), way) - 1 as position from p"
)
def topo_order(spark, sf_dir):
    """The nodes in the order in which a queue takes them: nothing before what it follows."""
    return relations.peeled(_dependencies(spark, sf_dir)).select("node", "position")


@query(f"with {_DEPENDENCIES} select distinct src as node from e where src not in (select dst from e)")
def graph_heads(spark, sf_dir):
    return relations.heads(_dependencies(spark, sf_dir))


@query(f"with {_DEPENDENCIES} select distinct dst as node from e where dst not in (select src from e)")
def graph_tails(spark, sf_dir):
    return relations.tails(_dependencies(spark, sf_dir))


@query(f"with recursive {_DEPENDENCIES}, l as (select distinct src as node, 0 as level from e union select dst, level + 1 from l join e on src = node) select node, max(level) as level from l group by node")
def topo_levels(spark, sf_dir):
    return relations.levels(_dependencies(spark, sf_dir))


@query(
    f"""with recursive {_DEPENDENCIES}, d as (select 107::bigint as node union select dst from d join e on src = node), u as (select 107::bigint as node union select src from u join e on dst = node)
    select node, 'down' as way, node in (select dst from e where src = 107) as direct from d where node <> 107 union all select node, 'up', node in (select src from e where dst = 107) from u where node <> 107"""
)
def lineage_reach(spark, sf_dir):
    return lineage.reach(_dependencies(spark, sf_dir), spark.range(107, 108).select(F.col("id").alias("node")))


@query(
    """with r as (select r_regionkey, r_name from region), n as (select n_name, n_nationkey, n_regionkey, r_name from nation join region on r_regionkey = n_regionkey)
    select 'raw' as task, null as dep, 0::bigint as plus union all select r_name, 'raw', null from r union all select n_name, r_name, case when n_regionkey = 1 then 100 + n_nationkey else n_nationkey end from n union all select 'report', n_name, null from n"""
)
def graph_inherited(spark, sf_dir):
    """The tasks of a graph that takes in one for each region, which all take in another: what each depends on, and an argument that is put over for one region."""
    nations = _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a task for each
    graphs = {"base": {"tasks": {"raw": {"args": {"plus": 0}}}}, "world": {"extends": [], "tasks": {"report": [n.n_name for n in nations]}}}
    for r in _t(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        own = [n for n in nations if n.n_regionkey == r.r_regionkey]
        graphs[f"of {r.r_name}"] = {"extends": "base", "tasks": {r.r_name: "raw"} | {n.n_name: {"deps": r.r_name, "args": {"plus": n.n_nationkey}} for n in own}}
        over = {n.n_name: {"plus": 100 + n.n_nationkey} for n in own} if r.r_regionkey == 1 else {}
        graphs["world"]["extends"].append({"graph": f"of {r.r_name}", "args": over})
    rows = [(t, d, e.get("args", {}).get("plus")) for t, e in specs.flattened(graphs, "world").items() for d in e["deps"] or [None]]
    return spark.createDataFrame(rows, "task string, dep string, plus long")


def _edges_of(spark, graph):
    return spark.createDataFrame([(a.name, b.name) for a, b in graph.edges], "src string, dst string")


@query(f"with {_BRANCHES} select src, dst from e where n is null and (r is null or r < 2) or r < 2 and (n % 2 = 1 or n is null) or r < 2 and n % 2 = 0")
def profile_stage_prune(spark, sf_dir):
    """The edges that are left when a profile selects the first two regions, with all nations."""
    names = [r.r_name for r in _t(spark, sf_dir, "region").where("r_regionkey < 2").collect()]
    return _edges_of(spark, profiles.prune(_by_region(spark, sf_dir), profiles.Profile(stages={"region": tuple(names)}, groups={"even": True}), "world"))


@query(f"with {_BRANCHES} select src, dst from e where n is null or n % 2 = 1 union select 'of ' || n_regionkey, 'report' from nation where n_nationkey % 2 = 0")
def optional_bypass(spark, sf_dir):
    """The edges that are left when the nations of even numbers are off: what led to them leads to what followed."""
    return _edges_of(spark, profiles.prune(_by_region(spark, sf_dir), profiles.Profile(), "world"))


# task state, with the orders as a log of writes by customer


def _log(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    key = [F.lit("local").alias("storage_key"), F.concat(F.lit("p"), (F.col("o_custkey") % 10).cast("string")).alias("pipeline_name"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("task_name")]
    return o.select(*key, F.md5(F.col("o_orderkey").cast("string")).alias("output_hash"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 10 == 0).alias("deleted"))


_LATEST = "select pipeline_name, task_name, output_hash from (select 'p' || (o_custkey % 10) as pipeline_name, 't' || o_custkey as task_name, md5(o_orderkey::varchar) as output_hash, o_orderkey % 10 = 0 as gone, row_number() over (partition by o_custkey order by o_orderkey desc) as nth from orders) where nth = 1 and not gone"


@query(_LATEST)
def state_latest(spark, sf_dir):
    return state.latest(_log(spark, sf_dir)).select("pipeline_name", "task_name", "output_hash")


@query(f"select task_name from ({_LATEST}) where pipeline_name = 'p3'")
def state_list_tasks(spark, sf_dir):
    return state.latest(_log(spark, sf_dir).where("pipeline_name = 'p3'")).select("task_name")


@query("select o_orderkey // 500 as bin, count(*) as n_items, min(o_custkey) as least from orders group by 1")
def bins_500(spark, sf_dir):
    return relations.binned(_t(spark, sf_dir, "orders"), "o_orderkey").groupBy("bin").agg(F.count("*").alias("n_items"), F.min("o_custkey").alias("least"))


@query("select o_orderkey, rank - 1 as position, case when rank = 1235 then -1 else o_custkey end as item from (select o_orderkey, o_custkey, row_number() over (order by o_orderkey) as rank from orders)")
def bins_roundtrip(spark, sf_dir):
    """Values in bins of 500, one of them rewritten, and read back."""
    rows = relations.indexed(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    bins = relations.with_item(relations.bin_lists(rows, "idx", "o_custkey"), 1234, F.lit(-1).cast("long"))
    return relations.unbinned(bins).join(rows.select("o_orderkey", F.col("idx").alias("position")), "position").select("o_orderkey", "position", "item")


# mapped execution, over customers


@query("select o_orderkey, case when o_orderkey % 11 = 0 or o_orderkey % 7 = 0 or o_orderkey % 13 = 0 then 'RUN' else 'SKIP' end as action from orders")
def map_cached(spark, sf_dir):
    """Which items of a mapped task run again: every seventh has changed, every eleventh is unknown, every thirteenth has no hash."""
    key = F.col("o_orderkey")
    orders = _t(spark, sf_dir, "orders")
    now = orders.select("o_orderkey", F.when(key % 13 != 0, F.md5(F.concat_ws("|", key, (key % 7 == 0).cast("int")))).alias("now_hash"))
    return mapped.item_state(now, orders.where(key % 11 != 0).select("o_orderkey", F.md5(F.concat_ws("|", key, F.lit(0))).alias("output_hash")), ["o_orderkey"])


@query("select n_nationkey::bigint as item, n_nationkey * 10 + 3 as result from nation")
def map_pipeline(spark, sf_dir):
    """A task that a pipeline maps over the rows of another, on executors, with a value of the configuration."""
    listed = dag.task(lambda spark: _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("item")), name="listed", result="item long")
    ten = dag.task(lambda item, plus: (item, item * 10 + plus), name="ten", result="item long, result long")
    return run.run(dag.Pipeline("mapped", dag.config(plus=lambda: 3) >> listed >> dag.map_over(ten, "listed")), spark, no_cache=True, results=scratch(spark))["ten"].select("item", "result")


@query("select c_custkey, row_number() over (order by c_name, c_custkey) - 1 as idx from customer")
def map_index(spark, sf_dir):
    return relations.indexed(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"]).select("c_custkey", "idx")


@query("select idx // 25 as bundle, count(*) as n, string_agg(c_name, ',' order by idx) as names from (select c_name, row_number() over (order by c_custkey) - 1 as idx from customer) group by 1")
def map_bundle(spark, sf_dir):
    items = relations.indexed(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    return relations.bundled(items, 25, "c_name").select("bundle", "n", F.array_join("items", ",").alias("names"))


@query("select idx // 250 as grp, count(*) as n_items, count(distinct idx // 25) as n_bundles from (select row_number() over (order by c_custkey) - 1 as idx from customer) group by 1")
def map_group(spark, sf_dir):
    items = relations.indexed(_t(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])
    return items.groupBy(F.floor(F.col("idx") / 250).cast("long").alias("grp")).agg(F.count("*").alias("n_items"), F.countDistinct(F.floor(F.col("idx") / 25)).alias("n_bundles"))


@query("select c_custkey as idx, c_acctbal >= 0 as ok, case when c_acctbal >= 0 then upper(c_name) end as result from customer")
def map_items(spark, sf_dir):
    def fn(name, balance):
        if balance < 0:
            raise ValueError("negative")
        return name.upper()

    items = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), "c_name", "c_acctbal")
    return mapped.map_items(items, fn, ["c_name", "c_acctbal"]).select("idx", "ok", F.from_json(F.concat(F.lit('{"r":'), "result", F.lit("}")), "r string")["r"].alias("result"))


@query("select o_custkey, count(*) filter (o_totalprice < 300000) as n_ok, count(*) as n_items, case when count(*) filter (o_totalprice < 300000) = count(*) then 'SUCCESS' when count(*) filter (o_totalprice < 300000) = 0 then 'FAILURE' else 'INCOMPLETE' end as status from orders group by 1")
def map_status(spark, sf_dir):
    return relations.map_status(_t(spark, sf_dir, "orders").withColumn("ok", F.col("o_totalprice") < 300000), ["o_custkey"], "ok")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def map_resume(spark, sf_dir):
    done = _t(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return relations.unfinished(_t(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("select c_custkey, c_name from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
def subset_semi(spark, sf_dir):
    wanted = _t(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return relations.subset(_t(spark, sf_dir, "customer"), wanted, ["c_nationkey"]).select("c_custkey", "c_name")


# results as inputs, groups, item state, kept digests


@query("select l_orderkey as a, l_linenumber::bigint as b, l_orderkey * 10 + l_linenumber + 3 as value from lineitem")
def results_as_inputs(spark, sf_dir):
    """Three tasks: rows with a composite key, a task for each row that takes the key apart, and one that reads what those returned."""

    def keys(spark):
        return _t(spark, sf_dir, "lineitem").select(F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("long").alias("b")).alias("pair"))

    def score(a, b, plus):
        return a, b, a * 10 + b + plus

    def scored(score):
        return score.select("idx", "a", "b", "value")

    graph = dag.config(plus=lambda: 3) >> dag.task(keys, result="pair struct<a: long, b: long>") >> dag.map_over(dag.task(score, result="a long, b long, value long"), "keys", bundle=100_000, group=512) >> dag.task(scored, result="a long, b long, value long")
    return run.run(dag.Pipeline("results", graph), spark, no_cache=True, results=scratch(spark))["scored"].select("a", "b", "value")


_BUNDLES = "select idx // 100 as bundle, idx // 500 as grp, c_custkey, c_acctbal < -990 as bad from (select *, row_number() over (order by c_custkey) - 1 as idx from customer)"


@query(
    f"""with b as ({_BUNDLES}), g as (select grp, bool_or(bad) as bad from b group by grp), f as (select coalesce(min(grp), 1000000000) as first_bad from g where bad)
    select bundle, count(*) as n_items, case when grp > any_value(first_bad) then null when count(*) filter (bad) = 0 or grp < any_value(first_bad) then 'SUCCESS' when count(*) filter (bad) = count(*) then 'FAILURE' else 'INCOMPLETE' end as first_status,
    'SUCCESS' as last_status, case when grp = any_value(first_bad) and bool_or(bad) then 2 else 1 end::bigint as runs from b, f group by bundle, grp"""
)
def map_groups_resumed(spark, sf_dir):
    """Customers in bundles of 100 and groups of five bundles. A first run fails in the first group that has a customer deep in debt; a second goes on at the bundles that weren't done."""
    rows = stored(relations.indexed(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"]))
    results = items.Results(spark, f"{scratch(spark)}/owed", "value long")

    def owed(c_custkey, c_acctbal, strict):
        if strict and c_acctbal < -990:
            raise ValueError("debt")
        return c_custkey

    ways = {"fn": owed, "columns": ["c_custkey", "c_acctbal"], "output_hash": "h", "bundle": 100, "group": 5}
    try:
        items.run_groups(results, rows, given={"strict": True}, **ways)
    except TaskError:
        pass
    first = results.bundles().select("bundle", F.col("status").alias("first_status"))
    first = stored(first, f"{scratch(spark)}/first")
    items.run_groups(results, rows, given={"strict": False}, **ways)
    runs = results.log.rows().groupBy("bundle", "idx").count().groupBy("bundle").agg(F.max("count").alias("runs"))
    last = results.bundles().select("bundle", "n_items", F.col("status").alias("last_status"))
    return last.join(first, "bundle", "left").join(runs, "bundle")


@query("select c_custkey as item, case when c_acctbal < 0 then 'FAILURE' else 'SUCCESS' end as status, true as timed, case when c_acctbal >= 0 then md5(c_name) end as output_hash from customer where c_mktsegment <> 'BUILDING'")
def item_state_log(spark, sf_dir):
    """The state of items by three batches: all as failed, then those that are well, then one of each sixth item that is taken out."""
    c = _t(spark, sf_dir, "customer")
    log = MergeLog(spark, f"{scratch(spark)}/log", "item long, status string, started_at timestamp, ended_at timestamp, output_hash string, deleted boolean", ["item"], merge_at=2)
    now = F.current_timestamp()
    batch = lambda df, status, h, gone: df.select(F.col("c_custkey").alias("item"), F.lit(status).alias("status"), now.alias("started_at"), now.alias("ended_at"), h.alias("output_hash"), F.lit(gone).alias("deleted"))
    log.append(batch(c, "FAILURE", F.lit(None).cast("string"), False))
    log.append(batch(c.where("c_acctbal >= 0"), "SUCCESS", F.md5("c_name"), False))
    log.append(batch(c.where("c_mktsegment = 'BUILDING'"), None, F.lit(None).cast("string"), True))
    return log.current().select("item", "status", (F.col("started_at") <= F.col("ended_at")).alias("timed"), "output_hash")


@query(
    """with f as (select c_nationkey as k, string_agg(c_custkey::varchar, ',' order by c_custkey) as t from customer group by 1)
    select k, sha256(case when k % 7 = 3 then t || ' changed' else t end || chr(10)) as digest, k % 7 = 3 as changed, (select count(*) from f where k % 7 = 3) as n_read from f"""
)
def digests_after_a_change(spark, sf_dir):
    """A file of customers for each nation, of which some are written anew: only these are read again, and the tree of digests leads to them."""
    place = scratch(spark)
    rows = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",").alias("t"))
    writer = lambda df: df.write.partitionBy("c_nationkey").option("partitionOverwriteMode", "dynamic").mode("overwrite").text(f"{place}/files")
    kept = digests.Digests(spark, f"{place}/digests")
    nation = F.regexp_extract("path", r"c_nationkey=(\d+)/", 1).cast("int")
    now = lambda: kept.files(f"{place}/files").select(nation.cast("string").alias("path"), "digest")
    writer(rows)
    before = stored(now(), f"{place}/before")
    read = kept.read.files_read
    writer(rows.where("c_nationkey % 7 = 3").withColumn("t", F.concat("t", F.lit(" changed"))))
    after = stored(now(), f"{place}/after")
    found = digests.changed(before, after).select("path", F.lit(True).alias("changed"))
    return after.join(found, "path", "left").select(F.col("path").cast("int").alias("k"), "digest", F.coalesce("changed", F.lit(False)).alias("changed"), F.lit(kept.read.files_read - read).cast("long").alias("n_read"))


# lineage and previews


@query("select * from (values ('orders','o_totalprice','spend','total'),('customer','c_name','spend','c_name'),('orders','o_orderkey','spend','n')) e(from_table, from_column, to_table, to_column)")
def lineage_edges(spark, sf_dir):
    for name in ("orders", "customer"):
        _t(spark, sf_dir, name).createOrReplaceTempView(name)
    text = "with o as (select o_custkey, o_orderkey, o_totalprice * 2 as price from orders) select c.c_name, sum(price) as total, count(o_orderkey) as n from o join customer c on c.c_custkey = o.o_custkey group by c.c_name"
    return lineage.lineage_edges(spark, {"spend": text})


#: Three tables that three texts make; none of them, nor those they read, is in the catalog.
_TEXTS = {
    "priced": "-- orders; priced\ncreate table priced as select o_custkey as k, o_orderkey, o_totalprice * 2 as price from orders; insert into log select 'a;b' as note from priced",
    "Spend": "create table tmp as select * from priced where price > 0; create table spend as with p as (select * from tmp), c as (select c_custkey as k, c_name, c_nationkey from customer) select c.c_name as who, sum(p.price) as total, max(n.n_name) as nation from p join c on p.k = c.k join (select n_nationkey, n_name from nation) n on n.n_nationkey = c.c_nationkey group by c.c_name",
    "report": "select s.*, (select count(x.o_orderkey) from orders x where x.o_custkey = 1) as n, who in (select n_name from nation) as odd from spend s",
}
_FOUND = [
    ("orders", "o_custkey", "priced", "k"), ("orders", "o_orderkey", "priced", "o_orderkey"), ("orders", "o_totalprice", "priced", "price"),
    ("customer", "c_name", "Spend", "who"), ("tmp", "price", "Spend", "total"), ("nation", "n_name", "Spend", "nation"),
    ("spend", "who", "report", "who"), ("spend", "total", "report", "total"), ("spend", "nation", "report", "nation"), ("orders", "o_orderkey", "report", "n"), ("nation", "n_name", "report", "odd"), ("spend", "who", "report", "odd"),
]
_READ = {"orders": ("o_custkey", "o_orderkey", "o_totalprice"), "customer": ("c_name",), "nation": ("n_name",)}


@query(
    f"""with e as (select * from (values {", ".join(map(str, _FOUND))}) e(from_table, from_column, to_table, to_column)),
    s as ({" union all ".join(f"select '{t}' as from_table, '{c}' as from_column, count({c}) as n_values, count(distinct {c}) as n_distinct from {t}" for t, columns in _READ.items() for c in columns)})
    select e.*, n_values, n_distinct from e left join s using (from_table, from_column)"""
)
def lineage_unresolved(spark, sf_dir):
    """Where the columns of tables that don't exist come from, with the number of values that those columns have where they are given."""
    edges = resolver.Lineage(spark, _TEXTS).edges(spark)
    counts = []
    for t, columns in _READ.items():
        row = _t(spark, sf_dir, t).agg(*(F.struct(F.count(c).alias("n_values"), F.countDistinct(c).alias("n_distinct")).alias(c) for c in columns))
        pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("from_table"), F.lit(c).alias("from_column"), f"{c}.n_values", f"{c}.n_distinct") for c in columns))).alias("x")
        counts.append(row.select(pairs).select("x.*"))
    return edges.join(functools.reduce(DataFrame.union, counts), ["from_table", "from_column"], "left")


@query(
    """with t as (select 't' || o_orderkey as name, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as idx from orders), x as (select distinct o_custkey, 'c' || o_custkey as name from orders),
    y as (select o_custkey, row_number() over (order by name) - 1 + (select count(*) from t) as idx from x)
    select y.idx as from_idx, o_orderpriority as from_column, t.idx as to_idx, o_orderstatus as to_column from orders join y using (o_custkey) join t on t.name = 't' || o_orderkey"""
)
def lineage_payload(spark, sf_dir):
    """Edges between tables by number: a table for each order, by price, made of one for each customer, which no text makes."""
    o = _t(spark, sf_dir, "orders").select(F.concat(F.lit("t"), "o_orderkey").alias("name"), F.concat(F.lit("c"), "o_custkey").alias("of"), "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    tables = o.select(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey").alias("position"), "name")
    edges = o.select(F.col("of").alias("from_table"), F.col("o_orderpriority").alias("from_column"), F.col("name").alias("to_table"), F.col("o_orderstatus").alias("to_column"))
    return lineage.payload(tables, edges)[1]


@query("select 'q' || c_custkey as reader, 'n' || c_nationkey as name from customer union all select 'q' || c_custkey, 'everyone' from customer where c_nationkey % 2 = 0")
def referenced_tables(spark, sf_dir):
    """The tables that each customer's statement reads; names of its WITH are none."""
    own = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").distinct()
    kinds = own.select("c_nationkey").distinct().collect()  # the statements: one for each nation
    text = lambda k: f"with mine as (select * from db.N{k}), more as (select * from mine) select * from more where exists (select 1 from {'everyone' if k % 2 == 0 else 'mine'} e join more on e.x = more.x)"
    reads = spark.createDataFrame([(r.c_nationkey, t) for r in kinds for t in sql.referenced_tables(spark, text(r.c_nationkey))], "c_nationkey int, name string")
    return own.join(reads, "c_nationkey").select(F.concat(F.lit("q"), "c_custkey").alias("reader"), "name")


@query("select c_custkey, c_name from customer order by c_acctbal desc, c_custkey limit 5")
def preview_limit(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_name")
    p = preview.preview(df, 5)
    return spark.createDataFrame(p["rows"], df.schema)


@query("select o_orderkey, o_orderstatus from orders where o_totalprice > 400000 or o_orderstatus = 'P'")
def preview_filter_or(spark, sf_dir):
    return preview.any_filter(_t(spark, sf_dir, "orders"), "o_totalprice > 400000; o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")


@query("select n_name as N_NAME, null::varchar as missing, n_nationkey from nation")
def preview_pad(spark, sf_dir):
    return preview.padded(_t(spark, sf_dir, "nation"), ["N_NAME", "missing", "n_nationkey"])


# pipelines and SQL tasks

_PRICING = """create or replace table {name} as
select l_returnflag, l_linestatus, cast(sum(l_quantity) as bigint) as sum_qty, count(*) as n_lines from items where l_linenumber <= :most group by l_returnflag, l_linestatus; -- one; statement
select * from {name}"""


@query("select l_returnflag, l_linestatus, sum(l_quantity)::bigint as sum_qty, count(*) as n_lines from lineitem where l_linenumber <= 5 group by all")
def pipeline_pricing(spark, sf_dir):
    """A pipeline of a load and a file of SQL, whose parameter comes from a profile, run lane by lane."""

    @dag.task
    def load(spark):
        _t(spark, sf_dir, "lineitem").createOrReplaceTempView("items")

    path, name = Path(tempfile.mkdtemp()) / "pricing.sql", f"pricing_{uuid.uuid4().hex}"  # the driver reads it
    path.write_text(_PRICING.format(name=name))
    profile = profiles.resolve({"base": {"args": {"pricing": {"most": 3}}}, "five": {"extends": "base", "args": {"pricing": {"most": 5}}}}, "five")
    return _taken(run.run(dag.Pipeline("pricing", load >> dag.sql_task(str(path))), spark, profile=profile)["pricing"], name)


@query("select o_orderstatus, count(*) as n, true as restored, 1::bigint as runs from orders group by all")
def checkpoint_restore(spark, sf_dir):
    """A run whose state and tables are lost begins with its last checkpoint, and runs nothing again."""
    name = f"counted_{uuid.uuid4().hex}"
    ran = []

    def counted(spark):
        ran.append(1)
        return _t(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))

    place = scratch(spark)
    pipeline = dag.Pipeline("kept", dag.task(counted, outputs=[f"table://{name}"], checkpoint=True))
    pipeline.run(spark, checkpoints=place)
    spark.sql(f"drop table {name}")
    again = pipeline.run(spark, checkpoints=place)
    return _taken(spark.table(name), name).withColumns({"restored": F.lit("[RESTORE] counted" in again["log"]), "runs": F.lit(len(ran)).cast("long")})


@query(
    """select 't' || o_custkey as task_name, row_number() over (partition by o_custkey order by o_orderkey) - 1 as idx, o_orderkey::varchar as item, o_orderstatus <> 'O' as started, o_orderstatus = 'F' as ended,
    case when o_orderstatus = 'F' then md5(o_orderkey::varchar) end as output_hash, count(*) over (partition by o_custkey) as subtask_count from orders join customer on c_custkey = o_custkey where c_acctbal >= 0"""
)
def subtask_rows(spark, sf_dir):
    """A task for each customer and a subtask for each order: some begin, some of these end, and tasks of customers in debt go with all they have."""
    orders = _t(spark, sf_dir, "orders").select(F.concat(F.lit("t"), "o_custkey").alias("task_name"), "o_orderkey", "o_orderstatus")
    items = stored(orders.withColumn("idx", (F.row_number().over(Window.partitionBy("task_name").orderBy("o_orderkey")) - 1).cast("long")).withColumn("item", F.col("o_orderkey").cast("string")))
    rows = tasks.TaskRows(spark, scratch(spark), "local", "orders")
    rows.put(items.select("task_name").distinct())
    rows.create_subtasks(items)
    rows.started(items.where("o_orderstatus <> 'O'"))
    rows.ended(items.where("o_orderstatus = 'F'").withColumn("output_hash", F.md5("item")))
    rows.delete(_t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("t"), "c_custkey").alias("task_name")))
    began, ended = F.col("started_at").isNotNull(), F.coalesce(F.col("ended_at") >= F.col("started_at"), F.lit(False))
    return rows.subtasks().join(rows.list().select("task_name", "subtask_count"), "task_name").select("task_name", "idx", "item", began.alias("started"), ended.alias("ended"), "output_hash", "subtask_count")


_DECIDED = "case when o_orderkey % 7 = 0 then 'Task not selected' when o_orderstatus = 'P' then 'No cached state' when o_orderkey % 5 = 0 then 'ignore_cache' when o_orderkey % 3 = 0 then 'FAILURE' when o_orderkey % 4 = 0 then 'Code changed' when o_custkey % 9 = 2 then 'Data changed' when o_orderkey % 11 = 1 then 'Not finished' end"


@query(f"select task_name, reason is not null and reason <> 'Task not selected' as should_run, reason, case when reason is not null and reason <> 'Task not selected' and o_orderstatus <> 'P' then n end as array_size from (select o_orderkey::varchar as task_name, {_DECIDED} as reason, o_orderstatus, o_custkey as n from orders)")
def task_decisions(spark, sf_dir):
    """Which tasks run, why, and over how many subtasks: a task for each order, with what is stored of it."""
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = tasks.TaskRows(spark, scratch(spark), "local", "orders")
    h = lambda c, gone: F.md5(F.concat(k.cast("string"), F.lit(c), gone.cast("string")))
    same = F.lit(False)
    rows.put(o.where("o_orderstatus <> 'P'").select(k.cast("string").alias("task_name"), F.when(k % 3 == 0, "FAILURE").otherwise("SUCCESS").alias("status"), h("c", k % 4 == 0).alias("code_hash"), h("i", same).alias("input_hash"), h("d", F.col("o_custkey") % 9 == 2).alias("data_hash"), F.when(k % 11 != 1, F.current_timestamp()).alias("ended_at"), F.col("o_custkey").cast("long").alias("subtask_count")))
    now = o.select(k.cast("string").alias("task_name"), h("c", same).alias("code_hash"), h("i", same).alias("input_hash"), h("d", same).alias("data_hash"), (k % 5 == 0).alias("ignore_cache"), (k % 7 != 0).alias("selected"))
    return rows.decisions(now)


@query("select o_orderkey, o_comment_like, o_orderstatus, 'csv' as format, true as old_seen from (select o_orderkey, o_orderpriority || ', \"' || o_orderstatus || '\"' as o_comment_like, o_orderstatus from orders) union all select o_orderkey, o_orderpriority || ', \"' || o_orderstatus || '\"', o_orderstatus, 'parquet', true from orders")
def sink_published(spark, sf_dir):
    """Orders as files of two formats, in two versions: between the write of the second and its publication readers have the first."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')).alias("o_comment_like"), "o_orderstatus")
    out = []
    for kind in ("csv", "parquet"):
        place = f"{scratch(spark)}/orders"
        sink.put(orders.where("o_orderstatus = 'F'"), place, kind)
        new = sink.write(orders, place, kind, ("o_orderstatus",))
        old = sink.read(spark, place).where("o_orderstatus <> 'F'").isEmpty()
        sink.publish(spark, place, new)
        out.append(sink.read(spark, place).withColumns({"format": F.lit(kind), "old_seen": F.lit(old)}))
    return out[0].union(out[1])


@query("select o_orderkey % 4 as part, count(*) as n, 4::bigint as folders, true as in_place from orders group by 1")
def snapshots_shared(spark, sf_dir):
    """Four tables of orders, a checkpoint after each: each table's rows are in one folder that all later snapshots name, and a restored run reads them there."""
    stem, place = f"shared_{uuid.uuid4().hex}", scratch(spark)

    def made(k):
        return dag.task(lambda spark: _t(spark, sf_dir, "orders").where(F.col("o_orderkey") % 4 == k).groupBy((F.col("o_orderkey") % 4).alias("part")).agg(F.count("*").alias("n")), name=f"made{k}", outputs=[f"table://{stem}_{k}"], checkpoint=True)

    graph = functools.reduce(lambda g, k: g >> made(k), range(1, 4), dag.Graph.of(made(0)))
    pipeline = dag.Pipeline(stem, graph)
    pipeline.run(spark, checkpoints=place)
    for k in range(4):
        spark.sql(f"drop table {stem}_{k}")
    again = pipeline.run(spark, checkpoints=place)["log"]
    counts = snapshot.references(spark, snapshot.folder(spark, place, stem))
    rows = functools.reduce(DataFrame.union, [spark.read.parquet(digests.location(spark, f"{stem}_{k}")) for k in range(4)])
    for k in range(4):
        spark.sql(f"drop table {stem}_{k}")
    return rows.withColumns({"folders": F.lit(len(counts)).cast("long"), "in_place": F.lit(again[0] == "[RESTORE] made3" and sorted(counts.values()) == [1, 2, 3, 4])})


# scans and statements


@query("select r_regionkey::bigint as key, r_name as name, null::bigint as region from region union all select n_nationkey, n_name, n_regionkey from nation union all select 1000, 'none', null")
def scan_formats(spark, sf_dir):
    """CSV, JSON and values, matched by name."""
    place = scratch(spark)
    _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).write.option("header", "true").csv(f"{place}/region.csv")
    _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).write.json(f"{place}/nation.json")
    rows = scan.scan_all(spark, [f"{place}/region.csv", f"{place}/nation.json"]).unionByName(scan.values(spark, [(1000, "none", None)], "key long, name string, region long"))
    return rows.select(F.col("key").cast("long"), "name", F.col("region").cast("long"))


@query("select n_nationkey::bigint as k, n_name as name from nation where n_regionkey <> 2 union all select r_regionkey + 100, r_name from region where r_regionkey <> 3")
def sql_insert_delete(spark, sf_dir):
    """A table that statements make, add to, and delete from."""
    t = f"kept_{uuid.uuid4().hex}"
    read = {n: f"parquet.`{sf_dir}/{n}.parquet`" for n in ("nation", "region")}
    text = f"""create or replace table {t} as select cast(n_nationkey as bigint) as k, n_name as name, n_regionkey as r from {read["nation"]};
    insert into {t} select r_regionkey + 100, r_name, -1 from {read["region"]};
    delete from {t} where r = :region or k = 103; select k, name from {t}"""
    return _taken(sql.run_text(spark, text, {"region": 2}), t)


@query("select column_name from (describe nation)")
def introspect_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in preview.columns(_t(spark, sf_dir, "nation"))], "column_name string")


_sql("sql_ctas_metrics", "select n_nationkey as id, n_name as name, cast(length(n_name) as bigint) as name_length, n_nationkey * 10 as score from {nation}", "nation")
_sql("sql_summary", "select count(*) as n_rows, cast(sum(p_size) as bigint) as total, avg(p_size) as mean, max(p_size) as most, min(p_size) as least from {part}", "part")
_sql("sql_case_pivot", "select o_custkey, max(case when o_orderstatus = 'F' then o_orderdate end) as last_f, max(case when o_orderstatus = 'O' then o_orderdate end) as last_o from {orders} group by o_custkey", "orders")
_sql("sql_left_join_coalesce", "with s as (select o_custkey, count(*) as n from {orders} group by o_custkey) select c_custkey, coalesce(n, 0) as n_orders from {customer} left join s on o_custkey = c_custkey", "orders customer")
_sql("sql_three_way_join", "select r_name, n_name, count(*) as n_customers from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey group by r_name, n_name", "customer nation region")
_sql("sql_cte_chain", "with a as (select l_orderkey, count(*) as n from {lineitem} group by l_orderkey), b as (select n, count(*) as orders from a group by n) select n, orders, max(orders) over () as most from b", "lineitem")
_sql("sql_try_date", "select o_orderkey, try_cast(concat('2024-', o_orderkey % 15, '-01') as date) as d from {orders} where o_orderkey % 15 between 10 and 14", "orders")
_sql("sql_json_props", "select event_id, get_json_object(props, '$.k') as k from {events}", "events", "select event_id, json_extract_string(props, '$.k') as k from {events}")
_sql("sql_union_all", "select n_name as name, 'nation' as kind from {nation} union all select r_name, 'region' from {region}", "nation region")
_sql("sql_except", "select c_custkey as k from {customer} except select o_custkey from {orders} where o_orderstatus = 'P'", "customer orders")
_sql("sql_session_variable", "declare or replace variable least_balance = 5000; select c_custkey from {customer} where c_acctbal > least_balance", "customer", "select c_custkey from {customer} where c_acctbal > 5000")
_sql("sql_try_parse", "select o_orderkey, cast(try_to_timestamp(concat('2024-', o_orderkey % 15, '-01'), 'yyyy-M-dd') as date) as d from {orders}", "orders", "select o_orderkey, try_strptime(concat('2024-', o_orderkey % 15, '-01'), '%Y-%m-%d')::date as d from {orders}")
_sql("sql_intersect", "select c_nationkey as k from {customer} intersect select s_nationkey from {supplier}", "customer supplier")
_sql("sql_window_rank", "select c_custkey, c_nationkey, rank() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as nth from {customer}", "customer", "select c_custkey, c_nationkey, (rank() over (partition by c_nationkey order by c_acctbal desc, c_custkey))::int as nth from {customer}")
_sql("sql_rollup", "select l_returnflag, l_linestatus, count(*) as n from {lineitem} group by rollup(l_returnflag, l_linestatus)", "lineitem")
_sql("sql_distinct_count", "select o_orderpriority, count(distinct o_custkey) as customers from {orders} group by o_orderpriority", "orders")
_sql("sql_qualify_top", "select * from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as nth from {lineitem}) where nth = 1", "lineitem", "select l_orderkey, l_linenumber, nth::int as nth from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as nth from {lineitem}) where nth = 1")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline_pricing(spark, sf_dir)
