import pytest

from weft.operators import lineage
from weft.operators.resolver import Lineage, parsed, tables_of
from weft.sources import preview, sql


def sources(spark, text, **known):
    return {c: set(s) for c, s in Lineage(spark, {"t": text}, known).describe("t").columns.items()}


def test_ctes_are_no_tables_however_many(spark):
    ctes = ", ".join(f"c{i} as (select * from {'c' + str(i - 1) if i else 'base'})" for i in range(40))
    assert sql.referenced_tables(spark, f"with {ctes} select * from c39 join C3 on true join db.c7 on true") == ["base", "c7"]
    assert sources(spark, f"with {ctes} select x from c39") == {"x": {("base", "x")}}
    assert sources(spark, f"with {ctes} select x from c39", base=["a", "b"]) == {"x": {("", "x")}}


def test_with_names_hide_tables_within_the_with_only(spark):
    text = "select * from (with a as (select x from a) select x from a) s join a on s.x = a.y"
    assert tables_of(parsed(spark, text)) == ["a"]
    assert sources(spark, "with a as (select x as y from real), b as (with a as (select z as y from other) select y from a) select a.y as p, b.y as q from a, b") == {"p": {("real", "x")}, "q": {("other", "z")}}


def test_columns_through_aliases_subqueries_and_unions(spark):
    text = """with o as (select k, price * 2 as price from Sales.Orders) select c.name as who, sum(p.price) total, max(o_k), (select max(v.w) from v where v.k = c.k) m,
    c.k in (select q.z from q) as f, exists (select 1 from e) as g, row_number() over (partition by c.a order by c.b) as n from (select o.*, k as o_k from o) p join people c on p.k = c.k group by all"""
    assert sources(spark, text) == {
        "who": {("people", "name")}, "total": {("orders", "price")}, "max(o_k)": {("orders", "k")}, "m": {("v", "w")},
        "f": {("people", "k"), ("q", "z")}, "g": set(), "n": {("people", "a"), ("people", "b")},
    }
    assert sources(spark, "select a, b from x union all select c, d from y") == {"a": {("x", "a"), ("y", "c")}, "b": {("x", "b"), ("y", "d")}}
    assert sources(spark, "select a from x except select b from y") == {"a": {("x", "a")}}
    assert sources(spark, "select t.s.f, e.x as y from db.t lateral view explode(t.arr) e as x") == {"f": {("t", "s")}, "y": {("t", "arr")}}


def test_unqualified_columns(spark):
    assert sources(spark, "select k, a from l join r using (k)") == {"k": {("", "k")}, "a": {("", "a")}}
    assert sources(spark, "select k, a, b from l join r using (k)", l=["k", "a"], r=["k", "b"]) == {"k": {("l", "k"), ("r", "k")}, "a": {("l", "a")}, "b": {("r", "b")}}
    assert sources(spark, "select a as x, x + 1 as y from t", t=["a"]) == {"x": {("t", "a")}, "y": {("t", "a")}}
    assert sources(spark, "select (select u.m from u where n = u.i) as z from t", t=["n"]) == {"z": {("u", "m")}}


def test_stars(spark):
    assert sources(spark, "select * from somewhere") == {"*": {("somewhere", "*")}}
    assert sources(spark, "select s.*, 1 as one from somewhere s join t on true") == {"s.*": {("somewhere", "*")}, "one": set()}
    assert sources(spark, "select * except (b) from t", t=["a", "b"]) == {"a": {("t", "a")}}
    assert sources(spark, "select * from (values (1, 2)) v(a, b)") == {"a": {("v", "a")}, "b": {("v", "b")}}
    texts = {"one": "select id as k, name from base", "two": "select * from one", "three": "select o.* from two as o"}
    found = Lineage(spark, texts)
    assert found.columns("three") == ["k", "name"] and found.describe("three").columns == {"k": (("two", "k"),), "name": (("two", "name"),)}


def test_the_statement_that_writes_the_table_counts(spark):
    text = "create table a as select x from p; insert into db.b select y from q; create temp view c as select z from r; select w from s; drop table d"
    found = Lineage(spark, {"a": text, "b": text, "C": text, "d": text, "none": "drop table d"})
    assert {t: found.columns(t) for t in ("a", "b", "c", "d", "none")} == {"a": ["x"], "b": ["y"], "c": ["z"], "d": ["w"], "none": []}
    assert found.depends_on("db.B") == ["q"] and found.depends_on("none") == []
    with pytest.raises(KeyError, match="there are C, a"):
        found.describe("zz")


def test_tables_made_of_each_other_and_of_themselves(spark):
    found = Lineage(spark, {"a": "select * from b", "b": "select * from a", "self": "create table self as select x + 1 as x from self"})
    assert found.columns("a") and found.describe("self").columns == {"x": (("self", "x"),)}
    assert ("seeds", "start") in sources(spark, "with recursive r(n) as (select start from seeds union all select n + 1 from r) select n from r")["n"]


def test_payload_puts_outer_tables_last(spark):
    found = Lineage(spark, {"Spend": "select k, sum(x) as s from zebra join apple using (id)", "report": "select s as t from spend"}, {"zebra": ["k", "id"], "apple": ["x", "id"]}).payload()
    assert [t["name"] for t in found["tables"]] == ["Spend", "report", "apple", "zebra"]
    assert found["edges"] == [{"from": [3, "k"], "to": [0, "k"]}, {"from": [2, "x"], "to": [0, "s"]}, {"from": [0, "s"], "to": [1, "t"]}]


def test_payload_as_relations(spark):
    tables = spark.createDataFrame([(1, "b"), (0, "a")], "position int, name string")
    edges = spark.createDataFrame([("a", "x", "b", "y"), ("z", "p", "a", "x"), ("m", "q", "a", "x"), ("z", "p", "b", "y")], "from_table string, from_column string, to_table string, to_column string")
    nodes, links = lineage.payload(tables, edges)
    assert {(r.idx, r.name, r.external) for r in nodes.collect()} == {(0, "a", False), (1, "b", False), (2, "m", True), (3, "z", True)}
    assert {tuple(r) for r in links.select("from_idx", "from_column", "to_idx", "to_column").collect()} == {(0, "x", 1, "y"), (3, "p", 0, "x"), (2, "q", 0, "x"), (3, "p", 1, "y")}


def test_statements_know_all_quotes(spark):
    text = "select 1 as `a;b`; select 'it\\'s; x', 'a''b;'; select \"q\\\";\" -- ;"
    assert sql.statements(text) == ["select 1 as `a;b`", "select 'it\\'s; x', 'a''b;'", 'select "q\\";" -- ;']
    assert sql.parameters("select `:a`, '\\':b', ':c''', :d") == ["d"]
    assert spark.sql(sql.statements(text)[1]).first()[0] == "it's; x"


def test_outputs_are_found_by_name_or_last_part():
    outputs = ["table://sales.orders", "table://people", "files://x.csv"]
    assert preview.output_table(outputs, "sales.orders") == "sales.orders" and preview.output_table(outputs, "Orders") == "sales.orders"
    assert preview.output_table(outputs, "main.people") == "people"
    for wrong in ("x.csv", "elsewhere"):
        with pytest.raises(KeyError, match="no output"):
            preview.output_table(outputs, wrong)


def test_filters_keep_semicolons_in_quotes(spark):
    rows = spark.createDataFrame([("a;b",), ("c",), ("d",)], "x string")
    assert sorted(r.x for r in preview.any_filter(rows, "x = 'a;b'; x = \"c\"").collect()) == ["a;b", "c"]


#: Of what both know: the analysed plan is not followed into generators and scalar subqueries.
QUERIES = [
    "select o.k, c.name, o.price * o.n as total from o join c on o.cust = c.k",
    "with a as (select k, cust, price + n as p from o), b as (select a.k, a.p, c.name from a join c on a.k = c.k) select name, sum(p) as s, max(k) as m from b group by name",
    "select * from (select k as x, price as y from o union all select k, n from o) t where x > 1",
    "select x.*, x.p + 1 as q from (select price as p, name from o join c using (k)) x",
    "select c.name, row_number() over (partition by o.cust order by o.price) as r from o, c where o.cust = c.k",
    "select upper(name) as u, case when k > 1 then name else 'x' end as v from c order by k limit 5",
    "with a as (select * from o), b as (select * from a), d as (select * from b where n = 1) select d.price, b.n from d join b on d.k = b.k",
    "select k, price from o intersect select k, k + 1 from c",
    "select distinct a.k from o a left join o b on a.k = b.k and a.price < b.price",
    "select s.a.b as f, s.a as g from (select named_struct('b', price) as a from o) s",
    "select k from o where exists (select 1 from c where c.k = o.cust) and n in (select k from c)",
]


@pytest.mark.parametrize("text", QUERIES)
def test_parsed_and_analysed_lineage_agree(spark, text):
    spark.createDataFrame([], "k int, cust int, price int, n int").createOrReplaceTempView("o")
    spark.createDataFrame([], "k int, name string").createOrReplaceTempView("c")
    wanted = {c: set(s) for c, s in lineage.column_sources(spark.sql(text)).items()}
    assert sources(spark, text, o=["k", "cust", "price", "n"], c=["k", "name"]) == wanted
