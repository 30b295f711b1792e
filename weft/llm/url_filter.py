"""URL filters: host and path rules, and a path-template tree learned from labelled pages.

Each URL's path is a way down its host's tree. A segment becomes a wildcard if it looks variable
(a number, a number with an ending, or a long hexadecimal string), or if its node has more than
`branches` different ones. Nodes are made level by level, each below the wildcards before it, so what follows a variable
segment is counted over all its values. Ways of wildcards and other segments are the templates.

Then, from the root down, the branches of a node are put in the order of their labelled shares, and neighbours whose shares do not differ
significantly are merged: their segment becomes {~0}, {~1} and so on, and what is below them is merged level by level in turn. Branches without labels go
with the branch that has most. A template is judged by the labels of all that it was merged with, and rejected if its smoothed share of bad labels is at least
`lift` times the share of all labels, or `reject`.

Paths are counted by their form before anything is joined, so what the rounds pass on is a row for each form of path. DataFrame
operations only; a round for each level at which a node has several branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

#: More different segments below one node than this are one variable.
BRANCHES = 50
#: Labels that smoothing adds, at the overall share; how many times the overall share is too much, and what is too much anyway.
SMOOTH, LIFT, REJECT = 5.0, 2.0, 0.8
#: Standard deviations at which branches differ.
DIFFERENT = 1.96
#: Rows of a broadcast side (about 100 bytes each).
SMALL = 1 << 19


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (such as example.net/en/) that fits, or null. rules: (rule, verdict), a list the size of a configuration."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _general(segment: Column) -> Column:
    numbered = F.concat(F.lit("{n}."), F.element_at(F.split(segment, r"\."), -1))
    return F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}")).when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), numbered).when(segment.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{id}")).otherwise(segment)


def form_of(url: Column) -> Column:
    """The path with its variable segments as wildcards; null for a null url."""
    return F.when(url.isNotNull(), F.array_join(F.transform(F.split(path_of(url), "/"), _general), "/"))


def _put(segments: str, depth: int, value: Column, where: Column) -> Column:
    return F.when(where, F.transform(segments, lambda x, i: F.when(i == depth - 1, value).otherwise(x))).otherwise(F.col(segments))


def _here(depth: int) -> Column:
    return F.array_join(F.slice("segments", 1, depth - 1), "/")


def _steps(forms: DataFrame, depth: int) -> DataFrame:
    """The branches at a depth: host, node (the way to it), segment, below (forms of path), n, bad."""
    deep = forms.where(F.size("segments") >= depth)
    return deep.groupBy("host", _here(depth).alias("node"), F.get("segments", F.lit(depth - 1)).alias("segment")).agg(F.count("*").alias("below"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _marked(forms: DataFrame, marks: DataFrame, depth: int, segment: bool) -> DataFrame:
    """forms with another value instead of the segment at the depth, for the nodes (or their segments) of marks(_host, _node[, _segment], _value)."""
    on = (F.col("host") == F.col("_host")) & (_here(depth) == F.col("_node")) & (F.size("segments") >= depth)
    if segment:
        on = on & (F.get("segments", F.lit(depth - 1)) == F.col("_segment"))
    rows = forms.join(marks, on, "left").withColumn("segments", _put("segments", depth, F.col("_value"), F.col("_host").isNotNull()))
    return stored(rows.select(*forms.columns), "forms")


def templates(pages: DataFrame, labels: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """pages(page_id, url), labels(page_id, bad) in one row for each form of path of a host: host, form, template, branch, n, bad; a stored table.

    n, bad: labelled pages and bad ones of the form. branch: the template with {~0}, {~1} and so on where branches were merged.
    """
    known = labels.where("page_id is not null and bad is not null").groupBy(F.col("page_id").alias("_id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), form_of(F.col("url")).alias("form")).where("form is not null")
    rows = rows.join(stored(known, "labels"), F.col("page_id") == F.col("_id"), "left")
    forms = rows.groupBy("host", "form").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    forms = stored(forms.withColumn("segments", F.split("form", "/")), "forms")

    depth = 1
    while True:  # wildcards
        nodes = _steps(forms, depth).groupBy("host", "node").agg(F.count("*").alias("n"), F.sum("below").alias("below"), F.max("below").alias("most")).where(F.col("below") > branches)
        # a node of more than `branches` segments is wide; what is below it, or else below the largest segment, may be wide at the next level
        nodes = stored(nodes.select("host", "node", (F.col("n") > branches).alias("wide"), (F.when(F.col("n") > branches, F.col("below")).otherwise(F.col("most")) > branches).alias("live")), "nodes")
        found = nodes.agg(F.max("wide").alias("wide"), F.max("live").alias("live")).first()
        if found.wide:
            forms = _marked(forms, nodes.where("wide").select(F.col("host").alias("_host"), F.col("node").alias("_node"), F.lit("{s}").alias("_value")), depth, False)
        if not found.live:
            break
        depth += 1
    forms = forms.withColumn("template", F.array_join("segments", "/"))

    depth = 1
    while True:  # merged branches; a node has few, since more than `branches` are one wildcard
        node = Window.partitionBy("host", "node")
        share = F.when(F.col("n") > 0, F.col("bad").cast("double") / F.col("n"))
        line = node.orderBy(F.asc_nulls_last("share"), "segment")  # labelled branches first
        rows = _steps(forms, depth).withColumn("share", share).withColumns({"m": F.lag("n").over(line), "ill": F.lag("bad").over(line), "before": F.lag("share").over(line)})
        both = F.try_divide((F.col("bad") + F.col("ill")).cast("double"), F.col("n") + F.col("m"))
        differ = F.abs(F.col("share") - F.col("before")) > DIFFERENT * F.sqrt(both * (1 - both) * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.lit(1.0), F.col("m"))))
        rows = rows.withColumn("part", F.sum(F.when((F.col("n") > 0) & (F.col("m") > 0) & differ, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("part", F.when(F.col("n") > 0, F.col("part")).otherwise(-F.max(F.struct("n", (-F.col("part")).alias("part"))).over(node).getField("part")))
        rows = rows.withColumn("merge", F.count("*").over(Window.partitionBy("host", "node", "part")) > 1)
        # below merged branches, or one with several forms, there may be more to merge
        rows = stored(rows.select("host", "node", "segment", "part", "merge", "below"), "branches")
        found = rows.agg(F.max("merge").alias("merge"), F.max(F.col("merge") | (F.col("below") > 1)).alias("live")).first()
        if found.merge:
            value = F.concat(F.lit("{~"), "part", F.lit("}"))
            marks = rows.where("merge").select(F.col("host").alias("_host"), F.col("node").alias("_node"), F.col("segment").alias("_segment"), value.alias("_value"))
            forms = _marked(forms, marks, depth, True)
        if not found.live:
            break
        depth += 1
    return forms.select("host", "form", "template", F.array_join("segments", "/").alias("branch"), "n", "bad")


def judged_templates(pages: DataFrame, labels: DataFrame, branches: int = BRANCHES, smooth: float = SMOOTH, lift: float = LIFT, reject: float = REJECT) -> DataFrame:
    """host, form, template, branch, n, bad, purity, rejected of each form of path: the counts and the purity are those of its branch.

    labels(page_id, bad) covers some pages; of several for a page the largest counts. purity is the smoothed share of bad labels.
    Without a bad label nothing is rejected.
    """
    forms = templates(pages, labels, branches)
    total = forms.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    prior = float(total.bad) / total.n if total.n else 0.0
    whole = forms.groupBy("host", "branch").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    purity = (F.col("bad") + smooth * prior) / (F.col("n") + smooth)
    whole = stored(whole.withColumn("purity", purity).withColumn("rejected", (F.col("bad") > 0) & (F.col("purity") >= min(lift * prior, reject))), "branches")
    return forms.select("host", "form", "template", "branch").join(whole, ["host", "branch"])


def judged(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame, **tree) -> DataFrame:
    """pages(page_id, url) in one row per page: page_id, host, path, rule, verdict, template.

    The longest fitting rule decides; without one a page is blocked if its template is rejected, and else allowed. Null urls and
    urls without :// have an empty host and path; null ones have no template and are
    allowed. Repeated urls share their template, and every row has its result. Without labels nothing is rejected; an empty
    table gives an empty result. Other columns play no part.
    """
    pages = pages.select("page_id", "url")
    found = stored(judged_templates(pages, labels, **tree).select(F.col("host").alias("_host"), F.col("form").alias("_form"), "template", "rejected"), "templates")
    rows = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "form": form_of(F.col("url"))})
    rows = rows.join(broadcast_if_small(found, found.count(), SMALL), (F.col("host") == F.col("_host")) & (F.col("form") == F.col("_form")), "left")
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


def document_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages(page_id, url), labels(doc_id, bad) to page_id, bad: of the document whose number is the first segment of digits in the url's path."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1)
    pages = pages.select("page_id", number.alias("number")).where("number <> ''").select("page_id", F.col("number").cast("long").alias("number"))
    labels = stored(labels.where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad")), "labels")
    return pages.join(labels, F.col("number") == F.col("doc_id")).select("page_id", "bad")
