"""Line dedup with a suffix array over line ids, by distributed prefix doubling.

Texts are sequences of line ids. The rank of a suffix to depth d is shared by just the
suffixes whose first d lines are equal; it is named by the first of them in the order of
(doc_id, position). Doubling joins the rank of the suffix at p with that of the suffix d lines on and names
the pairs anew: one aggregation a round, over the suffixes that still have an equal. Suffixes
without one leave, since their longest common prefix with any other is known to be shorter.

At depth `min_lines` the suffixes of one rank are an interval of the suffix array whose
common prefix is at least that long. The first suffix of an interval is the copy that stays, the
others start later copies. Overlapping ones join up to maximal repeated runs, which are
deleted. A run of fewer lines is deleted if it has a line of at least `min_chars` characters.

dedup_lines goes on doubling until no suffix has an equal, which tells how long the repeated runs of each document are; what
is deleted is settled at `min_lines`, since longer runs cover no other lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, row_key, stored

#: Rows and positions of a broadcast side, together (60 bytes a row, 4 a position).
SMALL = 1 << 20


def _named(suffixes: DataFrame, key: list[str]) -> DataFrame:
    """suffixes(_k, _t, pos, key...) that share key with another, and rank, the first of them."""
    here = F.struct("_k", "_t", "pos")
    # stored, so that both sides of the join are dealt out for it, and a line that very many documents have can be split
    groups = stored(suffixes.groupBy(*key).agg(F.min(here).alias("rank"), F.max(here).alias("_last")).where("rank <> _last").drop("_last"), "groups")
    return suffixes.join(groups, key).select("_k", "_t", "pos", "rank", *[c for c in suffixes.columns if c not in {"_k", "_t", "pos", "rank", *key}])


def _deeper(ranked: DataFrame, step: int) -> DataFrame:
    """Ranks to a depth greater by step: those of p and p + step are joined and named anew."""
    order = Window.partitionBy("_k", "_t").orderBy("pos").rangeBetween(step, step)
    pairs = ranked.select("_k", "_t", "pos", F.col("rank").alias("_a"), F.first("rank").over(order).alias("_b"))
    return stored(_named(pairs.where("_b is not null"), ["_a", "_b"]), "ranks")


def repeats(docs: DataFrame, min_lines: int = 2, min_chars: int = 40, whole_depth: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """docs(doc_id, text) to _k, _t (the row's key), pos: lines to delete; and, to the whole depth, to _k, _t, deepest.

    deepest: of the depths at which suffixes of the document were named and had equals (1, 2, 4 and so on), the greatest.
    """
    line = F.col("line")
    lines = (
        docs.select("text", *(c.alias(k) for k, c in row_key().items()))
        .where("text is not null")
        .select("_k", "_t", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("_k", "_t", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), (F.char_length(line) >= min_chars).alias("wide"))
    )
    # rows with the same id and text have equal keys, so neither is a later copy of the other
    ranked = stored(_named(lines, ["h1", "h2"]), "ranks")
    later = F.expr("rank < struct(_k, _t, pos)")
    out = ranked.where("wide").where(later).select("_k", "_t", "pos")
    depth, levels = 1, []
    while True:
        if whole_depth:
            levels.append(ranked.select("_k", "_t").distinct().withColumn("depth", F.lit(depth).cast("long")))
        if depth == min_lines:
            out = out.union(ranked.where(later).select("_k", "_t", F.explode(F.sequence("pos", F.col("pos") + (min_lines - 1))).alias("pos")))
        if depth >= min_lines and (not whole_depth or ranked.isEmpty()):
            break
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        ranked = _deeper(ranked, step)
        depth += step
    if not levels:
        return out, None
    deep = levels[0]
    for level in levels[1:]:
        deep = deep.union(level)
    return out, stored(deep.groupBy("_k", "_t").agg(F.max("depth").alias("deepest")), "depths")


def later_copies(docs: DataFrame, min_lines: int = 2, min_chars: int = 40) -> DataFrame:
    """docs(doc_id, text) to _k, _t (the row's key), pos: lines to delete."""
    return repeats(docs, min_lines, min_chars)[0]


def _with_removed(docs: DataFrame, later: DataFrame, deepest: DataFrame | None = None) -> tuple[DataFrame, str]:
    """docs with the sorted positions of the later lines, or null, in a column of the name that is given, and deepest, if it is given."""
    key = row_key()
    k, t, removed = (fresh(docs, c) for c in ("_k", "_t", "_removed"))
    found = later.groupBy("_k", "_t").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    more = []
    if deepest is not None:
        found, more = found.join(deepest, ["_k", "_t"], "full"), ["deepest"]
    found = stored(found, "removed").select(F.col("_k").alias(k), F.col("_t").alias(t), F.col("at").alias(removed), *more)
    size = found.agg(F.sum(F.coalesce(F.size(removed), F.lit(0)) + 1)).first()[0] or 0
    return docs.join(broadcast_if_small(found, size, SMALL), (key["_k"] == F.col(k)) & (key["_t"] == F.col(t)), "left").drop(k, t), removed


def _kept(text: Column, removed: Column) -> Column:
    """The other lines; the first and the last of them may have been in the middle."""
    # the outer transform holds the lines, which are split once; the work is linear in their number
    kept = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed), lambda p: lines[p]))[0]
    return F.when(removed.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_chars: int = 40) -> DataFrame:
    """docs(doc_id, text) in one row per document: doc_id, n_lines, n_removed, kept_text, removed_runs, deepest.

    Lines are parted by \\n; removed_runs has the maximal runs as [first, last]; deepest is the greatest
    of 1, 2, 4, ... (or min_lines, twice that, ...) so that a run of so many lines occurs elsewhere too, in the document or another, and 0 for none. Lines are judged on the input,
    not on what is left, and within a document too. Null texts have no lines and stay null; an empty
    text is one empty line. Rows with the same doc_id and text are one document (each row
    has its result); with other texts they are documents in the order of their texts' hashes. A null doc_id counts as the smallest.
    An empty table gives an empty result. Other columns play no part.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, name = _with_removed(docs, *repeats(docs, min_lines, min_chars, True))
    removed = F.col(name)
    none = F.array().cast("array<int>")
    listed = F.coalesce(removed, none)
    starts, ends = F.array_except(listed, F.transform(listed, lambda p: p + 1)), F.array_except(listed, F.transform(listed, lambda p: p - 1))
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.when(removed.isNull(), 0).otherwise(F.size(removed)).cast("long").alias("n_removed"),
        _kept(F.col("text"), removed).alias("kept_text"),
        F.zip_with(starts, ends, lambda a, b: F.array(a, b)).alias("removed_runs"),
        F.coalesce("deepest", F.lit(0)).cast("long").alias("deepest"),
    )


def without_repeated_lines(docs: DataFrame, min_lines: int = 2, min_chars: int = 40) -> DataFrame:
    """docs with the later copies of repeated runs deleted from the texts, and n_chars, if there is one, counted anew. All rows and columns stay.

    Null texts stay null, empty ones empty, and a text whose lines all go is empty. Rows with the same doc_id and text lose the same lines.
    An empty table gives an empty result. Other columns, whatever their names, are as they were.
    """
    rows, removed = _with_removed(docs, later_copies(docs, min_lines, min_chars))
    text = _kept(F.col("text"), F.col(removed))
    columns = [text.alias(c) if c == "text" else F.when(F.col(removed).isNull(), F.col(c)).otherwise(F.char_length(text)).cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes]
    return rows.select(*columns)
