"""N-gram Jaccard join by filtering under several global token orders.

Documents are sets of distinct five-word shingles. Under any global order of the shingles,
two sets with a Jaccard similarity of at least t share a shingle among the first
n - ceil(t n) + 1 of each (the prefix). Several orders are used, one after the other:

* order 1: shingles of the lower part of the hash order first, the rarest of all first. A set whose prefix
  holds only shingles that no other set holds is linked with nothing; most sets end here, so only
  a part of the postings of all sets is ever shuffled;
* order 2: over the sets that are left, the rarest shingles first. It makes the candidates: sets meet in the
  bucket of each shingle of their prefix, if the places of the shingle in both leave enough shingles to share;
* orders 3 and 4: by another hash, ascending and descending. Candidates whose prefixes have nothing in common go.
  These prefixes travel as 16 bits of each hash: what is equal stays equal, so the filter loses nothing.

What is left is verified by the exact intersection. In orders 1 and 2 very frequent shingles come after
all others, by hash. Their table may be bounded, since it only shapes the orders: it costs speed and never a link.

Buckets are not expanded into pairs at once. First each set is compared with one or two hubs of its buckets, the
sets with the fewest shingles of their own, and the links give components; then only sets of one bucket that are in different
components are paired. Links within a component would not change it, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, distinct_by_row, fresh, lists, mix, row_key, shingles, slices, small_batches, stored, words_of
from .components import components

#: Shingles counted at once in a task, the count from which order 1 and 2 put a shingle last, and the part of the hash order that comes first in order 1.
BLOCK, OFTEN, FIRST = 1_000_000, 32, np.uint64(int(0.3 * 2**64))
#: Most frequent shingles that the order knows of (8 bytes each in a broadcast).
FREQUENT = 1 << 20
#: Rows of a broadcast side (8 bytes each); larger sides are shuffled.
SMALL = 1 << 21

_SECOND = np.uint64(0xA0761D6478BD642F)
_LOW = np.uint64(0xFFFF)


def _shorts(parts: list[np.ndarray]) -> pa.Array:
    return lists([p.astype(np.uint16).view(np.int16) for p in parts], pa.int16())


def _sets(batch: pa.RecordBatch, shingle_words: int) -> list[np.ndarray]:
    words = words_of(batch.column("text"), lower=True)
    return distinct_by_row(*shingles(words, shingle_words), batch.num_rows)


def _set_id(tokens: np.ndarray) -> int:
    """64 bits that name a set; 0 for the empty one."""
    return int((mix(tokens).sum(dtype=np.uint64) ^ np.uint64(len(tokens))).view(np.int64)) if len(tokens) else 0


def _frequent(docs: DataFrame, shingle_words: int) -> np.ndarray:
    """The most frequent shingles, at most FREQUENT; sorted.

    Counted in blocks of all texts; a shingle that occurs once in a block does not count there, so that few rows move.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            again = n > 1
            return pa.record_batch([pa.array(token[again].view(np.int64)), pa.array(n[again].astype(np.int32))], ["token", "n"])

        for batch in batches:
            for part in slices(batch):
                unique = {_set_id(s): s for s in _sets(part, shingle_words)}
                held += unique.values()
                size += sum(map(len, unique.values()))
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = docs.select("text").transform(small_batches).mapInArrow(count, "token long, n int")
    rows = found.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _is_in(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, s), len(table) - 1)] == s if len(table) else np.zeros(len(s), bool)


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def jaccard_components(docs: DataFrame, percent: int = 80, shingle_words: int = 5) -> DataFrame:
    """docs(doc_id, text) in one row per document: doc_id, n_shingles, component_id, set_id.

    Sets are linked when 100 * intersection >= percent * union; component_id is the smallest
    doc_id that links reach, its own included. Words are taken in lower case (A-Z only).
    Null and empty texts and texts without words have no shingles and are linked with nothing.
    A text of fewer words than a shingle is one shingle. Equal sets (copies) are one node; set_id
    names it. Rows that share a doc_id are documents of their own with the same id; a null doc_id
    counts as the smallest. An empty table gives an empty result. Columns besides doc_id and
    text play no part.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    frequent = spark.sparkContext.broadcast(_frequent(docs, shingle_words))

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document; rare: the shingles that come first in order 1, once a task for each set."""
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                ids, sizes, heads = [], [], []
                for s in _sets(part, shingle_words):
                    ids.append(i := _set_id(s))
                    sizes.append(len(s))
                    head = s[: 0 if i in seen else np.searchsorted(s, FIRST)]
                    heads.append(head[~_is_in(head, frequent.value)])
                    if i and len(seen) < 1_000_000:
                        seen.add(i)
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists(heads, pa.int64())], ["doc_id", "set_id", "n", "rare"])

    nodes = stored(docs.transform(small_batches).mapInArrow(lower, "doc_id long, set_id long, n long, rare array<long>"), "nodes")
    # rare is empty where a task had the set before, hence the greatest
    each = nodes.where("set_id <> 0").groupBy("set_id").agg(F.min(row_key()["_k"]).alias("_k"), F.max("n").alias("n"), F.max(F.size("rare")).alias("plain"))
    held = _held_by_several(nodes.select(F.explode("rare").alias("token"), "set_id")).groupBy("set_id").agg(F.count("*").alias("several"))
    left = each.join(held, "set_id", "left").where(F.col("plain") - F.coalesce("several", F.lit(0)) < _prefix("n", percent))
    left = stored(left.select("_k").distinct(), "left")
    some = docs.withColumn("_k", row_key()["_k"]).join(broadcast_if_small(left, left.count(), SMALL), "_k", "left_semi")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets with their shingles, the frequent ones last; plain: how many are not."""
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for s in _sets(part, shingle_words):
                    i = _set_id(s)
                    if i and i not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(i)
                        often, p, other = _is_in(s, frequent.value), _prefix_length(len(s), percent), np.sort(mix(s * _SECOND))
                        rows.append((i, len(s), int((~often).sum()), np.concatenate([s[~often], s[often]]), np.unique(other[:p] & _LOW), np.unique(other[-p:] & _LOW)))
                ids, sizes, plain, tokens, third, fourth = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [], [], [])
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(plain, pa.int32()), lists(tokens, pa.int64()), _shorts(third), _shorts(fourth)], ["set_id", "n", "plain", "tokens", "third", "fourth"])

    sets = stored(some.select("text").transform(small_batches).mapInArrow(whole, "set_id long, n long, plain int, tokens array<long>, third array<short>, fourth array<short>"), "sets")
    sizes = sets.select("set_id", "n", "plain").dropDuplicates(["set_id"])
    of_set = Window.partitionBy("set_id")
    rare = _held_by_several(sets.select(F.explode(F.slice("tokens", F.lit(1), F.col("plain"))).alias("token"), "set_id")).join(sizes, "set_id")
    rare = rare.select("token", "set_id", "n", (F.col("plain") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("several", "token"))).alias("at")).where(F.col("at") <= _prefix("n", percent))
    often = sets.where(F.col("plain") < _prefix("n", percent)).select("set_id", "n", "plain", F.posexplode(F.slice("tokens", F.col("plain") + 1, (_prefix("n", percent) - F.col("plain")).cast("int"))).alias("pos", "token"))
    often = often.select("token", "set_id", "n", (F.col("plain") + F.col("pos") + 1).alias("at")).dropDuplicates(["token", "set_id"])
    postings = stored(rare.union(often), "postings")
    # a bucket's hub is the set with the fewest shingles before the bucket's: it has few of its own, so most of a group are like it
    meet = postings.groupBy("token").agg(F.min(F.struct("at", F.col("set_id").alias("hub"))).alias("mid"), F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high")
    meet = stored(meet.select("token", "mid"), "meet")
    buckets = stored(postings.join(meet, "token").select("token", "set_id", "n", "at", "mid"), "buckets")

    ends = buckets.where("mid.hub <> set_id").groupBy("set_id").agg(F.min("mid.hub").alias("x"), F.min("mid").getField("hub").alias("y"))
    hubs = ends.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), F.col("set_id").alias("b"))
    links = _linked(hubs, sets, percent)
    groups = stored(components(links), "groups")

    # sets of one bucket in different components that were not compared; their components are paired first, a few for each bucket
    placed = buckets.join(groups, F.col("set_id") == F.col("node"), "left").select("token", "set_id", "n", "at", F.coalesce("component", "set_id").alias("component"))
    split = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    placed = stored(placed.join(stored(split, "split"), "token"), "placed")
    # cells: the sets of one bucket, component, size and place; of two that can be linked, the smaller has the size of the other within its reach
    cells = placed.select("token", "component", "n", "at").distinct().withColumn("reach", F.expr(f"least({100 + percent} * (1 + n - at) div {percent} - n, 100 * n div {percent})"))
    x = cells.where("reach >= n").select("token", F.col("component").alias("ca"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("reach").alias("ra"), F.explode(F.sequence(_size_class("n"), _size_class("reach"))).alias("class"))
    y = cells.select("token", F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("reach").alias("rb"), _size_class("n").alias("class"))
    fits = F.expr("x.ca <> y.cb and y.nb between x.na and x.ra and x.na <= y.rb and (x.na < y.nb or x.ca < y.cb)")
    met = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.class") == F.col("y.class")) & fits).select("x.token", "ca", "na", "ia", "cb", "nb", "ib")
    met = stored(met, "met")
    first = placed.select("token", F.col("component").alias("ca"), F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"))
    second = placed.select("token", F.col("component").alias("cb"), F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    met = met.join(first, ["token", "ca", "na", "ia"]).join(second, ["token", "cb", "nb", "ib"])
    rest = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = rest.join(hubs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    groups = components(links.union(_linked(rest, sets, percent)))

    named = nodes.select("doc_id", "set_id", F.col("n").alias("n_shingles"))
    alone = named.where("set_id = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "set_id")
    named = named.where("set_id <> 0").join(groups, named.set_id == groups.node, "left").select("doc_id", "n_shingles", "set_id", F.coalesce("component", "set_id").alias("component"))
    named = stored(named, "named")
    least = named.groupBy("component").agg(F.min_by("doc_id", F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("component_id"))
    return named.join(stored(least, "least"), "component").select("doc_id", "n_shingles", "component_id", "set_id").union(alone)


def _prefix(n: str, percent: int) -> Column:
    """_prefix_length of a column."""
    return F.expr(f"{n} - ({percent} * {n} + 99) div 100 + 1")


def _size_class(n: str) -> Column:
    """Sizes within a factor of 1.25, so that those within a set's reach are in its class or the next two."""
    return F.floor(F.log(1.25, F.col(n).cast("double"))).cast("int")


def _held_by_several(postings: DataFrame) -> DataFrame:
    """The different rows of postings(token, set_id) whose token several sets hold, and how many rows have it: token, set_id, several."""
    # counted before rows meet, and stored, so that a token that very many sets hold can be split in the join
    held = postings.groupBy("token").agg(F.count("*").alias("several"), F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high")
    return postings.join(stored(held.select("token", "several"), "held"), "token").select("token", "set_id", "several").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, as a stored table: those that pass the filters, verified."""
    of = sets.select("set_id", "n", "third", "fourth").dropDuplicates(["set_id"])
    both = pairs.join(of.toDF("a", "na", "a3", "a4"), "a").join(of.toDF("b", "nb", "b3", "b4"), "b")
    near = both.where(F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and arrays_overlap(a3, b3) and arrays_overlap(a4, b4)")).select("a", "b", "na", "nb")
    near = stored(near, "near")
    of = sets.select("set_id", "tokens")
    both = near.join(of.toDF("a", "ta"), "a").join(of.toDF("b", "tb"), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return stored(both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b").distinct(), "links")


def one_per_group(docs: DataFrame, percent: int = 80, shingle_words: int = 5) -> DataFrame:
    """The documents without all but one of each group of linked ones: that with the smallest doc_id stays.

    Of rows that share the smallest doc_id of a group all stay. All columns are kept, whatever their names. Documents without
    shingles (null and empty texts) all stay; a null doc_id is the smallest. An empty table gives an empty result.
    """
    found = stored(jaccard_components(docs, percent, shingle_words).select("doc_id", "component_id"), "found")
    name = fresh(docs, "_gone")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stay = found.where(first).select(F.col("doc_id").alias("_stay")).distinct()
    gone = stored(found.where(~first).select(F.col("doc_id").alias(name)).distinct().join(stay, F.col(name).eqNullSafe(F.col("_stay")), "left_anti"), "gone")
    return docs.join(broadcast_if_small(gone, gone.count(), SMALL), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
