"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size into classes of up to 1, 2, 4, 8, ... shingles. A long document
cannot resemble a short item, so for each class its shingle sequence is cut into blocks of the
class's size, and each block and each item is sketched by HASHES minimum hashes. An item and a
document are candidates if one of the hashes of one of the blocks agrees. With a containment of
0.8 the hits expected are at least HASHES * 0.8 * q / (u + q), for q shingles in a class of up to
u, however the item is spread over blocks: as q is over u / 2, 12.8 or more, a miss in 360,000 at worst. Blocks of
one shingle are their own minimum, so items of one shingle are found exactly, with one hash. Candidates
are verified by the exact share of the item's shingles that the whole document holds.

Documents are never shuffled: items go to the documents, in blocks of at most ITEMS of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_by_row, fresh, mix, shingles, slices, small_batches, words_of

#: Minimum hashes of a block, and items that are broadcast at once.
HASHES, ITEMS = 48, 20_000
_SEED = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MULTIPLY = _SEED[:HASHES], _SEED[HASHES:] | np.uint64(1)


def _least(h: np.ndarray, starts: np.ndarray, j: int) -> np.ndarray:
    """The j-th minimum hash of each block of h that begins at starts."""
    return np.minimum.reduceat((h ^ _XOR[j]) * _MULTIPLY[j], starts)


class _Index:
    """Items of one block, by size class."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        sizes = np.array([len(s) for s in sets])
        top = (2 ** np.ceil(np.log2(np.maximum(sizes, 1)))).astype(np.int64)
        self.classes = []
        for u in np.unique(top):
            own = np.flatnonzero(top == u)
            flat = np.concatenate([sets[i] for i in own])
            starts = np.r_[0, np.cumsum(sizes[own])[:-1]]
            tables = []
            for j in range(HASHES if u > 1 else 1):  # of one shingle, any hash says the same
                least = _least(flat, starts, j)
                order = np.argsort(least)
                tables.append((least[order], own[order]))
            self.classes.append((int(u), tables))

    def candidates(self, h: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of a text and an item; the shingles of text i are h[first[i]:first[i + 1]]."""
        found: set[tuple[int, int]] = set()
        if not len(h):
            return found
        for u, tables in self.classes:
            blocks = -(-np.diff(first) // u)
            row = np.repeat(np.arange(len(blocks)), blocks)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = first[row] + nth * u
            for j, (values, items) in enumerate(tables):
                least = _least(h, starts, j)
                low, high = np.searchsorted(values, least, "left"), np.searchsorted(values, least, "right")
                for b in np.flatnonzero(high > low):
                    found.update((int(row[b]), int(i)) for i in items[low[b] : high[b]])
        return found


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, shingle_words: int = 5) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) to (doc_id, item_id, n_shared, n_item): documents that hold items.

    A document holds an item if 100 * n_shared >= percent * n_item: n_item distinct five-word shingles of
    the item, of which the document has n_shared. Words are lower-cased (A-Z). A text of fewer
    words is one shingle, so such an item is found only in a document of just these words. Items and documents
    that are null, empty or without words give no rows, nor do empty tables. Rows that share
    an id are judged one by one, and equal results appear once. Other columns play no part.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    items = items.select(F.col("item_id").cast("long"), "text")
    blocks = max(1, -(-items.count() // ITEMS))
    out = None
    for b in range(blocks):
        table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        sets = distinct_by_row(*shingles(words_of(table.column("text"), lower=True), shingle_words), table.num_rows)
        held = [i for i, s in enumerate(sets) if len(s)]
        ids = table.column("item_id").to_pylist()
        index = spark.sparkContext.broadcast(_Index([ids[i] for i in held], [sets[i] for i in held]) if held else None)

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in batches if known else ():
                for part in slices(batch):
                    h, row = shingles(words_of(part.column("text"), lower=True), shingle_words)
                    first = np.searchsorted(row, np.arange(part.num_rows + 1))
                    rows = []
                    doc_id = part.column("doc_id")
                    for r, i in sorted(known.candidates(h, first)):
                        item = known.sets[i]
                        shared = int(np.isin(item, h[first[r] : first[r + 1]]).sum())
                        if 100 * shared >= percent * len(item):
                            rows.append((doc_id[r].as_py(), known.ids[i], shared, len(item)))
                    if rows:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "n_shared", "n_item"])

        found = docs.transform(small_batches).mapInArrow(search, "doc_id long, item_id long, n_shared long, n_item long")
        out = found if out is None else out.union(found)
    return out.distinct()


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = 80, shingle_words: int = 5) -> DataFrame:
    """The documents that hold no item, with all their columns, whatever their names. Of rows that share a doc_id all go or stay.

    Null and empty texts hold no item and stay. Without items all documents stay; an empty table gives an empty result.
    """
    name = fresh(docs, "_gone")
    found = contaminated(docs, items, percent, shingle_words).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
