"""Substring dedup with a count-min prefilter.

A window is `size` consecutive words of one document. Words covered by a window that also
starts in a document with a smaller doc_id go. Two passes over the texts:

1. Every window is represented by its minimizer, the least hash among the runs of `size // 2`
   words inside it. Equal windows have equal minimizers, so counting minimizers never counts a
   window too low, and there is one for about `size // 4` words instead of one a word. Each
   task sketches its minimizers in cells; the sketches of all partitions are added up cell by cell, by a shuffle, and
   a cell knows its least and greatest doc_id as well.
2. Windows whose cell has two or more documents, and no others, are grouped exactly, by two
   64-bit hashes of independent lanes. Estimates are never too low, so no repeated window is lost.

The sketch has CELLS cells for a minimizer, whatever the size of the input, and is never in one place: minimizers are
joined to its cells. So the share of windows that pass without need is the same at every size.

Later copies of whole texts are found first, by a 128-bit hash of the text. They lose all their words if there is a window in them, and
need no part in the passes, since the first copy has the same windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, broadcast_if_small, mix, row_key, slices, small_batches, stored, windows, words_of

#: Cells of the sketch for a minimizer (of about 80 bytes of text), at least, and cells of the smallest sketch.
CELLS, NARROWEST = 64, 1 << 20
#: Rows of a broadcast side (about 60 bytes each), or entries of its lists.
SMALL = 1 << 20
_SEED = np.uint64(0x8CB92BA72F3D8DD7)


def _window_starts(words: Words, size: int) -> np.ndarray:
    """Positions, among all words, at which a window starts."""
    return np.flatnonzero(np.arange(len(words.hash)) + size <= words.first[words.row + 1]) if len(words.hash) else np.empty(0, np.int64)


def _minimizers(words: Words, size: int) -> np.ndarray:
    """The minimizer of the window that starts at each position (of those that cross texts too)."""
    k = max(1, size // 2)
    least = mix(windows(words.hash, k) + np.uint64(k))
    span = size - k + 1
    have = 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:]) if step < len(least) else least[:0]
        have += step
    return least


def _cells_of(docs: DataFrame, size: int, width: int) -> DataFrame:
    """cell, _k, _t, pos, n: the n windows from pos on of a document have one minimizer, which falls into the cell."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                at = _window_starts(words, size)
                if not len(at):
                    continue
                least, row = _minimizers(words, size)[at], words.row[at]
                new = np.ones(len(at), bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                head = np.flatnonzero(new)
                row = row[head]
                cell = (mix(least[head] ^ _SEED) & np.uint64(width - 1)).view(np.int64)
                ids, texts = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("_k", "_t"))
                columns = [cell, ids, texts, (at[head] - words.first[row]).astype(np.int32), np.diff(head, append=len(at)).astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], ["cell", "_k", "_t", "pos", "n"])

    return docs.select("text", "_k", "_t").transform(small_batches).mapInArrow(runs, "cell long, _k long, _t long, pos int, n int")


def suspected_windows(docs: DataFrame, size: int) -> DataFrame:
    """docs(_k, _t, text) to _k, _t and runs, [first, number] of the windows whose cell has several documents; a stored table."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = NARROWEST
    while width < CELLS * n // 80:
        width *= 2
    runs = stored(_cells_of(docs, size, width), "minimizers")
    # sketches of the partitions are added up here; of a cell the counts matter only as far as they tell one document from several
    cells = stored(runs.groupBy("cell").agg(F.min("_k").alias("low"), F.max("_k").alias("high")).where("low < high").select("cell"), "cells")
    found = runs.join(cells, "cell").groupBy("_k", "_t").agg(F.sort_array(F.collect_list(F.array("pos", "n"))).alias("runs"))
    return stored(found, "suspected")


def later_copies(docs: DataFrame) -> DataFrame:
    """_k, _t (the row's key) of the documents whose whole text a document with a smaller doc_id has too, as a stored table."""
    rows = docs.where("text is not null").select(*(c.alias(k) for k, c in row_key().items()), F.xxhash64(F.lit(1), "text").alias("_u"))
    low = stored(rows.groupBy("_t", "_u").agg(F.min("_k").alias("low"), F.max("_k").alias("high")).where("low < high").drop("high"), "copied")
    return stored(rows.join(low, ["_t", "_u"]).where("_k > low").select("_k", "_t").distinct(), "copies")


def repeated_spans(docs: DataFrame, size: int = 50) -> DataFrame:
    """docs(_k, _t, text) to _k, _t (the row's key) and spans: the word ranges [start, end) to remove, in order."""
    suspected = suspected_windows(docs, size)
    entries = suspected.agg(F.sum(F.size("runs") + 1)).first()[0] or 0

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), lanes=2)
                runs = part.column("runs")
                own = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
                pairs = np.asarray(runs.flatten().flatten(), np.int64).reshape(-1, 2)
                first, n = words.first[own] + pairs[:, 0], pairs[:, 1]
                at = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(own, n)
                ids, texts = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("_k", "_t"))
                columns = [windows(words.hash, size, 0)[at].view(np.int64), windows(words.second, size, 1)[at].view(np.int64), ids, texts, (at - words.first[row]).astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], ["h1", "h2", "_k", "_t", "pos"])

    some = docs.select("text", "_k", "_t").join(broadcast_if_small(suspected, entries, SMALL), ["_k", "_t"])
    found = stored(some.select("text", "_k", "_t", "runs").transform(small_batches).mapInArrow(exact, "h1 long, h2 long, _k long, _t long, pos int"), "windows")
    # stored, so that both sides of the join are dealt out for it, and a window that very many documents have can be split
    first = stored(found.groupBy("h1", "h2").agg(F.min("_k").alias("low"), F.max("_k").alias("high")).where("low < high").drop("high"), "first")
    later = found.join(first, ["h1", "h2"]).where("_k > low").groupBy("_k", "_t").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # positions of one document, at most its words; neighbours become one range

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for p in batch.column("at"):
                at = np.asarray(p.values)
                cut = np.flatnonzero(np.diff(at) > size)
                spans.append(np.stack([at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + size], 1).tolist())
            yield pa.record_batch([batch.column("_k"), batch.column("_t"), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["_k", "_t", "spans"])

    return later.transform(small_batches).mapInArrow(ranges, "_k long, _t long, spans array<array<int>>")


def dedup_substrings(docs: DataFrame, size: int = 50) -> DataFrame:
    """docs(doc_id, text) in one row per document: doc_id, n_words, n_removed, kept_text, kept_sha256, spans.

    kept_text has the words that stay, one space between them. Words are maximal runs of characters other
    than space and 0x09-0x0D, unchanged. Null and empty texts have no words; texts shorter than a
    window lose nothing. Rows with the same doc_id do not remove each other's words; a null doc_id
    counts as the smallest. Windows are judged on the input, not on what is left. An empty table gives an empty
    result. Columns besides doc_id and text play no part.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumns(row_key())
    copies = later_copies(docs.select("doc_id", "text"))
    copies = broadcast_if_small(copies, copies.count(), SMALL)
    spans = stored(repeated_spans(docs.join(copies, ["_k", "_t"], "left_anti"), size), "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                count, removed, texts, digests = [], [], [], []
                spans = []
                for text, gone, copy in zip(*(part.column(c).to_pylist() for c in ("text", "spans", "copy")), strict=True):
                    words = (text or "").encode().split()
                    count.append(len(words))
                    if copy and len(words) >= size:
                        gone = [[0, len(words)]]
                    spans.append(gone)
                    for a, b in reversed(gone or ()):
                        del words[a:b]
                    removed.append(count[-1] - len(words))
                    texts.append(kept := b" ".join(words))
                    digests.append(hashlib.sha256(kept).hexdigest())
                yield pa.record_batch([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "spans"])

    joined = docs.join(broadcast_if_small(spans, spans.count(), SMALL), ["_k", "_t"], "left").join(copies.withColumn("copy", F.lit(True)), ["_k", "_t"], "left")
    return joined.select("doc_id", "text", "spans", "copy").transform(small_batches).mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<array<int>>")
