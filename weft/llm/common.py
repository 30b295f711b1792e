"""Helpers shared by the training-data operators.

Words are maximal runs of bytes other than space and 0x09-0x0D, as in the regular
expression ``[^\\x20\\x09-\\x0D]+``. A word's hash is made of its bytes, eight at a time, with a mixing step after
each eight; that of a window of words is a tree of such steps. Both are computed with numpy over one slice
of an Arrow batch at a time, and come in two lanes that share no constant.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch where the session keeps Spark's default of 10,000: tasks hold few whole texts at once.
BATCH_ROWS = 1000
#: Stands for a null doc_id where a key is needed; it sorts first, as nulls do.
NULL_ID = -(1 << 63)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The first k bytes of eight that are read from a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Seed and multiplier of each lane.
_LANES = ((np.uint64(0x243F6A8885A308D3), np.uint64(0x9E3779B97F4A7C15)), (np.uint64(0x13198A2E03707344), np.uint64(0xD1342543DE82EF95)))
#: Words of more bytes are hashed one by one.
_LONG = 128


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, with one of its own for each application.

    Where the session names none it is in the warehouse, or, with a local master only, a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        found = _local.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="weft-shared-")
        _local[spark.sparkContext.applicationId] = found
    return f"{found or spark.conf.get('spark.sql.warehouse.dir')}/weft-{spark.sparkContext.applicationId}"


_local: dict[str, str] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: lineage ends there, and any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a stored table that no result reads any more."""
    for f in df.inputFiles()[:1]:
        delete(df.sparkSession, f.rpartition("/")[0])


def clear(spark: SparkSession) -> None:
    """Deletes all stored tables of the application; results that are not written yet need them."""
    delete(spark, shared_dir(spark))


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on passes BATCH_ROWS rows at a time to Python, unless it has a number of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, BATCH_ROWS)
    return df


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; beyond it, Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def join_hashes(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """The hash of a sequence whose beginning has the hash a and whose end has b."""
    seed, by = _LANES[lane]
    return mix((a ^ seed) * by + b)


def windows(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A hash of each k consecutive values of h: of halves, quarters and so on, joined."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out, have, part, size = None, 0, h, 1
    while True:
        if k & size:
            out = part if out is None else join_hashes(part[: len(h) - have - size + 1], out[size : size + len(h) - have - size + 1], lane)
            have += size
        if have == k:
            return mix(out + np.uint64(k))
        part = join_hashes(part[:-size], part[size:], lane)
        size *= 2


def chunks(body: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a little-endian number; zeros follow the last."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    return np.ndarray(len(body), "<u8", padded, strides=(1,))


def hash_words(body: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """The hash of each body[start:end]."""
    seed, by = _LANES[lane]
    size = end - start
    eight = chunks(body)
    h = mix(((eight[start] & _FIRST[np.minimum(size, 8)]) ^ seed) * by + size.astype(np.uint64))
    more = np.flatnonzero((size > 8) & (size <= _LONG))
    at = 8
    while len(more):
        rest = size[more] - at
        h[more] = mix((h[more] ^ (eight[start[more] + at] & _FIRST[np.minimum(rest, 8)])) * by)
        at += 8
        more = more[rest > 8]
    for i in np.flatnonzero(size > _LONG):
        h[i] = np.frombuffer(hashlib.blake2b(body[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), np.uint64)[0]
    return h


@dataclass
class Words:
    """The words of n texts: hash of each in both lanes, if there are two, and first[i]:first[i + 1] are those of text i."""

    hash: np.ndarray
    first: np.ndarray
    row: np.ndarray
    second: np.ndarray | None = None


def bytes_of(text: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each byte as table has it, and where each text begins, with the end of the last."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    n = len(text)
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
    body = np.frombuffer(text.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return body if table is None else table[body], off - off[0]


def edges_of(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words of texts that begin at off."""
    size = len(body)
    word = ~_SPACE[body]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = off[(off > 0) & (off < size)]
    begins[edge] |= word[edge]
    ends[edge - 1] |= word[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words_of(text: pa.Array, lower: bool = False, lanes: int = 1) -> Words:
    body, off = bytes_of(text, _LOWER if lower else None)
    n = len(off) - 1
    if not len(body):
        return Words(np.empty(0, np.uint64), np.zeros(n + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    start, end = edges_of(body, off)
    first = np.searchsorted(start, off)
    hashes = [hash_words(body, start, end, lane) for lane in range(lanes)]
    return Words(hashes[0], first, np.repeat(np.arange(n), np.diff(first)), hashes[-1])


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in pieces of about so many bytes of text."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and the text of each; a text of fewer words has its whole sequence as one."""
    count = np.diff(words.first)
    at = np.flatnonzero(np.arange(len(words.hash)) + k <= words.first[words.row + 1]) if len(words.hash) else np.empty(0, np.int64)
    h, row = windows(words.hash, k)[at] if len(at) else np.empty(0, np.uint64), words.row[at]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.array([windows(words.hash[words.first[i] : words.first[i + 1]], int(count[i]))[0] for i in short], np.uint64)
        h, row = np.concatenate([h, own]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def distinct_by_row(h: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each of n texts; row must ascend."""
    cut = np.searchsorted(row, np.arange(n + 1))
    return [np.unique(h[a:b]) if b > a else h[:0] for a, b in zip(cut, cut[1:], strict=False)]


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays."""
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key() -> dict[str, object]:
    """Columns that name a document within an operator: its id, and for rows that share an id, its text."""
    return {"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_t": F.xxhash64("text")}
