"""Media columns: 8-bit greyscale PNG files in a binary column, and a cosine-transform hash of them.

Files are written and read here: chunks with CRC-32 tests, one zlib stream, and numpy for filtering and unfiltering.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, stored

#: A payload is padded with bytes 255 to a positive multiple of UNIT, and laid out in rows of WIDTH samples.
UNIT, WIDTH = 576, 24
#: The hash compares SIDE x SIDE low frequencies of an image reduced to GRID x GRID means.
GRID, SIDE = 32, 8
_MAGIC = bytes([137, 80, 78, 71, 13, 10, 26, 10])
#: Cosine basis, rounded to integers so that hashes are the same on every machine.
_COSINE = np.rint(4096 * np.cos(np.pi * np.outer(np.arange(SIDE), 2 * np.arange(GRID) + 1) / (2 * GRID))).astype(np.int64)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A greyscale PNG of samples (height x width, uint8); a row is stored as the difference from the sample to the left or above where that
    sums up to less than a quarter of the plain row, as in flat parts and repeated rows; text compresses better plain."""
    plain = samples
    left, above = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    above[1:] -= samples[:-1]
    options = np.stack([plain, left, above])
    weight = np.minimum(options, 0 - options).sum(axis=2, dtype=np.int64)
    weight[1:] *= 4
    kind = weight.argmin(axis=0).astype(np.uint8)
    rows = np.concatenate([kind[:, None], options[kind, np.arange(len(samples))]], axis=1)
    head = struct.pack(">IIBBBBB", samples.shape[1], samples.shape[0], 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    return a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlace. ValueError for other files and for wrong checksums."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG file")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(part, zlib.crc32(kind)):
            raise ValueError(f"wrong checksum of {kind!r}")
        head = part if kind == b"IHDR" else head
        body += [part] if kind == b"IDAT" else []
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[8:] != bytes([8, 0, 0, 0, 0]):
        raise ValueError("not a whole 8-bit greyscale PNG file")
    width, height = struct.unpack(">II", head[:8])
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    out[kinds == 1] = np.cumsum(out[kinds == 1], axis=1, dtype=np.uint8)  # sums wrap as bytes do
    for i in np.flatnonzero(kinds > 1):
        before = out[i - 1] if i else np.zeros(width, np.uint8)
        if kinds[i] == 2:
            out[i] += before
            continue
        line, over = out[i].tolist(), before.tolist()
        for x in range(width):
            a, c = (line[x - 1], over[x - 1]) if x else (0, 0)
            line[x] = (line[x] + ((a + over[x]) // 2 if kinds[i] == 3 else _paeth(a, over[x], c))) & 255
        out[i] = line
    return out


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hexadecimal digits: which of the low frequencies (but the constant) are over their median."""
    h, w = samples.shape
    rows, columns = np.arange(GRID + 1) * h // GRID, np.arange(GRID + 1) * w // GRID
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = samples.cumsum(0, dtype=np.int64).cumsum(1)
    top, bottom = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    first, last = columns[:-1], np.maximum(columns[1:], columns[:-1] + 1)
    area = np.outer(bottom - top, last - first)
    means = 16 * (total[bottom][:, last] - total[top][:, last] - total[bottom][:, first] + total[top][:, first]) // area
    low = (_COSINE @ means @ _COSINE.T).ravel()
    bits = low > np.sort(low[1:])[(len(low) - 1) // 2]
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the PNG file of each text, as a stored table."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                files = [write_png(np.frombuffer(payload_of(t or b""), np.uint8).reshape(-1, WIDTH)) for t in texts]
                yield pa.record_batch([part.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(small_batches).mapInArrow(encode, "doc_id long, n_bytes long, media binary"), "media")


def media_features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in one row per document, from its stored PNG file as read back: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null and empty texts have a payload of padding only. Equal texts have equal values, and rows that share a doc_id
    are files of their own. An empty table gives an empty result. Other columns play no part.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                size, digest, tail, own, feature = [], [], [], [], []
                for f in part.column("media"):
                    f = f.as_py()
                    samples = read_png(f)
                    payload = samples.tobytes()
                    size.append(len(payload))
                    digest.append(hashlib.sha256(payload).hexdigest())
                    tail.append(zlib.crc32(payload[-32:]))
                    own.append(hashlib.sha256(f).hexdigest())
                    feature.append(cosine_hash(samples))
                stored_size = [len(f.as_buffer()) for f in part.column("media")]
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), pa.array(size, pa.int64()), pa.array(digest), pa.array(tail, pa.int64()), pa.array(stored_size, pa.int64()), pa.array(own), pa.array(feature)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media_table(docs).transform(small_batches).mapInArrow(decode, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
