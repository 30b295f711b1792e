"""Byte-level BPE encoding and decoding with a sentencepiece model that is serialised from a file of ranks.

Every byte b is written as the character 0x100 + b, so all tokens of the vocabulary, whole UTF-8 or not, are pieces of text. Their score
is the negative rank and their text is left as it is (identity normalisation), so the merges of the sentencepiece library are those of
the ranks: the best pair first, of equal ones the leftmost. Texts are cut into pre-tokens by a pattern; each is encoded by itself, and workers remember
the short ones.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, slices, small_batches

#: Pre-tokens that a worker remembers, bytes of the longest such, and bytes of text of a slice.
REMEMBERED, SHORT, SLICE = 500_000, 64, 2 << 20
_TO_TEXT = {b: 0x100 + b for b in range(256)}

# Field numbers and kinds of the sentencepiece model format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_TEXT, _SCORE, _KIND = 1, 2, 3
_NORMAL, _UNKNOWN = 1, 2
_MODEL_TYPE, _VOCABULARY, _UNK, _BOS, _EOS, _PAD = 3, 4, 40, 41, 42, 43
_BPE = 2
_NAME, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _real(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def mapped(token: bytes) -> str:
    """The text that stands for bytes: a character for each."""
    return token.decode("latin-1").translate(_TO_TEXT)


def unmapped(text: str) -> bytes:
    return bytes(ord(c) - 0x100 for c in text)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a file with a token in base 64 and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def model_of(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model of the BPE kind: the tokens in the order of their ranks, then the unknown piece.

    ValueError if a byte is no token of its own: texts with it could not be encoded. Ranks must be below 2^24, as scores are 32-bit numbers.
    """
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {missing}")
    if max(ranks.values()) >= 1 << 24:
        raise ValueError("ranks must be below 2^24")
    body = [_bytes(_PIECES, _bytes(_TEXT, mapped(t).encode()) + _real(_SCORE, -float(r)) + _number(_KIND, _NORMAL)) for t, r in sorted(ranks.items(), key=lambda x: x[1])]
    body.append(_bytes(_PIECES, _bytes(_TEXT, b"<unk>") + _real(_SCORE, 0.0) + _number(_KIND, _UNKNOWN)))
    body.append(_bytes(_TRAINER, _number(_MODEL_TYPE, _BPE) + _number(_VOCABULARY, len(body)) + _number(_UNK, len(ranks)) + b"".join(_number(f, -1) for f in (_BOS, _EOS, _PAD))))
    body.append(_bytes(_NORMALIZER, _bytes(_NAME, b"identity") + b"".join(_number(f, 0) for f in (_DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES))))
    return b"".join(body)


class ByteCodec:
    """Encoder and decoder for a vocabulary of ranks and a pattern of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_of(ranks))
        self.whole = {t: struct.pack("<I", r) for t, r in ranks.items()}
        self.rank = np.array(sorted(ranks.values()), "<u4")  # of each piece
        self.bytes_of = {int(r): unmapped(self.model.id_to_piece(i)) for i, r in enumerate(self.rank)}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _encode(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens, as little-endian numbers of 32 bits. A pre-token that is a token has its rank, also if no merges lead to it."""
        raw = [t.encode() for t in tokens]
        whole = [self.whole.get(r) for r in raw]
        merged = self.model.encode([mapped(r) for r, w in zip(raw, whole, strict=True) if w is None], num_threads=1)
        flat = self.rank[np.fromiter(chain.from_iterable(merged), np.int64)].tobytes()
        ends = [4 * e for e in accumulate(map(len, merged), initial=0)]
        own = iter([flat[a:b] for a, b in pairwise(ends)])
        return [next(own) if w is None else w for w in whole]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian numbers of 32 bits; none for null and empty texts."""
        parts = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {t for p in parts for t in p}.difference(self.known)
        short = [t for t in new if len(t) <= SHORT]
        self.known.update(zip(short, self._encode(short), strict=True))
        long = [t for t in new if len(t) > SHORT]
        own = dict(zip(long, self._encode(long), strict=True))
        known = self.known.__getitem__
        return [b"".join(own[t] if t in own else known(t) for t in p) if own else b"".join(map(known, p)) for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(rank_file: str, pattern: str) -> ByteCodec:
    """One codec for each worker and vocabulary."""
    return ByteCodec(read_ranks(rank_file), pattern)


def default_ranks() -> str:
    """The installed public vocabulary; pass another's path for other ones."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def default_pattern() -> str:
    import public_tokenizers

    return str(public_tokenizers.PATTERN)


def tokens(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs(doc_id, text) in one row per document: doc_id, n_tokens, ids, ids_sha256 (of the ids as little-endian unsigned 32-bit numbers), decoded.

    The ids are those that the tiktoken library gives for the whole text without special tokens, and decoded, a binary column, holds the bytes that they give back.
    What the pattern doesn't match has no tokens. Null and empty texts have none and decode to nothing. Rows that
    share a doc_id are encoded one by one. An empty table gives an empty result. Other columns play no part.
    rank_file must be readable by every worker.
    """
    pattern = pattern or default_pattern()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file or default_ranks(), pattern)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                raw = own.encode(part.column("text").to_pylist())
                ids = [np.frombuffer(r, "<u4") for r in raw]
                digests = pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())
                decoded = pa.array([own.decode(i) for i in ids], pa.binary())
                yield pa.record_batch([part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), lists([i.astype(np.int32) for i in ids], pa.int32()), digests, decoded], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(small_batches).mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded binary")
