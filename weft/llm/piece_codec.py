"""SentencePiece encoding and decoding by suffix-array matching.

For a batch of texts, the different segments (words with the spaces before them) are put together in one
text. Its suffixes are sorted, to the depth of the longest piece, and a binary search for every piece of the
vocabulary gives the range of suffixes that begin with it: all occurrences of all pieces. As edges between
positions they are sorted by where they end, and relaxed in that order.

For models of the BPE kind the relaxation is exact: the last piece of each prefix's encoding is unique, and an edge
extends the encoding of the prefix before it just if BPE would leave the pair of pieces apart.
Characters that no piece holds are edges of their own, and become byte pieces.

Long segments are cut where no piece has both neighbours, since no piece crosses there. What is still long, and runs of spaces (pieces of one
score, of which the leftmost goes first), is merged pair by pair from a heap, in time that grows with n log n.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, slices, small_batches

#: Characters that are indexed at once, segments whose pieces a worker remembers, pairs, and bytes of text of a slice.
INDEX_CHARS, REMEMBERED, PAIRS, SLICE = 1 << 18, 200_000, 1_000_000, 2 << 20
#: Characters of a segment that are relaxed position by position at most.
LONG = 512
_START, _NONE = -2, -3


class PieceCodec:
    """Encoder and decoder for the model in a file of the sentencepiece library (BPE with byte fallback)."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.unknown = model.unk_id()
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.text = [model.id_to_piece(i).replace("▁", " ") for i in range(n)]
        self.piece = {self.text[i]: i for i in range(n) if i not in special}
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_id)}
        self.control = {i for i in special if i not in self.byte_of and i != self.unknown}
        for b in range(128):  # these bytes are characters
            self.text[int(self.byte_id[b])] = chr(b)
        self.partial = self.control | {i for i, b in self.byte_of.items() if b > 127}
        score = [model.get_score(i) for i in range(n)]
        # a lower rank merges first; characters of their own come out of no merge
        self.rank = {i: -score[i] for t, i in self.piece.items() if len(t) > 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for t, i in self.piece.items():
            if len(t) > 1 and (s := self._merged(t, True)) is not None and s[0] == i:
                self.parts[i] = s[1]
        self.joined = {p: i for i, p in self.parts.items()}
        self.usable = {t: i for t, i in self.piece.items() if len(t) == 1 or i in self.parts}
        long = [t for t in self.piece if len(t) > 1]
        held = {c for t in long for c in t}
        alone = [c for c in "\n\t" if c not in held]
        inner = any(" " in t.lstrip(" ") for t in long)
        # no piece crosses from another character to a space, nor over these: texts fall into segments there
        self.segment = re.compile(("[" + "".join(map(re.escape, alone)) + "]|" if alone else "") + (r"(?s:.+)" if inner else f" *[^ {''.join(map(re.escape, alone))}]+| +"))
        names = sorted(self.usable)
        alphabet = sorted({c for t in names for c in t})
        self.code = np.ones(0x110000, np.uint16)  # 0 parts segments, 1 is any other character
        self.code[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
        self.depth = max(map(len, names)) + 1
        self.names = np.array([self.usable[t] for t in names])
        self.lengths = np.array([len(t) for t in names])
        keys = np.zeros((len(names), self.depth), ">u2")
        for k, t in enumerate(names):
            keys[k, : len(t)] = self.code[[ord(c) for c in t]]
        self.low = keys.copy().view(f"S{2 * self.depth}").ravel()
        keys[np.arange(len(names)), self.lengths] = 0xFFFF
        self.high = keys.copy().view(f"S{2 * self.depth}").ravel()
        bridges = {int(self.code[ord(a)]) << 16 | int(self.code[ord(b)]) for t in names for a, b in zip(t, t[1:], strict=False)}
        self.bridges = np.array(sorted(bridges), np.int64)
        self.apart: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Remembered segments: the number of each, and where the pieces of each begin in one array, with their end."""
        self.codes: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.begin = np.zeros(1, np.int64)
        self.new: list[np.ndarray] = []
        self.new_sizes: list[np.ndarray] = []

    def _merged(self, text: str, last: bool = False):
        """The pieces of text by merging the best neighbours, of equal ones the leftmost; last: rather the single piece that comes out and the pair it was made of, if one does."""
        names, n = list(text), len(text)
        now = [self.piece.get(c, -1 - ord(c)) for c in text]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(k: int) -> None:
            if (r := self.rank.get(self.piece.get(names[k] + names[after[k]], -1))) is not None:
                heapq.heappush(heap, (r, k, names[k], names[after[k]]))

        for k in range(n - 1):
            offer(k)
        pair = None
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k]
            if names[k] != left or j >= n or names[j] != right:  # one of the two has been merged meanwhile
                continue
            pair = (now[k], now[j])
            names[k] = left + right
            now[k] = self.piece[names[k]]
            names[j] = ""
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                offer(k)
            if before[k] >= 0:
                offer(before[k])
        if last:
            return (now[0], pair) if n and after[0] >= n else None
        return [i for i, t in zip(now, names, strict=True) if t]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether BPE over the text of both leaves just a and b: it does unless pieces of a's right edge and b's left edge would merge before the two were whole."""
        limit = np.inf
        while True:
            whole = self.joined.get((a, b))
            if whole is not None and self.rank[whole] < limit:
                return False
            ra, rb = (self.rank[x] if x in self.parts else -1.0 for x in (a, b))
            if ra < 0 and rb < 0:
                return True
            # undo the later of the two merges; of equal ones the right, which was made last
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1e-3, self.parts[b][0]

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of all occurrences of pieces; unknown characters have piece -1."""
        starts, ends, pieces = [], [], []
        for at in range(0, len(codes), INDEX_CHARS):
            block = np.zeros(min(INDEX_CHARS, len(codes) - at) + self.depth - 1, ">u2")
            own = codes[at : at + len(block)]
            block[: len(own)] = own
            grid = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(block, self.depth)).view(f"S{2 * self.depth}").ravel()
            suffixes = np.argsort(grid)
            grid = grid[suffixes]
            low, high = np.searchsorted(grid, self.low), np.searchsorted(grid, self.high)
            n = high - low
            which = np.repeat(np.arange(len(n)), n)
            found = suffixes[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]] + at
            starts.append(found)
            ends.append(found + self.lengths[which])
            pieces.append(self.names[which])
        odd = np.flatnonzero(codes == 1)
        return np.concatenate([*starts, odd]), np.concatenate([*ends, odd + 1]), np.concatenate([*pieces, np.full(len(odd), -1)])

    def _learn(self, segments: list[str]) -> None:
        """Encodes new segments and remembers them."""
        # runs of spaces are pieces of one score, so their merges are simulated
        heaped = [s for s in segments if "  " in s or len(s) > LONG]
        plain = [s for s in segments if "  " not in s and len(s) <= LONG]
        for s in heaped:
            self._remember([s], self._merged_runs(s))
        if not plain:
            return
        sizes = np.array([len(s) for s in plain])
        chars = np.frombuffer("\n".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.append(self.code[chars], np.uint16(0))
        first = np.cumsum(sizes + 1) - sizes - 1
        codes[first[1:] - 1] = 0
        start, end, piece = self._edges(codes)
        owner = np.repeat(np.arange(len(plain)), sizes + 1)
        rel = end - first[owner[start]]
        order = np.argsort(rel, kind="stable")
        start, end, piece, rel = start[order], end[order], piece[order], rel[order]
        last = np.full(len(codes) + 1, _NONE)
        last[first] = _START
        cuts = np.searchsorted(rel, np.arange(1, int(sizes.max()) + 2))
        for a, b in zip(cuts, cuts[1:], strict=False):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = last[s]
            good = (before == _START) | ((before != _NONE) & ((p == -1) | (before == -1)))
            ask = np.flatnonzero((before >= 0) & (p >= 0))
            if len(ask):
                keys, back = np.unique(before[ask] * 0x10000 + p[ask], return_inverse=True)
                good[ask] = np.fromiter((self._known_apart(int(k)) for k in keys), bool, len(keys))[back]
            last[e[good]] = p[good]
        length = np.zeros(len(self.text) + 1, np.int64)
        length[self.names] = self.lengths
        length[-1] = 1  # piece -1
        # back from the ends of all segments at once
        at = first + sizes
        live = np.flatnonzero(at > first)
        trail_seg, trail_piece, trail_at = [], [], []
        while len(live):
            p = last[at[live]]
            at[live] -= length[p]
            trail_seg.append(live)
            trail_piece.append(p)
            trail_at.append(at[live].copy())
            live = live[at[live] > first[live]]
        seg, p, where = np.concatenate(trail_seg), np.concatenate(trail_piece), np.concatenate(trail_at)
        order = np.lexsort((where, seg))
        seg, p, where = seg[order], p[order], where[order]
        bounds = np.searchsorted(seg, np.arange(len(plain) + 1))
        odd = p < 0
        has_odd = np.zeros(len(plain), bool)
        has_odd[seg[odd]] = True
        p32 = p.astype(np.int32)
        for k in np.flatnonzero(has_odd):
            ids = p32[bounds[k] : bounds[k + 1]]
            self._remember([plain[k]], self._with_bytes(plain[k], ids, where[bounds[k] : bounds[k + 1]] - first[k]))
        self._remember([s for s, o in zip(plain, has_odd, strict=True) if not o], p32[~has_odd[seg]], np.diff(bounds)[~has_odd])

    def _with_bytes(self, s: str, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.concatenate([self.byte_id[list(s[w].encode("utf-8", "surrogatepass"))] if i < 0 else [i] for i, w in zip(ids, at, strict=True)]).astype(np.int32)

    def _merged_runs(self, s: str) -> np.ndarray:
        now = self._merged(s)
        return np.concatenate([self.byte_id[list(chr(-1 - i).encode("utf-8", "surrogatepass"))] if i < 0 else [i] for i in now]).astype(np.int32)

    def _remember(self, segments: list[str], ids: np.ndarray, sizes: np.ndarray | None = None) -> None:
        """ids: the pieces of the segments, one after the other."""
        self.codes.update(zip(segments, range(len(self.codes), len(self.codes) + len(segments)), strict=True))
        self.new.append(ids)
        self.new_sizes.append(np.array([len(ids)]) if sizes is None else sizes)

    def _cut(self, segment: str) -> list[str]:
        """A long segment in parts that no piece crosses."""
        code = self.code[np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        cuts = [0, *(np.flatnonzero(~np.isin(code[:-1] << 16 | code[1:], self.bridges)) + 1).tolist(), len(segment)]
        return [segment[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _known_apart(self, key: int) -> bool:
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            found = self.apart[key] = self._stay_apart(key >> 16, key & 0xFFFF)
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The piece ids of each text; none for null and empty texts."""
        parts = [self.segment.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        parts = [[x for s in p for x in self._cut(s)] if len(max(p, key=len, default="")) > LONG else p for p in parts]
        if len(self.codes) > REMEMBERED or len(self.flat) > 16 * REMEMBERED:
            self._forget()
        new: dict[str, None] = {}
        for p in parts:
            new.update(dict.fromkeys(s for s in p if s not in self.codes))
        group, size = [], 0
        for s in new:
            group.append(s)
            size += len(s)
            if size >= INDEX_CHARS:
                self._learn(group)
                group, size = [], 0
        if group:
            self._learn(group)
        if self.new:
            self.flat = np.concatenate([self.flat, *self.new])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate(self.new_sizes))])
            self.new, self.new_sizes = [], []
        flat, begin, counts = self.flat, self.begin[:-1], np.diff(self.begin)
        out = []
        for p in parts:
            c = np.fromiter(map(self.codes.__getitem__, p), np.int64, len(p))
            n = counts[c] if len(c) else c
            out.append(flat[np.repeat(begin[c] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] if len(c) else np.empty(0, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids: byte pieces are read as UTF-8, control pieces are left out, and the space that encoding puts first goes."""
        if self.partial.isdisjoint(ids := ids.tolist()):
            return "".join(map(self.text.__getitem__, ids))[1:]
        own = (i for i in ids if i not in self.control)
        out = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode("utf-8", "surrogatepass") for i in own)
        return out.decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    """One codec for each worker and model."""
    return PieceCodec(model_file)


def default_model() -> str:
    """The installed public model; pass another's path for other vocabularies."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def pieces(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """docs(doc_id, text) in one row per document: doc_id, n_pieces, piece_ids, decoded.

    The ids are those of the sentencepiece library for the whole text, and decoded is the text that they give back: the text itself, but for U+2581, which comes
    back as a space. Null and empty texts have no pieces and decode to an empty text. Rows that
    share a doc_id are encoded one by one. An empty table gives an empty result. Other columns play no part.
    model_file must be readable by every worker.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file or default_model())
        for batch in batches:
            for part in slices(batch, most=SLICE):
                ids = own.encode(part.column("text").to_pylist())
                yield pa.record_batch([part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), lists(ids, pa.int32()), pa.array([own.decode(i) for i in ids], pa.string())], ["doc_id", "n_pieces", "piece_ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(small_batches).mapInArrow(encode, "doc_id long, n_pieces long, piece_ids array<int>, decoded string")
