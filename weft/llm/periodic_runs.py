"""Periodic runs of words, found while a text is read word by word, by catchers over its completed blocks of 2^k words.

A square is a sequence of words that follows itself; a run is a stretch of squares of one period that no neighbouring word extends. When the words of an aligned block
B of s = 2^k words are complete, a catcher stands over it, for squares of the periods from 2s-1 to 4s-2, whose first half holds such a block. Each appended word
advances the comparison of the text's suffixes of 2, 4, 8, ... words with the blocks before them, as far as they equal a known one (names of halves make the name of a whole);
a suffix that equals B at a distance in its range springs the catcher. Once the words that decide are there, a sprung catcher compares the suffixes before and
the prefixes after B with those at every distance of its range, in time linear in s, and reports the squares that they make up. Squares of one period that overlap by
it merge into a run.

Each level takes time linear in the text, so all do n log n, and most texts have no catcher sprung beyond the lowest levels.
"""

from __future__ import annotations

import heapq
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Words of the shortest run that is reported.
LEAST = 12
#: Distances of a block that are compared one by one; more are compared together.
FEW = 4
_NEVER = 1 << 62
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@lru_cache(maxsize=1 << 14)
def primes_of(n: int) -> tuple[int, ...]:
    """The different prime divisors of n."""
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return (*out, n) if n > 1 else tuple(out)


def prefixes(x: list[int]) -> list[int]:
    """How long the common prefix of x and each of its suffixes is."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


class Catchers:
    """The runs of at least `least` words in a sequence that grows by append()."""

    def __init__(self, least: int = LEAST) -> None:
        self.least = least
        #: The lowest level with catchers: a run's matches (its length without one period) hold a whole block of it.
        self.low = max(1, ((least + 1) // 2 + 1) // 2).bit_length() - 1
        self.words: list[int] = []
        self.names: list[dict[int, int]] = [{}, {}]  # by level: the name of the suffix that ended at a word, where it is that of a block but none itself
        self.pairs: list[dict[int, int]] = [{}, {}]  # by level: names of two halves to that of the whole
        self.blocks: list[list[int]] = [self.words, []]  # by level: names of the blocks in order
        self.sprung: dict[tuple[int, int], list[int]] = {}  # distances at which the words of a level's block come again
        self.due: list[tuple[int, int, int]] = []  # when, level, block
        self.found: dict[int, list[list[int]]] = {}  # by period: start, end, period of runs, and the first level that does not know of them
        self.wide: list[deque[list[int]]] = [deque(), deque()]  # by level: runs that cover all that a catcher looks at, of periods that are below its range

    def append(self, word: int) -> None:
        """Takes the next word, a number below 2^32."""
        self.extend([word])

    def extend(self, new: list[int]) -> None:
        """Takes words one after the other."""
        words, pairs, blocks, single = self.words, self.pairs[1], self.blocks[1], not self.low
        known, n, last = pairs.get, len(words), words[-1] if words else -1
        words += new
        when = self.due[0][0] if self.due else _NEVER
        for word in new:
            if single:
                for distance in (1, 2):
                    if n >= distance and words[n - distance] == word:
                        self._spring(0, n - distance, distance)
            if n:
                name = known(key := last << 32 | word)
                if n & 1:
                    if name is None:
                        blocks.append(len(pairs))
                        pairs[key] = len(pairs)
                    else:
                        blocks.append(name)
                if name is not None:
                    self._suffixes(n, name)
                    when = self.due[0][0] if self.due else _NEVER
            last = word
            while when <= n:
                level, block = heapq.heappop(self.due)[1:]
                self._settle(level, block, self.sprung.pop((level, block)), n + 1, self.found, self.wide)
                when = self.due[0][0] if self.due else _NEVER
            n += 1

    def _suffixes(self, n: int, name: int) -> None:
        """Compares the suffixes of 2, 4, 8, ... words that end at n with earlier blocks, as far as one equals them. name: of the suffix of two words, which has one."""
        k, size = 1, 2
        while True:
            blocks = self.blocks[k]
            if (n + 1) & (size - 1):
                self.names[k][n] = name
            if k >= self.low:
                first = n - size + 1
                nearest = 2 * size - 1 if k > self.low else 1
                for j in range(max(0, (first - 3 * size + 1) >> k), ((first - nearest) >> k) + 1):
                    if blocks[j] == name:
                        self._spring(k, j, first - (j << k))
            before = n + 1 - size  # words before this suffix
            if before < size:
                return
            left = self.names[k].get(before - 1) if before & (size - 1) else blocks[(before >> k) - 1]
            if left is None:
                return
            key = left << 32 | name
            k, size = k + 1, 2 * size
            name = self._completed(k, n).get(key)
            if name is None:
                return

    def _completed(self, k: int, n: int) -> dict[int, int]:
        """The names of a level's blocks by those of their halves; all blocks that end before n have one."""
        if k == len(self.pairs):
            self.names.append({})
            self.pairs.append({})
            self.blocks.append([])
            self.wide.append(deque())
        pairs, blocks, halves = self.pairs[k], self.blocks[k], self.blocks[k - 1]
        for j in range(len(blocks), n >> k):
            blocks.append(pairs.setdefault(halves[2 * j] << 32 | halves[2 * j + 1], len(pairs)))
        return pairs

    def _spring(self, level: int, block: int, distance: int) -> None:
        distances = self.sprung.get((level, block))
        if distances is None:
            self.sprung[level, block] = distances = []
            # by then the catchers of lower levels over the same words have reported
            heapq.heappush(self.due, ((block + 16) << level, level, block))
        distances.append(distance)

    def _settle(self, level: int, block: int, distances: list[int], n: int, found: dict[int, list[list[int]]], wide: list[deque[list[int]]]) -> None:
        """Reports the squares over a block that equal ones at some distances, among the first n words."""
        words, size, begin = self.words, 1 << level, block << level
        over, until = wide[level], min(begin + 5 * size, n)
        while over and over[0][1] < until:  # the run has ended, and later blocks reach further
            over.popleft()
        if any(r[0] <= begin and r[1] >= until for r in over):
            return  # every distance here is a multiple of that period
        reach = 4 * size
        if many := len(distances) > FEW:
            back, ahead = words[max(0, begin - reach) : begin][::-1], words[begin : begin + reach - 2][::-1]
            after = prefixes(words[begin : min(begin + 2 * reach, n)])
            before = prefixes([*back, -1, *ahead, *back])
            at = len(back) + 1 + len(ahead)
        for p in distances:
            if many:
                left, right = before[at - p], after[p]
            else:
                left, right = 0, size
                lowest, end = max(0, begin - reach), min(begin + reach, n - p)
                while begin - left > lowest and words[begin - left - 1] == words[begin - left - 1 + p]:
                    left += 1
                while begin + right < end and words[begin + right] == words[begin + right + p]:
                    right += 1
            if left + right >= p and not any(words[begin + p // f : begin + p] == words[begin : begin + p - p // f] for f in primes_of(p)):
                self._report(p, begin - left, begin + p + right, found, wide)

    def _report(self, period: int, start: int, end: int, found: dict[int, list[list[int]]], wide: list[deque[list[int]]]) -> None:
        own = found.setdefault(period, [])
        if own and start <= own[-1][1] - period:
            run = own[-1]
            run[0], run[1] = min(start, run[0]), max(end, run[1])
        else:
            own.append(run := [start, end, period, (period - 1).bit_length()])
        while run[1] - run[0] >= 5 << run[3] and run[3] < 60:
            while run[3] >= len(wide):
                wide.append(deque())
            wide[run[3]].append(run)
            run[3] += 1

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of the words so far, by start and then period. More words can be appended afterwards."""
        found = {p: [list(r) for r in own] for p, own in self.found.items()}
        same = {id(r): c for p, own in self.found.items() for r, c in zip(own, found[p], strict=True)}
        wide = [deque(same[id(r)] for r in level) for level in self.wide]
        for _, level, block in sorted(self.due):
            self._settle(level, block, self.sprung[level, block], len(self.words), found, wide)
        return sorted((r[0], r[1] - r[0], p) for p, own in found.items() for r in own if r[1] - r[0] >= self.least)


def runs_of(words: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words."""
    ids: dict[str, int] = {}
    catchers = Catchers(least)
    catchers.extend([ids.setdefault(w, len(ids)) for w in words])
    return catchers.runs()


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words but for those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs(doc_id, text) in one row per document: doc_id, n_words, runs (an array of start, length, period, by start and then period) and
    collapsed, the words that no run holds after its first period, joined by one space.

    Words are maximal runs of characters other than space and 0x09-0x0D; only equal ones match. Null and empty texts have no words, no runs and an empty collapsed text. Rows that share a
    doc_id are read one by one. An empty table gives an empty result. Other columns play no part.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = [_WORDS.findall(t) if t else [] for t in part.column("text").to_pylist()]
                runs = [runs_of(w, least) for w in words]
                rows = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], kind)
                left = pa.array([" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)], pa.string())
                yield pa.record_batch([part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), rows, left], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(small_batches).mapInArrow(find, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
