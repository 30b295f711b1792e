"""Fill-in-middle transformation: texts are cut in three by an indexable skip list, and put together with the middle last.

A text's units (code points, words or lines) are the nodes of the lowest lane. Each lane above keeps about a quarter of the nodes of the one below, and
a node carries how many units and how many code points lie between it and the next of its lane. A rank is reached by going along a lane while the units passed
don't exceed it, and then down; the code points passed are where the text is cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, small_batches

#: Lanes are added until one has so few nodes.
TOP = 4
#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What a unit is, other than a code point. Every code point is in one.
UNITS = {"word": re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"), "line": re.compile(r"[^\n]*\n|[^\n]+")}


def widths(text: str, unit: str) -> np.ndarray:
    """Code points of each unit of a text."""
    if unit == "character":
        return np.ones(len(text), np.uint8)
    return np.fromiter((len(m) for m in UNITS[unit].findall(text)), np.int64)


class SkipList:
    """Units with their widths in code points. Heights of nodes are drawn from their ranks, so that they are the same in every run."""

    def __init__(self, width: np.ndarray) -> None:
        self.lanes = [(np.ones(len(width), np.uint8), width)]
        self.down: list[np.ndarray] = []
        rank = np.arange(len(width), dtype=np.uint64)
        while len(rank) > TOP:
            keep = mix(rank + np.uint64(len(self.lanes) << 48)) & np.uint64(3) == 0
            keep[0] = True
            if keep.all():
                break
            at = np.flatnonzero(keep)
            units, chars = (np.add.reduceat(x, at, dtype=np.int64) for x in self.lanes[-1])
            self.down.append(at)
            self.lanes.append((units, chars))
            rank = rank[at]

    def find(self, rank: int) -> int:
        """The code points before the unit of a rank, or of all for the number of units."""
        node = units = chars = 0
        for level in range(len(self.lanes) - 1, -1, -1):
            unit_width, char_width = self.lanes[level]
            while node < len(unit_width) and units + (step := int(unit_width[node])) <= rank:
                units += step
                chars += int(char_width[node])
                node += 1
            if node == len(unit_width):
                return chars
            if level:
                node = int(self.down[level - 1][node])
        return chars


def draws(seed: str, doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 for a document: the first digits of a digest of the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def turned(text: str, doc_id: int | None, seed: str = "1", unit: str = "character", plain: int = 10, spm: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and output of one text."""
    width = widths(text, unit)
    n = len(width)
    h = draws(seed, doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    units = SkipList(width)
    a, b = (units.find(r) for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def restored(form: Column, output: Column) -> Column:
    """The text that an output of a form was made of. A text that is cut holds no mark, and no mark can begin within another or over its edge, so the marks are where they are found."""
    body = F.substring_index(output, MIDDLE, 1).substr(F.lit(len(PREFIX) + 1), F.length(output))
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(body, SUFFIX, 1), middle, F.substring_index(body, SUFFIX, -1))
    spm = F.concat(F.substring_index(body, PREFIX, -1), middle, F.substring_index(body, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: str = "1", unit: str = "character", plain: int = 10, spm: int = 20) -> DataFrame:
    """docs(doc_id, text) in one row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    plain percent of the texts stay as they are, and so do texts that hold a mark; of the others spm percent have the suffix first. unit: character, word or line.
    Null texts are read as empty, and empty texts are plain. Rows that share a doc_id are cut with the same draws, those without one with those of an empty id. An empty
    table gives an empty result. Other columns play no part.
    """
    if unit != "character" and unit not in UNITS:
        raise ValueError(f"no unit {unit}; there are character, {', '.join(UNITS)}")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [turned(t or "", i, seed, unit, plain, spm) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(small_batches).mapInArrow(turn, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
