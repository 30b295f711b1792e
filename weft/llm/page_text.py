"""Main text of web pages by nearest-URL page differencing.

A page is read as lines: the text between two block boundaries, with the way of tags that leads to it.
The pages of a host are put in the order of their paths, and each is paired with the neighbour whose path
has the longer beginning in common, or with both where they are as near. The lines of a pair are aligned by their longest common
subsequence, and shared ones are deleted. What two pages share is the site's frame. Its words may differ
from page to page (link lists, notices, adverts), so a line within an element that may be a frame, such as nav or a marked div,
is known by its place, the way to it; any other by its words. Lines of the page's article proper are
not deleted: pages quote and copy one another, and a passage of the article is no frame.

What the pairs of all hosts say of a kind of frame (an element or a mark) is counted: of the pages whose neighbour has the kind too, how many share it. A kind that most of them
share is deleted wherever it stands, so also on a host's only page; one that they don't share is text.
Only for kinds that no pair has on both sides do the lists of elements and marks decide.

A form, or an element with a mark in its class, id or role, may also be a wrapper of the whole page. An article in
wrappers only is the page's if there is none outside and it is longer than the text outside; and if all text is within
frames, what is directly in a wrapper counts as outside. Several articles that are together shorter than the text outside are teasers, and text like it. A header within an article
has its headline and stays.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, slices, small_batches, stored
from .url_filter import host_of, path_of

# Elements that part lines nowhere, elements without text, elements without content, frame elements,
# and words of class, id and role that mark a frame.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg math select option button textarea canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME = frozenset("nav header footer aside form menu dialog".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header masthead menu nav navbar navigation newsletter notice notices "
    "pagination pager popup promo promoted promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

# Words that say nothing of what a class is for, beside a mark.
GENERIC = frozenset(
    "area bar block body bottom box button buttons container content desktop fixed form global group icons inner item items left link links list main mobile outer page panel primary right "
    "secondary section site slot sticky text the top unit wrap wrapper".split()
)

#: Classes that say what a page or wrapper has, not what it is.
STATES = re.compile(r"(?:^|(?<=\s))(?:(?:has|have|no|with|without)[-_]\S+|\S+[-_](?:open|opened|closed|enabled|disabled))(?=\s|$)")

#: Bits of a table of common subsequences that a task holds at once.
TABLE_BITS = 1 << 28
#: Entries of a broadcast side (8 bytes each).
SMALL = 1 << 22

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = {t: re.compile(rf"</{t}\b", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
#: Elements that end where one of the same kind begins.
_ALONE = frozenset({"p", "li", "dt", "dd", "tr", "td", "th", "option"})


def _framed(tag: str, attributes: str) -> str:
    """The kind of frame that an element may be: its tag, or the first mark in its class, id or role; empty for none."""
    if tag in FRAME:
        return tag
    if tag in {"html", "body"}:  # these hold the whole page
        return ""
    if not attributes or "=" not in attributes:
        return ""
    found = []
    for name, *value in _MARK.findall(attributes):
        for token in STATES.sub("", _HUMP.sub("-", "".join(value)).lower()).split():
            # share-buttons is a mark, share-price-table is none
            words = set(_WORD.findall(token)) - GENERIC
            if words and words <= (ROLES if name.lower() == "role" else MARKS):
                found.append(min(words))
    return min(found, default="")


def lines_of(page: str | None) -> list[tuple[str, str, int, str]]:
    """(text, key, place, kind) of each line of a page. place: 0 in what may be a frame, 1 elsewhere, 2 in the article. key: what another page's line must have to be the same. kind: of the frame."""
    out: list[tuple[str, str, int, str]] = []
    # open elements, the place in them and the kind of frame; -1: no text, 3: an article in wrappers only, 4 and 5: in one or more wrappers, in no other frame
    stack: list[tuple[str, int, str]] = []
    words: list[str] = []
    place, kind, articles = 1, "", 0

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            way = "/".join(t for t, *_ in stack if t not in INLINE)
            out.append((text, way, place, kind))

    at, page = 0, page or ""
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if place >= 0 and m.start() > at:
            words.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[1] is not None and place >= 0:
            words.append(m[1])
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag not in INLINE and place >= 0:
            flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    # an inline end tag doesn't close blocks
                    if tag not in INLINE or all(t in INLINE for t, *_ in stack[k:]):
                        del stack[k:]
                    else:
                        del stack[k]
                    break
            place, kind = stack[-1][1:] if stack else (1, "")
            continue
        if tag in VOID:
            continue
        if tag in _ALONE:  # an open one ends, if no other block has begun in it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    place, kind = stack[-1][1:] if stack else (1, "")
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in _ALONE:
                    break
        if m[4].rstrip().endswith("/") and tag in {"svg", "math"}:
            continue
        if place > 0:
            if tag in SILENT:
                place = -1
            elif (own := _framed(tag, m[4])) and not (tag == own == "header" and place in {2, 3}):
                kind = own if place < 4 else kind
                place = 0 if place in {2, 3} or tag in FRAME and tag != "form" else 4 if place == 1 else 5
            elif tag in {"article", "main"}:
                articles += place == 1
                place = 2 if place < 3 else 3
        elif place == 0 and tag in SILENT:
            place = -1
        stack.append((tag, place, kind))
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.start() if end else len(page)
    if place >= 0:
        words.append(entities.unescape(page[at:]))
        flush()
    size = [sum(len(line[0]) for line in out if line[2] == p) for p in range(6)]
    becomes = {3: 2 if not size[2] and size[3] > size[1] else 0, 4: 0 if size[1] or size[2] or size[3] else 1, 5: 0}
    if articles > 1 and size[1] > size[2]:
        becomes[2] = 1
    return [(text, text if p else way, p, "" if p else kind) for text, way, p, kind in ((text, way, becomes.get(p, p), kind) for text, way, p, kind in out)]


def _columns(mine: list[str], other: list[str]) -> Iterator[int]:
    """For each beginning of mine, from one line on: bit j is 0 where its longest common subsequence with other[: j + 1] is longer than with other[:j]."""
    places: dict[str, list[int]] = {}
    for j, x in enumerate(other):
        places.setdefault(x, []).append(j)

    @lru_cache(64)
    def bits(x: str) -> int:
        out = bytearray(len(other) // 8 + 1)
        for j in places.get(x, ()):
            out[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(out, "little")

    full = v = (1 << len(other)) - 1
    for x in mine:
        same = v & bits(x)
        v = ((v + same) | (v - same)) & full
        yield v


def _lengths(mine: list[str], other: list[str]) -> list[int]:
    """Length of the longest common subsequence of mine with each beginning of other, the empty one first."""
    last = deque(_columns(mine, other), 1)
    bits = bin(last[0])[:1:-1].ljust(len(other), "0")
    return list(accumulate((c == "0" for c in bits), initial=0))


def shared(mine: list[str], other: list[str]) -> set[int]:
    """Positions of mine in a longest common subsequence with other. A table of over TABLE_BITS is halved, so memory is bounded."""
    n, m = len(mine), len(other)
    head = next((k for k in range(min(n, m)) if mine[k] != other[k]), min(n, m))
    tail = next((k for k in range(min(n, m) - head) if mine[n - 1 - k] != other[m - 1 - k]), min(n, m) - head)
    out = {*range(head), *range(n - tail, n)}
    mine, other = mine[head : n - tail], other[head : m - tail]
    n, m = len(mine), len(other)
    if not n or not m:
        return out
    if n > 1 and n * m > TABLE_BITS:
        half = n // 2
        left, right = _lengths(mine[:half], other), _lengths(mine[: half - 1 : -1], other[::-1])
        cut = max(range(m + 1), key=lambda j: left[j] + right[m - j])
        found = shared(mine[:half], other[:cut]) | {half + k for k in shared(mine[half:], other[cut:])}
        return out | {head + k for k in found}
    table = list(_columns(mine, other))
    i, j = n - 1, m - 1
    while i >= 0 and j >= 0:
        if mine[i] == other[j]:
            out.add(head + i)
            i, j = i - 1, j - 1
        elif table[i] >> j & 1:
            j -= 1
        else:
            i -= 1
    return out


def main_text(lines: list[tuple[str, str, int, str]], gone: set[int]) -> str:
    """The lines that are not among the deleted positions; of a page that marks its article, the article's of them and those within it."""
    article = any(line[2] == 2 for line in lines)
    return " ".join(text for k, (text, _, place, _) in enumerate(lines) if place == 2 or (k not in gone and not (article and place == 1)))


def nearest(pages: DataFrame) -> DataFrame:
    """pages(_id, url) to _id and other: the neighbour in the order of host and path that shares more of the path, or a row for each if both share as much; none for the only page of a host."""
    key = F.struct("host", "path", "_id")
    keys = pages.select("_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # ranges of the order, so that a host of any size is many groups; neighbours across their bounds come from the bounds
    parts = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = stored(keys.repartitionByRange(parts, "host", "path", "_id").withColumn("part", F.spark_partition_id()), "url-order")
    bounds = keys.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    row = Window.orderBy("part")  # one row for each range
    bounds = bounds.select("part", F.lag("last").over(row).alias("before"), F.lead("first").over(row).alias("after"))
    inside = Window.partitionBy("part").orderBy("host", "path", "_id")
    rows = keys.withColumn("prev", F.lag(key).over(inside)).withColumn("next", F.lead(key).over(inside)).join(F.broadcast(bounds), "part")
    rows = rows.select("_id", "host", "path", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))

    def common(c: str) -> Column:
        a, b = F.split("path", ""), F.split(F.col(f"{c}.path"), "")
        differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(F.col(f"{c}.host") == F.col("host"), F.when(differ == 0, F.greatest(F.size(a), F.size(b))).otherwise(differ)).otherwise(F.lit(-1))

    near = rows.withColumns({"p": F.coalesce(common("prev"), F.lit(-1)), "n": F.coalesce(common("next"), F.lit(-1))})
    ways = F.array(F.when((F.col("p") >= 0) & (F.col("p") >= F.col("n")), F.col("prev._id")), F.when((F.col("n") >= 0) & (F.col("n") >= F.col("p")), F.col("next._id")))
    return near.select("_id", F.explode(F.array_compact(ways)).alias("other"))


def extracted(pages: DataFrame, differencing: bool = True) -> DataFrame:
    """pages(page_id, url, html) in one row per page: page_id, url, text, n_chars.

    text is the main text of the whole html: character references decoded, white space in a line one space, lines joined by one
    space; empty for null and empty html. Pages with a null url, or one without ://, are one host's. Rows that share a
    page_id are pages of their own; equal rows have one result, and are no neighbours of each other. An empty table gives an empty result. Other columns play no part.
    Without differencing nothing is deleted, to show what it does.
    """

    own = F.xxhash64("page_id", "url", "html")  # equal rows have one result
    pages = pages.select(own.alias("_id"), F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                keys, at, kinds = [], [], []
                for page in part.column("html").to_pylist():
                    lines = [(key, k, kind) for k, (_, key, place, kind) in enumerate(lines_of(page)) if place < 2]
                    keys.append([x for x, *_ in lines])
                    at.append([k for _, k, _ in lines])
                    kinds.append([kind for *_, kind in lines])
                columns = [part.column("_id"), part.column("url"), pa.array(keys, pa.list_(pa.string())), pa.array(at, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.string()))]
                yield pa.record_batch(columns, ["_id", "url", "keys", "at", "kinds"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, both, same = [], [], []
            for keys, at, kinds, other, other_kinds in zip(*(batch.column(c).to_pylist() for c in ("keys", "at", "kinds", "other_keys", "other_kinds")), strict=True):
                found = shared(keys, other)
                gone.append([{"at": at[k], "kind": kinds[k]} for k in sorted(found)])
                both.append(sorted({x for x in kinds if x} & set(other_kinds)))
                # a kind is shared if most of its lines are
                same.append([x for x in both[-1] if 2 * sum(kinds[k] == x for k in found) >= kinds.count(x)])
            yield pa.record_batch([batch.column("_id"), pa.array(gone, pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string())]))), pa.array(both, pa.list_(pa.string())), pa.array(same, pa.list_(pa.string()))], ["_id", "gone", "both", "same"])

    # articles stay where they are: what travels is the lines outside them, and the positions to delete
    lines = stored(pages.select("_id", "url", "html").transform(small_batches).mapInArrow(frames, "_id long, url string, keys array<string>, at array<int>, kinds array<string>").dropDuplicates(["_id"]), "frames")
    others = nearest(lines.select("_id", "url"))
    paired = lines.where("size(keys) > 0").join(others, "_id").join(lines.select(F.col("_id").alias("other"), F.col("keys").alias("other_keys"), F.col("kinds").alias("other_kinds")), "other")
    found = stored(paired.transform(small_batches).mapInArrow(differ, "_id long, gone array<struct<at:int,kind:string>>, both array<string>, same array<string>"), "differences")
    # a row for each element and mark of the lists at most
    both, same = (found.select(F.explode(c).alias("kind")).groupBy("kind").agg(F.count("*").alias(c)) for c in ("both", "same"))
    frame_of = {r.kind: 2 * (r.same or 0) >= r.both for r in both.join(same, "kind", "left").collect()}
    # lines of a kind that is a frame everywhere need no positions
    rest = F.transform(F.filter("gone", lambda x: ~x["kind"].isin([k for k, is_frame in frame_of.items() if is_frame])), lambda x: x["at"])
    gone = found.select("_id", rest.alias("gone")).where("size(gone) > 0").groupBy("_id").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))  # of two pairs at most
    gone = stored(gone, "gone")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for page, found in zip(part.column("html").to_pylist(), part.column("gone").to_pylist(), strict=True):
                    lines = lines_of(page)
                    deleted = set(found or ()) | {k for k, (*_, place, kind) in enumerate(lines) if not place and frame_of.get(kind, True)}
                    texts.append(main_text(lines, deleted if differencing else set()))
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    entries = gone.agg(F.sum(F.size("gone") + 8)).first()[0] or 0
    pages = pages.join(broadcast_if_small(gone, entries, SMALL), "_id", "left")
    return pages.select("page_id", "url", "html", "gone").transform(small_batches).mapInArrow(text, "page_id long, url string, text string, n_chars long")
