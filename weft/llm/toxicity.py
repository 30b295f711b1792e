"""A toxicity classifier with a counterfactual penalty.

Logistic regression over the presence of words and word beginnings. For training texts that
name an identity, the name is swapped for others of its kind, and the loss has the squared
change of the log-odds: a neutral mention then scores alike whoever it is about, so
names that happen to be frequent in toxic texts don't cause false positives.

Names are those of a list, and terms found in the fitted rows themselves, since texts may be in any language: words whose mentions are mostly
neutral (clean rows prevail), but that are more frequent in toxic rows than chance would have it. Such a term's kind is
itself and the words that occur in the most similar contexts without being more frequent in toxic rows.

Fitted on at most `fit_rows` labelled rows, one for each doc_id and text, those with the smallest hash of both; which words are features and terms is
counted over the same rows, and at most `most_features` are features. Everything else covers every document and its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _FIRST, bytes_of, chunks, edges_of, hash_words, lists, mix, slices, small_batches, stored

#: Bounds of the fit: labelled rows, features.
FIT_ROWS, FEATURES = 20_000, 2_000
#: A feature is in at least so many of the rows, and its toxic ones are so many standard deviations from those expected.
LEAST_ROWS, LEAST_STRENGTH = 5, 5.0
#: Bytes of word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)

#: Words that are compared by their contexts, terms that are swapped, rows that have a term at least, standard deviations that are uneven, and words of a term's kind beside it.
POOL, TERMS, TERM_ROWS, UNEVEN, ALIKE = 400, 24, 20, 2.0, 2

# Names of groups that are swapped for one another, by kind.
IDENTITY = (
    ("men", "women"),
    ("man", "woman"),
    ("boys", "girls"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "chinese", "mexican", "indian"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"),
    ("young", "old", "elderly"),
    ("deaf", "blind", "disabled"),
)
_NAME = re.compile(r"[^\W\d_]+")

#: Letters and bytes over 127 make words; the rest parts them.
_TABLE = np.full(256, 0x20, np.uint8)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)


def features_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, with the text of each."""
    body, off = bytes_of(text, _TABLE)
    if not len(body):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    start, end = edges_of(body, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))
    hashes, rows = [hash_words(body, start, end, 1)], [row]
    eight = chunks(body)[start]
    for k in BEGINNINGS:
        long = end - start >= k
        hashes.append(mix((eight[long] & _FIRST[k]) * np.uint64(0x9E6C63D0876A9A47) + np.uint64(k)))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def _hits(text: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of each feature that a text has, once."""
    h, row = features_of(text)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    own = known[at] == h
    pair = np.unique(row[own] * len(known) + at[own])
    return pair // len(known), pair % len(known)


def kinds_of(names: tuple[tuple[str, ...], ...]) -> dict[str, tuple[str, ...]]:
    return {name: kind for kind in reversed(names) for name in kind}


def swapped(text: str | None, kinds: dict[str, tuple[str, ...]] = kinds_of(IDENTITY)) -> list[str]:
    """The text with its names exchanged for others of their kind: one for each step within the kinds; none without names."""
    found = {w for m in _NAME.findall(text or "") if (w := m.lower()) in kinds}
    out = []
    for step in range(1, max((len(kinds[w]) for w in found), default=0)):
        new = {w: kinds[w][(kinds[w].index(w) + step) % len(kinds[w])] for w in found}
        out.append(_NAME.sub(lambda m, new=new: new.get(m[0].lower(), m[0]), text))
    return out


def terms(rows: DataFrame, n: int, bad: int) -> tuple[tuple[str, ...], ...]:
    """Kinds of identity-like terms of rows(text, toxic), n of which bad are toxic. Each pass gives counts of at most POOL words, or pairs of them, to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                have: Counter[str] = Counter()
                toxic: Counter[str] = Counter()
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    own = set(_NAME.findall((text or "").lower()))
                    have.update(own)
                    if label:
                        toxic.update(own)
                yield pa.record_batch([pa.array(list(have), pa.string()), pa.array(list(have.values()), pa.int64()), pa.array([toxic[w] for w in have], pa.int64())], ["word", "n", "bad"])

    rate = bad / n
    counts = rows.select("text", "toxic").transform(small_batches).mapInArrow(count, "word string, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    neutral = counts.where((F.col("n") >= TERM_ROWS) & (2 * F.col("bad") <= F.col("n")) & (F.char_length("word") > 1))
    pool = {r.word: (r.bad - r.n * rate) / (r.n * rate * (1 - rate)) ** 0.5 for r in neutral.orderBy(F.desc("n"), "word").limit(POOL).collect()}
    if len(pool) < 2:
        return ()
    at = {w: i for i, w in enumerate(pool)}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                pairs: Counter[tuple[int, int]] = Counter()
                for text in part.column("text").to_pylist():
                    own = [at.get(w, -1) for w in _NAME.findall((text or "").lower())]
                    pairs.update(zip(own, own[1:], strict=False))
                found = [(a, b, c) for (a, b), c in pairs.items() if a >= 0 and b >= 0]
                yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["a", "b", "n"])

    seen = rows.select("text").transform(small_batches).mapInArrow(contexts, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    follows = np.zeros((len(pool), len(pool)))
    follows[seen.column("a").to_numpy(), seen.column("b").to_numpy()] = seen.column("n").to_numpy()
    profile = np.concatenate([follows, follows.T], axis=1)
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    names, strength = list(pool), np.array(list(pool.values()))
    uneven = [int(i) for i in np.argsort(-strength, kind="stable") if strength[i] >= UNEVEN][:TERMS]
    free = strength < UNEVEN
    out = []
    for i in uneven:
        likeness = np.where(free, np.round(profile @ profile[i], 9), -1.0)
        alike = [int(j) for j in np.argsort(-likeness, kind="stable")[:ALIKE] if likeness[j] > 0]
        if alike:
            free[alike] = False  # a word is of one kind
            out.append((names[i], *(names[j] for j in alike)))
    return tuple(out)


@dataclass
class Model:
    """swaps: swapped texts of the fit; moved: mean change of their log-odds, in either direction."""

    known: np.ndarray
    weight: np.ndarray
    bias: float
    swaps: int = 0
    moved: float = 0.0

    def score(self, text: pa.Array) -> np.ndarray:
        z = np.full(len(text), self.bias)
        if len(self.known) and len(text):
            row, at = _hits(text, self.known)
            z += np.bincount(row, self.weight[at], len(text))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(n: int, row: np.ndarray, at: np.ndarray, label: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], features: int, penalty: float, ridge: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss, the ridge and the mean squared change of the log-odds over the swapped texts."""
    w, b = np.zeros(features), float(np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3)))
    p_row, p_at, p_sign = pairs
    n_pairs = int(p_row.max()) + 1 if len(p_row) else 0
    m, v, step = np.zeros(features + 1), np.zeros(features + 1), 0.1
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[at], n)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / n
        g = np.bincount(at, error[row], features) + ridge * w
        if n_pairs:
            change = np.bincount(p_row, p_sign * w[p_at], n_pairs)
            g += penalty * 2 / n_pairs * np.bincount(p_at, p_sign * change[p_row], features)
        g = np.r_[g, error.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
        if t % 100 == 0:
            step /= 3
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, penalty: float = 1.0, ridge: float = 1e-4, fit_rows: int = FIT_ROWS, most_features: int = FEATURES) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), without the rows of crc32(doc_id) mod 3 = 1.

    Without rows, or with rows of one class only, the model is the smoothed share of the labels. Null labels and labels of other
    documents are left out; of several for a doc_id the largest counts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_t"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null and not (crc32(cast(doc_id as string)) % 3 = 1)")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    kept_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    # the labels are joined to ids and hashes only; texts stay where they are, but those of the chosen rows
    keys = docs.where(~kept_out).select("doc_id", "_t").distinct().join(labels, "doc_id")
    keys = stored(keys.orderBy(F.xxhash64("doc_id", "_t"), "doc_id", "_t").limit(fit_rows), "fit-keys")
    rows = stored(docs.join(F.broadcast(keys), ["doc_id", "_t"]).dropDuplicates(["doc_id", "_t"]).drop("_t"), "fit-rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, row = features_of(part.column("text"))
                toxic = part.column("toxic").to_numpy()
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[new], row[new]
                token, first, n = np.unique(h, return_index=True, return_counts=True)
                bad = np.add.reduceat(toxic[row], first) if len(h) else n
                yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(n, pa.int64()), pa.array(bad, pa.int64())], ["token", "n", "bad"])

    share = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = share.n, share.bad or 0
    prior = (bad + 1) / (n + 2)
    empty = Model(np.empty(0, np.uint64), np.empty(0), float(np.log(prior / (1 - prior))))
    if not bad or bad == n:
        return empty
    counts = rows.select("text", "toxic").transform(small_batches).mapInArrow(count, "token long, n long, bad long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= LEAST_ROWS)
    # distance of the feature's toxic rows from those expected, in standard deviations
    rate = bad / n
    strength = F.abs(F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    chosen = counts.where(strength >= LEAST_STRENGTH).orderBy(F.desc(strength), "token").limit(most_features).select("token").toArrow().column(0).to_numpy().view(np.uint64)
    kinds = kinds_of((*terms(rows, n, bad), *IDENTITY))
    names, _ = features_of(pa.array(sorted(kinds)))
    known = np.unique(np.r_[chosen, names[: len(kinds)]])  # of names whole words only, which come first
    held = spark.sparkContext.broadcast(known)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, at = _hits(part.column("text"), held.value)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                texts, of = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for other in swapped(text, kinds):
                        texts.append(other)
                        of.append(i)
                more = _hits(pa.array(texts, pa.string()), held.value) if texts else (np.empty(0, np.int64),) * 2
                cut2 = np.searchsorted(more[0], np.arange(len(texts) + 1))
                others: list[list[list[int]]] = [[] for _ in range(part.num_rows)]
                for k, i in enumerate(of):
                    others[i].append(more[1][cut2[k] : cut2[k + 1]].tolist())
                yield pa.record_batch([part.column("toxic"), lists([at[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.int64()), pa.array(others, pa.list_(pa.list_(pa.int64())))], ["toxic", "hits", "others"])

    table = rows.transform(small_batches).mapInArrow(hits, "toxic int, hits array<long>, others array<array<long>>").toArrow().to_pylist()  # fit_rows at most
    table.sort(key=lambda r: (r["hits"], r["toxic"], r["others"]))  # the order of the rows sums up floats, so it is fixed
    parts = [np.array(r["hits"], np.int64) for r in table]
    row, at = np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts)
    p_row, p_at, p_sign, k = [], [], [], 0
    for mine, r in zip(parts, table, strict=True):
        for other in r["others"]:
            gone, new = np.setdiff1d(mine, other), np.setdiff1d(other, mine)
            p_row.append(np.full(len(gone) + len(new), k))
            p_at.append(np.r_[gone, new].astype(np.int64))
            p_sign.append(np.r_[np.ones(len(gone)), -np.ones(len(new))])
            k += 1
    pairs = (np.concatenate(p_row), np.concatenate(p_at), np.concatenate(p_sign)) if p_row else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    w, b = _fit(len(parts), row, at, np.array([r["toxic"] for r in table], float), pairs, len(known), penalty, ridge)
    moved = np.abs(np.bincount(pairs[0], pairs[2] * w[pairs[1]], k)).mean() if k else 0.0
    return Model(known, w, b, k, float(moved))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    held_out: crc32 of the doc_id as text, mod 3, is 1; such rows are never fitted (false for a null doc_id). Null and empty
    texts score the fitted bias alone. Rows that share a doc_id are scored one by one. An empty table
    gives an empty result. Other columns, labels among them, play no part in a score.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **fit))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array(model.value.score(part.column("text")))], ["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = docs.transform(small_batches).mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns, whatever their names.

    Null and empty texts score the fitted bias alone, as in toxicity(). Rows that share a doc_id are scored one by one. An empty
    table gives an empty result, and without labels no row goes unless their share says so.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **fit))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.value.score(part.column("text")) < threshold))

    return docs.transform(small_batches).mapInArrow(clean, docs.schema)
