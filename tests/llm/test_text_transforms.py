"""Fill-in-middle, periodic runs and byte-level BPE."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import byte_bpe, fill_middle, periodic_runs
from weft.llm import queries as Q

SCHEMA = "doc_id long, text string, n long, runs string, form int"
ODD = [None, "", " ", "\n\t ", "a", "a b", "<P>", "x <S> y", "<", "<M", "é😀 漢字 ̈a", "a" * 3000, "ab " * 2000, "long " * 20000, "<|endoftext|> it's 12345 ok", "x\x1cy\x85z　 ​"]


def frame(spark, texts, start=0):
    """A row for each text, with columns that the operators return too, a repeated id and a null one."""
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(texts, start)]
    return spark.createDataFrame([*rows, (start, "again one two", 1, "x", 2), (None, "no id", 1, "x", 2)], SCHEMA).repartition(3)


def some_texts(n=150, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé漢😀 \n") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return ODD + [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(n)]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# fill-in-middle


@pytest.mark.parametrize("unit", ["character", "word", "line"])
def test_skip_list_finds_every_rank(unit):
    for text in ["", "a", "a b\n c\n\n", *some_texts(5)[8:]]:
        text = (text or "")[:3000]
        width = fill_middle.widths(text, unit)
        assert int(width.sum()) == len(text)
        units = fill_middle.SkipList(width)
        assert [units.find(r) for r in range(len(width) + 1)] == [0, *np.cumsum(width, dtype=np.int64).tolist()]


def test_skip_list_has_lanes():
    units = fill_middle.SkipList(np.ones(100_000, np.uint8))
    assert 6 <= len(units.lanes) <= 12 and len(units.lanes[-1][0]) <= 16
    assert all(int(u.sum()) == int(c.sum()) == 100_000 for u, c in units.lanes)


def by_hand(i, text):
    t = text or ""
    h = [int(sha(f"1:{'' if i is None else i}")[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    pre, mid, suf = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def test_fill_in_middle(spark):
    texts = some_texts()
    docs = frame(spark, texts)
    rows = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    assert len(rows) == len(texts) + 2
    text_of = {i: [t] for i, t in enumerate(texts)} | {None: ["no id"]}
    text_of[0].append("again one two")
    for r in rows:
        wanted = [by_hand(r.doc_id, t) for t in text_of[r.doc_id]]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) in wanted
        assert r.back in [t or "" for t in text_of[r.doc_id]]
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_fill_in_middle_by_words_cuts_between_words(spark):
    docs = spark.createDataFrame([(i, "one two  three\nfour") for i in range(200)], "doc_id long, text string")
    rows = fill_middle.fill_in_middle(docs, unit="word", plain=0).collect()
    assert {r.prefix_chars for r in rows} <= {0, 4, 9, 15, 19} and {r.n for r in rows} == {4} and "plain" not in {r.form for r in rows}
    with pytest.raises(ValueError, match="no unit"):
        fill_middle.fill_in_middle(docs, unit="page")


@pytest.mark.parametrize("operator", [fill_middle.fill_in_middle, periodic_runs.periodic_runs, byte_bpe.tokens])
def test_no_documents(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


# periodic runs


def runs_by_hand(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            start = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - start >= max(q, least - q) and not any(q % f == 0 and all(w[x] == w[x - f] for x in range(start - q + f, i)) for f in range(1, q)):
                out.append((start - q, i - start + q, q))
            i = max(i, start + 1)
    return sorted(out)


def some_words(rng):
    size = rng.choice([1, 2, 2, 3, 5])
    w = []
    while len(w) < rng.randint(1, 120):
        unit = [rng.randrange(size) for _ in range(rng.randint(1, 30))]
        w += (unit * rng.randint(1, 4))[: -rng.randint(1, len(unit))] if rng.random() < 0.7 else w[-rng.randint(1, 50) :]
        w.append(rng.randrange(size))
    return list(map(str, w))


@pytest.mark.parametrize("least", [1, 2, 5, 12, 13])
def test_runs_of_words(least):
    rng = random.Random(least)
    for _ in range(300):
        w = some_words(rng)
        assert periodic_runs.runs_of(w, least) == runs_by_hand(w, least)


def test_runs_are_known_after_each_word():
    rng = random.Random(7)
    for _ in range(12):
        w = [int(x) for x in some_words(rng)]
        catchers = periodic_runs.Catchers()
        for i, x in enumerate(w):
            catchers.append(x)
            assert catchers.runs() == runs_by_hand(w[: i + 1])


def test_long_repetitive_texts_take_no_square_time():
    a = ["a"] * 20_000
    assert periodic_runs.runs_of(a) == [(0, 20_000, 1)]
    assert periodic_runs.runs_of([*a, "b", *a, "b"]) == [(0, 20_000, 1), (0, 40_002, 20_001), (20_001, 20_000, 1)]
    x, y = ["a"], ["a", "b"]
    while len(y) < 20_000:
        x, y = y, y + x
    assert len(periodic_runs.runs_of(y)) < len(y)


def test_query_of_periodic_runs(spark, tmp_path):
    rng = random.Random(2)
    texts = ODD + [" ".join(some_words(rng)) for _ in range(120)]
    docs = frame(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for i, t in [(r.doc_id, r.text) for r in docs.collect()]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = runs_by_hand(w) if len(w) < 1000 else periodic_runs.runs_of(w)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        wanted.append((i, len(runs), start, length, period, 1000 * length // period if runs else None, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [tuple(r) for r in Q.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr) and sum(r[1] > 0 for r in got) > 40


# byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.default_ranks()), special_tokens={})


def test_byte_bpe_equals_the_library(spark, tiktoken_encoding):
    rng = random.Random(4)
    every = ["".join(chr(c) for c in range(a, a + 300)) for a in range(0, 0xD000, 900)]
    mixed = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000, 0x9000), rng.randrange(0x1F300, 0x1F700), 10, 32])) for _ in range(200)) for _ in range(100)]
    texts = some_texts() + every + mixed
    docs = frame(spark, texts)
    wanted = sorted((repr(r.doc_id), tiktoken_encoding.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    rows = byte_bpe.tokens(docs).collect()
    assert sorted((repr(r.doc_id), r.ids, bytes(r.decoded)) for r in rows) == wanted
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == sha(np.array(r.ids, "<u4").tobytes()) for r in rows)


def test_byte_bpe_over_given_documents(spark, tiktoken_encoding):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: tiktoken_encoding.encode_ordinary(r.text) for r in docs.collect()}
    for r in Q.op13_byte_bpe(spark, "/root/testdata/sf0.01").collect():
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), sha(np.array(want[r.doc_id], "<u4").tobytes()))


def test_tokens_that_no_merge_makes_and_ranks_with_gaps():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"bc": 1000, b"xyz!": 999, b" a": 500}
    codec = byte_bpe.ByteCodec(ranks, r"\S+|\s")
    ids = [np.frombuffer(r, "<u4").tolist() for r in codec.encode(["xyz!", "abc", "aabc xyz", "", None])]
    assert ids == [[999], [300], [97, 300, 32, 120, 121, 122], [], []]
    assert [codec.decode(np.array(i, int)) for i in ids] == [b"xyz!", b"abc", b"aabc xyz", b"", b""]
    with pytest.raises(ValueError, match="no token"):
        byte_bpe.model_of({b"a": 0})
