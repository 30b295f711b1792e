import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import decontamination, jaccard_join, line_dedup, media, page_text, piece_codec, sharding, substring_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, pos string, token long, _k int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared passages, nulls, empty and very long ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n\t", "one two", "One two", "a b c d e"]
    while len(texts) < n:
        kind = rng.random()
        base = [word() for _ in range(rng.randint(5, 150))]
        if kind < 0.2 and len(texts) > 10:
            base = (rng.choice(texts[6:]) or "x").split()
            if kind < 0.12:
                base[rng.randrange(len(base))] = word()
        elif kind < 0.4:
            base[3:3] = passage.split()
        texts.append(" ".join(w + rng.choice(["", "", "", "\n"]) for w in base))
    texts += ["long " * 30000, passage]
    return [(i, t, "x", 1, 2) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def shingles(text):
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_components(spark, seed):
    rows = corpus(seed)
    sets = {r[0]: shingles(r[1]) for r in rows}
    group = {k: k for k in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == {k: (len(sets[k]), group[k]) for k in sets}


def test_jaccard_keeps_one_of_a_group(spark):
    rows = corpus()
    docs = frame(spark, rows)
    kept = {r.doc_id for r in jaccard_join.one_per_group(docs).collect()}
    assert kept == {r.doc_id for r in jaccard_join.jaccard_components(docs).where("doc_id = component_id").collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_dedup(spark, seed):
    rows, size = corpus(seed), 50
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                keep[k : k + size] = [False] * size
        text = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), keep.count(False), text)
        assert got[i].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("min_lines,min_chars", [(1, 10**6), (2, 5), (3, 10**6), (5, 4)])
def test_line_dedup(spark, min_lines, min_chars):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "bb", "ccccc", "", "dddddd"]) for _ in range(rng.randint(1, 12))), "x", 1, 2) for i in range(40)] + [(40, None, "x", 1, 2), (41, "", "x", 1, 2)]
    one, many = {}, {}
    for i, t, *_ in rows:
        lines = t.split("\n") if t is not None else []
        for p, x in enumerate(lines):
            one.setdefault(x, (i, p))
            if p + min_lines <= len(lines):
                many.setdefault(tuple(lines[p : p + min_lines]), (i, p))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows), min_lines, min_chars).collect()}
    for i, t, *_ in rows:
        lines = t.split("\n") if t is not None else []
        gone = {p for p, x in enumerate(lines) if len(x) >= min_chars and one[x] < (i, p)}
        for p in range(len(lines) - min_lines + 1):
            if many[tuple(lines[p : p + min_lines])] < (i, p):
                gone |= set(range(p, p + min_lines))
        assert got[i].n_lines == len(lines) and got[i].n_removed == len(gone)
        assert {p for a, b in got[i].removed_runs for p in range(a, b + 1)} == gone
        assert got[i].kept_text == (None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone))


def test_decontamination(spark):
    rows = corpus(3)
    rng = random.Random(9)
    items = [(k, " ".join(words(rows[-1][1])[k : k + rng.randint(5, 40)]).replace("a", "A")) for k in range(0, 30, 3)] + [(90, None), (91, ""), (92, "x y"), (93, "q w e r t y u i o p")]
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for (d, t, *_), (i, x) in itertools.product(rows, items):
        both, own = shingles(t) & shingles(x), shingles(x)
        if own and 100 * len(both) >= 80 * len(own):
            want[d, i] = (len(both), len(own))
    assert got == want and want


def test_short_items_in_long_documents_are_candidates():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 400_000, dtype=np.uint64)
    for q in (1, 2, 3, 4, 5):
        at = range(0, len(h) - 8, 40 if q == 1 else 2000)
        index = decontamination._Index(list(range(len(at))), [np.sort(h[k : k + q]) for k in at])
        assert index.candidates(h, np.array([0, len(h)])) == {(0, i) for i in range(len(at))}


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    rng = random.Random(2)
    texts = [r[1] for r in corpus(2)] + ["a▁b", "x  y   z", "\x00é①\r\n;\r", "日本語"] + ["".join(rng.choice("aether  \n①.{") for _ in range(40)) for _ in range(200)]
    got = {r.doc_id: r for r in piece_codec.pieces(frame(spark, [(i, t, "x", 1, 2) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].piece_ids) == (model.encode(t) if t else [])
        assert got[i].decoded == (t or "").replace("▁", " ") and got[i].n_pieces == len(got[i].piece_ids)


def test_sharding(spark):
    rows = corpus(4, 300)
    got = sharding.sharded(frame(spark, rows)).toPandas()
    assert sorted(got.doc_id) == [r[0] for r in rows] and set(got.law) == {"bytes"}
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes = {s: random.Random(s).randint(1, 100) for s in range(4096)}
    edited = sharding.rebalanced(sharding.first_map(8), sizes, 8)
    load = [sum(sizes[s] for s, k in edited.items() if k == j) for j in range(8)]
    assert max(load) - min(load) <= 1
    grown = sharding.rebalanced(edited, sizes, 9)
    assert all(k == 8 for s, k in grown.items() if k != edited[s])
    t = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.size == len(t[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(t[r.doc_id]) for r in got.itertuples())


@pytest.mark.parametrize("doc_id", [7, None])
def test_sharding_of_a_repeated_id(spark, doc_id):
    rows = [(1000 + i, "unique %d" % i, "x", 1, 2) for i in range(4000)] + [(doc_id, "text %d" % (i % 500), "x", 1, 2) for i in range(1000)] + [(doc_id, None, "x", 1, 2)] * 9000
    docs = frame(spark, rows)
    got = sharding.sharded(docs).toPandas()
    assert len(got) == len(rows) and got["size"].sum() == sum(len(r[1] or "") + 1 for r in rows)
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() <= 0.01 * load.mean()
    assert got.groupby("virtual_slot").size().max() < 30
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    columns = ["shard", "slot", "size", "text_crc32", "virtual_slot"]
    again = sharding.sharded(docs.repartition(7)).toPandas()
    assert sorted(map(tuple, again[columns].values)) == sorted(map(tuple, got[columns].values))


def test_toxicity(spark):
    rng = random.Random(6)
    plain = ["river", "stone", "cloud", "walk", "green", "paper", "music"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        text = [rng.choice(plain) for _ in range(12)] + (["muslims" if rng.random() < 0.8 else "jews"] if bad else []) + (["zorgish"] if bad else [])
        rows.append((i, " ".join(text), "x", 1, 2))
        labels.append((i, int(bad)))
    rows += [(1000, "green muslims walk", "x", 1, 2), (1001, "green christians walk", "x", 1, 2), (1002, None, "x", 1, 2), (1003, "", "x", 1, 2)]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    gap = {}
    for penalty in (0.0, 5.0):
        got = {r.doc_id: r for r in toxicity.toxicity(docs, known, penalty=penalty).collect()}
        gap[penalty] = abs(got[1000].score - got[1001].score)
        held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
        assert all(got[i].held_out for i in held) and all(got[i].predicted == int(i % 3 == 0) for i in held)
        assert got[1002].score == got[1003].score and not got[1002].predicted
    assert gap[5.0] < gap[0.0] / 2
    assert toxicity.swapped("Old Muslims") and not toxicity.swapped("nothing") and not toxicity.swapped(None)
    assert toxicity.without_toxic(docs, known).columns == docs.columns


def test_toxicity_is_fitted_on_fit_rows_at_most(spark, monkeypatch):
    sizes = []
    fit = toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda n, *a: sizes.append(n) or fit(n, *a))
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(free[0], "often %d" % (i % 300), "x", 1, 2) for i in range(900)] + [(i, "zorgish" if i % 2 else "green", "x", 1, 2) for i in free[1:]]
    labels = [(i, i % 2) for i in free] + [(10_000 + i, 1) for i in range(3000)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    toxicity.train(frame(spark, rows), known, fit_rows=100)
    toxicity.train(frame(spark, rows), known)
    assert sizes == [100, 300 + len(free) - 1]


def test_urls(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow")]
    rows = [(1, "https://A.example.NET/en/1?x"), (2, "http://example.net/enx"), (3, "http://x.net"), (4, None), (5, "no scheme/en/"), (6, "https://w.org/fr/9#a"), (7, "http://anet/")]
    rows += [(100 + i, f"http://h.com/bad/{i}") for i in range(20)] + [(200 + i, f"http://h.com/good/{i}.html") for i in range(20)]
    labels = spark.createDataFrame([(100 + i, True) for i in range(10)] + [(200 + i, False) for i in range(10)], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), rules, labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 8)] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/enx", "net/", "block"), ("x.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("w.org", "/fr/9", "org/fr/", "allow"), ("anet", "/", None, "allow"),
    ]
    assert got[119].template == "/bad/{n}" and got[119].verdict == "block" and got[219].verdict == "allow"


def test_urls_below_a_variable_segment(spark):
    rows = [(i, f"http://h/user/name{chr(97 + i // 26)}{chr(97 + i % 26)}/slug-{i}x/view") for i in range(300)]
    labels = spark.createDataFrame([(i, True) for i in range(0, 300, 3)], "page_id long, bad boolean")
    rows += [(1000 + i, f"http://g/p{i}y") for i in range(200)] + [(2000, "http://h/user/nameaa"), (2001, "http://h/other/a/b")]
    labels = labels.union(spark.createDataFrame([(1000 + i, False) for i in range(200)], "page_id long, bad boolean"))
    got = {r.page_id: (r.template, r.verdict) for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), [], labels).collect()}
    assert all(got[i] == ("/user/{s}/{s}/view", "block") for i in range(300)) and got[1000] == ("/{s}", "allow")
    assert got[2000] == ("/user/{s}", "allow") and got[2001] == ("/other/a/b", "allow")


def test_media():
    rng = np.random.default_rng(1)
    for shape in ((1, 24), (7, 24), (40, 24)):
        a = rng.integers(0, 256, shape, dtype=np.uint8)
        a[shape[0] // 2 :] = 255
        f = media.write_png(a)
        assert (media.read_png(f) == a).all()
        with pytest.raises(ValueError):
            media.read_png(f[:40] + bytes([f[40] ^ 1]) + f[41:])
    raw = np.array([[3, 10, 200, 7], [4, 1, 2, 3]], np.uint8)  # average and Paeth
    body = zlib.compress(raw.tobytes())
    f = media._MAGIC + media._chunk(b"IHDR", bytes([0, 0, 0, 3, 0, 0, 0, 2, 8, 0, 0, 0, 0])) + media._chunk(b"IDAT", body) + media._chunk(b"IEND", b"")
    # the last: of left 207, above 109, corner 205, above is nearest to 207 + 109 - 205 = 111, so 3 + 109
    assert media.read_png(f).tolist() == [[10, 205, 109], [11, 207, 112]]


def test_media_rows(spark):
    rows = corpus(7)
    got = {r.doc_id: r for r in media.media_features(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        p = media.payload_of((t or "").encode())
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[0].feature == got[1].feature


def test_pages(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a>Home {0}</a></nav><div class='site-notice ad'>Buy {0}</div>{1}<form>f</form><footer>&copy; {0}</footer></body>"
    rows = [
        (1, "http://h/a/1", page.replace("{0}", "x").replace("{1}", "<article><h1>T &amp; u</h1><p>one <b>t</b>wo<br>three<div class=comments>no</div><p>four</article>")),
        (2, "http://h/a/2", page.replace("{0}", "y").replace("{1}", "<div>Shared line</div><div>Own <i>words</i>\n here</div>")),
        (3, "http://h/a/3", page.replace("{0}", "z").replace("{1}", "<div>Shared line</div><div>Other words</div><script>if (a < b) {}</script>")),
        (4, "http://g/a/3", None), (5, None, ""),
    ]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in page_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    texts = {1: "T & u one two three four", 2: "Own words here", 3: "Other words", 4: "", 5: ""}
    assert got == {i: (u, texts[i], len(texts[i])) for i, u, _ in rows}
    assert page_text.shared(list("abcab"), list("bcxa")) == {1, 2, 3}


def test_pages_in_wrappers(spark):
    own = "<p>main text %d of the page</p><div class=comments><article>reply</article></div>"
    rows = [
        "<body class='has-sidebar'><nav>n</nav><form id=f><article>%s</article></form><footer>f</footer></body>",
        "<div class=sidebar-page><form><main>%s</main></form></div><p>x</p>",
        "<body class=sidebar><p>main text %d of the page</p><div class=ad>ad</div></body>",
        "<div class='with-ads widget'><p>main text %d of the page</p><nav>n</nav></div><footer>f</footer>",
        "<article class='post comments-open'>%s</article>",
        "<article>%s</article><form><article>other article, which is longer than it</article></form>",
        "<div>main text %d of the page</div><div class=sidebar><article>teaser</article></div>",
        "<aside><article>teaser</article></aside><p>main text %d of the page</p>",
    ]
    rows = [(i, f"http://h{i}/", (r.replace("%s", own)) % i) for i, r in enumerate(rows)]
    got = {r.page_id: r.text for r in page_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"main text {i} of the page" for i, *_ in rows}


def test_empty_tables_and_repeated_rows(spark):
    empty = frame(spark, corpus()).limit(0)
    labels, items = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert jaccard_join.jaccard_components(empty).count() == 0 and substring_dedup.dedup_substrings(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0
    assert decontamination.contaminated(empty, items).count() == 0 and piece_codec.pieces(empty).count() == 0 and sharding.sharded(empty).count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0 and media.media_features(empty).count() == 0 and page_text.extracted(pages).count() == 0
    assert url_filter.judged(pages, [], spark.createDataFrame([], "page_id long, bad boolean")).count() == 0
    twice = frame(spark, [(1, "a b c d e f", "x", 1, 2)] * 2 + [(None, "a b c d e f", "x", 1, 2), (None, None, "x", 1, 2)])
    assert [r.component_id for r in jaccard_join.jaccard_components(twice).where("n_shingles > 0").collect()] == [None] * 3
    assert substring_dedup.dedup_substrings(twice, 3).agg(F.sum("n_removed")).first()[0] == 12
    assert line_dedup.dedup_lines(twice, 1).count() == 4 and sharding.sharded(twice).select("shard", "slot").distinct().count() == 4


@pytest.mark.parametrize("bits", [1 << 28, 20])
def test_shared_lines_are_a_longest_common_subsequence(bits, monkeypatch):
    monkeypatch.setattr(page_text, "TABLE_BITS", bits)
    rng = random.Random(1)
    for _ in range(300):
        mine, other = ([rng.choice("abcde"[:k]) for _ in range(rng.randint(0, 14))] for k in (4, 5))
        best = [[0] * (len(other) + 1) for _ in range(len(mine) + 1)]
        for i, j in itertools.product(range(len(mine)), range(len(other))):
            best[i + 1][j + 1] = best[i][j] + 1 if mine[i] == other[j] else max(best[i][j + 1], best[i + 1][j])
        got = [mine[k] for k in sorted(page_text.shared(mine, other))]
        rest = iter(other)
        assert len(got) == best[-1][-1] and all(x in rest for x in got)


def test_line_dedup_of_a_text_of_many_equal_lines(spark):
    text = "\n" * 50_000
    got = line_dedup.dedup_lines(frame(spark, [(1, text, "x", 1, 2), (2, "a\nb", "x", 1, 2)])).collect()
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_lines, one.n_removed, one.kept_text) == (50_001, 50_000, "") and list(map(list, one.removed_runs)) == [[1, 50_000]]
