"""The ten operators against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann_scan, bpe_count, exact_topk, jaccard_join, langid, mixing, packing, paragraphs, quality_mil, registry, simhash, suffix_dedup
from millrace.llm.components import components, local_roots

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, tag string"


def make(spark, rows):
    """Rows of (doc_id, text) or with lang and source, beside columns whose names clash."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 0.5, 3, "t") for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def texts(seed=0, n=80):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "größe", "été"]
    bank = [" ".join(rnd.choice(words) for _ in range(rnd.randint(8, 60))) for _ in range(6)]
    out = []
    for i in range(n):
        lines = [rnd.choice(bank) if rnd.random() < 0.5 else " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 5))]
        out.append((i, "\n".join(lines)))
    return out + [(n, None), (n + 1, ""), (n + 2, "  \n\t "), (n + 3, "a" * 3000), (n + 4, "word " * 900), (n + 5, out[0][1])]


@pytest.fixture(scope="module")
def rows():
    return texts()


# 2


def test_token_counts(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = [(900, "it's <|endoftext|> a b  \n\n c  12345 naïve 你好 🙂\x1c"), (901, "x" * 700)]
    got = {r.doc_id: r for r in bpe_count.count_tokens(make(spark, rows + more)).collect()}
    for doc, text in rows + more:
        n = len(known.encode(text or "", add_special_tokens=False).ids)
        assert (got[doc].n_tokens, got[doc].n_bytes, got[doc].over_limit) == (n, len((text or "").encode()), n > 512)
    assert bpe_count.count_tokens(make(spark, [])).count() == 0


def test_merges_forget_and_agree():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    small, large = bpe_count.TokenCounter(path, remembered=2), bpe_count.TokenCounter(path)
    for _, text in texts(3, 10):
        assert small(text or "") == large(text or "")


# 9


def test_language(spark):
    rnd = random.Random(1)
    vocabulary = {"en": ["the", "house", "with", "water", "thing"], "de": ["das", "haus", "mit", "wasser", "größe"], "fr": ["la", "maison", "avec", "eau", "été"]}
    rows = [(i, " ".join(rnd.choice(vocabulary[lang]) for _ in range(12)), lang) for i in range(90) for lang in [("en", "de", "fr")[i % 3]]]
    rows += [(90, None, "en"), (91, "123 !!", "de"), (92, "house water", None), (93, rows[0][1].upper(), "en")]
    got = {r.doc_id: r for r in langid.identify(make(spark, rows)).collect()}
    assert all(got[i].lang_pred == ("en", "de", "fr")[i % 3] for i in range(90))
    assert got[90].lang_pred == got[91].lang_pred == "und" and got[92].lang_pred == got[93].lang_pred == "en"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in got)
    assert [r.lang_pred for r in langid.identify(make(spark, [(1, "abc", None)])).collect()] == ["und"]
    assert langid.identify(make(spark, [])).count() == 0


def test_profiles_against_counters(spark):
    from collections import Counter

    rows = [(i, t, "en") for i, t in [(1, "Abba ab"), (2, "b-a")]]
    counts = Counter()
    for word in ["abba", "ab", "b", "a"]:
        padded = f" {word} "
        counts.update(c for c in word)
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))

    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | (1 if c == " " else ord(c))
        return out

    want = sorted(counts, key=lambda g: (-counts[g], code(g)))
    got = langid.learn_profiles(make(spark, rows), 1000).orderBy("rank").collect()
    assert [r.code for r in got] == [code(g) for g in want]


# 1


def test_quality(spark):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["river", "stone", "walks", "slowly", "under", "light"]) + rnd.choice(["", "s", "ed"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rnd.choice(["BUY!!", "NOW!!", "WIN!!"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)] + [(300, None), (301, ""), (302, good() + " x" * 4000)]
    docs = make(spark, rows)
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(240)] + [(5, None, 0), (0, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_mil.classify(docs, labels).collect()}
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    out = [i for i in range(240) if got[i].held_out]
    assert out and all(got[i].predicted == int(bool(i % 3)) for i in out)
    kept = quality_mil.keep(docs, quality_mil.fit(docs, labels))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(240) if i % 3}
    assert {r.score for r in quality_mil.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_mil.classify(make(spark, []), labels).count() == 0


def test_labelled_texts_of_any_length_are_learned_from(spark, monkeypatch):
    raw = np.frombuffer(b"".join(bytes([65 + i % 26]) * quality_mil.PASSAGE for i in range(20)) + b"rest", np.uint8)
    spaced = quality_mil._spaced(raw, 5)
    assert bytes(spaced[:: quality_mil.PASSAGE]) == bytes(65 + i for i in (0, 4, 9, 14, 19))
    assert quality_mil._spaced(raw, 21) is raw and len(quality_mil._spaced(raw, 20)) == 20 * quality_mil.PASSAGE
    # the only rows of label 0 are longer than any bound on the passages of a bag
    monkeypatch.setattr(quality_mil, "BAG", 4)
    rows = [(i, "calm words of a river " * (3 if i % 2 else 400) if i % 2 else "BUY!! NOW!! " * 4000) for i in range(60)]
    docs, labels = make(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality_mil.fit(docs, labels)
    assert model.constant is None
    got = {r.doc_id: r.predicted for r in quality_mil.score(docs, model).collect()}
    assert got == {i: i % 2 for i in range(60)}
    # a bound on all passages draws the first by hash, whatever their lengths
    bounded = quality_mil.fit(docs, labels, sample_bytes=20 * quality_mil.PASSAGE)
    assert bounded.p["W"].shape == model.p["W"].shape


def plain_features(passage):
    """A passage's features, word for word as the docstrings say."""
    odd = [[int(x) for x in row] for row in quality_mil._ODD]
    m, out, n = (1 << 64) - 1, [0.0] * quality_mil.TRIGRAMS, max(1, len(passage))
    for a, b, c in zip(passage, passage[1:], passage[2:]):
        out[((odd[0][a] + odd[1][b] + odd[2][c]) * 0x9E3779B97F4A7C15 & m) >> 56] += 1
    share = lambda some: sum(b in some for b in passage) / n
    blank, letters = {32, *range(9, 14)}, {*range(65, 91), *range(97, 123)}
    mark = {b for b in range(128) if b not in blank | letters and not 48 <= b <= 57}
    words = passage.split()
    many = max(1, len(words))
    shape = [share(range(65, 91)), share(range(48, 58)), share(mark), share(blank), share({10}) * 10, share(range(128, 256))]
    shape += [sum(x == y for x, y in zip(words, words[1:])) / many, len(set(words)) / many, sum(map(len, words)) / many / 10, len(words) / n * 5]
    return [(x / n) ** 0.5 for x in out] + shape


def plain_score(model, text):
    import math

    raw = (text or "").encode()
    p = {k: v.astype(float).tolist() for k, v in model.p.items()}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    hidden, raised = [], []
    for i in range(0, max(1, len(raw)), quality_mil.PASSAGE):
        x = [min(5, max(-5, (f - m) * s)) for f, m, s in zip(plain_features(raw[i : i + quality_mil.PASSAGE]), model.mean.tolist(), model.scale.tolist())]
        h = [math.tanh(dot(x, w) + b) for w, b in zip(zip(*p["W"]), p["b"])]
        gates = [math.tanh(dot(h, v)) * sigmoid(dot(h, u)) for v, u in zip(zip(*p["V"]), zip(*p["U"]))]
        hidden.append(h)
        raised.append(math.exp(dot(gates, p["w"])))
    z = [sum(r * h[j] for r, h in zip(raised, hidden)) / sum(raised) for j in range(len(hidden[0]))]
    return sigmoid(dot(z, p["c"]) + p["c0"][0])


def test_scores_depend_on_the_text_alone(spark, rows):
    every = rows + [(500, "end same"), (501, "same start of the next text"), (502, "x" * 511 + "ü tail"), (None, "no id"), (503, " ".join(["word"] * 250_000)), (5, "another text of an id")]
    docs = make(spark, every)
    labels = spark.createDataFrame([(i, int(len(t or "") % 2), 0) for i, t in rows[:70]], "doc_id long, quality int, toxic int")
    model = quality_mil.fit(docs, labels)
    assert model.constant is None and all(np.array_equal(v, model.p[k]) for k, v in quality_mil.fit(docs.repartition(7), labels).p.items())
    scores = lambda d: {(r.doc_id, r.text): r.score for r in quality_mil.score(d, model).join(d, "doc_id").collect() if r.doc_id != 5}
    one, other = scores(docs), scores(docs.orderBy(F.desc("doc_id")).coalesce(1))
    assert one == other == scores(docs.repartition(40))
    for doc, text in rows[::7] + every[-7:-2]:
        if doc is not None and doc != 5:
            assert one[doc, text] == pytest.approx(plain_score(model, text), abs=2e-5)
    alone = quality_mil.score(make(spark, [(1, rows[3][1])]), model).first().score
    assert alone == one[3, rows[3][1]]


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    model = quality_mil.GatedAttention(hidden=4, gate=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, first, y = rng.standard_normal((7, quality_mil.FEATURES)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model._forward(x, first)[-1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, grad in model._gradients(x, first, y).items():
        at = tuple(0 for _ in model.p[name].shape)
        was = model.p[name][at]
        model.p[name][at] = was + 1e-5
        up = loss()
        model.p[name][at] = was - 1e-5
        down = loss()
        model.p[name][at] = was
        assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


# 3 and 7


def vectors(spark, x, more=()):
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


WRONG = [(1000, None, 0), (1020, [1.0, None], 0), (1040, [float("nan")] * 6, 0), (1060, [float("inf")] * 6, 1), (None, [0.5] * 6, 2)]


def test_exact_topk(spark):
    x = np.round(np.random.default_rng(1).standard_normal((130, 6)), 1).astype(np.float32)
    x[40:60] = x[20]
    whole = vectors(spark, x, WRONG)
    got = exact_topk.search(whole.filter("vec_id % 20 = 0"), whole, 20, tile=3, shard=11).collect()
    m = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    want = set()
    for q in range(0, 130, 20):
        s = m @ m[q]
        order = [i for i in np.lexsort((np.arange(130), -s)) if i != q][:20]
        want |= {(q, r + 1, int(i), int(s[i])) for r, i in enumerate(order)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = whole.filter("vec_id in (0, 1, 2)")
    assert exact_topk.search(few.filter("vec_id = 0"), few, 20).count() == 2
    assert exact_topk.search(whole.limit(0), whole.limit(0), 20).count() == 0


def test_exact_topk_of_large_numbers(spark):
    x = np.array([[3e8, 1.0], [2e8, -5.0], [-3e8, 2.0], [2e8, 7.0]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(exact_topk.search(rows.filter("vec_id = 0"), rows, 3, scale=1.0).collect(), key=lambda r: r["rank"])
    assert [(r.vec_id, r.score) for r in got] == [(3, 60000000000000007), (1, 59999999999999995), (2, -89999999999999998)]


def brute_nearest(x, q, k):
    u = x.astype(np.float64)
    with np.errstate(invalid="ignore"):
        s = (u @ u[q]) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((u[q] ** 2).sum()))
    s[q] = -9
    s = np.nan_to_num(s, nan=-9)
    return np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:k], s


def test_ann(spark):
    x = np.random.default_rng(3).standard_normal((700, 16)).astype(np.float32)
    x[300:330] = x[7]
    x[11] = 0
    whole = vectors(spark, x, [(1000, None, 0), (1050, [float("nan")] * 16, 0), (None, [0.5] * 16, 2), (1100, [1.0] * 5, 0), (7, x[7].tolist(), 0), (300, x[300].tolist(), 9)])
    got = ann_scan.search(whole.filter("vec_id % 50 = 0 or vec_id = 7"), whole, 5)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in [*range(0, 700, 50), 7]:
        best, s = brute_nearest(x, q, 5)
        hits += len({v for v, _ in found[q].values()} & set(best.tolist()))
        assert all(score == pytest.approx(s[v], abs=1e-12) for v, score in found[q].values()) and sorted(found[q]) == [1, 2, 3, 4, 5]
    assert hits / 75 >= 0.9
    assert [found[7][i][0] for i in range(1, 6)] == [300, 301, 302, 303, 304]
    few = whole.filter("vec_id in (0, 1, 2)")
    assert ann_scan.search(few.filter("vec_id = 0"), few, 5).count() == 2
    assert ann_scan.search(whole.limit(0), whole.limit(0), 5).count() == 0


def test_ann_of_more_rows_than_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 32)).astype(np.float32)
    x[1000:3000] = x[0] + 0.3 * rng.standard_normal((2000, 32))  # a list of a third of all rows
    x[3000:4500] = x[5]
    monkeypatch.setattr(ann_scan, "SAMPLE", 600)
    whole = vectors(spark, x)
    found = {}
    for r in ann_scan.search(whole.filter("vec_id % 50 = 0"), whole, 5).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 6000, 50):
        best, s = brute_nearest(x, q, 5)
        level = s[best[-1]] - 1e-12
        hits += sum(s[v] >= level for v, _ in found[q].values())
        assert sorted(found[q]) == [1, 2, 3, 4, 5]
    assert hits / 600 >= 0.9


def test_lists_form_groups():
    sizes = np.array([10, 3000, 0, 400, 400, 400, 1, 5])
    first, parts = ann_scan.grouped(sizes, np.random.default_rng(0).standard_normal((8, 4)).astype(np.float32))
    held = {}
    for f, p, n in zip(first, parts, sizes):
        for part in range(p):
            held[f + part] = held.get(f + part, 0) + n / p
    assert max(held.values()) <= ann_scan.GROUP_ROWS[0] and parts.tolist() == [1, 6, 1, 1, 1, 1, 1, 1]


# 4


def brute_fingerprint(text, width):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, rows):
    rnd = random.Random(4)
    base = " ".join(f"w{rnd.randint(0, 500)}" for _ in range(400))
    near = []
    for i in range(30):
        words = base.split()
        words[rnd.randrange(400)] = "changed" + str(i)
        near.append((500 + i, " ".join(words)))
    every = rows + near
    got = {r.doc_id: r for r in simhash.near_duplicates(make(spark, every)).collect()}
    fp = np.array([brute_fingerprint(t, 4) for _, t in every], np.uint64)
    assert all(int(got[d].fingerprint, 16) == f for (d, _), f in zip(every, fp.tolist()))
    u, v = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    root = local_roots(len(fp), u, v)
    ids = np.array([d for d, _ in every])
    assert all(got[int(d)].component_id == ids[root == r].min() for d, r in zip(ids, root))
    assert len({got[500 + i].component_id for i in range(30)}) < 30
    kept = simhash.keep_one(make(spark, every + [every[0]]), 4, 4, None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got.values()})
    assert simhash.near_duplicates(make(spark, [])).count() == 0


def test_keep_one_compares_exactly(spark, monkeypatch):
    rnd = random.Random(11)
    words = lambda n: [f"w{rnd.randint(0, 9999)}" for _ in range(n)]
    every = [(i, " ".join(words(6))) for i in range(400)]
    for i in range(100):  # 96 shingles, of which the other text has 77 or 58
        one = words(100)
        every += [(1000 + 2 * i, " ".join(one)), (1001 + 2 * i, " ".join(one[: 81 if i % 2 else 62]))]
    every += [(2000, None), (2001, ""), (2002, every[5][1].upper())]
    kept = {r.doc_id for r in simhash.keep_one(make(spark, every)).collect()}
    close = {1001 + 2 * i for i in range(100) if i % 2}
    assert kept >= {d for d, _ in every} - close - {2001, 2002} and not kept & {2001, 2002}
    assert len(close - kept) >= 0.95 * len(close)
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", 2000)
    near = every[600:] + [(3000 + i, " ".join(x if j != i else "new" for j, x in enumerate(every[400][1].split()))) for i in range(30)]
    assert {r.doc_id for r in simhash.keep_one(make(spark, every[400:401] + near)).collect()} == {1000, 2000, 2002}


def test_chance_links_join_nothing(spark):
    """Sets of nearly one fingerprint that share no shingle stay apart, whatever they meet."""
    rng = np.random.default_rng(6)
    fp = rng.integers(1 << 62, dtype=np.uint64)
    nodes = [(int(np.uint64(fp ^ (np.uint64(1) << np.uint64(i))).view(np.int64)), 7) for i in range(12)]
    held = simhash.meetings(spark.createDataFrame(nodes, "fp long, fq long"), 12, 17, 32)
    assert held.select("fp").distinct().count() == 12  # all of them meet
    words = [f"u{i}" for i in range(1200)]
    docs = make(spark, [(i, " ".join(words[100 * i : 100 * i + 100])) for i in range(12)] + [(50, " ".join(words[:95]))])
    classes, edges = simhash.similar_sets(docs, k=64, checked=128)  # limits that let all meet
    assert classes.count() == 13 and edges.distinct().count() == 1
    assert {r.doc_id for r in simhash.keep_one(docs, k=64, checked=128).collect()} == set(range(12))


def test_topk_of_one_id_with_vectors_of_two_lengths(spark):
    rnd = random.Random(7)
    vector = lambda n: [rnd.uniform(-1, 1) for _ in range(n)]
    rows = [(1, vector(2)), (1, vector(3)), (2, vector(3)), (2, vector(3))] + [(10 + i, vector(2 + i % 2)) for i in range(40)]
    rows.append(rows[1])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = exact_topk.search(table.filter("vec_id < 3"), table, 4, tile=2, shard=5).collect()
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for i, v in whole:
        if i < 3:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v)))[:4]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("k", [0, 2, 4, 7, 10])
def test_thresholds_cover(k):
    rng = np.random.default_rng(k)
    parts = simhash.allocate(np.abs(rng.standard_normal((8, k + 1))) * 1e4, 1000, k)
    assert sum(t + 1 for _, t in parts) == k + 1
    assert len({g for of, _ in parts for g in of}) == sum(len(of) for of, _ in parts)


def test_links_with_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fp = rng.integers(1 << 62, size=300, dtype=np.uint64)
    fp[100:200] = fp[0] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    fp = np.unique(fp)
    monkeypatch.setattr(simhash, "TILE", 16)
    nodes = spark.createDataFrame([(int(x), 0) for x in fp.view(np.int64)], "fp long, fq long")
    found = components(simhash.links(nodes, len(fp), 4)).collect()
    u, v = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    root = local_roots(len(fp), u, v)
    sizes = sorted(np.bincount(root)[np.bincount(root) > 1].tolist())
    from collections import Counter

    assert sorted(n + 1 for n in Counter(r.root for r in found).values()) == sizes


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}
    assert components(edges.limit(0)).count() == 0


# 5


def naive_packing(sizes, capacities, overhead):
    """Bins as lists of sizes, found by looking through all bins and all pieces still to come."""
    bins = []
    for at, size in enumerate(sizes):
        fits = [b for b in bins if b[0] >= size]
        if not fits:
            cost = {}
            for c in (c for c in capacities if c >= size):
                room = c - size
                for later in sizes[at + 1 :]:
                    room -= later if later <= room else 0
                cost[c] = (c + overhead) / (c - room)
            c = min(cost, key=lambda c: (cost[c], -c))
            fits = [[c, []]]
            bins += fits
        best = min(fits, key=lambda b: b[0])
        best[0] -= size
        best[1].append(size)
    return sorted(b for _, b in bins)


def cost_of(bins, capacities, overhead):
    return sum(min(c for c in capacities if c >= sum(b)) + overhead for b in bins)


@pytest.mark.parametrize("seed", range(12))
def test_packing_against_a_naive_one(seed):
    rnd = random.Random(seed)
    capacities, overhead = (16, 24, 64, 128), rnd.choice([0, 2, 16, 64])
    sizes = sorted((rnd.randint(1, rnd.choice([10, 128])) for _ in range(rnd.randint(1, 120))), reverse=True)
    of, position, capacity = packing.pack(sizes, capacities, overhead)
    bins = [[s for s, o in zip(sizes, of) if o == n] for n in range(len(capacity))]
    assert all(p == sum(s for s, o in zip(sizes[:i], of) if o == of[i]) for i, p in enumerate(position))
    joint, single = (naive_packing(sizes, c, overhead) for c in (capacities, capacities[-1:]))
    costs = cost_of(joint, capacities, overhead), cost_of(single, capacities, overhead)
    assert sum(capacity) + overhead * len(capacity) == cost_of(bins, capacities, overhead) == min(costs) >= sum(sizes)
    if len({*map(len, joint), *map(len, single)}) > 1 and costs[0] != costs[1]:
        assert sorted(map(sum, bins)) == sorted(map(sum, joint if costs[0] < costs[1] else single))


def test_smaller_lengths_are_opened_where_they_cost_less():
    sizes = [50, 50, 10]  # what is left fills neither of the longer lengths
    assert packing.pack(sizes, (64, 200), 0)[2] == [64, 64] and packing._packed(sizes, [200], 0)[2] == [110]
    assert packing.pack(sizes, (64, 110, 200), 0)[2] == [110]


def test_packing(spark, rows):
    every = rows + [rows[0], (3, "another text of the id"), (None, rows[1][1]), (None, rows[1][1]), (None, rows[2][1])]
    docs = make(spark, every)
    got = packing.best_fit(docs, (16, 64, 128), 2).collect()
    bins = {}
    for r in got:
        if r.bin_id is None:
            assert r.words == 0 and r.capacity is None
        else:
            bins.setdefault((r.bin_id, r.capacity), []).append((r.position, r.words))
    for (_, capacity), held in bins.items():
        held.sort()
        used = sum(w for _, w in held)
        assert [p for p, _ in held] == [sum(w for _, w in held[:i]) for i in range(len(held))]
        assert used <= capacity and capacity == min(c for c in (16, 64, 128) if c >= used)
    # one shard: costs and lengths are those of the naive packing
    sizes = sorted((r.words for r in got if r.words), reverse=True)
    least = min(cost_of(naive_packing(sizes, c, 2), (16, 64, 128), 2) for c in ((16, 64, 128), (128,)))
    assert sum(c + 2 for _, c in bins) == least
    want = sum(len((t or "").encode().split()) for _, t in every)
    assert sum(r.words for r in got) == want
    made = packing.sequences(docs, (16, 64, 128), 2).collect()
    assert all(len(r.doc_ids) == len(r.pieces) and sum(len(p.split()) for p in r.pieces) == r.words <= r.capacity for r in made)
    from collections import Counter

    packed_words, words = Counter(), Counter()
    for r in made:
        for d, p in zip(r.doc_ids, r.pieces):
            packed_words.update((d, w) for w in p.encode().split())
    for d, t in every:
        words.update((d, w) for w in (t or "").encode().split())
    assert packed_words == words
    assert packing.best_fit(make(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_bin():
    of, position, capacity = packing.pack([60, 50, 40, 12, 3], (64, 100), 0)
    assert of == [0, 1, 0, 1, 1] and position == [0, 0, 60, 50, 62] and capacity == [100, 100]


# 6


def brute_cut(docs, window):
    least = {}
    for i, b in docs.items():
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            least[w] = min(i, least.get(w, i))
    out = {}
    for i, b in docs.items():
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if least[b[p : p + window]] < i:
                gone[p : p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, rows, monkeypatch):
    rnd = random.Random(6)
    more = [(200 + i, "".join(rnd.choice(["ab", "ba", "é", "abababababab", " " * 60, "\0" * 40 + "q", "\0q"]) for _ in range(60))) for i in range(40)]
    every = rows + more
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 3000)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.cut(make(spark, every)).collect()}
    assert got == brute_cut({i: (t or "").encode() for i, t in every}, 50)
    docs = suffix_dedup.cut_documents(make(spark, every))
    assert docs.columns == make(spark, []).columns and docs.count() == len(every)
    assert {r.doc_id: len(r.text.encode()) for r in docs.collect() if r.doc_id < 80} == {i: got[i][0] - got[i][1] for i in range(80)}
    assert suffix_dedup.cut(make(spark, [])).count() == 0


def test_suffix_dedup_of_repeated_ids(spark):
    a, b = "x" * 20 + "0123456789" * 8, "0123456789" * 8 + "y" * 30
    got = sorted(tuple(r)[:3] for r in suffix_dedup.cut(make(spark, [(1, a), (1, b), (2, b), (None, b), (None, b)])).collect() if r.doc_id is not None)
    assert got == [(1, 100, 0), (1, 110, 0), (2, 110, 110)]
    null = [r for r in suffix_dedup.cut(make(spark, [(1, a), (None, b), (None, b), (None, b + "z")])).collect() if r.doc_id is None]
    assert sorted((r.n_bytes, r.n_removed) for r in null) == [(110, 80), (110, 80), (111, 80)]
    with pytest.raises(ValueError):
        suffix_dedup.cut(make(spark, [(1, a)]), 300)


def test_suffix_dedup_of_long_texts(spark):
    rnd = np.random.default_rng(8)
    letters = lambda n: bytes(rnd.integers(97, 123, n, dtype=np.uint8)).decode()
    shared = [letters(700) for _ in range(4)]
    long, longer = letters(1 << 20), letters(2 << 20)
    every = [
        (1, letters(30) + shared[0] + letters(40)),
        (2, long[:5000] + shared[0] + long[5000:] + shared[1]),
        (3, longer[:9] + shared[1] + longer[9:] + shared[2]),
        (4, letters(60) + shared[2] + long[(1 << 20) - 800 : (1 << 20) - 100] + letters(9)),
        (5, long[:5000] + shared[0] + long[5000:] + shared[1]),
        (6, longer[(1 << 20) - 300 : (1 << 20) + 900]),
    ]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.cut(make(spark, every)).collect()}
    lost = {1: 0, 2: 700, 3: 700, 4: 1400, 5: len(every[4][1]), 6: 1200}
    assert got == {i: (len(t), lost[i]) for i, t in every}


# 8


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Words to take from each source, by going round until no source is above its most."""
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    out, rest, left = {}, share * sum(sizes), list(range(len(sizes)))
    while left:
        total = sum(weigh[i] for i in left)
        above = [i for i in left if rest * weigh[i] / total > most * sizes[i]]
        out |= {i: most * sizes[i] for i in above} if above else {i: rest * weigh[i] / total for i in left}
        rest -= sum(out[i] for i in above)
        left = [i for i in left if i not in out]
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 0], [1, 2, 4, 8, 16, 5000, 3], [0, 0], []])
def test_targets(spark, sizes):
    names = sorted(["", "A", "a", "b", "é", "中", "\U0001f600"][: max(0, len(sizes) - 1)], key=lambda n: n.encode()) + [None] * bool(sizes)
    sized = spark.createDataFrame([(s, n) for s, n in zip(names, sizes)], "source string, size long").repartition(3)
    got = sorted(mixing.targets(mixing.placed_sources(sized)).collect(), key=lambda r: r.place)
    assert [(r.place, r.source, r.source_size) for r in got] == [(i, s, n) for i, (s, n) in enumerate(zip(names, sizes))]
    assert [r.target for r in got] == pytest.approx(targets(sizes))


def test_many_sources_are_in_order(spark):
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.pmod(F.col("id") * 7919, F.lit(1500))).alias("source"), F.lit(1).cast("long").alias("size"))
    got = mixing.placed_sources(rows).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1500)) and [r.source for r in got] == sorted(r.source for r in got)


def test_mixing(spark, rows):
    more = [(None, rows[3][1], "en", "a"), (None, rows[3][1], "en", "a"), (None, rows[5][1], "en", None), (3, "other words of the id", "en", "B"), (700, "w " * 6000, "en", "a")]
    every = [(i, t, "en", [None, "a", "B", "ü"][i % 4]) for i, t in rows] + more
    every.append(every[3])
    docs = make(spark, every)
    block = 16
    got = mixing.mix(docs, block).collect()
    assert len(got) == len(every) and sorted(map(str, mixing.mix(docs.repartition(5), block).collect())) == sorted(map(str, got))
    size = lambda t: len((t or "").encode().split())
    total = {s: sum(size(t) for _, t, _, x in every if x == s) for *_, s in every}
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    wanted = dict(zip(order, targets([total[s] for s in order])))
    # words taken, recomputed from the plan of slots by walking through every source's words
    rows_, sources, buckets = mixing.size_sources(docs)
    plan = mixing.slots(sources, block).collect()
    place, held = {r.source: r.place for r in sources.collect()}, {r.place: r.source_size for r in sources.collect()}
    times = {}
    for r in plan:  # a source's last block may be short
        for w in range(min(r.words, held[r.place] - r.block * block)):
            at = (r.place, r.block * block + w)
            times[at] = times.get(at, 0) + 1
    own = sorted(mixing.located(rows_.filter("size > 0"), buckets).collect(), key=lambda r: (r.place, r.start))
    ends = {}
    for r in own:  # the documents of a source lie one after the other
        assert r.start == ends.get(r.place, 0)
        ends[r.place] = r.start + r.size
    assert ends == {place[s]: n for s, n in total.items() if n}
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got if r["size"]) == sorted((r.doc_id or -1, r["size"], sum(times.get((r.place, w), 0) for w in range(r.start, r.start + r["size"]))) for r in own)
    assert max(times.values()) <= 2 and sum(r.taken for r in got) == sum(times.values())
    taken = {s: sum(n for (p, _), n in times.items() if p == place[s]) for s in order}
    assert all(taken[s] == pytest.approx(wanted[s], abs=1) for s in order)
    key = sorted((str(d), size(t), total[s], round(wanted[s], 6)) for d, t, _, s in every)
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6)) for r in got) == key and all(r.taken <= 2 * r["size"] for r in got)
    made = mixing.mixed_documents(docs, block)
    assert made.columns == docs.columns
    words, want = {}, {}
    for r in made.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
    for r in got:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert words == {d: n for d, n in want.items() if n}
    assert mixing.mix(make(spark, [])).count() == 0 and mixing.mixed_documents(make(spark, [])).count() == 0


def test_rows_of_several_sources_stay_apart(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = make(spark, [(1, text, "en", "a"), (1, text, "de", "b"), (1, text, "de", None), (1, text, "de", "b"), (2, "other words", "en", "a")])
    docs = docs.withColumn("marks", F.create_map(F.lit("k"), "source"))
    got = [(r.doc_id, r.source, r.lang, r.marks["k"], r.text) for r in mixing.mixed_documents(docs, 8).collect()]
    assert {(d, s, lang) for d, s, lang, m, _ in got if d == 1 and s == m} == {(1, "a", "en"), (1, "b", "de"), (1, None, "de")}
    per = {}
    for _, s, _, _, t in got:
        per[s] = per.get(s, 0) + len(t.split())
    want = dict(zip(["a", "b", None], targets([42, 80, 40])))
    assert all(per[s] == pytest.approx(want[s], abs=1) for s in want)
    assert sorted(map(str, got)) == sorted(str((r.doc_id, r.source, r.lang, r.marks["k"], r.text)) for r in mixing.mixed_documents(docs.repartition(7), 8).collect())


def test_more_sources_than_cells(spark, monkeypatch):
    docs = make(spark, [(i, f"one two three {i}", "en", f"s{i % 30}") for i in range(120)])
    few = {r.doc_id: r.taken for r in mixing.mix(docs, 4).collect()}
    monkeypatch.setattr(mixing, "CELLS", 7)
    assert {r.doc_id: r.taken for r in mixing.mix(docs, 4).collect()} == few and sum(few.values()) == pytest.approx(720, abs=30)


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(1)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_mixing_is_native(spark, rows):
    plan = mixing.mix(make(spark, rows[:5]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 10


def brute_paragraphs(text):
    """(first word, words): the set of shingles of each paragraph, by the same anchors."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    found = paragraphs.Paragraphs(raw, np.array([0, len(raw)]))
    runs = {int(s) for s, line in zip(found.start, found.line) if not line}
    words, out, at = (text or "").encode().lower().split(), {}, 0
    for line in (text or "").split("\n"):
        n = len(line.encode().split())
        if n >= paragraphs.LEAST:
            out[at, n] = None
        at += n
    assert {(int(s), int(n)) for s, n, line in zip(found.start, found.words, found.line) if line} == set(out)
    # an anchor among each GAP neighbours, so that each run of LEAST + GAP - 1 words holds a paragraph
    last = len(words) - paragraphs.LEAST
    assert all(runs & set(range(i, i + paragraphs.GAP)) for i in range(last - paragraphs.GAP + 2)) and all(r <= last for r in runs)
    out |= {(r, paragraphs.LEAST): None for r in runs}
    return {(s, n): {tuple(words[j : j + 5]) for j in range(s, s + n - 4)} for s, n in out}


def brute_removed(every):
    """Words that go of each row: those of paragraphs whose cluster begins in a smaller doc_id.
    Equal paragraphs are a class; classes that begin in different documents may be linked."""
    classes = {}
    for i, (d, t) in enumerate(every):
        words = (t or "").encode().lower().split()
        for (s, n), grams in brute_paragraphs(t).items():
            classes.setdefault(tuple(words[s : s + n]), (grams, []))[1].append((d, s, i, n))
    found = sorted((min(at), grams, at) for grams, at in classes.values())
    by = {}
    for k, (_, grams, _) in enumerate(found):
        for g in grams:
            by.setdefault(g, []).append(k)
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    pairs = {(k, o) for k, (first, grams, _) in enumerate(found) for g in grams for o in by[g] if o < k and found[o][0][0] != first[0] and near(grams, found[o][1])}
    root = local_roots(len(found), np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))
    gone = {i: set() for i in range(len(every))}
    for (_, _, at), r in zip(found, root):
        for d, s, i, n in at:
            if found[r][0][0] < d:
                gone[i] |= set(range(s, s + n))
    return [len(gone[i]) for i in range(len(every))]


def test_paragraphs(spark, rows, monkeypatch):
    rnd = random.Random(9)
    base = [f"t{i}" for i in range(60)]
    near = []
    for i in range(40):
        words = list(base)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(60)] = f"c{i}"
        near.append((400 + i, "short line\n" + " ".join(words)))
    every = rows + near
    got = {r.doc_id: r for r in paragraphs.removals(make(spark, every)).collect()}
    assert [got[d].n_removed for d, _ in every] == brute_removed(every)
    assert all(r.n_removed == sum(s.end - s.start for s in r.removed) and r.n_spans == len(r.removed) and all(s.kept_doc_id < r.doc_id for s in r.removed) for r in got.values())
    monkeypatch.setattr(paragraphs, "TILE", 3)
    monkeypatch.setattr(paragraphs, "GATHERED", 3000)
    assert {r.doc_id: r for r in paragraphs.removals(make(spark, every)).collect()} == got
    cut = paragraphs.cut_documents(make(spark, every))
    assert cut.columns == make(spark, []).columns
    size = lambda t: len((t or "").encode().split())
    assert {r.doc_id: size(r.text) for r in cut.collect()} == {d: size(t) - got[d].n_removed for d, t in every}
    assert paragraphs.removals(make(spark, [])).count() == 0


def test_passages_within_lines_and_stock_lines(spark):
    rnd = random.Random(13)
    words = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    shared, stock = [words(51) for _ in range(30)], words(12)
    every = [(i, f"{words(40)}\n{stock}\n{words(rnd.randint(5, 300))} {shared[i % 30]} {words(rnd.randint(5, 90))}\n{stock}") for i in range(60)]
    every += [(100, words(30_000) + " " + shared[3] + " " + words(120_000)), (101, f"{stock}\n{stock}\n{stock}"), (102, " ".join([shared[0]] * 2))]
    got = {r.doc_id: r for r in paragraphs.removals(make(spark, every)).collect()}
    # a run may begin or end a few words beside the passage
    assert all(25 <= got[d].n_removed <= 55 for d in [*range(30, 60), 100]) and got[102].n_removed >= 50
    assert all(got[d].n_removed == 0 for d in [*range(30), 101]) and got[100].n_bytes > 1 << 20


def test_paragraphs_of_null_and_repeated_ids(spark):
    rnd = random.Random(12)
    one, two, three, four = (" ".join(f"w{rnd.randint(0, 9999)}" for _ in range(60)) for _ in range(4))
    near = lambda t: t + " more"
    every = [(1, one), (2, two), (2, two + "\n" + four), (3, four), (None, near(one)), (None, near(two)), (None, three), (None, three), (7, near(one)), (7, four), (7, four)]
    got = sorted((r.doc_id or 99, r.n_removed > 0, min([s.kept_doc_id for s in r.removed], default=0)) for r in paragraphs.removals(make(spark, every)).collect())
    assert got == [(1, False, 0), (2, False, 0), (2, False, 0), (3, True, 2), (7, True, 1), (7, True, 2), (7, True, 2), (99, False, 0), (99, False, 0), (99, True, 1), (99, True, 2)]


def test_bands_reach_the_recall():
    for similar in (0.5, 0.8, 0.9):
        bands, rows = paragraphs.tuned(similar, 0.99)
        assert 1 - (1 - similar**rows) ** bands >= 0.99


# All


def test_registry():
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


def jaccard_components(texts):
    """For each text the number of the first one that pairs of a similarity of 0.8 lead to."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return local_roots(len(sets), np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(21)
    prose = lambda n: " ".join(rnd.choice(["river", "stone", "walks", "slowly", "under", "light"]) + rnd.choice(["", "s", "ed"]) + str(rnd.randint(0, 40)) for _ in range(n)) + "."
    junk = lambda: " ".join(rnd.choice(["BUY!!", "NOW!!", "WIN!!"]) for _ in range(40))
    shared, rows = prose(70), []
    for i in range(120):
        text = junk() if i % 4 == 0 else prose(60) + (" " + shared if i % 10 == 3 else "") + "\n" + prose(20)
        rows.append((i, text, "en", ["a", "b", None][i % 3]))
    rows += [(200 + i, rows[i][1] + " end", "en", "a") for i in range(0, 40, 3)]  # near copies
    rows += [(300, None, "en", "a"), (301, "", "en", None), (None, prose(80), None, "b"), (None, rows[1][1], "en", "a"), (302, prose(9000), "en", "c"), rows[2], (5, prose(50), "en", "a")]
    docs = make(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf_dir, size = str(tmp_path), lambda t: len((t or "").encode().split())
    now, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, now, sf_dir)
        made.write.parquet(f"{sf_dir}/stage{number}.parquet")
        given, before = sorted(((r.doc_id, r.text) for r in now.collect()), key=str), now
        now = spark.read.parquet(f"{sf_dir}/stage{number}.parquet")
        if number < 4:
            assert now.columns == docs.columns
            got = sorted(((r.doc_id, r.text) for r in now.collect()), key=str)
        if number == 0:
            labels = {i: int(i % 4 != 0) for i in range(120)}
            assert set(got) <= set(given) and all(bool((d, t) in set(got)) == bool(labels[d]) for d, t in given if d in labels and t != rows[-1][1])
        elif number == 1:
            order = sorted(set(given), key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
            root = jaccard_components([t for _, t in order])
            stay = {order[r][0] for r in root}
            assert sorted(got, key=str) == sorted({r for r in order if r[0] in stay}, key=str) and len(got) < len(given)
        elif number == 2:
            own = {d: (t or "").encode() for d, t in given if d is not None and d != 5}
            assert len(got) == len(given)
            cut = brute_cut({**own, 5: b"\n".join((t or "").encode() for d, t in given if d == 5)}, 50)
            assert {d: (len(own[d]) - cut[d][1]) for d in own} == {d: len((t or "").encode()) for d, t in got if d in own}
        elif number == 3:
            taken = {}
            for r in mixing.mix(before).collect():
                taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
            words = {}
            for d, t in got:
                words[d] = words.get(d, 0) + size(t)
            assert words == {d: n for d, n in taken.items() if n}
        else:
            packed_rows = now.collect()
            assert sum(r.words for r in packed_rows) == sum(size(t) for _, t in given) == sum(size(p) for r in packed_rows for p in r.pieces)
            assert all(r.words <= r.capacity for r in packed_rows) and {d for r in packed_rows for d in r.doc_ids} == {d for d, _ in given}
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, whole)) == sorted(map(str, packed_rows))
    for table in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(f"{sf_dir}/none/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{sf_dir}/none").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = corpus_pipeline.run(spark, folder).collect()
    known = {r.doc_id for r in docs.collect()}
    assert made and all(set(r.doc_ids) <= known and r.words <= r.capacity for r in made)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "best-fit packing"]
