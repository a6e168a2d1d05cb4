import math

import numpy as np
import pytest

from millrace.errors import RetrieveError, StoreError
from millrace.operators import fusion, lexical, lookups, vector


def _docs(spark):
    rows = [("rare", "r1", "needle in haystack", None), ("dense", "r1", "needle needle needle needle in haystack", None), ("none", "r2", "other words here", "Nädle"), ("two", "r2", "foo bar baz foo-bar", "x")]
    return spark.createDataFrame(rows, "id string, repo_id string, content string, symbol string")


def test_bm25_ranks_and_values(spark):
    docs = _docs(spark)
    got = lexical.bm25_scan(docs, "id", ("content", "symbol"), ["needle"], 10).collect()
    assert [r.id for r in got] == ["dense", "rare"]
    lengths = [3, 6, 4, 5]
    idf = math.log((4 - 2 + 0.5) / (2 + 0.5))
    idf = idf if idf > 0 else 1e-6
    want = idf * 4 * 2.2 / (4 + 1.2 * (0.25 + 0.75 * 6 / (sum(lengths) / 4)))
    assert got[0].score == pytest.approx(want, abs=1e-6)
    assert [r.id for r in lexical.bm25_scan(docs, "id", ("content", "symbol"), lexical.query_terms(spark, "NADLE?"), 10).collect()] == ["none"]


def test_statistics_ignore_the_filter(spark):
    from pyspark.sql import functions as F

    docs = _docs(spark)
    whole = {r.id: r.score for r in lexical.bm25_scan(docs, "id", ("content",), ["foo", "needle"], None).collect()}
    part = lexical.bm25_scan(docs, "id", ("content",), ["foo", "needle"], 5, where=F.col("repo_id") == "r2").collect()
    assert [(r.id, r.score) for r in part] == [("two", whole["two"])]


def test_ways_to_match(spark):
    docs = lexical.tokenised(_docs(spark), "content")
    ids = lambda c: {r.id for r in docs.filter(c).collect()}
    assert ids(lexical.has_all("needle", "in")) == {"rare", "dense"}
    assert ids(lexical.has_phrase("foo", "bar")) == {"two"}
    assert ids(lexical.has_phrase("bar", "foo")) == set()
    assert ids(lexical.has_prefix("hay")) == {"rare", "dense"}
    assert ids(lexical.has_near("needle", "haystack", 1)) == {"rare", "dense"}
    assert ids(lexical.has_near("baz", "bar", 0)) == {"two"}
    assert ids(lexical.has_any("other", "foo") & lexical.has_none("baz")) == {"none"}


def test_wrong_requests(spark):
    docs = _docs(spark)
    with pytest.raises(RetrieveError):
        lexical.bm25_scan(docs, "id", ("content",), ["a"], 0)
    with pytest.raises(StoreError):
        lexical.bm25_scan(docs, "id", ("content",), [], 5)
    with pytest.raises(RetrieveError):
        fusion.repo_of({"repo_id": 3})
    assert fusion.repo_of({"other": 3}) is None


def test_cosine_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = vector.cosine_topk(rows, "id", "v", x[5].tolist(), 7).collect()
    assert [r.id for r in got] == np.argsort(-(u @ u[5]), kind="stable")[:7].tolist()
    asked = rows.filter("id < 4").selectExpr("id as query_id", "v as vector")
    batch = vector.cosine_topk_batch(rows, "id", "v", asked, 5).collect()
    for q in range(4):
        s = u @ u[q]
        s[q] = -9
        assert [r.id for r in sorted(batch, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(-s, kind="stable")[:5].tolist()
    with pytest.raises(Exception, match="components"):
        vector.checked(rows, "v", 9).collect()


def test_fusion_order(spark):
    ranks = lambda ids, name: spark.createDataFrame([(k, i + 1) for i, k in enumerate(ids)], f"id string, {name} int")
    got = fusion.fuse(ranks("ABC", "vec_rank"), ranks("BDA", "lex_rank"), "id").orderBy("rank").collect()
    assert [r.id for r in got] == ["B", "A", "D", "C"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    tied = fusion.fuse(ranks("A", "vec_rank"), ranks("B", "lex_rank"), "id").orderBy("rank").collect()
    assert [r.id for r in tied] == ["A", "B"]


def test_lookups(spark):
    rows = spark.createDataFrame([("c1", "r", "p", 1, 10), ("c2", "r", "p", 11, 20), ("c3", "r", "p", 21, 30)], "chunk_id string, repo_id string, path string, start_line int, end_line int")
    assert [r.chunk_id for r in lookups.overlapping(rows, 8, 15).collect()] == ["c1", "c2"]
    ids = spark.createDataFrame([(0, "c3"), (1, "zz"), (2, "c1"), (3, "c3")], "place int, chunk_id string")
    assert [r.chunk_id for r in lookups.get_many(rows, "chunk_id", ids).collect()] == ["c3", "c1", "c3"]


def test_stored_postings_give_the_scores_of_a_scan(spark):
    from pyspark.sql import functions as F

    docs = _docs(spark).union(spark.createDataFrame([("empty", "r3", "", None)], "id string, repo_id string, content string, symbol string"))
    stored = (lexical.postings(docs, "id", "content", "symbol", keep=("repo_id",)), lexical.lengths(docs, "id", "content", "symbol", keep=("repo_id",)))
    for words in (["needle"], ["foo", "needle", "nadle", "absent"], ["bar", "baz"]):
        scan = lambda **more: {tuple(r) for r in lexical.bm25_scan(docs, "id", ("content", "symbol"), words, None, **more).collect()}  # noqa: E731, B023
        asked = lambda **more: {tuple(r) for r in lexical.bm25(stored, "id", words, None, **more).collect()}  # noqa: E731, B023
        assert asked() == scan() and asked(where=F.col("repo_id") == "r2") == scan(where=F.col("repo_id") == "r2")
        assert asked(every=True) == scan(match=lexical.has_all(*words))
    with pytest.raises(StoreError):
        lexical.bm25(stored, "id", [])
    with pytest.raises(RetrieveError):
        lexical.bm25(stored, "id", ["a"], 0)


def test_many_queries_are_dealt_into_tiles(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((90, 5)))], "vec_id long, x array<float>")
    asked = rows.filter("vec_id % 2 = 0").selectExpr("vec_id as query_id", "x as vector")
    one, tiled = (sorted(map(tuple, vector.cosine_topk_batch(rows, "vec_id", "x", asked, 4, most=most).collect())) for most in (100, 7))
    assert one == tiled and len(one) == 45 * 4


def test_vectors_without_direction_and_of_another_length(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.5, 0.5]), (5, [float("nan"), 1.0]), (6, [None, 1.0])], "id long, v array<double>")
    assert [(r.id, r.score) for r in vector.cosine_topk(rows, "id", "v", [2.0, 0.0], 9).collect()] == [(1, 1.0), (4, 0.707106781)]
    assert vector.cosine_topk(rows, "id", "v", [0.0, 0.0], 9).count() == 0
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (7, [0.0, 0.0]), (8, None)], "query_id long, vector array<double>")
    for most in (100, 2):
        got = vector.cosine_topk_batch(rows, "id", "v", asked, 3, most=most).collect()
        assert [(r.query_id, r.id, r.score) for r in got] == [(1, 4, 0.707106781)]
        both = vector.cosine_topk_batch(rows, "id", "v", asked, 3, most=most, own=True).collect()
        assert sorted((r.query_id, r.id) for r in both) == [(1, 1), (1, 4)]
    for bad in ([1.0], [1.0, 2.0, 3.0]):
        with pytest.raises(Exception, match="components"):
            vector.cosine_topk(rows, "id", "v", bad, 2).collect()
        with pytest.raises(Exception, match="components"):
            vector.cosine_topk_batch(rows, "id", "v", spark.createDataFrame([(1, bad)], "query_id long, vector array<double>"), 2).collect()


def test_many_questions_are_each_answered_as_alone(spark):
    import random

    rnd = random.Random(3)
    bank = [f"w{i}" for i in range(40)]
    texts = [(i, "r" + str(i % 2), " ".join(["the"] * rnd.randint(0, 3) + rnd.choices(bank, k=rnd.randint(1, 30)))) for i in range(150)]
    docs = spark.createDataFrame(texts, "id long, repo_id string, content string")
    stored = (lexical.postings(docs, "id", "content", keep=("repo_id",)).cache(), lexical.lengths(docs, "id", "content", keep=("repo_id",)).cache())
    questions = [(n, rnd.sample(["the", "absent", *bank], rnd.randint(1, 6))) for n in range(12)] + [(50, []), (51, ["absent"]), (52, ["the", "the"])]
    asked = spark.createDataFrame(questions, "query_id long, words array<string>")
    from pyspark.sql import functions as F

    for where in (None, F.col("repo_id") == "r1"):
        many = lexical.bm25_many(stored, "id", asked, 5, where).collect()
        for n, words in questions:
            one = [tuple(r) for r in lexical.bm25(stored, "id", words, 5, where).collect()] if words else []
            assert [(r.id, r.score) for r in sorted(many, key=lambda r: r["rank"]) if r.query_id == n] == one


def test_lists_give_exact_results_and_are_skipped(spark, tmp_path):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((12, 6))
    x = np.concatenate([c + 0.05 * rng.standard_normal((40, 6)) for c in centre] + [np.zeros((2, 6)), centre[:1], centre[:1]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] + [1.0] * 5)], "id long, v array<double>")
    lists = vector.Lists(spark, str(tmp_path / "lists"), "id").write(rows, "v", 6, 30)
    for k, query in ((5, x[3]), (45, x[100]), (3, rng.standard_normal(6)), (600, x[7]), (1, -x[9])):
        plain = vector.cosine_topk(rows, "id", "v", query.tolist(), k).collect()
        assert lists.search(query.tolist(), k).collect() == plain
    assert len(lists.needed(x[3].tolist(), 5)) < 8 and lists.needed([0.0] * 6, 5) == [] and lists.search([0.0] * 6, 5).count() == 0
    with pytest.raises(StoreError):
        lists.search([1.0], 5)
    with pytest.raises(Exception, match="components"):
        vector.Lists(spark, str(tmp_path / "wrong"), "id").write(rows, "v", 7)


def test_tiles_do_not_grow_in_number_with_what_one_job_may_send(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 5))[rng.integers(0, 60, 400)]  # copies, so that scores are tied
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<float>").repartition(3)
    asked = rows.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("x").alias("vector"))
    ask = lambda **more: vector.cosine_topk_batch(rows, "vec_id", "x", asked, 4, **more)
    held = {}
    unit = vector._unit(x.astype(np.float32).astype(np.float64))
    for q in range(0, 400, 4):
        score = np.round(unit @ unit[q], 9)
        held[q] = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:4]
    plans = {}
    for name, more in {"one": {}, "tiled": {"most": 16}, "many": {"most": 16, "tile": 30}}.items():
        got = ask(**more)
        assert {q: [r.vec_id for r in sorted(got.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in held} == held
        plans[name] = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 13" not in plans["tiled"] and plans["tiled"].count("CoGroup") == 1 and plans["tiled"] != plans["many"]


def test_best_rows_are_k_whatever_is_tied_and_some_queries_at_a_time(monkeypatch):
    import pyarrow as pa

    x = np.array([[1.0, 0.0]] * 50 + [[0.0, 1.0], [0.0, 0.0], [1.0, 1.0]])
    own = pa.array(range(52, -1, -1))
    monkeypatch.setattr(vector, "SCORES", 100)
    found = list(vector._best(np.array([3, 90, 91]), vector._unit(np.array([[2.0, 0.0], [0.0, 3.0], [0.0, 0.0]])), own, x, 3, 9, False))
    assert len(found) == 3
    got = [list(zip(*map(np.ndarray.tolist, f))) for f in found]
    assert sorted(got[0]) == [(3, 4, 1.0), (3, 5, 1.0), (3, 6, 1.0)]
    assert sorted(got[1]) == [(90, 0, 0.707106781), (90, 2, 1.0), (90, 3, 0.0)] and got[2] == []


def test_citations_of_one_rank_are_no_single_task(spark):
    rows = spark.range(3000).selectExpr("concat('p', id) as path", "1 as start_line", "9 as end_line", "cast(null as string) as symbol", "1 as rank", "repeat('ab', 900) as content")
    found = lookups.citations(rows.union(rows.selectExpr("path", "start_line", "end_line", "symbol", "2 as rank", "'later' as content")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [n for n in found.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 3000 and len(sizes) > 1 and max(sizes) < 2000
    assert {(len(r.citation.snippet), r["rank"]) for r in found.collect()} == {(800, 1)}


def test_postings_of_many_questions_are_not_shuffled_for_their_terms(spark, monkeypatch):
    import random

    rnd = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(["the", "of", "and"], k=4) + rnd.choices([f"w{j}" for j in range(60)], k=6))) for i in range(300)], "id long, content string")
    stored = (lexical.postings(docs, "id", "content").cache(), lexical.lengths(docs, "id", "content").cache())
    questions = [(n, ["the", "of", "and", *rnd.sample([f"w{j}" for j in range(60)], 3)]) for n in range(6)]
    asked = spark.createDataFrame(questions, "query_id long, words array<string>")
    few = lexical.bm25_many(stored, "id", asked, 4)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "salt" not in plan and "least" in plan
    monkeypatch.setattr(lexical, "MOST_SENT", 3)
    many = lexical.bm25_many(stored, "id", asked, 4)
    assert "salt" in many._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, few.collect()))
    assert got == sorted(map(tuple, many.collect())) and len(got) == 24
    for n, words in questions:
        assert [r[1:3] for r in sorted(got, key=lambda r: r[3]) if r[0] == n] == [tuple(r) for r in lexical.bm25(stored, "id", words, 4).collect()]
