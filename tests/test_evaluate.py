import json

import pytest
from pyspark.sql import functions as F

from millrace.errors import EvalError
from millrace.operators import evaluate, graph, store


def _lists(spark, retrieved, expected):
    return spark.createDataFrame([(retrieved, expected)], "r array<string>, e array<string>")


def test_ranking_measures(spark):
    row = _lists(spark, ["a", "a", "b", "c", "d"], ["b", "d", "x"]).select(evaluate.recall_at_k("r", "e", 3).alias("recall"), evaluate.mrr("r", "e").alias("mrr"), evaluate.ndcg_at_k("r", "e", 4).alias("ndcg")).first()
    assert row.recall == pytest.approx(1 / 3) and row.mrr == pytest.approx(1 / 2)
    import math

    gain = 1 / math.log2(3) + 1 / math.log2(5)
    assert row.ndcg == pytest.approx(gain / (1 + 1 / math.log2(3) + 1 / math.log2(4)))
    none = _lists(spark, ["a"], []).select(evaluate.recall_at_k("r", "e", 1), evaluate.mrr("r", "e"), evaluate.ndcg_at_k("r", "e", 1)).first()
    assert list(none) == [1.0, 0.0, 0.0]
    with pytest.raises(EvalError):
        evaluate.recall_at_k("r", "e", 0)


def test_grounding(spark):
    chunks = spark.createDataFrame([("r", "a.py", 1, 10, "def foo():\n    return 1\n")], "repo_id string, path string, start_line int, end_line int, content string")
    cited = spark.createDataFrame([("r", "a.py", 1, 5, "return 1"), ("r", "b.py", 1, 5, "x"), ("r", "a.py", 5, 15, "def foo"), ("r", "a.py", 2, 3, "nowhere"), ("r", "a.py", 2, 4, "")], "repo_id string, path string, start_line int, end_line int, snippet string")
    got = {(r.path, r.start_line, r.end_line): (r.grounded, len(r.reasons)) for r in evaluate.grounded(cited, chunks).collect()}
    assert got == {("a.py", 1, 5): (True, 0), ("b.py", 1, 5): (False, 3), ("a.py", 5, 15): (False, 2), ("a.py", 2, 3): (False, 1), ("a.py", 2, 4): (True, 0)}


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ('{"per_trait": {"x": true, "y": "yes"}, "rationale": "ok"}', 1.0), ('```json\n{"per_trait": {"x": "TRUE"}}\n```', 0.5), ('{"per_trait": {"z": true}}', 0.0),
        ("no json", 0.0), ('{"per_trait": [1]}', 0.0), ("", 0.0),
    ],
)
def test_rubric(spark, text, score):
    row = spark.createDataFrame([(text, ["x", "y"])], "j string, t array<string>").select(evaluate.rubric("j", "t").alias("r")).first().r
    assert row.score == score


def test_rubric_without_traits(spark):
    assert spark.createDataFrame([("junk", [])], "j string, t array<string>").select(evaluate.rubric("j", "t").alias("r")).first().r.score == 1.0


def test_costs_and_aggregates(spark, tmp_path):
    rates = spark.createDataFrame([("a", "m", 1.0, 2.0), ("a", "default", 0.5, 0.5)], "provider string, model string, prompt_per_1k double, completion_per_1k double")
    used = spark.createDataFrame([("a", "m", 1000, 500), ("a", "other", 1000, 1000), ("b", "m", 9, 9)], "provider string, model string, prompt int, completion int")
    assert sorted(r.cost_usd for r in evaluate.costs(used, rates).collect()) == [0.0, 1.0, 2.0]
    cases = spark.createDataFrame([("c1", 1.0, 1.0, 1.0, 1.0, 0.5, 100, 0.1), ("c2", 0.0, 0.0, 0.0, 0.0, 0.5, 300, 0.3)], "case_id string, recall_at_k double, mrr double, ndcg_at_k double, grounding_rate double, correctness double, latency_ms long, cost_usd double")
    total = evaluate.aggregates(cases, 5)
    row = total.first()
    assert row.latency_p50_ms == 200.0 and row.latency_p95_ms == pytest.approx(290.0) and row.total_cost_usd == pytest.approx(0.4)
    assert evaluate.aggregates(cases.limit(0), 5).first().mean_mrr == 0.0
    as_json, as_text = evaluate.report(cases, total, "run", str(tmp_path))
    assert json.loads(open(as_json).read())["aggregates"]["n_cases"] == 2 and "| c2 |" in open(as_text).read()


def test_store_round_trip(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "t"), "chunk_id string, repo_id string, v int")
    assert table.count() == 0
    make = lambda rows: spark.createDataFrame(rows, "chunk_id string, repo_id string, v int")
    table.upsert(make([("a", "r1", 1), ("b", "r2", 2)]))
    assert table.upsert(make([("b", "r2", 3), ("c", "r2", 4), ("d", "r/4 =", 5)])) == 3
    table.swap(table.read().limit(0), make([("d", "r/4 =", 0)]).select("repo_id", "chunk_id"))
    assert table.count("r/4 =") == 0
    assert {(r.chunk_id, r.v) for r in table.read().collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert table.delete_repo("r2") == 2 and table.delete_repo("zz") == 0 and table.count() == 1


def test_symbol_graph(spark, tmp_path):
    symbols = spark.createDataFrame([("a.py", "f", "function", 1, None, 1), ("a.py", "f", "function", 9, None, 2), ("b.py", "g", "function", 3, None, 1), ("c.py", "f", "class", 2, None, 1)], "path string, name string, kind string, line int, parent string, seq long")
    links = spark.createDataFrame([("b.py", "g", "a.py", "f", "calls"), ("b.py", "g", "a.py", "f", "calls"), ("b.py", "g", "c.py", "f", "calls"), ("a.py", "f", "b.py", "g", "imports")], "src_path string, src_name string, dst_path string, dst_name string, kind string")
    assert graph.edges(links).count() == 3 and graph.nodes(symbols).count() == 3
    assert [(r.path, r.line) for r in graph.by_name(symbols, "f").collect()] == [("a.py", 9), ("c.py", 2)]
    assert [r.name for r in graph.neighbours(symbols, links, "f", True).collect()] == ["g"]
    assert [r.path for r in graph.neighbours(symbols, links, "g", False).collect()] == ["a.py", "c.py"]
    assert graph.has_symbol(symbols, "a.py", "f") and not graph.has_symbol(symbols, "a.py", "g")
    graph.export_json(symbols, links, str(tmp_path / "g"))
    back = graph.import_json(spark, str(tmp_path / "g"))
    assert graph.nodes(back[0]).count() == 3 and graph.edges(back[1]).count() == 3
    with pytest.raises(Exception, match="unknown kind"):
        graph.edges(links.withColumn("kind", F.lit("other"))).collect()


def test_symbols_of_several_repositories(spark):
    of = "repo_id string, path string, name string, kind string, line int, parent string, seq long"
    symbols = spark.createDataFrame([("a", "m.py", "f", "function", 1, None, 1), ("b", "m.py", "g", "function", 3, None, 1), ("b", "m.py", "f", "class", 2, None, 1)], of)
    links = spark.createDataFrame([("a", "m.py", "h", "m.py", "f", "calls"), ("b", "m.py", "g", "m.py", "f", "calls"), ("b", "m.py", "g", "m.py", "f", "calls")], "repo_id string, src_path string, src_name string, dst_path string, dst_name string, kind string")
    whole = graph.with_ends(symbols, links)
    assert graph.nodes(whole).count() == 4 and graph.edges(links).count() == 2
    assert [(r.repo_id, r.name, r.kind) for r in graph.neighbours(whole, links, "f", True).collect()] == [("a", "h", "other"), ("b", "g", "function")]


def test_foreign_graphs_are_refused(spark, tmp_path):
    from millrace.errors import StoreError

    for number, text in enumerate(['{"type": "else", "name": "x"}', "no json", '{"type": "node"}']):
        (tmp_path / f"{number}.txt").write_text(text + "\n")
        with pytest.raises(StoreError):
            graph.import_json(spark, str(tmp_path / f"{number}.txt"))
    with pytest.raises(StoreError):
        graph.import_json(spark, str(tmp_path / "none"))


def test_measures_of_hits(spark):
    row = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "d", "x"], [False, True, False, True], 3), (["a"], [], [False], 0)], "r array<string>, e array<string>, h array<boolean>, n long")
    for got in row.select(evaluate.of_hits("h", "n", 3).alias("m"), evaluate.recall_at_k("r", "e", 3).alias("recall"), evaluate.mrr("r", "e").alias("mrr"), evaluate.ndcg_at_k("r", "e", 3).alias("ndcg")).collect():
        assert (got.m.recall, got.m.mrr, got.m.ndcg) == pytest.approx((got.recall, got.mrr, got.ndcg))


def test_traits_that_are_listed_twice_and_values_of_other_kinds(spark):
    said = '{"per_trait": {"a": 2, "b": [1], "c": 0, "d": [], "e": "YES", "f": {"x": 1}, "g": null, "h": 0.5, "i": "no", "j": {}}}'
    rows = spark.createDataFrame([(said, list("abcdefghij")), (said, ["a", "a", "c", "missing"])], "judged string, traits array<string>")
    got = [r.r for r in rows.select(evaluate.rubric("judged", "traits").alias("r")).collect()]
    assert got[0].per_trait == {"a": True, "b": True, "c": False, "d": False, "e": True, "f": True, "g": False, "h": True, "i": False, "j": False}
    assert got[1].score == 0.25 and got[1].per_trait == {"a": True, "c": False, "missing": False}
