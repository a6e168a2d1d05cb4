"""Postings that are grouped where rows are read, against counts in Python."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import lexical, match

ROWS = [(1, "a", "x y x", "x z"), (2, "a", "", None), (3, "b", None, "y"), (4, "b", "z " * 9 + "x", "Ü u"), (5, "c", " ".join(f"w{i % 7}" for i in range(50)), "w3")]
AGAIN = [(1, "a", "y y", "z q r"), (4, "b", "x", None)]  # the first has as many tokens as the other row of its key


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, repo_id string, content string, symbol string")


def by_hand(rows):
    found = defaultdict(list)
    for key, repo, *texts in rows:
        tokens = [(text or "").lower().replace("ü", "u").split() for text in texts]
        for name, words in zip(("content", "symbol"), tokens):
            for at, word in enumerate(words):
                found[word, key, repo, name, sum(map(len, tokens))].append(at)
    return sorted((*k, len(v), sorted(v)) for k, v in found.items())


@pytest.mark.parametrize("rows", [ROWS, ROWS + AGAIN])
@pytest.mark.parametrize("size", [1, 4, 1 << 18])
def test_postings_are_those_of_a_count(spark, monkeypatch, rows, size):
    monkeypatch.setattr(lexical, "SLICE", size)
    docs, want = frame(spark, rows), by_hand(rows)
    got = lexical.placed_postings(docs, "id", {"content": "content", "symbol": "symbol"}, ("repo_id",)).select("term", "id", "repo_id", "field", "dl", "tf", "positions")
    assert sorted((*r[:6], list(r[6])) for r in got.collect()) == want
    times = Counter()
    for term, key, repo, _, dl, tf, _ in want:
        times[term, key, repo, dl] += tf
    plain = lexical.postings(docs, "id", "content", "symbol", keep=("repo_id",)).select("term", "id", "repo_id", "dl", "tf")
    assert sorted(map(tuple, plain.collect())) == sorted((*k, n) for k, n in times.items())


@pytest.mark.parametrize("rows", [ROWS, ROWS + AGAIN])
def test_dictionary_counts_a_key_once(spark, tmp_path, rows):
    made = match.Lexicon(spark, str(tmp_path / "i"), "id", ("content", "symbol"), ("repo_id",)).write(frame(spark, rows), 3, content="content", symbol="symbol")
    keys, times = defaultdict(set), Counter()
    for term, key, *_, tf, _ in by_hand(rows):
        keys[term].add(key)
        times[term] += tf
    assert {(r.term, r.df, r.cf) for r in made.terms().collect()} == {(term, len(keys[term]), times[term]) for term in keys}
    held = made.postings().select("term", F.col("_metadata.file_name").alias("f")).groupBy("term").agg(F.collect_set("f").alias("f")).collect()
    assert {r.term: set(r.f) for r in held} == {r.term: set(r.files) for r in made.terms().collect()}
    assert sorted(map(tuple, made.lengths().select("id", "dl").collect())) == sorted(map(tuple, lexical.lengths(frame(spark, rows), "id", "content", "symbol").collect()))


def test_no_token_is_shuffled_to_be_grouped(spark):
    found = lexical.by_row(frame(spark, ROWS), "id", lexical.field_terms({"content": "content"}))
    plan = lexical.placed_of(found, "id", repeated=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert not lexical.repeats(frame(spark, ROWS), "id") and lexical.repeats(frame(spark, ROWS + AGAIN), "id")
