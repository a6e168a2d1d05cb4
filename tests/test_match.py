"""Match texts over stored positions, against positions kept in Python."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from millrace.errors import RetrieveError, StoreError
from millrace.operators import lexical, match

ROWS = [
    (1, "r1", "needle in haystack", None), (2, "r1", "needle needle needle in a haystack", "needle"), (3, "r2", "other words here", "Nädle"),
    (4, "r2", "foo bar baz foo-bar", "x"), (5, "r2", "in a needle the haystack of the needle", "foo bar"), (6, "r3", "", None), (7, "r3", None, "hay"), (8, "r1", "one two three four five six", "two"),
]


@pytest.fixture(scope="module")
def lexicon(spark, tmp_path_factory):
    rows = spark.createDataFrame(ROWS, "id long, repo_id string, content string, symbol string")
    return match.Lexicon(spark, str(tmp_path_factory.mktemp("lexicon") / "i"), "id", ("content", "symbol"), ("repo_id",)).write(rows, 6, content="content", symbol="symbol")


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("needle", {1, 2, 5}), ("needle haystack", {1, 2, 5}), ("needle OR foo", {1, 2, 4, 5}), ("needle NOT foo", {1, 2}), ("needle NOT foo OR bar", {1, 2, 4, 5}),
        ("needle AND NOTHING", set()), ('"in haystack"', {1}), ('"in a"', {2, 5}), ("in + a", {2, 5}), ("foo-", None), ('"foo bar"', {4, 5}), ("symbol : needle", {2}), ("content:foo", {4}), ("- symbol : foo", {4}),
        ("{content symbol} : foo", {4, 5}), ("symbol:(foo OR hay*)", {5, 7}), ("hay*", {1, 2, 5, 7}), ('"a hay" *', {2}), ("^ needle", {1, 2}), ("symbol : ^two", {8}), ("NEAR(one four, 2)", {8}), ("NEAR(one four, 1)", set()),
        ("NEAR(four one, 2)", {8}), ('NEAR("one two" "four five" six, 1)', set()), ('NEAR("one two" "four five" six, 3)', {8}), ("NEAR(needle haystack)", {1, 2, 5}), ("NADLE", {3}), ("one two NOT three", set()), ("(needle OR foo) AND the", {5}), ('needle "!!"', {1, 2, 5}), ('needle NOT "?"', {1, 2, 5}),
        ('"unterminated', None), ("", None), ("  ", None), ('"..."', None), ("needle)", None), ("(needle", None), ("needle AND", None), ("NOT needle", None), ("nofield:x", None), ("a,b", None), ("who's", None), ("NEAR(a b, c)", None), ("NEAR()", None), ("(a OR b) c", None), ("needle?", None), ("{content: a", None), ("*", None),
    ],
)
def test_what_is_found(lexicon, text, found):
    if found is None:
        with pytest.raises(StoreError) as error:
            lexicon.search(text)
        assert error.value.context["query"] == text
    else:
        assert {r.id for r in lexicon.search(text, None).collect()} == found


def test_scores(spark, lexicon):
    rows = spark.createDataFrame(ROWS, "id long, repo_id string, content string, symbol string")
    for words in (["needle"], ["needle", "foo"], ["in", "haystack", "bar"]):
        plain = lexical.bm25_scan(rows, "id", ("content", "symbol"), words, None)
        stored = lexical.merged(lexicon.postings(), "id", ("repo_id",)), lexicon.lengths()
        want = sorted(map(tuple, plain.collect()))
        assert sorted(map(tuple, lexicon.search(" OR ".join(words), None).collect())) == want == sorted(map(tuple, lexical.bm25(stored, "id", words, None).collect()))
    idf = max(1e-6, math.log((8 - 2 + 0.5) / (2 + 0.5)))  # two rows hold the phrase
    mean = sum(len(lexical.query_terms(spark, f"{c or ''} {s or ''}") and (c or "").replace("-", " ").split() + (s or "").split()) for _, _, c, s in ROWS) / 8
    assert lexicon.search('"foo bar"', 1).collect() == [(4, round(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 6 / mean)), 6))]
    part = lexicon.search("needle", None, F.col("repo_id") == "r2").collect()
    assert [r.id for r in part] == [5] and part[0] in lexicon.search("needle", None).collect()
    with pytest.raises(RetrieveError):
        lexicon.search("needle", 0)


def test_clumps_are_those_of_all_choices(spark):
    rows = [(i, " ".join("abcd"[(i * 7 + j * j + j // 3) % 4] for j in range(14))) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, content string")
    stored = lexical.placed_postings(frame, "id", {"content": "content"}), lexical.lengths(frame, "id", "content")
    for text, phrases, n in (('NEAR("a b" c, 1)', (["a", "b"], ["c"]), 1), ("NEAR(d a c, 0)", (["d"], ["a"], ["c"]), 0)):
        want = set()
        for i, content in rows:
            words = content.split()
            places = [[p for p in range(len(words)) if words[p : p + len(x)] == x] for x in phrases]
            if any(max(c) - min(p + len(x) for p, x in zip(c, phrases)) <= n for c in itertools.product(*places)):
                want.add(i)
        assert {r.id for r in match.search(stored, "id", match.parse(spark, text, ("content",)), None).collect()} == want


def test_dictionary_and_files(spark, lexicon):
    assert {(r.term, r.df, r.cf) for r in lexicon.with_prefix("h").select("term", "df", "cf").collect()} == {("haystack", 3, 3), ("hay", 1, 1), ("here", 1, 1)}
    every = {r[0] for r in lexicon.postings().select("_metadata.file_name").distinct().collect()}
    leaves = list(match._leaves(match.parse(spark, "hay* foo", ("content", "symbol"))))
    assert len(every) > 1 and set(lexicon.files(leaves)) < every
    plan = lexicon.search('"foo bar" OR hay*')._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "StringStartsWith(term,hay)" in plan
