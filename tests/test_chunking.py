import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions import text as t
from millrace.operators import chunking

FILES = "repo_id string, path string, language string, content string"
SOURCE = '''import os

@decorated
def first(a):
    return a


class Second(object):
    x = 1

    def plain(self):
        return 2

    @property
    def hidden(self):
        return 3

async def third():
    pass
'''


def test_windows_of_100_lines(spark):
    rows = spark.createDataFrame([("r", "a.txt", None, "\n".join(f"line {i}" for i in range(1, 101))), ("r", "blank", None, " \n\t\n")], FILES)
    got = [(r.start_line, r.end_line, r.kind) for r in chunking.chunk_files(rows).orderBy("start_line").collect()]
    assert got == [(1, 50, "block"), (46, 95, "block"), (91, 100, "block")]


def test_python_definitions(spark):
    rows = spark.createDataFrame([("r", "m.py", "python", SOURCE), ("r", "bad.py", "python", "def (:\n"), ("r", "flat.py", "python", "x = 1\n")], FILES)
    got = {(r.path, r.kind, r.symbol, r.start_line, r.end_line) for r in chunking.chunk_files(rows).collect()}
    assert got == {
        ("m.py", "function", "first", 3, 5), ("m.py", "class", "Second", 8, 16), ("m.py", "method", "plain", 11, 12), ("m.py", "function", "third", 18, 19),
        ("bad.py", "file", None, 1, 1), ("flat.py", "file", None, 1, 1),
    }


def test_ids_are_hashes(spark):
    row = chunking.fixed_windows(spark.createDataFrame([("r", "p", None, "a\r\nb")], FILES)).first()
    hashed = hashlib.sha256(b"a\nb\n").hexdigest()
    assert row.content == "a\nb\n" and row.content_hash == hashed
    assert row.chunk_id == hashlib.sha256(f"r\np\n1-2\n{hashed}".encode()).hexdigest()[:32]


@settings(max_examples=40, deadline=None)
@given(n=st.integers(1, 400), window=st.integers(2, 60), data=st.data())
def test_definitions_of_any_length(n, window, data):
    """The rule for starts covers every line, and only the last window may be short."""
    overlap = data.draw(st.integers(0, window - 1))
    step = window - overlap
    starts = [s for s in range(1, n + 1, step) if s == 1 or s + overlap - 1 < n]
    ends = [min(s + window - 1, n) for s in starts]
    assert ends[-1] == n and all(e - s + 1 == window for s, e in zip(starts[:-1], ends[:-1]))


def test_lines_and_names(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("a\nb\n", "x/y/Name.tar.gz"), ("", "x/.hidden"), ("a\n\n", "noext"), ("a\x0cb c", "d.e/f")], "t string, p string")
    rows = one.select(t.lines(F.col("t")).alias("l"), t.suffix(F.col("p")).alias("s"), t.stem(F.col("p")).alias("m")).collect()
    assert [r.l for r in rows] == [["a", "b"], [], ["a", ""], ["a", "b", "c"]]
    assert [r.s for r in rows] == [".gz", "", "", ""]
    assert [r.m for r in rows] == ["Name.tar", ".hidden", "noext", "f"]
