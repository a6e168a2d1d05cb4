"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math

import pytest

from millrace.plans import queries as library

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    made = duckdb.connect()
    for name in TABLES:
        made.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return made


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, duck, name):
    ours = library.QUERIES[name](spark, FOLDER)
    theirs = duck.sql(library.SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in ours.collect())
    want = sorted(tuple(map(plain, r)) for r in theirs.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want
