"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(DIR, t)}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    got = df.collect()
    r = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    want = r.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want)
    assert got, "an empty result proves nothing"
