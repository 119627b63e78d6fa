"""Every query with SQL against DuckDB on a small scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell import queries as engine

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_matches_sql(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    want = duck.execute(engine.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    plain = df.selectExpr(*[f"cast(`{c}` as timestamp_ntz) `{c}`" if t == "timestamp" else f"`{c}`" for c, t in df.dtypes])
    assert canonical(df.columns, [tuple(r) for r in plain.collect()]) == canonical(columns, want.fetchall())


def test_others_run(spark):
    for name in sorted(set(engine.QUERIES) - set(engine.SQL)):
        assert engine.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
