"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in sorted(os.listdir(DIR))]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, DIR)
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted(tuple(map(norm, r)) for r in df.collect())
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_training_data_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(f"{root}/docloom"):
        for name in names:
            if name.endswith(".py") and not folder.startswith(f"{root}/docloom/llm"):
                assert "docloom.llm" not in open(f"{folder}/{name}").read(), name
