"""Every registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from sieveline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    out = []
    for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False):
        out.append(tuple(None if x is None or x != x else str(x)[:19] if hasattr(x, "year") else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10


def test_names_match():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    mine, theirs = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows_only(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
