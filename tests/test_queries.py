"""Every registered query with SQL against DuckDB on the small tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from sitara.plans.queries import ORACLE_SQL, QUERIES


def _norm(x):
    if isinstance(x, float):
        return round(x, 9)
    return tuple(map(_norm, x)) if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(_norm(r[c]) for c in columns)) for r in df.collect())
    sql = duck.sql(ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(_norm(r[i]) for i in at)) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    """Queries without SQL: every column is computed, reruns agree, and there are rows."""
    first, again = (sorted(map(repr, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert first and first == again


def test_no_value_columns(spark, sf_dir):
    """Nothing that a query returns has a column for matched values."""
    for name in ("detect_documents", "ner_dictionary_tagger", "recognize_national_id"):
        assert not {"value", "text"} & set(QUERIES[name](spark, sf_dir).columns)
