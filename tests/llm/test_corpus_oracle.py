"""Operator queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from tessera.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = con.execute(registry.ORACLE_SQL[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[at.index(c)] for c in columns) for r in result.fetchall()), key=repr)
