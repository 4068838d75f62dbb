"""The queries that SQL can express, against DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quern.llm.queries import ORACLE_SQL, QUERIES


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, want = QUERIES[name](spark, sf_dir), c.sql(ORACLE_SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_plain_backoff(spark, sf_dir):
    """Every n-gram that is there counts as seen."""
    from quern.llm.lm_scores import lm_scores, oracle

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df, want = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")), c.sql(oracle())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
