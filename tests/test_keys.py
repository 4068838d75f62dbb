"""Key functions on keys that the smallest tables don't have."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from quern.functions.keys import next_name
from quern.registry import ORACLE_SQL, QUERIES

KEYS = [0, 9, 99998, 99999, 100000, 999998, 999999, 1000000, 1000009, 1199999, 9999999, 12345678]


def test_next_name_query_at_a_carry(spark, tmp_path):
    path = str(tmp_path / "part.parquet")
    spark.createDataFrame([(k,) for k in KEYS], "p_partkey long").write.parquet(path)
    got = sorted(tuple(r) for r in QUERIES["next_name"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(c.sql(ORACLE_SQL["next_name"]).fetchall())


def test_next_name_grows_at_a_carry(spark):
    want = {"shard-999999.bin": "shard-1000000.bin", "a9": "a10", "a09b": "a10b", "7/x008": "7/x009", "none": None}
    got = spark.createDataFrame([(k,) for k in want], "k string").select("k", next_name(F.col("k"))).collect()
    assert dict(map(tuple, got)) == want
