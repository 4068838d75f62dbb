"""Tables of a scale-factor folder, and the storage relations that stand on them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table. Time arithmetic is in UTC throughout, so the session is pinned to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; one of our own only on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: read as often as wanted, it stays the same, and lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/quern-tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def millis(ts) -> F.Column:
    """Milliseconds since 1970 of a timestamp without zone."""
    return F.unix_millis(F.col(ts).cast("timestamp")) if isinstance(ts, str) else F.unix_millis(ts.cast("timestamp"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, op, seq, ts_ms, latency_ms: one access per event; value is its latency."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_type").alias("op"), F.col("event_id").alias("seq"), millis("ts").alias("ts_ms"), F.col("value").alias("latency_ms"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk, size_bytes: parts stand for chunks."""
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk"), (F.col("p_size").cast("long") * 65536).alias("size_bytes"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge and its state: suppliers stand for edges; figures follow from their keys."""
    k = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(
        k.alias("edge"),
        (F.lit(1e6) * (1 + k % 97)).alias("bandwidth"),
        (F.lit(1000.0) * (1 + k % 53)).alias("rtt_us"),
        (F.lit(1.0) - (k % 10) / F.lit(20.0)).alias("health"),
        ((k % 11) / F.lit(10.0)).alias("load"),
        (k % 7).cast("long").alias("active"),
        (F.lit(6) + k % 3).cast("long").alias("slots"),
        (k % 13 != 0).alias("online"),
    )


EDGES_SQL = """edges AS (
  SELECT s_suppkey AS edge, 1e6::DOUBLE * (1 + s_suppkey % 97) AS bandwidth, 1000.0::DOUBLE * (1 + s_suppkey % 53) AS rtt_us,
         1.0::DOUBLE - (s_suppkey % 10) / 20.0::DOUBLE AS health, (s_suppkey % 11) / 10.0::DOUBLE AS load,
         s_suppkey % 7 AS active, 6 + s_suppkey % 3 AS slots, s_suppkey % 13 <> 0 AS online FROM supplier)"""

CHUNKS_SQL = "chunks AS (SELECT p_partkey AS chunk, CAST(p_size AS BIGINT) * 65536 AS size_bytes FROM part)"


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (chunk, edge): which supplier ever shipped a part."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk"), F.col("l_suppkey").alias("edge")).distinct()


REPLICAS_SQL = "replicas AS (SELECT DISTINCT l_partkey AS chunk, l_suppkey AS edge FROM lineitem)"
ACCESS_SQL = "access AS (SELECT user_id AS key, event_type AS op, event_id AS seq, (epoch_us(ts) // 1000) AS ts_ms, value AS latency_ms FROM events)"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, size: the path of a page's address, without scheme."""
    p = load(spark, sf_dir, "pages")
    return p.select(F.regexp_replace("url", "^https?://", "").alias("key"), F.octet_length("html").cast("long").alias("size"), "page_id")


KEYS_SQL = "keys AS (SELECT regexp_replace(url, '^https?://', '') AS key, CAST(octet_length(encode(html)) AS BIGINT) AS size, page_id FROM pages)"
