"""Set operators: version, snapshot and checkpoint differences, merges of sets, what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..registry import query

OLD = "a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0)"
NEW = "b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0)"


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = tables.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return o.where("o_orderkey % 5 <> 0"), new


def diff(old: DataFrame, new: DataFrame, key: str, checksum: list[str]) -> DataFrame:
    """key, state (added, removed, modified, unchanged) and both rows, from one full outer join."""
    a = old.select(F.col(key).alias("ka"), F.struct(*checksum).alias("x"))
    b = new.select(F.col(key).alias("kb"), F.struct(*checksum).alias("y"))
    j = a.join(b, a["ka"] == b["kb"], "full")
    state = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "removed").when(F.col("x").eqNullSafe(F.col("y")), "unchanged").otherwise("modified")
    return j.select(F.coalesce("ka", "kb").alias(key), state.alias("state"), "x", "y")


@query(f"""WITH {OLD}, {NEW} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus = b.o_orderstatus AND a.o_totalprice = b.o_totalprice THEN 'unchanged' ELSE 'modified' END AS state FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(*versions(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "state")


@query(f"""WITH {OLD}, {NEW} SELECT count_if(b.o_orderkey IS NULL) AS removed, count_if(a.o_orderkey IS NULL) AS added, count_if(a.o_orderkey = b.o_orderkey) AS kept, round(sum(CASE WHEN a.o_orderkey IS NULL THEN b.o_totalprice ELSE 0 END), 2) AS bytes_added, round(sum(CASE WHEN b.o_orderkey IS NULL THEN a.o_totalprice ELSE 0 END), 2) AS bytes_removed,
round(count_if(a.o_orderkey = b.o_orderkey) / count(*), 6) AS unchanged_ratio FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def delta_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diff(*versions(spark, sf_dir), "o_orderkey", ["o_totalprice"])
    is_ = {s: F.col("state") == s for s in ("added", "removed")}
    kept = F.count_if(~is_["added"] & ~is_["removed"])
    return d.agg(F.count_if(is_["removed"]).alias("removed"), F.count_if(is_["added"]).alias("added"), kept.alias("kept"), F.round(F.sum(F.when(is_["added"], F.col("y.o_totalprice")).otherwise(0.0)), 2).alias("bytes_added"), F.round(F.sum(F.when(is_["removed"], F.col("x.o_totalprice")).otherwise(0.0)), 2).alias("bytes_removed"), F.round(F.when(F.count("*") > 0, kept / F.count("*")).otherwise(1.0), 6).alias("unchanged_ratio"))


@query(f"WITH {OLD}, {NEW} SELECT 'added' AS change, o_orderkey FROM (SELECT o_orderkey FROM b EXCEPT SELECT o_orderkey FROM a) UNION ALL SELECT 'removed', o_orderkey FROM (SELECT o_orderkey FROM a EXCEPT SELECT o_orderkey FROM b)")
def delta_added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta; its inverse swaps the two tags."""
    old, new = (v.select("o_orderkey") for v in versions(spark, sf_dir))
    return new.subtract(old).select(F.lit("added").alias("change"), "o_orderkey").union(old.subtract(new).select(F.lit("removed"), "o_orderkey"))


@query(f"WITH {OLD}, {NEW} SELECT o_orderkey FROM a INTERSECT SELECT o_orderkey FROM b")
def shared_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = versions(spark, sf_dir)
    return old.select("o_orderkey").intersect(new.select("o_orderkey"))


@query("""SELECT coalesce(x.label, y.label) AS label, CASE WHEN x.label IS NULL THEN 'added' WHEN y.label IS NULL THEN 'removed' WHEN x.c = y.c THEN 'unchanged' ELSE 'modified' END AS state FROM (SELECT label, sum(vec_id) AS c FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY 1) x FULL JOIN (SELECT label, sum(vec_id) AS c FROM embeddings WHERE vec_id % 3 <> 0 OR label % 2 = 0 GROUP BY 1) y ON x.label = y.label""")
def checkpoint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors by name and checksum."""
    e = tables.load(spark, sf_dir, "embeddings")
    old, new = (e.where(c).groupBy("label").agg(F.sum("vec_id").alias("c")) for c in ("vec_id % 3 <> 0", "vec_id % 3 <> 0 or label % 2 = 0"))
    return diff(old, new, "label", ["c"]).select("label", "state")


def or_set_merge(*replicas: DataFrame) -> DataFrame:
    """Union of (element, node, dot); an element is there while one of its dots is."""
    out = replicas[0]
    for r in replicas[1:]:
        out = out.unionByName(r)
    return out.distinct()


@query("""SELECT user_id AS element, count(*) AS dots, max(dot) AS version FROM (SELECT DISTINCT user_id, user_id % 5 AS node, event_id AS dot FROM events WHERE event_id % 3 <> 0 UNION SELECT user_id, user_id % 5, event_id FROM events WHERE event_id % 4 = 0) GROUP BY 1""")
def orset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.load(spark, sf_dir, "events").select(F.col("user_id").alias("element"), (F.col("user_id") % 5).alias("node"), F.col("event_id").alias("dot"))
    return or_set_merge(d.where("dot % 3 <> 0"), d.where("dot % 4 = 0")).groupBy("element").agg(F.count("*").alias("dots"), F.max("dot").alias("version"))


def missing_numbers(df: DataFrame, key: str, index: str, n: str) -> DataFrame:
    """{0..n-1} without what is there, for each key."""
    there = df.groupBy(key).agg(F.collect_set(index).alias("there"), F.max(n).alias("n"))
    return there.select(key, F.explode(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.col("there"))).alias("missing"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber - 1 AS i FROM lineitem WHERE l_linenumber % 3 <> 0), k AS (SELECT DISTINCT l_orderkey FROM t) SELECT l_orderkey, CAST(m AS BIGINT) AS missing FROM (SELECT l_orderkey, unnest(generate_series(0, 6)) AS m FROM k) x WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.l_orderkey = x.l_orderkey AND t.i = x.m)""")
def missing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.load(spark, sf_dir, "lineitem").where("l_linenumber % 3 <> 0").select("l_orderkey", (F.col("l_linenumber") - 1).cast("long").alias("i"), F.lit(7).cast("long").alias("n"))
    return missing_numbers(t, "l_orderkey", "i", "n")


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first occurrence of each."""
    return tables.load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"))


@query("SELECT o_custkey, count(*) - count_if(o_orderstatus = 'F') AS remaining FROM orders GROUP BY 1")
def remaining_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.load(spark, sf_dir, "orders")
    left = o.select("o_custkey", "o_orderkey").join(o.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("left"))
    return o.select("o_custkey").distinct().join(left, "o_custkey", "left").select("o_custkey", F.coalesce("left", F.lit(0)).alias("remaining"))


@query("SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey % 8 AS VARCHAR), ',' ORDER BY CAST(l_suppkey % 8 AS VARCHAR)) AS domains FROM lineitem GROUP BY 1")
def distinct_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.array_sort(F.collect_set((F.col("l_suppkey") % 8).cast("string")))
    return tables.load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(d, ",").alias("domains"))
