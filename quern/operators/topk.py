"""Sort, limit and top-k operators. A limit here is the feature itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..registry import query
from .rules import COST_SQL, edge_cost

A, C, E, R = tables.ACCESS_SQL, tables.CHUNKS_SQL, tables.EDGES_SQL, tables.REPLICAS_SQL


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """rank 1 to k of each group. Spark keeps only k rows of a group before the shuffle (window group limit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def k_cheapest_edges(costs: DataFrame, k: int, max_cost: float) -> DataFrame:
    return top_per_group(costs.where(F.col("cost") <= max_cost), ["chunk"], [F.col("cost"), F.col("edge")], k)


@query(f"""WITH {C}, {E}, {R}, {COST_SQL}, x AS (SELECT chunk, edge, cost, row_number() OVER (PARTITION BY chunk ORDER BY cost, edge) AS rank FROM costs WHERE cost <= 0.9)
SELECT chunk, edge, round(cost, 6) AS cost, CAST(rank AS INTEGER) AS rank FROM x WHERE rank <= 3""")
def k_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: for each chunk the three cheapest edges that hold it, under a cost limit."""
    return k_cheapest_edges(edge_cost(spark, sf_dir), 3, 0.9).select("chunk", "edge", F.round("cost", 6).alias("cost"), "rank")


@query(f"WITH {E} SELECT edge, round(health, 6) AS health, rank() OVER (ORDER BY round(health, 6) DESC) AS rank FROM edges")
def rank_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by score; equal scores share the rank of their first. Places come from sorted ranges, never from one task."""
    from .joins import numbered

    e = tables.edges(spark, sf_dir).select("edge", F.round("health", 6).alias("health"))
    placed = numbered(e.withColumn("at", F.struct((-F.col("health")).alias("score"), "edge")), "at")
    ranks = placed.groupBy("health").agg(F.min("pos").cast("long").alias("rank"))
    return e.join(ranks, "health").select("edge", "health", "rank")


@query(f"WITH {E} SELECT edge, rtt_us FROM edges ORDER BY CASE WHEN edge % 10 = 0 THEN rtt_us - 10000 ELSE rtt_us END, edge LIMIT 15")
def latency_local_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest, where a local one is preferred within ten milliseconds."""
    key = F.when(F.col("edge") % 10 == 0, F.col("rtt_us") - 10000).otherwise(F.col("rtt_us"))
    return tables.edges(spark, sf_dir).orderBy(key, "edge").limit(15).select("edge", "rtt_us")


@query(f"WITH {A} SELECT key, count(*) AS n FROM access GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def hot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.access_log(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(20)


@query(f"WITH {A} SELECT key, round(avg(latency_ms) / 100, 6) AS score FROM access GROUP BY 1 HAVING round(avg(latency_ms) / 100, 6) >= 0.3 ORDER BY score DESC, key LIMIT 10")
def prediction_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.access_log(spark, sf_dir).groupBy("key").agg(F.round(F.avg("latency_ms") / 100, 6).alias("score"))
    return s.where("score >= 0.3").orderBy(F.desc("score"), "key").limit(10)


@query(f"""WITH {R}, {E}, x AS (SELECT chunk, edge, health * (1 - load) AS score FROM replicas JOIN edges USING (edge) WHERE online), y AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY score DESC, edge) AS rank FROM x WHERE score > 0) SELECT chunk, edge, CAST(rank AS INTEGER) AS rank FROM y WHERE rank <= 3""")
def top3_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables.replicas(spark, sf_dir).join(tables.edges(spark, sf_dir).where("online"), "edge").withColumn("score", F.col("health") * (1 - F.col("load"))).where("score > 0")
    return top_per_group(x, ["chunk"], [F.desc("score"), F.col("edge")], 3).select("chunk", "edge", "rank")


@query(f"""WITH {R}, {E} SELECT chunk, arg_max(edge, (bandwidth * (1 - load) * health / (rtt_us + 1), -edge)) AS source FROM replicas JOIN edges USING (edge) WHERE online GROUP BY 1""")
def best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("bandwidth") * (1 - F.col("load")) * F.col("health") / (F.col("rtt_us") + 1)
    x = tables.replicas(spark, sf_dir).join(tables.edges(spark, sf_dir).where("online"), "edge")
    return x.groupBy("chunk").agg(F.max_by("edge", F.struct(score, -F.col("edge"))).alias("source"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 3 AND o_orderkey % 10 <> 0")
def keep_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes when the three newest versions and the protected ones stay."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    orders = tables.load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", r.alias("r"))
    protected = tables.load(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select("o_orderkey")
    return orders.where("r > 3").join(protected, "o_orderkey", "left_anti").select("o_custkey", "o_orderkey")


@query("""WITH d AS (SELECT o_custkey % 300 AS key, arg_min(o_orderkey, (o_orderpriority, o_orderdate, o_orderkey)) AS job, min(o_orderpriority) AS priority FROM orders GROUP BY 1) SELECT key, job, priority FROM d ORDER BY priority, job LIMIT 50""")
def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per key, by priority and then first in, first out."""
    o = tables.load(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 300).alias("key")).agg(F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderdate", "o_orderkey")).alias("job"), F.min("o_orderpriority").alias("priority"))
    return o.orderBy("priority", "job").limit(50)


@query(f"WITH {tables.KEYS_SQL} SELECT split_part(key, '/', 1) AS host, CAST(sum(size) AS BIGINT) AS bytes FROM keys GROUP BY 1 ORDER BY bytes DESC, host LIMIT 5")
def top_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keys(spark, sf_dir).groupBy(F.substring_index("key", "/", 1).alias("host")).agg(F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), "host").limit(5)


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS snapshot FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def latest_active_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("snapshot"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS r, sum(o_totalprice) OVER w - o_totalprice AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE r <= 5 AND before < 300000""")
def rate_capped_dequeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First in, first out while fewer than five run and their bytes stay under the cap; the one that crosses it goes."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = tables.load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r"), (F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("o_totalprice")).alias("before"))
    return x.where("r <= 5 and before < 300000").select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, ['a', 'b', 'c'][l_linenumber % 3 + 1] AS source FROM lineitem")
def round_robin_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.pmod(F.col("l_linenumber"), F.lit(3)) + 1)
    return tables.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", pick.alias("source"))
