"""Maintenance jobs: collection of garbage, eviction, scrubbing, repair, stripes, logs, snapshots, lifecycle runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..registry import query

A, C, E, R = tables.ACCESS_SQL, tables.CHUNKS_SQL, tables.EDGES_SQL, tables.REPLICAS_SQL


def garbage(chunks: DataFrame, referenced: DataFrame, protected: DataFrame, min_age: int, batch: int) -> DataFrame:
    """Chunks without a reference, old enough and not protected, the oldest first, one batch of them."""
    dead = chunks.join(referenced, "chunk", "left_anti").join(protected, "chunk", "left_anti").where(F.col("age") >= min_age)
    return dead.orderBy(F.desc("age"), "chunk").limit(batch)


@query(f"""WITH {R} SELECT p_partkey AS chunk, CAST(p_size AS BIGINT) AS age FROM part WHERE p_partkey NOT IN (SELECT chunk FROM replicas WHERE edge % 20 = 0) AND p_partkey % 10 <> 0 AND p_size >= 10 ORDER BY age DESC, chunk LIMIT 100""")
def gc_with_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk"), F.col("p_size").cast("long").alias("age"))
    used = tables.replicas(spark, sf_dir).where("edge % 20 = 0").select("chunk").distinct()
    return garbage(chunks, used, chunks.where("chunk % 10 = 0").select("chunk"), 10, 100)


@query(f"WITH {A}, s AS (SELECT key, max(ts_ms) AS last FROM access GROUP BY 1) SELECT key FROM s WHERE last < (SELECT max(last) FROM s) - 3 * 3600000::BIGINT")
def stale_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.access_log(spark, sf_dir).groupBy("key").agg(F.max("ts_ms").alias("last"))
    now = s.agg(F.max("last").alias("now"))
    return s.crossJoin(F.broadcast(now)).where(F.col("last") < F.col("now") - 3 * 3_600_000).select("key")


@query("""SELECT CASE WHEN doc_id % 40 = 0 THEN 'deep' ELSE 'light' END AS pass, count(*) AS checked, count_if(CASE WHEN doc_id % 40 = 0 THEN doc_id % 80 = 0 ELSE n_chars <> length(text) END) AS quarantined FROM documents GROUP BY 1""")
def scrub_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light passes compare sizes; deep ones compare digests of the stored bytes with the recorded ones."""
    deep = F.col("doc_id") % 40 == 0
    stored = F.when(F.col("doc_id") % 80 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    bad = F.when(deep, F.sha2(stored, 256) != F.sha2("text", 256)).otherwise(F.col("n_chars") != F.length("text"))
    return tables.load(spark, sf_dir, "documents").groupBy(F.when(deep, "deep").otherwise("light").alias("pass")).agg(F.count("*").alias("checked"), F.count_if(bad).alias("quarantined"))


@query(f"""WITH {R}, {E}, n AS (SELECT chunk, count(*) AS n FROM replicas GROUP BY 1 HAVING count(*) < 32), c AS (SELECT n.chunk, e.edge, row_number() OVER (PARTITION BY n.chunk ORDER BY e.health DESC, e.edge) AS r, 32 - n.n AS need FROM n, (SELECT * FROM edges WHERE online) e WHERE NOT EXISTS (SELECT 1 FROM replicas x WHERE x.chunk = n.chunk AND x.edge = e.edge)) SELECT chunk, edge FROM c WHERE r <= need""")
def replication_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each chunk short of copies, the healthiest of all online peers that lack it, as many as are short."""
    return missing_copies(tables.replicas(spark, sf_dir), tables.edges(spark, sf_dir), 32)


def missing_copies(held: DataFrame, edges: DataFrame, copies: int) -> DataFrame:
    """(chunk, edge): where each chunk with fewer copies gets the rest.

    A chunk with n copies holds n at most of the ``copies`` healthiest peers, so its ``copies - n`` best are among those.
    """
    short = held.groupBy("chunk").agg((copies - F.count("*")).alias("need"), F.collect_set("edge").alias("have")).where("need > 0")
    peers = edges.where("online").orderBy(F.desc("health"), "edge").limit(copies)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("health")).alias("ill"), "edge")))
    c = short.crossJoin(F.broadcast(peers.agg(ranked.alias("p")).select(F.transform("p", lambda x: x["edge"]).alias("best"))))
    left = F.filter("best", lambda e: ~F.array_contains("have", e))
    return c.select("chunk", F.explode(F.slice(left, F.lit(1), F.col("need").cast("int"))).alias("edge"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS path, CASE WHEN l_quantity > 48 THEN 'timeout' WHEN l_quantity > 45 THEN 'retry' ELSE 'ok' END AS state FROM lineitem")
def stripe_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return tables.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_linenumber", F.lit(3)).alias("path"), F.when(q > 48, "timeout").when(q > 45, "retry").otherwise("ok").alias("state"))


@query("SELECT l_orderkey AS chunk, count(DISTINCT l_linenumber) AS shards, count(DISTINCT l_linenumber) >= 4 AS can_decode, greatest(4 - count(DISTINCT l_linenumber), 0) AS needed FROM lineitem GROUP BY 1")
def session_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_distinct("l_linenumber")
    return tables.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk")).agg(n.alias("shards"), (n >= 4).alias("can_decode"), F.greatest(4 - n, F.lit(0)).alias("needed"))


def apply_log(log: DataFrame) -> DataFrame:
    """The objects left by an ordered log of puts, deletes and bucket deletes (which take all earlier objects of it)."""
    last = log.where("op <> 'drop'").groupBy("bucket", "key").agg(F.max_by(F.struct("idx", "op", "value"), "idx").alias("l"))
    drops = log.where("op = 'drop'").groupBy("bucket").agg(F.max("idx").alias("dropped"))
    left = last.join(drops, "bucket", "left").where("l.op = 'put' and (dropped is null or l.idx > dropped)")
    return left.select("bucket", "key", "l.value")


@query("""WITH g AS (SELECT event_id AS idx, user_id % 10 AS bucket, user_id AS key, value, CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'drop' WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op FROM events), d AS (SELECT bucket, max(idx) AS dropped FROM g WHERE op = 'drop' GROUP BY 1), l AS (SELECT bucket, key, max(idx) AS idx, arg_max(op, idx) AS op, arg_max(value, idx) AS value FROM g WHERE op <> 'drop' GROUP BY ALL) SELECT bucket, key, value FROM l LEFT JOIN d USING (bucket) WHERE op = 'put' AND (dropped IS NULL OR idx > dropped)""")
def replicated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    op = F.when(bad & (F.col("event_id") % 10 == 0), "drop").when(bad, "delete").otherwise("put")
    return apply_log(tables.load(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), (F.col("user_id") % 10).alias("bucket"), F.col("user_id").alias("key"), "value", op.alias("op")))


@query(f"WITH {R} SELECT chunk AS block, count(*) AS refs, count(*) > 1 AS shared FROM replicas WHERE edge % 4 = 0 GROUP BY 1")
def snapshot_refcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many snapshots hold each block; a shared one is copied on write."""
    return tables.replicas(spark, sf_dir).where("edge % 4 = 0").groupBy(F.col("chunk").alias("block")).agg(F.count("*").alias("refs"), (F.count("*") > 1).alias("shared"))


@query("""WITH a AS (SELECT CASE WHEN age > 2000 AND starts_with(o_orderpriority, '5') THEN 'expire' WHEN age > 1500 THEN 'archive' WHEN age > 700 THEN 'infrequent' ELSE 'none' END AS action, o_totalprice FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS age FROM orders)) SELECT action, count(*) AS objects, round(sum(o_totalprice), 2) AS bytes FROM a GROUP BY 1""")
def lifecycle_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluate, act, add up: what a run did by action."""
    from .rules import lifecycle_eval

    done = lifecycle_eval(spark, sf_dir).join(tables.load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return done.groupBy("action").agg(F.count("*").alias("objects"), F.round(F.sum("o_totalprice"), 2).alias("bytes"))


@query(f"WITH {A} SELECT seq, key, CASE WHEN latency_ms > 90 THEN 'error' WHEN latency_ms > 60 THEN 'warn' ELSE 'info' END AS level, op || ' took ' || CAST(floor(latency_ms) AS BIGINT) || ' ms' AS message FROM access")
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured log lines."""
    x = F.col("latency_ms")
    text = F.concat("op", F.lit(" took "), F.floor("latency_ms").cast("string"), F.lit(" ms"))
    return tables.access_log(spark, sf_dir).select("seq", "key", F.when(x > 90, "error").when(x > 60, "warn").otherwise("info").alias("level"), text.alias("message"))
