"""Join-shaped operators: replicas, constraints, event fan-out, rules, as-of lookups, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..registry import query

C, E, R = tables.CHUNKS_SQL, tables.EDGES_SQL, tables.REPLICAS_SQL


def available_replicas(chunks: DataFrame, replicas: DataFrame, edges: DataFrame) -> DataFrame:
    """Every (chunk, edge) whose edge holds the chunk, is online and has a slot to spare."""
    free = edges.where("online and active < slots")
    return chunks.join(replicas, "chunk").join(free, "edge")


@query(f"WITH {C}, {E}, {R} SELECT r.chunk, r.edge, size_bytes FROM chunks JOIN replicas r USING (chunk) JOIN edges USING (edge) WHERE online AND active < slots")
def chunk_edge_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = available_replicas(tables.chunks(spark, sf_dir), tables.replicas(spark, sf_dir), tables.edges(spark, sf_dir))
    return out.select("chunk", "edge", "size_bytes")


@query(f"""WITH {E}, m AS (SELECT l_suppkey AS edge, avg(l_discount) AS loss FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1)
SELECT edge, round(1 - health + coalesce(loss, 0), 6) AS cost FROM edges LEFT JOIN m USING (edge)""")
def cost_with_live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static cost plus live loss; an edge without live figures has no penalty."""
    live = tables.load(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 0").groupBy(F.col("l_suppkey").alias("edge")).agg(F.avg("l_discount").alias("loss"))
    return tables.edges(spark, sf_dir).join(live, "edge", "left").select("edge", F.round(1 - F.col("health") + F.coalesce("loss", F.lit(0.0)), 6).alias("cost"))


def fan_out(events: DataFrame, config: DataFrame, name: Column, key: Column) -> DataFrame:
    """events x destinations whose event pattern and key filters match. config: dest, pattern, prefix, suffix.

    The configuration is a short constant list and is broadcast; patterns are exact, 'family:*' or '*'.
    """
    pattern = F.col("pattern")
    named = (pattern == "*") | (pattern == name) | (pattern.endswith(":*") & F.startswith(name, F.regexp_replace(pattern, r"\*$", "")))
    keyed = F.startswith(key, F.col("prefix")) & F.endswith(key, F.col("suffix"))
    return events.join(F.broadcast(config), named & keyed)


FANOUT = [("topic", "access:*", "", ""), ("queue", "access:error", "", "7"), ("function", "commerce:purchase", "1", ""), ("webhook", "*", "12", "3")]


def _event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(F.col("event_type").isin("view", "click", "error"), "access").otherwise("commerce")
    return tables.load(spark, sf_dir, "events").select("event_id", F.concat_ws(":", family, "event_type").alias("name"), F.col("user_id").cast("string").alias("key"))


_NAMES = "names AS (SELECT event_id, (CASE WHEN event_type IN ('view','click','error') THEN 'access' ELSE 'commerce' END) || ':' || event_type AS name, CAST(user_id AS VARCHAR) AS key FROM events)"
_FANOUT = "config(dest, pattern, prefix, suffix) AS (VALUES " + ", ".join(str(x) for x in FANOUT) + ")"


@query(f"""WITH {_NAMES}, {_FANOUT} SELECT event_id, dest FROM names JOIN config
ON (pattern = '*' OR pattern = name OR (pattern LIKE '%:*' AND starts_with(name, rtrim(pattern, '*')))) AND starts_with(key, prefix) AND ends_with(key, suffix)""")
def event_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = spark.createDataFrame(FANOUT, "dest string, pattern string, prefix string, suffix string")
    return fan_out(_event_names(spark, sf_dir), config, F.col("name"), F.col("key")).select("event_id", "dest")


def first_rule(objects: DataFrame, rules: DataFrame, condition: Column, keys: list[str]) -> DataFrame:
    """Per object the action of the first rule that matches (by pos); objects without one keep null."""
    hit = objects.join(F.broadcast(rules), condition, "left")
    return hit.groupBy(*keys).agg(F.min_by("action", "pos").alias("action"))


RULES = [(1, "1-URGENT", "O", "pin"), (2, "2-HIGH", "", "standard"), (3, "", "F", "archive"), (4, "3", "", "infrequent")]
_RULES = "rules(pos, prefix, tag, action) AS (VALUES " + ", ".join(str(x) for x in RULES) + ")"


@query(f"""WITH {_RULES} SELECT o_orderkey, (SELECT arg_min(action, pos) FROM rules WHERE starts_with(o_orderpriority, prefix) AND (tag = '' OR tag = o_orderstatus)) AS action FROM orders""")
def first_rule_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "pos int, prefix string, tag string, action string")
    match = F.startswith("o_orderpriority", F.col("prefix")) & ((F.col("tag") == "") | (F.col("tag") == F.col("o_orderstatus")))
    return first_rule(tables.load(spark, sf_dir, "orders"), rules, match, ["o_orderkey"])


@query("""WITH policy AS (SELECT n_nationkey AS scope, 1000000.0::DOUBLE * (1 + n_nationkey) AS soft FROM nation WHERE n_nationkey % 4 = 0)
SELECT c_custkey, coalesce(soft, 500000.0::DOUBLE) AS soft FROM customer LEFT JOIN policy ON scope = c_nationkey""")
def effective_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explicit policy of a scope, else the default."""
    policy = tables.load(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("c_nationkey"), (F.lit(1e6) * (1 + F.col("n_nationkey"))).alias("soft"))
    return tables.load(spark, sf_dir, "customer").join(policy, "c_nationkey", "left").select("c_custkey", F.coalesce("soft", F.lit(500000.0)).alias("soft"))


def as_of(probes: DataFrame, versions: DataFrame, key: str, at: str, created: str, order: str, value: str, unit: str = "day") -> DataFrame:
    """Per probe the newest version at or before its time.

    Both sides are put on one time line per key and the last version is carried forward, so a key with many versions
    never multiplies with its probes. The line is worked on in pieces of one ``unit`` of time; what a piece begins with
    comes from a short line of the pieces' last versions. So one key's rows spread over as many tasks as it has pieces.
    """
    kinds = versions.schema
    v = versions.select(key, F.col(created).alias("t"), F.lit(0).alias("is_probe"), F.col(order).alias("o"), F.col(value).alias("v"), F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"))
    p = probes.select(key, F.col(at).alias("t"), F.lit(1).alias("is_probe"), F.lit(None).cast(kinds[order].dataType).alias("o"), F.lit(None).cast(kinds[value].dataType).alias("v"), "probe")
    line = v.unionByName(p).withColumn("piece", F.date_trunc(unit, F.col("t")))
    here = F.last("v", ignorenulls=True).over(Window.partitionBy(key, "piece").orderBy("t", "is_probe", "o").rowsBetween(Window.unboundedPreceding, 0))
    found = line.withColumn("here", here).where("is_probe = 1").select("probe", key, "piece", "here")
    version = F.when(F.col("v").isNotNull(), F.struct("t", "o", "v"))
    pieces = line.groupBy(key, "piece").agg(F.max(version)["v"].alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    carried = pieces.select(F.col(key).alias("k"), F.col("piece").alias("of"), before.alias("before"))
    same = F.col(key).eqNullSafe(F.col("k")) & F.col("piece").eqNullSafe(F.col("of"))
    return found.join(carried, same).select("probe", key, F.coalesce("here", "before").alias(value))


@query("""SELECT p.probe, p.o_custkey, v.o_orderkey FROM (SELECT event_id AS probe, user_id % 1500 + 1 AS o_custkey, ts FROM events) p
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL) v ON p.o_custkey = v.o_custkey AND p.ts >= v.o_orderdate""")
def version_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version in force at each event; deleted ones (status F) don't count."""
    probes = tables.load(spark, sf_dir, "events").select(F.col("event_id").alias("probe"), (F.col("user_id") % 1500 + 1).alias("o_custkey"), "ts")
    versions = tables.load(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return as_of(probes, versions, "o_custkey", "ts", "o_orderdate", "o_orderkey", "o_orderkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, count(*) AS n_versions FROM orders GROUP BY 1")
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count("*").alias("n_versions"))


@query("SELECT a.o_orderkey, a.pos AS from_pos, b.pos AS to_pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderkey % 5 <> 0) a JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderkey % 7 <> 0) b USING (o_orderkey) WHERE a.pos <> b.pos", name="delta_moved")
def delta_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that stand elsewhere in the new version."""
    orders = tables.load(spark, sf_dir, "orders").select("o_orderkey")
    return moved(numbered(orders.where("o_orderkey % 5 <> 0"), "o_orderkey"), numbered(orders.where("o_orderkey % 7 <> 0"), "o_orderkey"), "o_orderkey")


def moved(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of (key, pos) on both sides at different places."""
    return old.withColumnRenamed("pos", "from_pos").join(new.withColumnRenamed("pos", "to_pos"), key).where("from_pos <> to_pos")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """pos: the global rank of each row by key, in two scans of the sorted ranges, never in one task.

    Ranges are sorted and numbered for themselves; the sizes of the ranges before are added (one row a range). The
    ranges are written first: dealt out twice, rows could fall into different ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = tables.written(df.repartitionByRange(n, key).withColumn("range", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("r", F.row_number().over(Window.partitionBy("range").orderBy(key)))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(before.select("range", "before")), "range").select(*df.columns, (F.col("r") + F.col("before")).alias("pos"))


@query("SELECT DISTINCT l_partkey AS chunk FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for chunks that aren't stored."""
    asked = tables.load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk")).distinct()
    stored = tables.load(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("chunk"))
    return asked.join(stored, "chunk", "left_anti")


@query(f"""WITH {R} SELECT DISTINCT user_id % 2000 + 1 AS chunk, CAST(user_id % 100 + 1 AS BIGINT) AS edge FROM events e WHERE event_type = 'purchase'
AND NOT EXISTS (SELECT 1 FROM replicas r WHERE r.chunk = e.user_id % 2000 + 1 AND r.edge = e.user_id % 100 + 1)""")
def prestage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted (chunk, node) pairs that aren't there yet."""
    wanted = tables.load(spark, sf_dir, "events").where("event_type = 'purchase'").select((F.col("user_id") % 2000 + 1).alias("chunk"), (F.col("user_id") % 100 + 1).alias("edge")).distinct()
    return wanted.join(tables.replicas(spark, sf_dir), ["chunk", "edge"], "left_anti")


@query(f"WITH {R}, {E} SELECT DISTINCT chunk FROM replicas JOIN edges USING (edge) WHERE NOT online")
def scope_of_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a source in the scope: those on an edge that is down."""
    down = tables.edges(spark, sf_dir).where("not online").select("edge")
    return tables.replicas(spark, sf_dir).join(down, "edge", "left_semi").select("chunk").distinct()


@query(f"""WITH {R}, {E}, x AS (SELECT chunk, edge, row_number() OVER (PARTITION BY chunk ORDER BY rtt_us, edge) AS rank, count(*) OVER (PARTITION BY chunk) AS n FROM replicas JOIN edges USING (edge) WHERE online)
SELECT chunk, edge, CAST(rank AS INTEGER) AS rank FROM x WHERE rank <= 2 AND n >= 2""")
def shard_read_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k nearest healthy places of each chunk that has k."""
    return read_plan(tables.replicas(spark, sf_dir).join(tables.edges(spark, sf_dir).where("online"), "edge"), 2)


def read_plan(places: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("chunk")
    ranked = places.withColumn("rank", F.row_number().over(w.orderBy("rtt_us", "edge"))).withColumn("n", F.count("*").over(w))
    return ranked.where((F.col("rank") <= k) & (F.col("n") >= k)).select("chunk", "edge", "rank")


def range_join(files: DataFrame, chunks: DataFrame, first: str, end: str, idx: str) -> DataFrame:
    """Chunks with first <= idx < end of each file, as an equi-join on the file's listed positions."""
    wide = files.where(F.col(end) > F.col(first)).withColumn(idx, F.explode(F.sequence(F.col(first), F.col(end) - 1)))
    return wide.join(chunks, idx)


@query("""SELECT o_orderkey, p_partkey AS idx, p_size FROM (SELECT o_orderkey, o_custkey AS first, o_custkey + o_orderkey % 4 AS stop FROM orders) f JOIN part ON p_partkey >= first AND p_partkey < stop""")
def file_chunk_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("first"), (F.col("o_custkey") + F.col("o_orderkey") % 4).alias("stop"))
    return range_join(files, tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), "p_size"), "first", "stop", "idx").select("o_orderkey", "idx", "p_size")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 INTERSECT SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0")
def partition_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreachable before and reachable now."""
    s = tables.load(spark, sf_dir, "supplier").select("s_suppkey")
    return s.where("s_suppkey % 3 = 0").intersect(s.where("s_suppkey % 4 <> 0"))


@query("""SELECT p_partkey AS block, CASE WHEN p_partkey % 10 = 0 THEN p_size + 1000 ELSE p_size END AS content FROM part WHERE p_partkey % 15 <> 0""")
def clone_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clone's view: its own blocks over the snapshot's, without those it deleted."""
    base = tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("block"), F.col("p_size").alias("content"))
    own = base.where("block % 10 = 0").select("block", (F.col("content") + 1000).alias("own"))
    gone = base.where("block % 15 = 0").select("block")
    return overlay(base, own, gone)


def overlay(base: DataFrame, own: DataFrame, gone: DataFrame) -> DataFrame:
    return base.join(own, "block", "left").join(gone, "block", "left_anti").select("block", F.coalesce("own", "content").alias("content"))


@query("""WITH u AS (SELECT o_custkey, sum(o_totalprice) AS used FROM orders GROUP BY 1)
SELECT c_custkey, round(coalesce(used, 0), 2) AS used, c_acctbal * 100 AS quota FROM customer LEFT JOIN u ON o_custkey = c_custkey WHERE coalesce(used, 0) > c_acctbal * 100""")
def quota_alert_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = tables.load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("used"))
    swept = tables.load(spark, sf_dir, "customer").join(used, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("used", F.coalesce("used", F.lit(0.0))).withColumn("quota", F.col("c_acctbal") * 100)
    return swept.where("used > quota").select("c_custkey", F.round("used", 2).alias("used"), "quota")


@query(f"WITH {R}, {E} SELECT chunk, arg_min(edge, (rtt_us, edge)) AS edge FROM replicas JOIN edges USING (edge) WHERE online GROUP BY 1")
def reachable_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place to read a shard from: the nearest that is online."""
    near = tables.replicas(spark, sf_dir).join(tables.edges(spark, sf_dir).where("online"), "edge")
    return near.groupBy("chunk").agg(F.min_by("edge", F.struct("rtt_us", "edge")).alias("edge"))
