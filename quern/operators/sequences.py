"""Sequence operators: runs, bursts, co-occurrence, moving averages, estimators, version chains.

Each key's rows are ordered by (time, id). Moving averages are linear, so each day of a key folds to one linear map and
a key's days are chained; folds that aren't stream over sorted partitions with one state at a time. No key's rows are ever
gathered in memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..registry import query

A = tables.ACCESS_SQL


def by_time(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("ts_ms", "seq")


def runs(log: DataFrame, key: str, value: str) -> DataFrame:
    """Islands of consecutive values with a step of +1 or -1, of two rows at least.

    A flip of direction begins a new run at the record before, which both runs then share: a run's length is its steps
    plus one.
    """
    w = by_time(key)
    step = F.col(value) - F.lag(value).over(w)
    s = log.withColumn("step", F.when(F.abs(step) == 1, step)).withColumn("before", F.lag("step").over(w))
    s = s.withColumn("new", (~F.col("step").eqNullSafe(F.col("before"))).cast("int")).withColumn("run", F.sum("new").over(w))
    return s.where("step is not null").groupBy(key, "run", "step").agg((F.count("*") + 1).alias("length"), (F.min_by(value, F.struct("ts_ms", "seq")) - F.col("step")).alias("first_value"))


@query(f"""WITH {A}, v AS (SELECT key % 20 AS stream, seq // 3 + seq % 3 AS v, ts_ms, seq FROM access), s AS (SELECT *, CASE WHEN abs(v - lag(v) OVER w) = 1 THEN v - lag(v) OVER w END AS step FROM v WINDOW w AS (PARTITION BY stream ORDER BY ts_ms, seq)),
n AS (SELECT *, CASE WHEN step IS NOT DISTINCT FROM lag(step) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY stream ORDER BY ts_ms, seq)), r AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY ts_ms, seq) AS run FROM n)
SELECT stream, CAST(run AS BIGINT) AS run, count(*) + 1 AS length, arg_min(v, (ts_ms, seq)) - step AS first_value FROM r WHERE step IS NOT NULL GROUP BY stream, run, step""")
def sequential_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.access_log(spark, sf_dir).select((F.col("key") % 20).alias("stream"), (F.expr("seq div 3") + F.col("seq") % 3).alias("v"), "ts_ms", "seq")
    return runs(log, "stream", "v").select("stream", "run", "length", "first_value")


def bursts(log: DataFrame, key: str, least: int = 10, factor: int = 3) -> DataFrame:
    """Keys of at least ten records with two or more gaps above three times the mean gap, and runs of five between them."""
    g = log.withColumn("gap", F.col("ts_ms") - F.lag("ts_ms").over(by_time(key)))
    n = Window.partitionBy(key)
    g = g.withColumn("mean", F.expr("sum(gap) over (partition by {0}) div count(gap) over (partition by {0})".format(key))).withColumn("n", F.count("*").over(n))
    s = g.groupBy(key).agg(F.max("n").alias("n"), F.max("mean").alias("mean_gap"), F.count_if(F.col("gap") > factor * F.col("mean")).alias("large"))
    s = s.withColumn("burst_size", F.expr("n div (large + 1)"))
    return s.where((F.col("n") >= least) & (F.col("large") >= 2) & (F.col("burst_size") >= 5)).select(key, "n", "mean_gap", "large", "burst_size")


@query(f"""WITH {A}, g AS (SELECT key % 50 AS stream, ts_ms - lag(ts_ms) OVER (PARTITION BY key % 50 ORDER BY ts_ms, seq) AS gap FROM access), m AS (SELECT stream, CAST(sum(gap) // nullif(count(gap), 0) AS BIGINT) AS mean_gap, count(*) AS n FROM g GROUP BY 1), l AS (SELECT stream, count_if(gap > 3 * mean_gap) AS large FROM g JOIN m USING (stream) GROUP BY 1)
SELECT stream, n, mean_gap, large, n // (large + 1) AS burst_size FROM m JOIN l USING (stream) WHERE n >= 10 AND large >= 2 AND n // (large + 1) >= 5""")
def burst_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts(tables.access_log(spark, sf_dir).withColumn("stream", F.col("key") % 50), "stream")


@query(f"""WITH {A}, h AS (SELECT key AS k, count(*) AS n FROM access GROUP BY 1 HAVING count(*) >= 10), g AS (SELECT key % 50 AS stream, ts_ms - lag(ts_ms) OVER (PARTITION BY key % 50 ORDER BY ts_ms, seq) AS gap FROM access), m AS (SELECT stream, CAST(sum(gap) // nullif(count(gap), 0) AS BIGINT) AS mean_gap, count(*) AS n FROM g GROUP BY 1), l AS (SELECT stream, count_if(gap > 3 * mean_gap) AS large FROM g JOIN m USING (stream) GROUP BY 1),
t AS (SELECT key, CAST(hour(make_timestamp(ts_ms * 1000)) AS BIGINT) AS hr, count(*) AS c FROM access GROUP BY ALL)
SELECT 'hot' AS pattern, k AS key, n AS strength FROM h UNION ALL SELECT 'bursty', stream, n // (large + 1) FROM m JOIN l USING (stream) WHERE n >= 10 AND large >= 2 AND n // (large + 1) >= 5 UNION ALL SELECT 'temporal', key, max(c) FROM t GROUP BY key HAVING max(c) >= 3""")
def pattern_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot, bursty and temporal patterns under one tag."""
    log = tables.access_log(spark, sf_dir)
    hot = log.groupBy("key").agg(F.count("*").alias("strength")).where("strength >= 10").select(F.lit("hot").alias("pattern"), "key", "strength")
    burst = bursts(log.withColumn("stream", F.col("key") % 50), "stream").select(F.lit("bursty"), "stream", "burst_size")
    hours = log.groupBy("key", F.hour(F.timestamp_millis("ts_ms")).alias("h")).agg(F.count("*").alias("c")).groupBy("key").agg(F.max("c").alias("c")).where("c >= 3")
    return hot.union(burst).union(hours.select(F.lit("temporal"), "key", "c"))


@query(f"WITH {A}, x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) AS r FROM access) SELECT key, count(*) AS kept, min(ts_ms) AS oldest FROM x WHERE r <= 20 GROUP BY 1")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty records of each key."""
    return last_n(tables.access_log(spark, sf_dir), "key", 20).groupBy("key").agg(F.count("*").alias("kept"), F.min("ts_ms").alias("oldest"))


def last_n(log: DataFrame, key: str, n: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts_ms"), F.desc("seq")))
    return log.withColumn("r", r).where(F.col("r") <= n).drop("r")


def co_occurrence(log: DataFrame, stream: str, item: str, ahead: int, top: int) -> DataFrame:
    """Which items follow each within the next ``ahead`` records of its stream, the most frequent ``top``."""
    w = by_time(stream)
    nexts = F.array(*[F.lead(item, k).over(w) for k in range(1, ahead + 1)])
    pairs = log.select(F.col(item).alias("item"), nexts.alias("nexts")).select("item", F.explode("nexts").alias("follower")).where("follower is not null and follower <> item")
    counted = pairs.groupBy("item", "follower").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "follower"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top)


@query(f"""WITH {A}, x AS (SELECT key % 10 AS stream, key % 37 AS item, ts_ms, seq FROM access), p AS ({" UNION ALL ".join(f"SELECT item, lead(item, {k}) OVER (PARTITION BY stream ORDER BY ts_ms, seq) AS follower FROM x" for k in range(1, 10))}), c AS (SELECT item, follower, count(*) AS n FROM p WHERE follower IS NOT NULL AND follower <> item GROUP BY ALL)
SELECT * FROM (SELECT item, follower, n, CAST(row_number() OVER (PARTITION BY item ORDER BY n DESC, follower) AS INTEGER) AS rank FROM c) WHERE rank <= 5""")
def prefetch_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.access_log(spark, sf_dir).select((F.col("key") % 10).alias("stream"), (F.col("key") % 37).alias("item"), "ts_ms", "seq")
    return co_occurrence(log, "stream", "item", 9, 5)


@query(f"""WITH {A}, x AS (SELECT key % 10 AS stream, key, ts_ms, seq, row_number() OVER (PARTITION BY key % 10 ORDER BY ts_ms DESC, seq DESC) AS r FROM access WHERE op IN ('view','click')), d AS (SELECT stream, abs(key - lag(key) OVER (PARTITION BY stream ORDER BY ts_ms, seq)) AS d FROM x WHERE r <= 100)
SELECT stream, coalesce(count_if(d <= 5), 0) AS near, count(d) AS steps, coalesce(count_if(d <= 5), 0) * 2 > count(d) AS is_sequential FROM d GROUP BY 1""")
def recent_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the last 100 reads of a stream: do over half step by at most 5?"""
    reads = tables.access_log(spark, sf_dir).where("op in ('view','click')").withColumn("stream", F.col("key") % 10)
    d = last_n(reads, "stream", 100).withColumn("d", F.abs(F.col("key") - F.lag("key").over(by_time("stream"))))
    near = F.count_if(F.col("d") <= 5)
    return d.groupBy("stream").agg(near.alias("near"), F.count("d").alias("steps"), (near * 2 > F.count("d")).alias("is_sequential"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(regexp_replace('batch-' || l_partkey || '-v' || l_linenumber, '[^0-9]', '', 'g') AS BIGINT) AS digits FROM lineitem), d AS (SELECT l_orderkey, digits - lag(digits) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, digits) AS d FROM x)
SELECT l_orderkey, coalesce(count_if(d BETWEEN 0 AND 100000), 0) AS rising, count(d) AS steps, coalesce(count_if(d BETWEEN 0 AND 100000), 0) * 2 > count(d) AS is_batch FROM d GROUP BY 1""")
def batch_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose digits rise by small steps more often than not."""
    name = F.concat(F.lit("batch-"), F.col("l_partkey"), F.lit("-v"), F.col("l_linenumber"))
    x = tables.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.regexp_replace(name, r"\D", "").cast("long").alias("digits"))
    d = x.withColumn("d", F.col("digits") - F.lag("digits").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "digits")))
    rising = F.count_if(F.col("d").between(0, 100000))
    return d.groupBy("l_orderkey").agg(rising.alias("rising"), F.count("d").alias("steps"), (rising * 2 > F.count("d")).alias("is_batch"))


def streamed(rows: DataFrame, key: str, order: list[str], inputs: list[str], start: tuple, step: Callable[[tuple, tuple], tuple], schema: str) -> DataFrame:
    """Per key an ordered fold in Python: (key, *state). Rows stream by in order; one state is held."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now, seen = None, start, False
        for frame in frames:
            out = []
            for k, *x in zip(frame[key].tolist(), *(frame[c].tolist() for c in inputs), strict=True):
                if seen and k != at:
                    out.append((at, *now))
                    now = start
                at, now, seen = k, step(start if not seen else now, tuple(x)), True
            yield pd.DataFrame(out, columns=columns)
        if seen:
            yield pd.DataFrame([(at, *now)], columns=columns)

    return rows.select(key, *order, *inputs).repartition(n, key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


DAY_MS = 86_400_000


def ema(log: DataFrame, key: str, value: str, alpha: float) -> DataFrame:
    """(key, state): exponential moving average; the first sample seeds it. A day's samples are the map y -> a y + b."""
    day = F.floor(F.col("ts_ms") / DAY_MS).alias("day")
    items = F.array_sort(F.collect_list(F.struct("ts_ms", "seq", F.col(value).alias("x"))))
    days = log.groupBy(key, day).agg(items.alias("s"))
    b = F.aggregate(F.transform("s", lambda s: s["x"]), F.lit(0.0), lambda y, x: x * alpha + y * (1 - alpha))
    maps = days.select(key, "day", F.pow(F.lit(1 - alpha), F.size("s")).alias("a"), b.alias("b"), F.element_at("s", 1)["x"].alias("first"))
    line = F.array_sort(F.collect_list(F.struct("day", "a", "b", "first")))
    return maps.groupBy(key).agg(line.alias("m")).select(key, F.aggregate("m", F.element_at("m", 1)["first"], lambda y, m: m["a"] * y + m["b"]).alias("state"))


def _ema_sql(alpha: float, key: str, extra: str = "") -> str:
    return f"WITH {A} SELECT {key}, round(list_reduce(list(latency_ms ORDER BY ts_ms, seq), lambda y, x: x * {alpha} + y * (1 - {alpha})), 6) AS ema{extra} FROM access GROUP BY 1"


@query(_ema_sql(0.2, "key", ", max(latency_ms) AS peak"))
def ema_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.access_log(spark, sf_dir)
    return ema(log, "key", "latency_ms", 0.2).join(log.groupBy("key").agg(F.max("latency_ms").alias("peak")), "key").select("key", F.round("state", 6).alias("ema"), "peak")


@query(_ema_sql(0.3, "key"))
def speed_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zero average counts as not seeded yet: zeros before the first other value are left out."""
    log = tables.access_log(spark, sf_dir)
    seeded = F.max(F.col("latency_ms") != 0).over(by_time("key").rowsBetween(Window.unboundedPreceding, 0))
    return ema(log.withColumn("seeded", seeded).where("seeded"), "key", "latency_ms", 0.3).select("key", F.round("state", 6).alias("ema"))


@query(f"""WITH {A}, l AS (SELECT key, list(CAST(floor(latency_ms * 1000) AS BIGINT) ORDER BY ts_ms, seq) AS xs FROM access GROUP BY 1),
s AS (SELECT key, list_reduce(list_prepend(struct_pack(srtt := xs[1], var := xs[1] // 2), list_transform(xs[2:], lambda x: struct_pack(srtt := x, var := 0::BIGINT))),
  lambda a, b: struct_pack(srtt := CAST(floor(a.srtt * 0.875 + b.srtt * 0.125) AS BIGINT), var := CAST(floor(a.var * 0.75 + abs(a.srtt - b.srtt) * 0.25) AS BIGINT))) AS s FROM l)
SELECT key, s.srtt AS srtt, s.var AS rttvar, s.srtt + 4 * s.var AS rto FROM s""")
def rtt_rfc6298(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed round-trip time and its variation, cut to whole microseconds at each step; rto = srtt + 4 var."""
    def step(now, x):
        us = x[0]
        if now[0] < 0:  # the first sample
            return us, us // 2
        return math.floor(now[0] * 0.875 + us * 0.125), math.floor(now[1] * 0.75 + abs(now[0] - us) * 0.25)

    rows = tables.access_log(spark, sf_dir).withColumn("us", F.floor(F.col("latency_ms") * 1000))
    f = streamed(rows, "key", ["ts_ms", "seq"], ["us"], (-1, 0), step, "key long, srtt long, rttvar long")
    return f.withColumn("rto", F.col("srtt") + 4 * F.col("rttvar"))


@query(f"""WITH {A}, e AS (SELECT key % 30 AS edge, count(*) AS n, list_reduce(list(latency_ms ORDER BY ts_ms, seq), lambda y, x: x * 0.2 + y * 0.8) AS ema, avg(latency_ms) AS expected FROM access GROUP BY 1)
SELECT edge, n, round(ema, 6) AS ema, round(ema / expected, 6) AS ratio, CASE WHEN ema / expected > 1.1 THEN 'slow' WHEN ema / expected < 0.9 THEN 'fast' ELSE 'steady' END AS state FROM e WHERE n >= 5""")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose recent average drifts from the expected one; five samples at least."""
    log = tables.access_log(spark, sf_dir).withColumn("edge", F.col("key") % 30)
    g = log.groupBy("edge").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("expected")).where("n >= 5")
    r = F.col("state") / F.col("expected")
    return ema(log, "edge", "latency_ms", 0.2).join(g, "edge").select("edge", "n", F.round("state", 6).alias("ema"), F.round(r, 6).alias("ratio"), F.when(r > 1.1, "slow").when(r < 0.9, "fast").otherwise("steady").alias("state"))


@query(f"""WITH {A}, x AS (SELECT key, latency_ms, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) AS r FROM access), l AS (SELECT key, r, latency_ms, count(*) OVER (PARTITION BY key) AS n FROM x WHERE r <= 10),
h AS (SELECT key, max(n) AS n, avg(CASE WHEN r > n - n // 2 THEN latency_ms END) AS old, avg(CASE WHEN r <= n - n // 2 THEN latency_ms END) AS new FROM l GROUP BY 1) SELECT key, n, CASE WHEN new > old * 1.2 THEN 'rising' WHEN new < old * 0.8 THEN 'falling' ELSE 'stable' END AS trend FROM h WHERE n >= 4""")
def rtt_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the last ten samples against the earlier, by a fifth."""
    x = last_n(tables.access_log(spark, sf_dir), "key", 10)
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts_ms"), F.desc("seq")))).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    late = F.col("r") <= F.col("n") - F.expr("n div 2")
    h = x.groupBy("key").agg(F.max("n").alias("n"), F.avg(F.when(~late, F.col("latency_ms"))).alias("old"), F.avg(F.when(late, F.col("latency_ms"))).alias("new")).where("n >= 4")
    return h.select("key", "n", F.when(F.col("new") > F.col("old") * 1.2, "rising").when(F.col("new") < F.col("old") * 0.8, "falling").otherwise("stable").alias("trend"))


@query(f"WITH {A} SELECT key % 25 AS path, seq, round(avg(latency_ms) OVER (PARTITION BY key % 25 ORDER BY ts_ms, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS quality FROM access")
def sliding_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last twenty samples."""
    log = tables.access_log(spark, sf_dir).withColumn("path", F.col("key") % 25)
    return log.select("path", "seq", F.round(F.avg("latency_ms").over(by_time("path").rowsBetween(-19, 0)), 6).alias("quality"))


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w IS NULL AS is_latest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def version_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return tables.load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).isNull().alias("is_latest"))


def ancestors(nodes: DataFrame, node: str, parent: str, starts: DataFrame) -> DataFrame:
    """(start, node, depth) of every ancestor up to the roots, in as many rounds as the depth has bits.

    Paths of 2^k steps are joined to themselves; each round is written, so plans don't grow with the depth.
    """
    jump = tables.written(nodes.where(F.col(parent).isNotNull()).select(F.col(node).alias("a"), F.col(parent).alias("b")), "paths")
    reach = tables.written(starts.select(F.col(node).alias("start"), F.col(node).alias("node"), F.lit(0).alias("depth")), "reached")
    bit = 0
    while True:
        step = tables.written(reach.join(jump, reach["node"] == jump["a"]).select("start", F.col("b").alias("node"), (F.col("depth") + (1 << bit)).alias("depth")), "step")
        if step.isEmpty():
            return reach
        reach = tables.written(reach.unionByName(step), "reached")
        left, right = jump.alias("l"), jump.alias("r")
        jump = tables.written(left.join(right, F.col("l.b") == F.col("r.a")).select(F.col("l.a").alias("a"), F.col("r.b").alias("b")), "paths")
        bit += 1


@query()
def ancestor_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier turns of a conversation as parents, from every turn at any depth; nodes are (conv_id, turn)."""
    return turn_ancestors(tables.load(spark, sf_dir, "conversations"))


def turn_ancestors(conversations: DataFrame) -> DataFrame:
    """(start, node, depth) of every turn; start and node are structs of conv_id and turn."""
    c = conversations.select("conv_id", "turn").distinct()
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"))
    parent = F.struct("conv_id", (F.col("turn") - 1).cast(c.schema["turn"].dataType).alias("turn"))
    n = c.join(first, "conv_id").select(F.struct("conv_id", "turn").alias("id"), F.when(F.col("turn") > F.col("first"), parent).alias("parent"))
    return ancestors(n, "id", "parent", n)


@query("""WITH x AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber - 1 AS BIGINT) AS idx FROM lineitem WHERE l_linenumber <> 4), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY idx) - 1 AS r FROM x) SELECT l_orderkey, count_if(idx = r) AS ready, count(*) AS received FROM r GROUP BY 1""")
def ordered_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces from the first on are there without a gap."""
    x = tables.load(spark, sf_dir, "lineitem").where("l_linenumber <> 4").select("l_orderkey", (F.col("l_linenumber") - 1).alias("idx")).distinct()
    r = x.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("idx")) - 1)
    return r.groupBy("l_orderkey").agg(F.count_if(F.col("idx") == F.col("r")).alias("ready"), F.count("*").alias("received"))


@query(f"""WITH {A} SELECT key, round(list_reduce(list(latency_ms ORDER BY ts_ms, seq), lambda y, x: (y + x) / 2), 6) AS latency FROM access GROUP BY 1""")
def transfer_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ema(tables.access_log(spark, sf_dir), "key", "latency_ms", 0.5).select("key", F.round("state", 6).alias("latency"))


@query(f"WITH {A} SELECT seq, abs(ts_ms - 1704067200000) > 86400000 AS drifted FROM access")
def clock_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.access_log(spark, sf_dir).select("seq", (F.abs(F.col("ts_ms") - 1704067200000) > 86_400_000).alias("drifted"))
