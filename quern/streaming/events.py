"""Structured Streaming forms over the event log, each run until its source is read (availableNow)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import tables
from ..registry import query


def shared(spark: SparkSession) -> str:
    return f"{tables.shared_dir(spark)}/quern-streams/{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 1000) -> DataFrame:
    """The events as a file stream; per_trigger files a batch hold the source back. ts becomes a zoned timestamp, as watermarks need."""
    schema = tables.load(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream to its end into a table in the shared folder.

    With mode complete, the last batch's result; with update, each key's row of the last batch that wrote it, as a batch
    holds only the keys that changed in it.
    """
    if mode == "update" and not keys:
        raise ValueError("an update stream needs the keys that its rows are merged by")
    spark, root = stream.sparkSession, shared(stream.sparkSession)
    if mode == "append":
        w = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
    else:
        # each batch's result replaces the last: a batch that runs again writes the same folder again
        w = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n:09d}"))
    w.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{root}/out")
    every = spark.read.parquet(f"{root}/out")
    if mode == "complete":
        return every.where(F.col("batch") == every.agg(F.max("batch")).head()[0]).drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*").select(stream.columns)


def replay(spark: SparkSession, sf_dir: str, slices: int = 4) -> DataFrame:
    """The events as a file stream of several batches in time order: a slice of time is a file set, one a trigger."""
    e = tables.load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    root = f"{shared(spark)}/in"
    lo, hi = e.agg(F.min("ts"), F.max("ts")).head()
    for k in range(slices):
        part = e if lo is None else e.where(F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(lo))) * slices / F.greatest(F.unix_micros(F.lit(hi)) - F.unix_micros(F.lit(lo)), F.lit(1))), F.lit(slices - 1)) == k)
        part.coalesce(1).write.parquet(f"{root}/slice={k}")  # a log's segment: its size is the writer's choice
        if lo is None:
            break
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(root)


@query("SELECT event_id, upper(event_type) AS op, round(value * 2, 6) AS doubled FROM events WHERE value > 50")
def stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read, transform, write; event_id keeps the order that a row stream has no other place for."""
    s = event_stream(spark, sf_dir).where("value > 50").select("event_id", F.upper("event_type").alias("op"), F.round(F.col("value") * 2, 6).alias("doubled"))
    return drain(s, "append")


@query("SELECT (epoch_us(date_trunc('hour', ts)) // 1000) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS bytes FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throughput by hour. Windows are aligned to the epoch."""
    w = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "event_type")
    return drain(w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("bytes")).select(F.unix_millis("window.start").alias("start_ms"), "event_type", "n", "bytes"), "complete")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, (epoch_us(min(ts)) // 1000) AS start_ms, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six quiet hours."""
    w = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return drain(w.select("user_id", F.unix_millis("session_window.start").alias("start_ms"), "n"), "complete")


@query("SELECT (epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000) AS start_ms, user_id % 10 AS scope, count(*) AS requests FROM events GROUP BY ALL")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request counters that begin anew with each window."""
    w = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), (F.col("user_id") % 10).alias("scope")).agg(F.count("*").alias("requests"))
    return drain(w.select(F.unix_millis("window.start").alias("start_ms"), "scope", "requests"), "complete")


@query("SELECT user_id % 20 AS transfer, count(*) AS chunks, round(sum(value), 4) AS bytes FROM events GROUP BY 1")
def progress_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = event_stream(spark, sf_dir).groupBy((F.col("user_id") % 20).alias("transfer")).agg(F.count("*").alias("chunks"), F.round(F.sum("value"), 4).alias("bytes"))
    return drain(w, "complete")


def folded_state(step: Callable[[tuple, float], tuple], start: tuple):
    """A stateful fold over each key's rows in (ts, id) order; the state is what the last row left."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else start
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for x in rows["value"].tolist():
            now = step(now, x)
        state.update(now)
        yield pd.DataFrame([[*key, *now]], columns=["key", "level", "flag"])

    return run


def _stateful(spark: SparkSession, sf_dir: str, step, start) -> DataFrame:
    s = replay(spark, sf_dir).withColumn("key", F.col("user_id") % 25).select("key", "ts", "event_id", "value")
    out = s.groupBy("key").applyInPandasWithState(folded_state(step, start), "key long, level double, flag long", "level double, flag long", "update", GroupStateTimeout.NoTimeout)
    return drain(out, "update", ("key",))


@query("""SELECT user_id % 25 AS key, round(list_reduce(list(value ORDER BY ts, event_id), lambda y, x: x * 0.2 + y * 0.8), 6) AS ema FROM events GROUP BY 1""")
def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving average as keyed state; flag says whether it is seeded."""
    return _stateful(spark, sf_dir, lambda s, x: (x * 0.2 + s[0] * 0.8 if s[1] else x, 1), (0.0, 0)).select("key", F.round("level", 6).alias("ema"))


@query("""WITH v AS (SELECT user_id % 25 AS key, list_prepend({'x': 0.0::DOUBLE, 'level': 0.0::DOUBLE, 'flag': 0}, list({'x': value, 'level': 0.0::DOUBLE, 'flag': 0} ORDER BY ts, event_id)) AS l FROM events GROUP BY 1),
r AS (SELECT key, list_reduce(l, lambda a, b: {'x': b.x, 'level': 0.3 * b.x + 0.7 * a.level, 'flag': CASE WHEN 0.3 * b.x + 0.7 * a.level > 60 OR (a.flag = 1 AND 0.3 * b.x + 0.7 * a.level > 40) THEN 1 ELSE 0 END}) AS s FROM v) SELECT key, round(s.level, 6) AS level, s.flag = 1 AS throttled FROM r""")
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed queue depth with a high and a low mark: throttled above the one until it is under the other."""
    def step(s, x):
        level = 0.3 * x + 0.7 * s[0]
        return level, 1 if level > 60 or (s[1] and level > 40) else 0

    return _stateful(spark, sf_dir, step, (0.0, 0)).select("key", F.round("level", 6).alias("level"), (F.col("flag") == 1).alias("throttled"))


def apply_deltas(state_dir: str, keys: list[str]):
    """A foreachBatch step that merges grow-only counter deltas into a state table.

    The merge is idempotent, so a batch that runs again after a failure changes nothing; states are numbered by batch.
    """
    def run(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        new = df.groupBy(*keys, "node").agg(F.max("count").alias("count"))
        if n:
            new = new.unionByName(spark.read.parquet(f"{state_dir}/{n - 1}"))
        new.groupBy(*keys, "node").agg(F.max("count").alias("count")).write.mode("overwrite").parquet(f"{state_dir}/{n}")

    return run


@query("SELECT event_type, CAST(sum(m) AS BIGINT) AS value FROM (SELECT event_type, user_id % 5 AS node, max(event_id) AS m FROM events GROUP BY ALL) GROUP BY 1")
def delta_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicated counters kept by a stream of deltas."""
    root = shared(spark)
    deltas = event_stream(spark, sf_dir).select("event_type", (F.col("user_id") % 5).alias("node"), F.col("event_id").alias("count"))
    q = deltas.writeStream.foreachBatch(apply_deltas(f"{root}/state", ["event_type"])).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    state = spark.read.parquet(f"{root}/state/{last}")
    return state.groupBy("event_type").agg(F.sum("count").alias("value"))


@query("""WITH b AS (SELECT epoch_us(min(ts)) AS lo, greatest(epoch_us(max(ts)) - epoch_us(min(ts)), 1) AS span FROM events)
SELECT least(CAST(floor((epoch_us(ts) - lo) * 4 / span) AS BIGINT), 3) AS batch, count(*) AS n, round(sum(value), 4) AS total FROM events, b GROUP BY 1""")
def stream_backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source held back to one file a trigger: how much each batch took, in the order of time."""
    root = shared(spark)

    def take(df: DataFrame, n: int) -> None:
        df.agg(F.lit(n).cast("long").alias("batch"), F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{root}/out/taken={n}")

    replay(spark, sf_dir).writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").where("n > 0").select("batch", "n", F.round("total", 4).alias("total"))


#: Subscribers of the bus in ``event_bus`` and the LIKE patterns of the topics that they hear.
SUBSCRIBERS = {"audit": "%", "sales": "purch%", "views": "%view%"}


@query("""WITH s AS (SELECT * FROM (VALUES ('audit', '%'), ('sales', 'purch%'), ('views', '%view%')) t(subscriber, pattern)) SELECT subscriber, event_type AS topic, count(*) AS n, max(event_id) AS last_event FROM events JOIN s ON event_type LIKE pattern GROUP BY ALL""")
def event_bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish and subscribe without loss: each batch goes to every subscriber whose pattern its topics match."""
    root = shared(spark)

    def publish(df: DataFrame, n: int) -> None:
        for name, pattern in SUBSCRIBERS.items():
            # a batch that comes again writes the same place again, so a subscriber sees every event once
            df.where(F.col("event_type").like(pattern)).select("event_id", F.col("event_type").alias("topic")).write.mode("overwrite").parquet(f"{root}/inbox/subscriber={name}/batch={n}")

    replay(spark, sf_dir).writeStream.foreachBatch(publish).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/inbox").groupBy("subscriber", "topic").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def hmac_sha256(key: bytes, message: F.Column) -> F.Column:
    """The message's HMAC by the key, in lower-case hex: expressions only."""
    key = key if len(key) <= 64 else __import__("hashlib").sha256(key).digest()
    inner, outer = (F.lit(bytearray(b ^ pad for b in key.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


@query("""WITH b AS (SELECT event_id, event_type, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS body FROM events), p AS (SELECT list_reduce(list_transform(generate_series(1, 64), lambda i: unhex(printf('%02x', xor(CASE WHEN i <= 6 THEN ascii(substr('secret', i, 1)) ELSE 0 END, 54)))), lambda x, y: x || y) AS inner_, list_reduce(list_transform(generate_series(1, 64), lambda i: unhex(printf('%02x', xor(CASE WHEN i <= 6 THEN ascii(substr('secret', i, 1)) ELSE 0 END, 92)))), lambda x, y: x || y) AS outer_)
SELECT event_id, event_type, sha256(outer_ || unhex(sha256(inner_ || encode(body)))) AS signature FROM b, p WHERE event_type = 'purchase'""")
def signed_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies for a webhook, each with its keyed signature."""
    e = tables.load(spark, sf_dir, "events").where("event_type = 'purchase'")
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return e.select("event_id", "event_type", hmac_sha256(b"secret", body).alias("signature"))


def notify(targets: dict[str, Callable[[DataFrame, int], None]]):
    """A foreachBatch step that gives each destination its own rows; a destination is any function of (rows, batch)."""
    def run(df: DataFrame, n: int) -> None:
        for name, send in targets.items():
            send(df.where(F.col("dest") == name), n)

    return run
