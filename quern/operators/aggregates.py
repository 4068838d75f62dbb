"""Aggregations: reductions, collectives, registry and access statistics, health, quota, replicated state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions.text_bytes import ENTROPY_SQL
from ..registry import query

A, C, E, R = tables.ACCESS_SQL, tables.CHUNKS_SQL, tables.EDGES_SQL, tables.REPLICAS_SQL

LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def saturating_sum(c: Column) -> Column:
    """A 64-bit sum that stops at the ends of the range instead of overflowing."""
    wide = F.sum(c.cast("decimal(38,0)"))
    return F.least(F.greatest(wide, F.lit(LONG_MIN).cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


@query("""SELECT l_returnflag AS grp, CAST(sum(l_orderkey) AS BIGINT) AS r_sum, max(l_orderkey) AS r_max, min(l_orderkey) AS r_min, bit_and(l_orderkey) AS r_and, bit_or(l_orderkey) AS r_or, bit_xor(l_orderkey) AS r_xor,
round(sum(ln(1 + l_discount)), 6) AS r_log_product, CAST(least(sum(CAST(l_orderkey AS HUGEINT) * 1000000000000000), 9223372036854775807) AS BIGINT) AS r_saturated FROM lineitem GROUP BY 1""")
def reduce_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    return tables.load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(
        F.sum(k).alias("r_sum"), F.max(k).alias("r_max"), F.min(k).alias("r_min"), F.bit_and(k).alias("r_and"), F.bit_or(k).alias("r_or"), F.bit_xor(k).alias("r_xor"),
        # the product as a sum of logarithms: a product of many factors leaves the range of doubles
        F.round(F.sum(F.log(1 + F.col("l_discount"))), 6).alias("r_log_product"),
        saturating_sum(k.cast("decimal(38,0)") * F.lit(10**15)).alias("r_saturated"),
    )


def all_reduce(vectors: DataFrame, rank: str, vector: str) -> DataFrame:
    """(rank, pos, value): the element-wise sum over all ranks, given to every rank."""
    total = vectors.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x").cast("double")).alias("value"))
    ranks = vectors.select(rank).distinct()
    # one vector's length of rows: a constant of the data's shape, not of its size
    return ranks.crossJoin(F.broadcast(total))


@query("""WITH x AS (SELECT unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings), t AS (SELECT pos, sum(CAST(x AS DOUBLE)) AS value FROM x GROUP BY 1)
SELECT label, CAST(pos AS INTEGER) AS pos, round(value, 4) AS value FROM (SELECT DISTINCT label FROM embeddings), t""")
def allreduce_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_reduce(tables.load(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "pos", F.round("value", 4).alias("value"))


def reduce_scatter(vectors: DataFrame, vector: str, width: int) -> DataFrame:
    """(rank, pos, value): contiguous slices of the element-wise sum, the remainder with the last rank."""
    n = F.size(F.col(vector))
    x = vectors.select(F.posexplode(vector).alias("pos", "x"), n.alias("n")).groupBy("pos").agg(F.sum(F.col("x").cast("double")).alias("value"), F.max("n").alias("n"))
    return x.select(F.least(F.floor(F.col("pos") / F.greatest(F.floor(F.col("n") / width), F.lit(1))), F.lit(width - 1)).cast("int").alias("rank"), "pos", "value")


@query("""WITH x AS (SELECT unnest(embedding) AS x, len(embedding) AS n, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings)
SELECT CAST(least(pos // greatest(max(n) // 4, 1), 3) AS INTEGER) AS rank, CAST(pos AS INTEGER) AS pos, round(sum(CAST(x AS DOUBLE)), 4) AS value FROM x GROUP BY pos""")
def reduce_scatter_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_scatter(tables.load(spark, sf_dir, "embeddings"), "embedding", 4).select("rank", "pos", F.round("value", 4).alias("value"))


@query("SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 6 AS BIGINT) AS rank, o_orderkey FROM orders")
def scatter_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .joins import numbered

    rows = numbered(tables.load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return rows.select(((F.col("pos") - 1) % 6).alias("rank"), "o_orderkey")


@query("SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // CAST(ceil(count(*) OVER () / 6.0) AS BIGINT) AS BIGINT) AS rank, o_orderkey FROM orders")
def scatter_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .joins import numbered

    rows = numbered(tables.load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    n = tables.load(spark, sf_dir, "orders").agg(F.ceil(F.count("*") / 6).alias("block"))
    return rows.crossJoin(F.broadcast(n)).select(F.floor((F.col("pos") - 1) / F.col("block")).alias("rank"), "o_orderkey")


@query("SELECT label AS rank, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS objects, count(*) AS n FROM embeddings GROUP BY 1")
def gather_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rank holds, gathered."""
    e = tables.load(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("rank"))
    return e.agg(F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), ",").alias("objects"), F.count("*").alias("n"))


def guarded(top: Column, bottom: Column, empty: float) -> Column:
    """A ratio with a fixed answer for nothing."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty))


@query(f"""WITH {C}, {R}, r AS (SELECT chunk, count(*) AS refs FROM replicas GROUP BY 1), x AS (SELECT size_bytes, size_bytes // 2 AS compressed, coalesce(refs, 0) AS refs FROM chunks LEFT JOIN r USING (chunk))
SELECT count(*) AS n_chunks, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, CAST(sum(compressed) AS BIGINT) AS stored_bytes, CAST(sum(refs) AS BIGINT) AS total_refs, count_if(refs = 0) AS unreferenced,
round(sum(refs) / count(*), 6) AS avg_refs, round(sum(compressed) / sum(size_bytes), 6) AS compression_ratio FROM x""")
def registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = tables.replicas(spark, sf_dir).groupBy("chunk").agg(F.count("*").alias("refs"))
    x = tables.chunks(spark, sf_dir).join(refs, "chunk", "left").select("size_bytes", F.expr("size_bytes div 2").alias("compressed"), F.coalesce("refs", F.lit(0)).alias("refs"))
    return x.agg(
        F.count("*").alias("n_chunks"), F.sum("size_bytes").alias("total_bytes"), F.sum("compressed").alias("stored_bytes"), F.sum("refs").alias("total_refs"), F.count_if(F.col("refs") == 0).alias("unreferenced"),
        F.round(guarded(F.sum("refs"), F.count("*"), 0.0), 6).alias("avg_refs"), F.round(guarded(F.sum("compressed"), F.sum("size_bytes"), 1.0), 6).alias("compression_ratio"),
    )


def registration(pieces: DataFrame, digest: str, order: list[str], size: str) -> DataFrame:
    """New against repeated chunks: the first occurrence of a digest is new."""
    first = pieces.groupBy(digest).agg(F.count("*").alias("n"), F.max(size).alias("bytes"))
    sums = first.agg(F.count("*").alias("new_chunks"), F.sum(F.col("n") - 1).alias("dedup_chunks"), F.sum("bytes").alias("new_bytes"), F.sum((F.col("n") - 1) * F.col("bytes")).alias("dedup_bytes"))
    return sums.withColumn("dedup_ratio", F.round(guarded(F.col("dedup_bytes"), F.col("new_bytes") + F.col("dedup_bytes"), 0.0), 6))


FIXED_SQL = """pieces AS (SELECT doc_id, i - 1 AS idx, substr(text, CAST((i - 1) * 512 + 1 AS BIGINT), 512) AS piece FROM (SELECT doc_id, text, unnest(generate_series(1, CAST(ceil(length(text) / 512.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0))"""


@query(f"""WITH {FIXED_SQL}, f AS (SELECT sha256(piece) AS h, count(*) AS n, max(octet_length(encode(piece))) AS bytes FROM pieces GROUP BY 1)
SELECT count(*) AS new_chunks, CAST(sum(n - 1) AS BIGINT) AS dedup_chunks, CAST(sum(bytes) AS BIGINT) AS new_bytes, CAST(sum((n - 1) * bytes) AS BIGINT) AS dedup_bytes, round(sum((n - 1) * bytes) / sum(n * bytes), 6) AS dedup_ratio FROM f""")
def dedup_registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text_bytes import fixed_chunks

    pieces = fixed_chunks(tables.load(spark, sf_dir, "documents"), "doc_id", "text", 512)
    return registration(pieces.withColumn("bytes", F.octet_length("piece").cast("long")), "digest", ["doc_id", "idx"], "bytes")


@query(f"WITH {C}, {R} SELECT chunk FROM chunks WHERE chunk NOT IN (SELECT chunk FROM replicas WHERE edge % 20 = 0)")
def unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chunks(spark, sf_dir).join(tables.replicas(spark, sf_dir).where("edge % 20 = 0"), "chunk", "left_anti").select("chunk")


@query(f"""WITH {FIXED_SQL}, f AS (SELECT sha256(piece) AS h, count(*) AS n, max(octet_length(encode(piece))) AS bytes FROM pieces GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_chunks, count(*) AS unique_chunks, round(sum(bytes) / sum(n * bytes), 6) AS copy_on_write_ratio FROM f""")
def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored over logical bytes; 1.0 when there is nothing."""
    from ..functions.text_bytes import fixed_chunks

    pieces = fixed_chunks(tables.load(spark, sf_dir, "documents"), "doc_id", "text", 512).withColumn("bytes", F.octet_length("piece").cast("long"))
    f = pieces.groupBy("digest").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    return f.agg(F.sum("n").alias("total_chunks"), F.count("*").alias("unique_chunks"), F.round(guarded(F.sum("bytes"), F.sum(F.col("n") * F.col("bytes")), 1.0), 6).alias("copy_on_write_ratio"))


BUCKETS = (1000.0, 10000.0, 30000.0, 60000.0, 100000.0)


@query("SELECT l_returnflag, " + ", ".join(f"count_if(l_extendedprice <= {b}) AS le_{int(b)}" for b in BUCKETS) + ", count(*) AS le_inf, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets: how many values are at most each bound."""
    p = F.col("l_extendedprice")
    return tables.load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.count_if(p <= b).alias(f"le_{int(b)}") for b in BUCKETS], F.count("*").alias("le_inf"), F.round(F.sum(p), 2).alias("total"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: list[float]) -> DataFrame:
    """Exact percentiles: the element at round(p/100 (n-1)), halves away from zero, of the sorted values without NaN.

    Value counts are dealt out by (key, value) ranges and ranked inside them; the counts of a key's earlier ranges are
    added, one row a range. So one key's values spread over tasks, and no list is gathered.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count("*").alias("c"))
    ranged = tables.written(counted.repartitionByRange(n, *keys, value).withColumn("range", F.spark_partition_id()), "value-ranges")
    within = ranged.withColumn("here", F.sum("c").over(Window.partitionBy("range", *keys).orderBy(value)))
    w = Window.partitionBy(*keys)
    sums = ranged.groupBy("range", *keys).agg(F.sum("c").alias("s"))
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("s").over(w))
    sums = sums.select(F.col("range").alias("of"), *[F.col(k).alias(f"of_{k}") for k in keys], "before", "n")
    same = F.col("range") == F.col("of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    upto = within.join(sums, same).withColumn("upto", F.col("here") + F.col("before"))
    out = []
    for p in percents:
        at = F.floor(F.lit(p / 100) * (F.col("n") - 1) + 0.5)
        out.append(F.min(F.when(F.col("upto") > at, F.col(value))).alias(f"p{p:g}"))
    return upto.groupBy(*keys).agg(*out)


@query("SELECT event_type, " + ", ".join(f"list(value ORDER BY value)[CAST(floor({p / 100} * (count(value) - 1) + 0.5) AS BIGINT) + 1] AS p{p:g}" for p in (50, 90, 99)) + " FROM events WHERE value IS NOT NULL GROUP BY 1")
def exact_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rank(tables.load(spark, sf_dir, "events"), ["event_type"], "value", [50, 90, 99])


@query("SELECT user_id, count_if(event_type = 'purchase') AS counter, arg_max(value, (ts, event_id)) AS gauge, count(*) AS timer_count, round(sum(value), 6) AS timer_sum FROM events GROUP BY 1")
def counter_gauge_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("counter"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"), F.count("*").alias("timer_count"), F.round(F.sum("value"), 6).alias("timer_sum"))


@query(f"""WITH {A} SELECT op, count(*) AS ops, count_if(latency_ms > 90) AS errors, CAST(sum(CAST(floor(latency_ms) AS BIGINT)) // count(*) AS BIGINT) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
round(count_if(latency_ms > 90) / count(*), 6) AS error_rate, count_if(latency_ms > 90) / count(*) < 0.2 AS is_healthy FROM access GROUP BY 1""")
def store_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.count_if(F.col("latency_ms") > 90)
    return tables.access_log(spark, sf_dir).groupBy("op").agg(
        F.count("*").alias("ops"), late.alias("errors"), F.expr("sum(cast(floor(latency_ms) as bigint)) div count(*)").alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"),
        F.round(guarded(late, F.count("*"), 0.0), 6).alias("error_rate"), (guarded(late, F.count("*"), 0.0) < 0.2).alias("is_healthy"),
    )


def object_stats(log: DataFrame) -> DataFrame:
    write = F.col("op").isin("purchase", "signup")
    return log.groupBy("key").agg(
        F.count_if(~write).alias("reads"), F.count_if(write).alias("writes"), F.expr("sum(cast(floor(latency_ms) as bigint)) div count(*)").alias("avg_ms"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
    )


STATS_SQL = f"""{A}, stats AS (SELECT key, count_if(op NOT IN ('purchase','signup')) AS reads, count_if(op IN ('purchase','signup')) AS writes, CAST(sum(CAST(floor(latency_ms) AS BIGINT)) // count(*) AS BIGINT) AS avg_ms, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM access GROUP BY 1)"""


@query(f"WITH {STATS_SQL} SELECT * FROM stats")
def object_access_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_stats(tables.access_log(spark, sf_dir))


@query(f"""WITH {STATS_SQL}, g AS (SELECT CAST(sum(reads + writes) AS BIGINT) AS total_ops, count(*) AS unique_keys, count_if(reads + writes >= 10) AS hot_keys, count_if(reads = 0) AS cold_keys, max(last_ms) - min(first_ms) AS span FROM stats)
SELECT total_ops, unique_keys, hot_keys, cold_keys, CAST(total_ops // (span // 60000 + 1) AS BIGINT) AS ops_per_minute FROM g""")
def global_access_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = object_stats(tables.access_log(spark, sf_dir)).agg(F.sum(F.col("reads") + F.col("writes")).alias("total_ops"), F.count("*").alias("unique_keys"), F.count_if(F.col("reads") + F.col("writes") >= 10).alias("hot_keys"), F.count_if(F.col("reads") == 0).alias("cold_keys"), (F.max("last_ms") - F.min("first_ms")).alias("span"))
    return g.select("total_ops", "unique_keys", "hot_keys", "cold_keys", F.expr("total_ops div (span div 60000 + 1)").alias("ops_per_minute"))


@query("""WITH h AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS h, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT event_type, CAST(isodow(ts) - 1 AS INTEGER) AS d, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, (SELECT h FROM h WHERE h.event_type = t.event_type ORDER BY n DESC, h LIMIT 1) AS peak_hour, (SELECT d FROM d WHERE d.event_type = t.event_type ORDER BY n DESC, d LIMIT 1) AS peak_weekday FROM (SELECT DISTINCT event_type FROM events) t""")
def hour_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest hour and weekday (Monday 0), ties to the smallest."""
    e = tables.load(spark, sf_dir, "events")

    def mode(part: Column, name: str) -> DataFrame:
        counted = e.groupBy("event_type", part.alias("x")).agg(F.count("*").alias("n"))
        return counted.groupBy("event_type").agg(F.min_by("x", F.struct(-F.col("n"), F.col("x"))).alias(name))

    return mode(F.hour("ts"), "peak_hour").join(mode(F.weekday("ts"), "peak_weekday"), "event_type")


@query(f"""WITH {A}, x AS (SELECT *, key - lag(key) OVER (ORDER BY ts_ms, seq) AS step FROM access), h AS (SELECT CAST(hour(ts) AS INTEGER) AS h, count(*) AS n FROM events GROUP BY 1), k AS (SELECT key, count(*) AS n FROM access GROUP BY 1)
SELECT count(*) AS total, count(DISTINCT key) AS distinct_keys, round(avg(latency_ms), 6) AS avg_ms, round(count_if(abs(step) = 1) / count(*), 6) AS sequential_ratio, round((SELECT sum(n) FROM k WHERE n >= 10) / count(*), 6) AS hot_ratio, (SELECT h FROM h ORDER BY n DESC, h LIMIT 1) AS peak_hour FROM x""")
def access_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about the whole log. Neighbours are found within time-ordered ranges, whose edges meet by rank."""
    from .joins import numbered

    log = tables.access_log(spark, sf_dir)
    order = F.struct("ts_ms", "seq")
    ranked = numbered(log.select("key", "latency_ms", "ts_ms", order.alias("at")), "at")
    after = ranked.select((F.col("pos") + 1).alias("pos"), F.col("key").alias("before"))
    steps = ranked.join(after, "pos", "left").withColumn("step", F.abs(F.col("key") - F.col("before")))
    hot = log.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum(F.when(F.col("n") >= 10, F.col("n"))).alias("hot"))
    hours = log.groupBy(F.hour(F.timestamp_millis("ts_ms")).alias("h")).agg(F.count("*").alias("n")).agg(F.min_by("h", F.struct(-F.col("n"), F.col("h"))).alias("peak_hour"))
    one = steps.agg(F.count("*").alias("total"), F.count_distinct("key").alias("distinct_keys"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"), F.round(F.count_if(F.col("step") == 1) / F.count("*"), 6).alias("sequential_ratio"))
    return one.crossJoin(hot).crossJoin(hours).select("total", "distinct_keys", "avg_ms", "sequential_ratio", F.round(F.col("hot") / F.col("total"), 6).alias("hot_ratio"), "peak_hour")


@query("""WITH x AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^\\x20-\\x7e]', '', 'g'), '')) AS ch FROM documents), c AS (SELECT doc_id, ch, count(*) AS n FROM x WHERE ch <> '' GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY 1)
SELECT doc_id, round(-sum(n / t * log2(n / t)) / 8, 6) + 0.0 AS entropy FROM c JOIN t USING (doc_id) GROUP BY 1""")
def entropy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy over 8 of the printable ASCII characters: one pass over each text's bytes, no shuffle."""
    from ..functions.text_bytes import entropy

    docs = tables.load(spark, sf_dir, "documents").select("doc_id", entropy("text").alias("entropy")).where("entropy is not null")
    return docs.select("doc_id", (F.round("entropy", 6) + 0.0).alias("entropy"))


@query(f"""WITH {tables.KEYS_SQL}, x AS (SELECT coalesce(nullif(regexp_extract(key, '\\.([a-z0-9]+)([?#].*)?$', 1), ''), 'none') AS ext, key, size, page_id FROM keys)
SELECT ext, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, round(100.0 * sum(size) / sum(sum(size)) OVER (), 4) AS percent, arg_max(page_id, (size, page_id)) AS largest FROM x GROUP BY 1""")
def extension_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.keys import extension

    x = tables.keys(spark, sf_dir).withColumn("ext", extension(F.col("key")))
    g = x.groupBy("ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max_by("page_id", F.struct("size", "page_id")).alias("largest"))
    total = g.agg(F.sum("bytes").alias("total"))  # one row per extension at most
    return g.crossJoin(F.broadcast(total)).select("ext", "n", "bytes", F.round(100.0 * F.col("bytes") / F.col("total"), 4).alias("percent"), "largest")


@query(f"""WITH {ENTROPY_SQL} SELECT source, count(*) AS files, CAST(sum(n) AS BIGINT) AS total, round(avg(ratio), 6) AS avg_ratio, CASE WHEN avg(ratio) > 0.95 THEN 'none' WHEN avg(ratio) > 0.7 THEN 'lz4' WHEN avg(ratio) > 0.3 THEN 'zstd3' ELSE 'zstd19' END AS hint,
CASE WHEN sum(n) < 1048576 THEN 65536 WHEN sum(n) < 1073741824 THEN 1048576 ELSE 4194304 END AS chunk_size FROM (SELECT source, octet_length(encode(text)) AS n, e.e AS ratio FROM documents LEFT JOIN e USING (doc_id)) GROUP BY 1""")
def payload_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: files, bytes, mean entropy, and the codec and chunk size that follow."""
    from ..functions.text_bytes import codec_for, entropy

    d = tables.load(spark, sf_dir, "documents").select("source", F.octet_length("text").cast("long").alias("n"), F.round(entropy("text"), 6).alias("ratio"))
    g = d.groupBy("source").agg(F.count("*").alias("files"), F.sum("n").alias("total"), F.avg("ratio").alias("r"))
    size = F.when(F.col("total") < 1 << 20, 65536).when(F.col("total") < 1 << 30, 1 << 20).otherwise(4 << 20)
    return g.select("source", "files", "total", F.round("r", 6).alias("avg_ratio"), codec_for(F.col("r")).alias("hint"), size.alias("chunk_size"))


@query(f"""WITH {E} SELECT count(*) AS n, round(avg(active / slots), 6) AS avg_load, max(active / slots) > 0.9 AS any_over, count_if(active / slots > 0.8) AS saturated, count_if(active / slots < 0.2) AS under, arg_max(edge, (active / slots, -edge)) AS busiest FROM edges""")
def load_and_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = F.col("active") / F.col("slots")
    return tables.edges(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(load), 6).alias("avg_load"), (F.max(load) > 0.9).alias("any_over"), F.count_if(load > 0.8).alias("saturated"), F.count_if(load < 0.2).alias("under"), F.max_by("edge", F.struct(load, -F.col("edge"))).alias("busiest"))


@query(f"WITH {C}, {R} SELECT chunk, count(DISTINCT edge) AS replica_count FROM replicas GROUP BY 1")
def replica_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.replicas(spark, sf_dir).groupBy("chunk").agg(F.count("*").alias("replica_count"))


@query(f"WITH {C}, {R}, n AS (SELECT chunk, count(edge) AS n FROM chunks LEFT JOIN replicas USING (chunk) GROUP BY 1) SELECT chunk, n, CASE WHEN n < 20 THEN 'under' WHEN n > 21 THEN 'over' ELSE 'ok' END AS state FROM n WHERE n < 20 OR n > 21")
def under_replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.chunks(spark, sf_dir).join(tables.replicas(spark, sf_dir), "chunk", "left").groupBy("chunk").agg(F.count("edge").alias("n"))
    return n.withColumn("state", F.when(F.col("n") < 20, "under").when(F.col("n") > 21, "over").otherwise("ok")).where("state <> 'ok'")


@query(f"WITH {R} SELECT edge, count(*) AS chunks, min(chunk) AS first_chunk, max(chunk) AS last_chunk FROM replicas GROUP BY 1")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.replicas(spark, sf_dir).groupBy("edge").agg(F.count("*").alias("chunks"), F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"))


@query(f"WITH {E} SELECT CAST(sum(slots) AS BIGINT) AS capacity, CAST(sum(active) AS BIGINT) AS used, count_if(online) AS online, round(avg(load), 6) AS avg_load FROM edges")
def fleet_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.edges(spark, sf_dir).agg(F.sum("slots").alias("capacity"), F.sum("active").alias("used"), F.count_if("online").alias("online"), F.round(F.avg("load"), 6).alias("avg_load"))


@query("""SELECT user_id, round(0.4 * sr + 0.3 * up + 0.3 * (1 - least(lat * 50 / 5000, 1)), 6) AS health FROM (SELECT user_id, 1 - count_if(event_type = 'error') / count(*) AS sr, count_if(event_type <> 'signup') / count(*) AS up, avg(value) AS lat FROM events GROUP BY 1)""")
def health_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rate, uptime and speed, weighted .4, .3, .3."""
    n = F.count("*")
    x = tables.load(spark, sf_dir, "events").groupBy("user_id").agg((1 - F.count_if(F.col("event_type") == "error") / n).alias("sr"), (F.count_if(F.col("event_type") != "signup") / n).alias("up"), F.avg("value").alias("lat"))
    return x.select("user_id", F.round(0.4 * F.col("sr") + 0.3 * F.col("up") + 0.3 * (1 - F.least(F.col("lat") * 50 / 5000, F.lit(1.0))), 6).alias("health"))


@query(f"""WITH {R}, {E}, o AS (SELECT chunk, count_if(health > 0.6) AS healthy, count(*) AS shards FROM replicas JOIN edges USING (edge) GROUP BY 1) SELECT chunk, healthy, shards, healthy >= 4 AS recoverable, healthy < shards AS needs_repair FROM o""")
def shard_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.replicas(spark, sf_dir).join(tables.edges(spark, sf_dir), "edge").groupBy("chunk").agg(F.count_if(F.col("health") > 0.6).alias("healthy"), F.count("*").alias("shards"))
    return o.select("chunk", "healthy", "shards", (F.col("healthy") >= 4).alias("recoverable"), (F.col("healthy") < F.col("shards")).alias("needs_repair"))


@query("""SELECT CASE WHEN grouping(c_nationkey) = 0 THEN 'bucket' WHEN grouping(c_mktsegment) = 0 THEN 'user' ELSE 'global' END AS scope, CAST(c_nationkey AS VARCHAR) AS bucket, c_mktsegment AS "user", count(*) AS objects, round(sum(o_totalprice), 2) AS bytes
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())""")
def quota_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by bucket, user and in all, in one pass."""
    o = tables.load(spark, sf_dir, "orders").join(tables.load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    g = o.groupingSets([["c_nationkey"], ["c_mktsegment"], []], "c_nationkey", "c_mktsegment").agg(F.grouping("c_nationkey").alias("a"), F.grouping("c_mktsegment").alias("b"), F.count("*").alias("objects"), F.round(F.sum("o_totalprice"), 2).alias("bytes"))
    scope = F.when(F.col("a") == 0, "bucket").when(F.col("b") == 0, "user").otherwise("global")
    return g.select(scope.alias("scope"), F.col("c_nationkey").cast("string").alias("bucket"), F.col("c_mktsegment").alias("user"), "objects", "bytes")


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS bytes, round(avg(o_totalprice), 4) AS avg_speed FROM orders GROUP BY 1")
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("bytes"), F.round(F.avg("o_totalprice"), 4).alias("avg_speed"))


def g_counter(deltas: DataFrame, keys: list[str], node: str, count: str) -> DataFrame:
    """Grow-only counter: the greatest count of each node, summed."""
    return deltas.groupBy(*keys, node).agg(F.max(count).alias("m")).groupBy(*keys).agg(F.sum("m").alias("value"))


@query("SELECT event_type, CAST(sum(m) AS BIGINT) AS value FROM (SELECT event_type, user_id % 5 AS node, max(event_id % 1000) AS m FROM events GROUP BY ALL) GROUP BY 1")
def gcounter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.load(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("node"), (F.col("event_id") % 1000).alias("c"))
    return g_counter(d, ["event_type"], "node", "c")


@query("SELECT event_type, CAST(sum(p) - sum(n) AS BIGINT) AS value, round(sum(p) / nullif(sum(p) + sum(n), 0), 6) AS vote_ratio FROM (SELECT event_type, user_id % 5 AS node, max(CASE WHEN event_id % 2 = 0 THEN event_id % 1000 ELSE 0 END) AS p, max(CASE WHEN event_id % 2 = 1 THEN event_id % 700 ELSE 0 END) AS n FROM events GROUP BY ALL) GROUP BY 1")
def pncounter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up and down counts per node; the vote ratio is .5 without votes."""
    even = F.col("event_id") % 2 == 0
    d = tables.load(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("node"), F.when(even, F.col("event_id") % 1000).otherwise(0).alias("p"), F.when(~even, F.col("event_id") % 700).otherwise(0).alias("n"))
    m = d.groupBy("event_type", "node").agg(F.max("p").alias("p"), F.max("n").alias("n")).groupBy("event_type").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return m.select("event_type", (F.col("p") - F.col("n")).alias("value"), F.round(guarded(F.col("p"), F.col("p") + F.col("n"), 0.5), 6).alias("vote_ratio"))


@query("SELECT user_id, arg_max(value, (ts, event_id, user_id % 5)) AS value FROM events GROUP BY 1")
def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last writer wins by (physical, logical, node)."""
    return tables.load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id", F.col("user_id") % 5)).alias("value"))


@query("""WITH w AS (SELECT user_id % 50 AS key, user_id % 5 AS node, max(event_id) AS ts FROM events GROUP BY ALL) SELECT key, node, ts FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.key = a.key AND b.node <> a.node AND b.ts > a.ts + 500)""")
def mv_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that no later value of another node dominates (by more than the window of concurrency)."""
    w = tables.load(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("key"), (F.col("user_id") % 5).alias("node")).agg(F.max("event_id").alias("ts"))
    # the two greatest per key tell for every node what the greatest of the others is
    top = w.groupBy("key").agg(F.max(F.struct("ts", "node")).alias("best"))
    return w.join(top, "key").where((F.col("best.node") == F.col("node")) | (F.col("best.ts") <= F.col("ts") + 500)).select("key", "node", "ts")


@query(f"WITH {A} SELECT op, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, CAST(sum(CAST(floor(latency_ms) AS BIGINT)) // count(*) AS BIGINT) AS mean_ms, count(*) AS n FROM access GROUP BY 1")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.access_log(spark, sf_dir).groupBy("op").agg(F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), F.expr("sum(cast(floor(latency_ms) as bigint)) div count(*)").alias("mean_ms"), F.count("*").alias("n"))


@query("SELECT l_linestatus AS stage, count(*) AS n, round(sum(l_quantity), 2) AS bytes, round(avg(l_tax), 6) AS avg_us, min(l_tax) AS min_us, max(l_tax) AS max_us, round(sum(l_quantity) / sum(l_tax), 4) AS throughput FROM lineitem GROUP BY 1")
def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("bytes"), F.round(F.avg("l_tax"), 6).alias("avg_us"), F.min("l_tax").alias("min_us"), F.max("l_tax").alias("max_us"), F.round(F.sum("l_quantity") / F.sum("l_tax"), 4).alias("throughput"))


@query("SELECT CAST(count_if(event_type = 'error') * 1000000 // count(*) AS BIGINT) AS error_ppm, round(1 - count_if(event_type = 'error') / count(*), 6) AS success_rate, round(avg(CASE WHEN event_type = 'error' THEN value END), 6) AS avg_repair_ms FROM events")
def scrub_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    return tables.load(spark, sf_dir, "events").agg(F.expr("count_if(event_type = 'error') * 1000000 div count(*)").alias("error_ppm"), F.round(1 - F.count_if(bad) / F.count("*"), 6).alias("success_rate"), F.round(F.avg(F.when(bad, F.col("value"))), 6).alias("avg_repair_ms"))


@query(f"""WITH {R}, n AS (SELECT chunk, count(*) AS x FROM replicas GROUP BY 1) SELECT count(*) AS total, round(avg(x), 6) AS average, count_if(x >= 15) AS valid FROM n""")
def selection_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.replicas(spark, sf_dir).groupBy("chunk").agg(F.count("*").alias("x"))
    return n.agg(F.count("*").alias("total"), F.round(F.avg("x"), 6).alias("average"), F.count_if(F.col("x") >= 15).alias("valid"))


@query(f"""WITH {R}, u AS (SELECT edge, count(*) AS c FROM replicas GROUP BY 1), t AS (SELECT sum(c) AS total, count(*) AS n, var_pop(c) AS v FROM u)
SELECT round(greatest(0, least(1, 1 - v / ((total * total / n) * (1 - 1.0 / n)))), 6) AS diversity, (SELECT count_if(c > 0.5 * total) FROM u) AS overloaded, (SELECT count_if(c < 0.1 * total / n) FROM u) AS underutilised FROM t""")
def path_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 minus the variance of use over its greatest possible value."""
    u = tables.replicas(spark, sf_dir).groupBy("edge").agg(F.count("*").alias("c"))
    t = u.agg(F.sum("c").alias("total"), F.count("*").alias("n"), F.var_pop("c").alias("v"))
    share = u.crossJoin(F.broadcast(t)).groupBy("total", "n", "v").agg(F.count_if(F.col("c") > 0.5 * F.col("total")).alias("overloaded"), F.count_if(F.col("c") < 0.1 * F.col("total") / F.col("n")).alias("underutilised"))
    worst = (F.col("total") * F.col("total") / F.col("n")) * (1 - 1 / F.col("n"))
    return share.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("v") / worst)), 6).alias("diversity"), "overloaded", "underutilised")


@query("""SELECT o_custkey, count_if(o_orderstatus = 'F') AS done, count(*) AS total, round(100.0 * count_if(o_orderstatus = 'F') / count(*), 4) AS percent, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / nullif(count_if(o_orderstatus = 'F'), 0), 4) AS speed,
round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END) / nullif(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 0), 6) AS eta FROM orders GROUP BY 1""")
def progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    bytes_done, bytes_left = F.sum(F.when(done, F.col("o_totalprice")).otherwise(0.0)), F.sum(F.when(~done, F.col("o_totalprice")).otherwise(0.0))
    return tables.load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(done).alias("done"), F.count("*").alias("total"), F.round(100.0 * F.count_if(done) / F.count("*"), 4).alias("percent"), F.round(bytes_done / F.nullif(F.count_if(done), F.lit(0)), 4).alias("speed"), F.round(F.try_divide(bytes_left, bytes_done), 6).alias("eta"))


@query("SELECT p_brand, round(sum(p_retailprice) / sum(p_size), 6) AS batch_ratio, round(sum(p_size) / sum(p_retailprice), 6) AS registry_ratio, round(1 - sum(p_size) / sum(p_retailprice), 6) AS savings FROM part GROUP BY 1")
def compression_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch ratio is original over compressed, registry ratio the other way round."""
    a, b = F.sum("p_retailprice"), F.sum("p_size")
    return tables.load(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(guarded(a, b, 0.0), 6).alias("batch_ratio"), F.round(guarded(b, a, 1.0), 6).alias("registry_ratio"), F.round(1 - guarded(b, a, 1.0), 6).alias("savings"))


@query("SELECT p_type AS store, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes, count_if(p_partkey % 9 = 0) AS orphans FROM part GROUP BY 1")
def storage_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("store")).agg(F.count("*").alias("n"), F.sum(F.col("p_size").cast("long")).alias("bytes"), F.count_if(F.col("p_partkey") % 9 == 0).alias("orphans"))


@query(f"WITH {E} SELECT count_if(bandwidth > 5e7) AS fast, count_if(health > 0.8) AS healthy, count_if(online AND load < 0.5) AS ready, round(avg(load), 6) AS avg_load FROM edges")
def fleet_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.edges(spark, sf_dir).agg(F.count_if(F.col("bandwidth") > 5e7).alias("fast"), F.count_if(F.col("health") > 0.8).alias("healthy"), F.count_if(F.col("online") & (F.col("load") < 0.5)).alias("ready"), F.round(F.avg("load"), 6).alias("avg_load"))


@query(f"""WITH {E} SELECT edge % 8 AS domain, CASE WHEN count(*) = 0 THEN 'unknown' WHEN count_if(online AND health > 0.6) = count(*) THEN 'healthy' WHEN count_if(NOT online) = 0 THEN 'degraded' WHEN count_if(online) * 2 >= count(*) THEN 'degraded' ELSE 'unhealthy' END AS state FROM edges GROUP BY 1""")
def domain_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, good, up = F.count("*"), F.count_if(F.col("online") & (F.col("health") > 0.6)), F.count_if("online")
    state = F.when(n == 0, "unknown").when(good == n, "healthy").when(up == n, "degraded").when(up * 2 >= n, "degraded").otherwise("unhealthy")
    return tables.edges(spark, sf_dir).groupBy((F.col("edge") % 8).alias("domain")).agg(state.alias("state"))


@query("SELECT l_suppkey AS edge, round(count(DISTINCT l_partkey) / count(*), 6) AS diversity FROM lineitem GROUP BY 1")
def edge_path_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("edge")).agg(F.round(F.count_distinct("l_partkey") / F.count("*"), 6).alias("diversity"))


@query("SELECT user_id % 20 AS edge, count_if(event_type = 'view') AS idle, count_if(event_type = 'click') AS active, count_if(event_type = 'error') AS failed FROM events GROUP BY 1")
def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = {"view": "idle", "click": "active", "error": "failed"}
    return tables.load(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("edge")).agg(*[F.count_if(F.col("event_type") == k).alias(v) for k, v in states.items()])


@query("SELECT round(count_if(o_orderstatus = 'F') / count(*), 6) AS completion_rate, round(count_if(o_orderstatus = 'P') / count(*), 6) AS failure_rate, count_if(o_orderstatus = 'P') / count(*) < 0.1 AS healthy FROM orders")
def scheduler_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = {s: F.count_if(F.col("o_orderstatus") == s) / F.count("*") for s in "FP"}
    return tables.load(spark, sf_dir, "orders").agg(F.round(rate["F"], 6).alias("completion_rate"), F.round(rate["P"], 6).alias("failure_rate"), (rate["P"] < 0.1).alias("healthy"))


@query("SELECT user_id % 10 AS model, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events GROUP BY 1")
def prediction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("model")).agg(F.round(F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("""SELECT count_if(a.o_orderkey IS NULL) AS added, count_if(b.o_orderkey IS NULL) AS removed, count_if(a.o_orderstatus <> b.o_orderstatus) AS conflicts, count_if(a.o_orderstatus = b.o_orderstatus) AS unchanged
FROM (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0) b ON a.o_orderkey = b.o_orderkey""")
def crdt_merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.load(spark, sf_dir, "orders")
    a = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("x"))
    b = o.where("o_orderkey % 7 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("y"))
    j = a.join(b, "o_orderkey", "full")
    return j.agg(F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("y").isNull()).alias("removed"), F.count_if(F.col("x") != F.col("y")).alias("conflicts"), F.count_if(F.col("x") == F.col("y")).alias("unchanged"))
