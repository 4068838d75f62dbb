"""Predicate operators: event patterns, key filters, conditions, time windows, allow and block windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..registry import query


def event_matches(name: Column, pattern: str) -> Column:
    """Exact, 'family:*', or '*'."""
    if pattern == "*":
        return F.lit(True)
    return F.startswith(name, F.lit(pattern[:-1])) if pattern.endswith(":*") else name == pattern


@query("SELECT event_id, event_type = 'click' AS exact, starts_with('access:' || event_type, 'access:') AS family, starts_with('access:' || event_type, 'access:c') AS other FROM events")
def event_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.concat(F.lit("access:"), "event_type")
    return tables.load(spark, sf_dir, "events").select("event_id", event_matches(n, "access:click").alias("exact"), event_matches(n, "access:*").alias("family"), F.startswith(n, F.lit("access:c")).alias("other"))


def key_matches(key: Column, rules: list[tuple[str, str]]) -> Column:
    """All prefix and suffix rules must hold; rules of other names are ignored."""
    out = F.lit(True)
    for kind, value in rules:
        if kind == "prefix":
            out = out & F.startswith(key, F.lit(value))
        elif kind == "suffix":
            out = out & F.endswith(key, F.lit(value))
    return out


@query(f"WITH {tables.KEYS_SQL} SELECT page_id, key FROM keys WHERE starts_with(key, 'm.') AND ends_with(key, '.html')")
def key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.keys(spark, sf_dir)
    return k.where(key_matches(F.col("key"), [("prefix", "m."), ("suffix", ".html"), ("other", "x")])).select("page_id", "key")


def condition(op: str, value: Column, wanted: list[str]) -> Column:
    """One policy condition; an unknown operator holds."""
    from ..functions.keys import glob_regex, in_cidr

    any_like = lambda f: F.coalesce(F.greatest(*[f(w) for w in wanted], F.lit(False)), F.lit(False))
    table = {
        "StringEquals": lambda: any_like(lambda w: value == w),
        "StringNotEquals": lambda: ~any_like(lambda w: value == w),
        "StringEqualsIgnoreCase": lambda: any_like(lambda w: F.lower(value) == w.lower()),
        "StringLike": lambda: any_like(lambda w: value.rlike(glob_regex(w))),
        "StringNotLike": lambda: ~any_like(lambda w: value.rlike(glob_regex(w))),
        "IpAddress": lambda: any_like(lambda w: in_cidr(value, w)),
        "NotIpAddress": lambda: ~any_like(lambda w: in_cidr(value, w)),
        "Bool": lambda: any_like(lambda w: F.lower(value) == w.lower()),
        "Null": lambda: value.isNull() if wanted[0].lower() == "true" else value.isNotNull(),
    }
    return table[op]() if op in table else F.lit(True)


@query("""SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS eq, c_mktsegment NOT IN ('BUILDING') AS ne, lower(c_mktsegment) = 'building' AS eq_ci, regexp_matches(c_mktsegment, '^.*M.CH.*$') AS lk, NOT regexp_matches(c_mktsegment, '^.*E$') AS nlk, c_custkey % 256 BETWEEN 0 AND 127 AS ip, true AS unknown FROM customer""")
def condition_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("c_mktsegment")
    ip = F.concat_ws(".", F.lit("192.168.1"), (F.col("c_custkey") % 256).cast("string"))
    return tables.load(spark, sf_dir, "customer").select(
        "c_custkey", condition("StringEquals", s, ["BUILDING", "MACHINERY"]).alias("eq"), condition("StringNotEquals", s, ["BUILDING"]).alias("ne"), condition("StringEqualsIgnoreCase", s, ["Building"]).alias("eq_ci"),
        condition("StringLike", s, ["*M?CH*"]).alias("lk"), condition("StringNotLike", s, ["*E"]).alias("nlk"), condition("IpAddress", ip, ["192.168.1.0/25"]).alias("ip"), condition("DateLessThan", s, ["x"]).alias("unknown"),
    )


def in_window(ts: Column, days: list[int], first: int, last: int, offset_hours: int = 0) -> Column:
    """Weekday (Monday 0) and hour, the end inclusive and possibly past midnight, at a fixed offset."""
    local = ts + F.make_interval(hours=F.lit(offset_hours))
    hour = F.hour(local)
    hours = (hour >= first) & (hour <= last) if first <= last else (hour >= first) | (hour <= last)
    return F.weekday(local).isin(*days) & hours


@query("SELECT event_id FROM events WHERE isodow(ts + INTERVAL 2 HOUR) - 1 IN (0, 1, 2, 3, 4) AND (hour(ts + INTERVAL 2 HOUR) >= 22 OR hour(ts + INTERVAL 2 HOUR) <= 5)")
def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "events").where(in_window(F.col("ts"), [0, 1, 2, 3, 4], 22, 5, 2)).select("event_id")


MODEL_FILE = r"\.(safetensors|gguf|pt|bin|onnx|html)$|/model|checkpoint"


@query(f"WITH {tables.KEYS_SQL} SELECT page_id, starts_with(key, 'blog.') OR starts_with(key, 'm.') AS protected, regexp_matches(key, '{MODEL_FILE}') AS model_file FROM keys")
def protected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = F.array(F.lit("blog."), F.lit("m."))
    return tables.keys(spark, sf_dir).select("page_id", F.exists(prefixes, lambda p: F.startswith(F.col("key"), p)).alias("protected"), F.col("key").rlike(MODEL_FILE).alias("model_file"))


def tensor_query(df: DataFrame, name_like: str | None = None, dtype: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """Tensors by name pattern, type and size; what isn't given doesn't restrict."""
    from ..functions.keys import glob_regex

    for given, keep in ((name_like, lambda v: F.col("name").rlike(glob_regex(v))), (dtype, lambda v: F.col("dtype") == v), (least, lambda v: F.col("bytes") >= v), (most, lambda v: F.col("bytes") <= v)):
        if given is not None:
            df = df.where(keep(given))
    return df


@query("SELECT vec_id FROM embeddings WHERE regexp_matches('layer.' || label || '.w', '^layer\\.1.*\\.w$') AND len(embedding) * 4 <= 4096 AND label % 2 = 1")
def tensor_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.load(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("layer."), F.col("label").cast("string"), F.lit(".w")).alias("name"), F.when(F.col("label") % 2 == 1, "f32").otherwise("f16").alias("dtype"), (F.size("embedding") * 4).alias("bytes"))
    return tensor_query(t, "layer.1*.w", "f32", None, 4096).select("vec_id")


@query(f"WITH {tables.EDGES_SQL} SELECT edge FROM edges WHERE online AND health > 0.7 AND load < 0.9")
def registry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.edges(spark, sf_dir).where("online and health > 0.7 and load < 0.9").select("edge")


def allowed(windows: Column, at: Column) -> Column:
    """windows: array of (kind, first, last). A block in force wins; else an allow; else only if there are no allows."""
    on = lambda w: (w["first"] <= at) & (at <= w["last"])
    block = F.exists(windows, lambda w: (w["kind"] == "block") & on(w))
    allow = F.exists(windows, lambda w: (w["kind"] == "allow") & on(w))
    return F.when(block, False).when(allow, True).otherwise(~F.exists(windows, lambda w: w["kind"] == "allow"))


@query("SELECT event_id, CASE WHEN hour(ts) BETWEEN 12 AND 13 THEN false WHEN hour(ts) BETWEEN 8 AND 17 THEN true ELSE user_id % 2 = 0 END AS ok FROM events")
def allow_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    def w(kind, first, last):
        return F.struct(F.lit(kind).alias("kind"), F.lit(first).alias("first"), F.lit(last).alias("last"))

    windows = F.when(F.col("user_id") % 2 == 0, F.array(w("block", 12, 13))).otherwise(F.array(w("block", 12, 13), w("allow", 8, 17)))
    return tables.load(spark, sf_dir, "events").select("event_id", allowed(windows, F.hour("ts")).alias("ok"))


LEVELS = ("view", "click", "signup", "purchase", "error")


@query("SELECT event_id FROM events WHERE list_position(['view','click','signup','purchase','error'], event_type) >= 4")
def alert_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of at least a level; whether they were seen doesn't matter."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("event_type"))
    return tables.load(spark, sf_dir, "events").where(rank >= 4).select("event_id")


@query("SELECT user_id, (kind = 'user' AND id = '7') OR kind = 'wildcard' AS matches FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 10 = 0 THEN 'wildcard' WHEN user_id % 3 = 0 THEN 'group' ELSE 'user' END AS kind, CAST(user_id AS VARCHAR) AS id FROM events)")
def principal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal within a kind; a wildcard on either side matches all."""
    k = F.col("user_id")
    p = tables.load(spark, sf_dir, "events").select("user_id").distinct()
    kind = F.when(k % 10 == 0, "wildcard").when(k % 3 == 0, "group").otherwise("user")
    return p.select("user_id", (((kind == "user") & (k.cast("string") == "7")) | (kind == "wildcard")).alias("matches"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_tax < 0.05")
def statement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "lineitem").where("l_quantity between 10 and 20 and l_returnflag in ('A', 'R') and l_tax < 0.05").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))
