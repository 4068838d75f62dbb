"""Decision operators: costs, constraints, placement, failover, lifecycle, tiering, quota, access."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..registry import query

A, C, E, R = tables.ACCESS_SQL, tables.CHUNKS_SQL, tables.EDGES_SQL, tables.REPLICAS_SQL


@dataclass(frozen=True)
class Weights:
    bandwidth: float = 0.3
    rtt: float = 0.3
    health: float = 0.2
    load: float = 0.2
    max_rtt_us: float = 100_000.0


#: Weights by scheduling policy.
POLICIES = {"balanced": Weights(), "throughput": Weights(0.6, 0.2, 0.1, 0.1), "latency": Weights(0.2, 0.6, 0.1, 0.1), "reliability": Weights(0.2, 0.2, 0.5, 0.1)}


def cost(size: Column, w: Weights = POLICIES["balanced"]) -> Column:
    """Weighted sum of the time to send (ten seconds count as one), round trip, ill health and load."""
    send = F.least(size * 8 / F.col("bandwidth") / 10.0, F.lit(1.0))
    rtt = F.least(F.col("rtt_us") / w.max_rtt_us, F.lit(1.0))
    return w.bandwidth * send + w.rtt * rtt + w.health * (1 - F.col("health")) + w.load * (F.col("active") / F.col("slots"))


COST_SQL = """costs AS (SELECT chunk, edge, 0.3::DOUBLE * least(size_bytes * 8 / bandwidth / 10.0, 1.0) + 0.3::DOUBLE * least(rtt_us / 100000.0, 1.0) + 0.2::DOUBLE * (1 - health) + 0.2::DOUBLE * (active / slots) AS cost
FROM chunks JOIN replicas USING (chunk) JOIN edges USING (edge) WHERE online AND active < slots)"""


def edge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .joins import available_replicas

    x = available_replicas(tables.chunks(spark, sf_dir), tables.replicas(spark, sf_dir), tables.edges(spark, sf_dir))
    return x.withColumn("cost", cost(F.col("size_bytes"))).select("chunk", "edge", "size_bytes", "cost")


@query(f"WITH {C}, {E}, {R}, {COST_SQL} SELECT chunk, edge, round(cost, 6) AS cost FROM costs")
def cost_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix as its valid entries only."""
    return edge_cost(spark, sf_dir).select("chunk", "edge", F.round("cost", 6).alias("cost"))


@query(f"""WITH {C}, {E}, {R}, {COST_SQL}, k AS (SELECT edge, CASE WHEN edge % 17 = 0 THEN NULL ELSE (CASE WHEN edge % 2 = 0 THEN 1.5 ELSE 1.0 END) * (CASE WHEN edge % 3 = 0 THEN 2.0 ELSE 1.0 END) END::DOUBLE AS factor FROM edges) SELECT chunk, edge, round(cost * factor, 6) AS cost FROM costs JOIN k USING (edge) WHERE factor IS NOT NULL""")
def cost_with_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs times the constraints' multipliers; a blocked edge has no row."""
    k = F.col("edge")
    factor = F.when(k % 17 != 0, F.when(k % 2 == 0, 1.5).otherwise(1.0) * F.when(k % 3 == 0, 2.0).otherwise(1.0))
    constraints = tables.edges(spark, sf_dir).select("edge", factor.alias("factor"))
    return edge_cost(spark, sf_dir).join(constraints, "edge").where("factor is not null").select("chunk", "edge", F.round(F.col("cost") * F.col("factor"), 6).alias("cost"))


@query(f"""WITH {C}, {E}, {R}, {COST_SQL}, cur AS (SELECT chunk, max(edge) AS edge FROM replicas GROUP BY 1), best AS (SELECT chunk, arg_min(edge, (cost, edge)) AS best, min(cost) AS cost FROM costs GROUP BY 1)
SELECT cur.chunk, cur.edge AS current, best.best, best.cost IS NOT NULL AND (c.cost IS NULL OR best.cost < c.cost * 0.95) AS greedy, best.cost IS NOT NULL AND (c.cost IS NULL OR c.cost > 0.9) AS min_disruption, best.cost IS NOT NULL AND (c.cost IS NULL OR best.cost < c.cost) AS optimal, best.cost IS NOT NULL AND (c.cost IS NULL OR best.cost < c.cost * (0.5 - 0.4 * 0.5)) AS hybrid
FROM cur LEFT JOIN best USING (chunk) LEFT JOIN costs c ON c.chunk = cur.chunk AND c.edge = cur.edge""")
def reoptimise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each strategy would move a chunk from its present edge to the cheapest."""
    costs = edge_cost(spark, sf_dir).select("chunk", "edge", "cost")
    cur = tables.replicas(spark, sf_dir).groupBy("chunk").agg(F.max("edge").alias("edge"))
    best = costs.groupBy("chunk").agg(F.min_by("edge", F.struct("cost", "edge")).alias("best"), F.min("cost").alias("best_cost"))
    j = cur.join(best, "chunk", "left").join(costs, ["chunk", "edge"], "left")
    b, c = F.col("best_cost"), F.col("cost")

    def rule(better: Column) -> Column:
        return F.coalesce(b.isNotNull() & (c.isNull() | better), F.lit(False))

    return j.select("chunk", F.col("edge").alias("current"), "best", rule(b < c * 0.95).alias("greedy"), rule(c > 0.9).alias("min_disruption"), rule(b < c).alias("optimal"), rule(b < c * (0.5 - 0.4 * 0.5)).alias("hybrid"))


@query(f"""WITH {E}, o AS (SELECT edge AS src, load AS sl FROM edges WHERE load > 0.8), u AS (SELECT edge AS dst, load AS dl FROM edges WHERE load < 0.3 AND online ORDER BY load, edge LIMIT 1) SELECT src, dst, round(sl - dl, 6) AS benefit FROM o, u""")
def rebalance_first_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each overloaded edge with the least loaded one."""
    e = tables.edges(spark, sf_dir)
    least = e.where("load < 0.3 and online").agg(F.min(F.struct("load", "edge")).alias("t")).where("t is not null").select(F.col("t.edge").alias("dst"), F.col("t.load").alias("dl"))
    return e.where("load > 0.8").crossJoin(F.broadcast(least)).select(F.col("edge").alias("src"), "dst", F.round(F.col("load") - F.col("dl"), 6).alias("benefit"))


def greedy_rebalance(edges: DataFrame, high: float = 0.8, low: float = 0.3, step: float = 0.1, most: int = 100) -> DataFrame:
    """Moves from the fullest to the emptiest edge while both are out of bounds.

    Loads change with each move, so it is one sequential fold. In ``most`` moves no more than ``most`` edges of either end
    can take part, so the fold gets those alone, whatever the fleet's size.
    """
    def plan(pdf):
        import pandas as pd

        load = {int(e): float(x) for e, x in zip(pdf["edge"], pdf["load"], strict=True)}
        out = []
        while len(out) < most and load:
            src = max(load, key=lambda e: (load[e], -e))
            dst = min(load, key=lambda e: (load[e], e))
            if load[src] <= high or load[dst] >= low:
                break
            out.append((len(out), src, dst, load[src] - load[dst]))
            load[src] -= step
            load[dst] += step
        return pd.DataFrame(out, columns=["move", "src", "dst", "benefit"])

    both = edges.where(F.col("load") > high).orderBy(F.desc("load"), "edge").limit(most).unionByName(edges.where(F.col("load") < low).orderBy("load", "edge").limit(most))
    return both.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(plan, "move long, src long, dst long, benefit double")


@query()
def rebalance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_rebalance(tables.edges(spark, sf_dir)).withColumn("benefit", F.round("benefit", 6))


@query(f"WITH {A} SELECT seq, CASE WHEN retries >= 3 THEN 'abort' WHEN op = 'error' AND latency_ms < 50 THEN 'retry' WHEN op = 'error' AND key % 4 <> 0 THEN 'reroute' WHEN op = 'error' THEN 'abort' ELSE 'none' END AS action FROM (SELECT *, seq % 5 AS retries FROM access)")
def failover_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abort when out of retries; retry a healthy edge; else reroute if there is another; else abort."""
    bad = F.col("op") == "error"
    action = F.when(F.col("seq") % 5 >= 3, "abort").when(bad & (F.col("latency_ms") < 50), "retry").when(bad & (F.col("key") % 4 != 0), "reroute").when(bad, "abort").otherwise("none")
    return tables.access_log(spark, sf_dir).select("seq", action.alias("action"))


@query(f"""WITH {C}, {E}, {R}, {COST_SQL}, cur AS (SELECT chunk, max(edge) AS edge FROM replicas GROUP BY 1), j AS (SELECT cur.chunk, c.cost, b.cost AS best FROM cur JOIN costs c ON c.chunk = cur.chunk AND c.edge = cur.edge JOIN (SELECT chunk, min(cost) AS cost FROM costs GROUP BY 1) b ON b.chunk = cur.chunk)
SELECT count(*) AS assignments, round(avg(cost - best), 6) AS improvement, round(count_if(best < cost) / count(*), 6) AS disruption FROM j""")
def reopt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = edge_cost(spark, sf_dir).select("chunk", "edge", "cost")
    cur = tables.replicas(spark, sf_dir).groupBy("chunk").agg(F.max("edge").alias("edge"))
    j = cur.join(costs, ["chunk", "edge"]).join(costs.groupBy("chunk").agg(F.min("cost").alias("best")), "chunk")
    return j.agg(F.count("*").alias("assignments"), F.round(F.avg(F.col("cost") - F.col("best")), 6).alias("improvement"), F.round(F.count_if(F.col("best") < F.col("cost")) / F.count("*"), 6).alias("disruption"))


@query(f"""WITH {A}, s AS (SELECT key % 30 AS edge, avg(latency_ms) AS m, max(latency_ms) AS x, max(ts_ms) AS t FROM access GROUP BY 1) SELECT edge, CASE WHEN edge % 6 = 0 THEN 'none' WHEN m > 51 THEN 'full' WHEN x > 99.5 THEN 'partial' ELSE 'none' END AS decision FROM s""")
def reopt_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In cooldown nothing; beyond the drift limit everything; else only what is unhealthy."""
    s = tables.access_log(spark, sf_dir).groupBy((F.col("key") % 30).alias("edge")).agg(F.avg("latency_ms").alias("m"), F.max("latency_ms").alias("x"))
    return s.select("edge", F.when(F.col("edge") % 6 == 0, "none").when(F.col("m") > 51, "full").when(F.col("x") > 99.5, "partial").otherwise("none").alias("decision"))


def hysteresis(log: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """(key, seq, change): 'degraded' once below low, 'recovered' only once above high again."""
    w = Window.partitionBy(key).orderBy("ts_ms", "seq")
    mark = F.when(F.col(value) < low, "degraded").when(F.col(value) > high, "recovered")
    s = log.withColumn("mark", mark).where("mark is not null")
    s = s.withColumn("before", F.coalesce(F.lag("mark").over(w), F.lit("recovered")))
    return s.where("mark <> before").select(key, "seq", F.col("mark").alias("change"))


@query(f"""WITH {A}, s AS (SELECT key % 30 AS edge, seq, ts_ms, CASE WHEN latency_ms < 20 THEN 'degraded' WHEN latency_ms > 60 THEN 'recovered' END AS change FROM access), x AS (SELECT *, coalesce(lag(change) OVER (PARTITION BY edge ORDER BY ts_ms, seq), 'recovered') AS before FROM s WHERE change IS NOT NULL) SELECT edge, seq, change FROM x WHERE change <> before""")
def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hysteresis(tables.access_log(spark, sf_dir).withColumn("edge", F.col("key") % 30), "edge", "latency_ms", 20, 60)


@query(f"""WITH {A}, p AS (SELECT key, count(*) AS n, round(avg(latency_ms) / 100, 6) AS confidence FROM access WHERE key % 4 <> 0 GROUP BY 1) SELECT key, n, confidence FROM p WHERE confidence >= 0.5 AND n >= 3 ORDER BY confidence DESC, key LIMIT 32""")
def preposition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident predictions outside their cooldown, the best batch of them."""
    p = tables.access_log(spark, sf_dir).where("key % 4 <> 0").groupBy("key").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms") / 100, 6).alias("confidence"))
    return p.where("confidence >= 0.5 and n >= 3").orderBy(F.desc("confidence"), "key").limit(32).select("key", "n", "confidence")


@query(f"""WITH {A} SELECT key % 25 AS path, greatest(1, least(6, list_reduce(list_prepend(3::BIGINT, list(CASE WHEN latency_ms / 100 < 0.3 THEN 1::BIGINT WHEN latency_ms / 100 > 0.7 THEN -1::BIGINT ELSE 0::BIGINT END ORDER BY ts_ms, seq)), lambda p, d: greatest(1, least(6, p + d))))) AS parity FROM access GROUP BY 1""")
def adaptive_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity goes up on bad quality and down on good, within bounds, sample by sample."""
    from .sequences import streamed

    q = F.col("latency_ms") / 100
    log = tables.access_log(spark, sf_dir).withColumn("path", F.col("key") % 25).withColumn("d", F.when(q < 0.3, 1).when(q > 0.7, -1).otherwise(0))
    return streamed(log, "path", ["ts_ms", "seq"], ["d"], (3,), lambda now, x: (max(1, min(6, now[0] + x[0])),), "path long, parity long")


NOW = "1998-08-02"


@query(f"""SELECT o_orderkey, CASE WHEN age > 2000 AND starts_with(o_orderpriority, '5') THEN 'expire' WHEN age > 1500 THEN 'archive' WHEN age > 700 THEN 'infrequent' ELSE 'none' END AS action FROM (SELECT o_orderkey, o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), DATE '{NOW}') AS age FROM orders)""")
def lifecycle_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiration before transitions, the coldest class first."""
    age = F.datediff(F.lit(NOW).cast("date"), F.col("o_orderdate").cast("date"))
    action = F.when((age > 2000) & F.col("o_orderpriority").startswith("5"), "expire").when(age > 1500, "archive").when(age > 700, "infrequent").otherwise("none")
    return tables.load(spark, sf_dir, "orders").select("o_orderkey", action.alias("action"))


@query(f"""WITH {A}, s AS (SELECT key, count(*) AS n, max(ts_ms) AS last, count_if(op = 'purchase') AS writes FROM access GROUP BY 1), g AS (SELECT max(ts_ms) AS now FROM access) SELECT key, CASE WHEN key % 20 = 0 THEN 'pinned' WHEN n >= 15 THEN 'standard' WHEN now - last > 30 * 86400000::BIGINT THEN 'archive' WHEN now - last > 7 * 86400000::BIGINT THEN 'infrequent' ELSE 'keep' END AS tier FROM s, g""")
def autotier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected keys are pinned, hot ones standard, then by days since the last access."""
    log = tables.access_log(spark, sf_dir)
    s = log.groupBy("key").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last"))
    s = s.crossJoin(F.broadcast(s.agg(F.max("last").alias("now"))))
    idle = F.col("now") - F.col("last")
    return s.select("key", F.when(F.col("key") % 20 == 0, "pinned").when(F.col("n") >= 15, "standard").when(idle > 30 * 86_400_000, "archive").when(idle > 7 * 86_400_000, "infrequent").otherwise("keep").alias("tier"))


@query(f"""WITH {A}, s AS (SELECT key, count_if(op NOT IN ('purchase','signup')) AS r, count_if(op IN ('purchase','signup')) AS w FROM access GROUP BY 1) SELECT key, CASE WHEN w <= 2 AND r > 10 THEN 'worm' WHEN w > 0 AND r / w < 0.3 THEN 'write_heavy' WHEN r > 100 THEN 'repeated' WHEN key % 10 = 0 THEN 'sequential' ELSE 'random' END AS pattern FROM s""")
def access_pattern_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .aggregates import object_stats

    r, w = F.col("reads"), F.col("writes")
    label = F.when((w <= 2) & (r > 10), "worm").when((w > 0) & (r < 0.3 * w), "write_heavy").when(r > 100, "repeated").when(F.col("key") % 10 == 0, "sequential").otherwise("random")
    return object_stats(tables.access_log(spark, sf_dir)).select("key", label.alias("pattern"))


@query("""SELECT conv_id, CASE WHEN bool_or(contains(lower(text), 'code')) THEN 'checkpoint' WHEN count(*) > 4 THEN 'batch' WHEN bool_or(role = 'system') THEN 'preprocess' WHEN bool_or(contains(lower(text), '?')) THEN 'eval' ELSE 'model' END AS workload FROM conversations GROUP BY 1""")
def workload_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sign that a session shows, in order of precedence."""
    has = lambda s: F.coalesce(F.bool_or(F.contains(F.lower("text"), F.lit(s))), F.lit(False))
    label = F.when(has("code"), "checkpoint").when(F.count("*") > 4, "batch").when(F.bool_or(F.col("role") == "system"), "preprocess").when(has("?"), "eval").otherwise("model")
    return tables.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(label.alias("workload"))


@query("""WITH u AS (SELECT c_custkey, c_nationkey, round(coalesce(sum(o_totalprice), 0) / 2000000, 6) AS used FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) SELECT c_custkey, used, CASE WHEN used >= 1 AND c_nationkey % 3 <> 0 THEN 'deny' WHEN used >= 1 THEN 'grace' WHEN used >= 0.8 THEN 'warn' ELSE 'allow' END AS decision, CASE WHEN used >= 0.95 THEN 95 WHEN used >= 0.9 THEN 90 WHEN used >= 0.8 THEN 80 END AS level FROM u""")
def quota_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard limit where it is enforced, grace elsewhere, then the soft limit; the highest threshold reached."""
    used = tables.load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"))
    u = tables.load(spark, sf_dir, "customer").join(used, "c_custkey", "left").withColumn("used", F.round(F.coalesce("s", F.lit(0.0)) / 2000000, 6))
    x = F.col("used")
    level = F.when(x >= 0.95, 95).when(x >= 0.9, 90).when(x >= 0.8, 80)
    return u.select("c_custkey", "used", F.when((x >= 1) & (F.col("c_nationkey") % 3 != 0), "deny").when(x >= 1, "grace").when(x >= 0.8, "warn").otherwise("allow").alias("decision"), level.alias("level"))


POLICY = [("allow", "user:*", "*", "*"), ("deny", "user:1*", "purchase", "*"), ("allow", "user:13", "purchase", "obj/7*"), ("deny", "*", "error", "obj/?1")]


def authorise(requests: DataFrame, statements: list[tuple[str, str, str, str]]) -> DataFrame:
    """Per request: an explicit deny wins over an allow; else it doesn't apply. Statements become one expression."""
    from ..functions.keys import glob_regex

    def any_of(effect: str) -> Column:
        out = F.lit(False)
        for e, who, action, what in statements:
            if e == effect:
                out = out | (F.col("principal").rlike(glob_regex(who)) & F.col("action").rlike(glob_regex(action)) & F.col("resource").rlike(glob_regex(what)))
        return out

    return requests.withColumn("decision", F.when(any_of("deny"), "deny").when(any_of("allow"), "allow").otherwise("not_applicable"))


def _sql_match(s) -> str:
    from ..functions.keys import glob_regex

    return "(" + " AND ".join(f"regexp_matches({c}, '{glob_regex(p)}')" for c, p in zip(("principal", "action", "resource"), s[1:], strict=True)) + ")"


@query(f"""SELECT event_id, CASE WHEN {" OR ".join(_sql_match(s) for s in POLICY if s[0] == "deny")} THEN 'deny' WHEN {" OR ".join(_sql_match(s) for s in POLICY if s[0] == "allow")} THEN 'allow' ELSE 'not_applicable' END AS decision
FROM (SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 'svc:' ELSE 'user:' END || user_id AS principal, event_type AS action, 'obj/' || event_id % 100 AS resource FROM events)""", name="authorise")
def authorise_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id")
    r = tables.load(spark, sf_dir, "events").select("event_id", F.concat(F.when(k % 9 == 0, "svc:").otherwise("user:"), k.cast("string")).alias("principal"), F.col("event_type").alias("action"), F.concat(F.lit("obj/"), (F.col("event_id") % 100).cast("string")).alias("resource"))
    return authorise(r, POLICY).select("event_id", "decision")


@query(f"WITH {C} SELECT chunk, shard, ['a', 'b', 'c', 'd', 'e'][CAST((chunk + shard) % 5 AS INTEGER) + 1] AS domain FROM (SELECT chunk, unnest([0, 1, 2, 3]) AS shard FROM chunks)")
def shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round robin over the domains, beginning at the chunk's own place: shards of a chunk never share one."""
    domains = F.array(*[F.lit(d) for d in "abcde"])
    s = tables.chunks(spark, sf_dir).select("chunk", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shard"))
    return s.select("chunk", "shard", F.element_at(domains, (F.pmod(F.col("chunk") + F.col("shard"), F.lit(5)) + 1).cast("int")).alias("domain"))


def repair_targets(replicas: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk, target, score): each held chunk's best online edge: +100 for a new domain, +50 local, +25 with room, and up to 10 for latency.

    A score depends on the chunk only through whether it has a copy in the edge's domain, so each domain's best edge for
    either case stands for all of it: no chunk meets more than one row a domain.
    """
    held = replicas.join(edges.select("edge"), "edge").groupBy("chunk").agg(F.collect_set(F.col("edge") % 8).alias("domains"))
    e = edges.where("online").withColumn("domain", F.col("edge") % 8)
    best = []
    for new in (0, 100):
        score = F.lit(new) + F.when(F.col("edge") % 5 == 0, 50).otherwise(0) + F.when(F.col("load") < 0.8, 25).otherwise(0) + (100 - F.least(F.col("rtt_us") / 1000, F.lit(100.0))) / 10
        best.append(F.max(F.struct(score.alias("score"), (-F.col("edge")).alias("least"))).alias(f"best{new}"))
    c = held.crossJoin(F.broadcast(e.groupBy("domain").agg(*best)))
    own = F.when(F.array_contains("domains", F.col("domain")), F.col("best0")).otherwise(F.col("best100"))
    top = c.groupBy("chunk").agg(F.max(own).alias("top"))
    return top.select("chunk", (-F.col("top.least")).alias("target"), F.round("top.score", 4).alias("score"))


@query(f"""WITH {R}, {E}, h AS (SELECT chunk, list(DISTINCT edge % 8) AS domains FROM replicas JOIN edges USING (edge) GROUP BY 1), s AS (SELECT h.chunk, e.edge, (CASE WHEN list_contains(domains, e.edge % 8) THEN 0 ELSE 100 END) + (CASE WHEN e.edge % 5 = 0 THEN 50 ELSE 0 END) + (CASE WHEN e.load < 0.8 THEN 25 ELSE 0 END) + (100 - least(rtt_us / 1000, 100)) / 10 AS score FROM h, (SELECT * FROM edges WHERE online) e)
SELECT chunk, arg_max(edge, (score, -edge)) AS target, round(max(score), 4) AS score FROM s GROUP BY 1""")
def repair_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best online edge for a new copy of every chunk."""
    return repair_targets(tables.replicas(spark, sf_dir), tables.edges(spark, sf_dir))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN false WHEN DATE '{NOW}' >= until THEN true WHEN o_orderstatus = 'O' THEN o_custkey % 3 = 0 ELSE false END AS may_delete FROM (SELECT *, CAST(o_orderdate AS DATE) + CAST(365 * (1 + o_orderkey % 4) AS INTEGER) AS until FROM orders)""")
def retention_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A legal hold blocks; an ended retention allows; governance needs the bypass; compliance never."""
    k = F.col("o_orderkey")
    until = F.date_add(F.col("o_orderdate").cast("date"), (365 * (1 + k % 4)).cast("int"))
    may = F.when(k % 50 == 0, False).when(F.lit(NOW).cast("date") >= until, True).when(F.col("o_orderstatus") == "O", F.col("o_custkey") % 3 == 0).otherwise(False)
    return tables.load(spark, sf_dir, "orders").select("o_orderkey", may.alias("may_delete"))


@query(f"""WITH {E} SELECT edge, CASE WHEN edge % 10 = 0 THEN 'shared_memory' WHEN bandwidth > 5e7 THEN 'rdma' ELSE 'tcp' END AS transport, round((1e8 / bandwidth + rtt_us / 1e6) * (1 + 0.5 * load), 6) AS seconds FROM edges""")
def transfer_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("edge") % 10 == 0, "shared_memory").when(F.col("bandwidth") > 5e7, "rdma").otherwise("tcp")
    return tables.edges(spark, sf_dir).select("edge", t.alias("transport"), F.round((1e8 / F.col("bandwidth") + F.col("rtt_us") / 1e6) * (1 + 0.5 * F.col("load")), 6).alias("seconds"))


@query(f"""WITH {A}, s AS (SELECT key, count_if(op NOT IN ('purchase','signup')) AS r, count_if(op IN ('purchase','signup')) AS w, round(avg(latency_ms) / 100, 6) AS confidence FROM access GROUP BY 1) SELECT key, CASE WHEN w <= 2 AND r > 10 THEN 3 WHEN w > r THEN 1 ELSE 2 END AS replication, CASE WHEN r > 10 THEN 0.9 WHEN r > 5 THEN 0.6 ELSE 0.3 END::DOUBLE AS cache_weight, confidence FROM s""")
def placement_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .aggregates import object_stats

    log = tables.access_log(spark, sf_dir)
    s = object_stats(log).join(log.groupBy("key").agg(F.round(F.avg("latency_ms") / 100, 6).alias("confidence")), "key")
    r, w = F.col("reads"), F.col("writes")
    return s.select("key", F.when((w <= 2) & (r > 10), 3).when(w > r, 1).otherwise(2).alias("replication"), F.when(r > 10, 0.9).when(r > 5, 0.6).otherwise(0.3).alias("cache_weight"), "confidence")


@query("""SELECT event_id, value < 80 AND user_id % 11 <> 0 AND event_id % 3 = 0 AS light_due, value < 80 AND user_id % 11 <> 0 AND event_id % 7 = 0 AND isodow(ts) >= 6 AND hour(ts) >= 1 AND hour(ts) < 5 AS deep_due FROM events""")
def scrub_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not while paused or loaded; a deep pass only in its weekly window."""
    gate = (F.col("value") < 80) & (F.col("user_id") % 11 != 0)
    deep = gate & (F.col("event_id") % 7 == 0) & (F.weekday("ts") >= 5) & (F.hour("ts") >= 1) & (F.hour("ts") < 5)
    return tables.load(spark, sf_dir, "events").select("event_id", (gate & (F.col("event_id") % 3 == 0)).alias("light_due"), deep.alias("deep_due"))


@query(f"SELECT o_orderkey, o_orderstatus <> 'P' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '{NOW}') >= 30 AS due, o_orderstatus = 'O' AS can_delete FROM orders")
def snapshot_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.lit(NOW).cast("date"), F.col("o_orderdate").cast("date"))
    return tables.load(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderstatus") != "P") & (age >= 30)).alias("due"), (F.col("o_orderstatus") == "O").alias("can_delete"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN l_suppkey % 2 = 0 AND l_quantity > 10 WHEN 'N' THEN l_suppkey % 5 = 0 OR l_suppkey % 5 = 1 ELSE false END AS may_write FROM lineitem""")
def write_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive: the owner with a live lease. Shared: listed writers. Write once: nobody."""
    s = F.col("l_suppkey")
    may = F.when(F.col("l_returnflag") == "A", (s % 2 == 0) & (F.col("l_quantity") > 10)).when(F.col("l_returnflag") == "N", (s % 5).isin(0, 1)).otherwise(False)
    return tables.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", may.alias("may_write"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {w.bandwidth}::DOUBLE, {w.rtt}::DOUBLE, {w.health}::DOUBLE, {w.load}::DOUBLE)" for k, w in POLICIES.items()) + ") AS t(policy, bandwidth, rtt, health, load)")
def policy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, w.bandwidth, w.rtt, w.health, w.load) for k, w in POLICIES.items()], "policy string, bandwidth double, rtt double, health double, load double")
