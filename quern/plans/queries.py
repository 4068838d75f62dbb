"""Registered selections and the scheduler's tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..registry import query
from .select import compat


def _strict(table: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.load(spark, sf_dir, table).createOrReplaceTempView("s3object")
        return spark.sql(sql)

    return run


def _compat(table: str, sql: str):
    return lambda spark, sf_dir: compat(tables.load(spark, sf_dir, table), sql)


def _both(name: str, table: str, sql: str, twin: str | None = None, run=_strict) -> None:
    query((twin or sql).replace("s3object", table), name=name)(run(table, sql))


_both("select_filter_project", "lineitem", "SELECT l_orderkey, l_extendedprice AS price FROM s3object WHERE l_quantity > 45 AND l_returnflag = 'R'")
_both("select_in_between_like", "customer", "SELECT c_custkey FROM s3object WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND c_acctbal BETWEEN 100 AND 5000 AND c_name LIKE '%7%'")
_both("select_arith", "lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net FROM s3object WHERE l_quantity % 7 = 3")
_both("select_limit", "nation", "SELECT n_nationkey FROM s3object ORDER BY n_nationkey LIMIT 5")
_both("compat_filter", "lineitem", "SELECT l_orderkey, l_linenumber FROM s3object WHERE l_quantity > 40 AND l_shipmode = 1", "SELECT l_orderkey, l_linenumber FROM s3object WHERE false", _compat)
_both("compat_in_between_like", "customer", "SELECT c_custkey, c_name FROM s3object WHERE c_mktsegment NOT IN ('BUILDING', NULL) AND c_acctbal NOT BETWEEN 0 AND 5000 AND c_name LIKE 'Customer%1'", "SELECT c_custkey, c_name FROM s3object WHERE c_mktsegment NOT IN ('BUILDING') AND c_acctbal NOT BETWEEN 0 AND 5000 AND regexp_matches(c_name, '^Customer.*1$')", _compat)
_both("compat_mixed_types", "orders", "SELECT o_orderkey FROM s3object WHERE o_orderstatus <> 1 AND o_totalprice / 0 IS NULL AND o_custkey * 2 >= 2990", "SELECT o_orderkey FROM s3object WHERE o_custkey * 2 >= 2990", _compat)
_both("compat_concat", "nation", "SELECT n_nationkey FROM s3object WHERE n_name || 'x' = 'FRANCEx' OR n_regionkey = 2", None, _compat)

C, E, R = tables.CHUNKS_SQL, tables.EDGES_SQL, tables.REPLICAS_SQL


@query(f"""WITH x AS (SELECT o_orderkey, o_custkey % 7 = 0 AS n, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) SELECT o_orderkey FROM x WHERE v IS NOT DISTINCT FROM NULL OR v > 300000""")
def select_null_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL = NULL is true here, and a comparison with NULL never keeps a row."""
    x = tables.load(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")))
    null = compat(x, "SELECT o_orderkey FROM s3object WHERE v = NULL")
    return null.unionByName(compat(x, "SELECT o_orderkey FROM s3object WHERE v > 300000"))


def tick(costs: DataFrame, requests: DataFrame, load_limit: int) -> DataFrame:
    """One round of scheduling: each requested chunk to its cheapest edge, edges filled up to a limit in cost order.

    The limit on an edge is by rank within the edge, so rounds need no state beyond their input.
    """
    from ..operators.topk import top_per_group

    best = top_per_group(costs.join(requests, "chunk", "left_semi"), ["chunk"], [F.col("cost"), F.col("edge")], 1).drop("rank")
    return top_per_group(best, ["edge"], [F.col("cost"), F.col("chunk")], load_limit)


@query(f"""WITH {C}, {E}, {R}, costs AS (SELECT chunk, edge, 0.3::DOUBLE * least(size_bytes * 8 / bandwidth / 10.0, 1.0) + 0.3::DOUBLE * least(rtt_us / 100000.0, 1.0) + 0.2::DOUBLE * (1 - health) + 0.2::DOUBLE * (active / slots) AS cost FROM chunks JOIN replicas USING (chunk) JOIN edges USING (edge) WHERE online AND active < slots),
b AS (SELECT chunk, arg_min(edge, (cost, edge)) AS edge, min(cost) AS cost FROM costs WHERE chunk % 3 = 0 GROUP BY 1) SELECT chunk, edge, CAST(rank AS INTEGER) AS rank FROM (SELECT chunk, edge, row_number() OVER (PARTITION BY edge ORDER BY cost, chunk) AS rank FROM b) WHERE rank <= 10""")
def scheduler_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.rules import edge_cost

    costs = edge_cost(spark, sf_dir).select("chunk", "edge", "cost")
    requests = tables.chunks(spark, sf_dir).where("chunk % 3 = 0").select("chunk")
    return tick(costs, requests, 10).select("chunk", "edge", "rank")
