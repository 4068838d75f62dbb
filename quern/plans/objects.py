"""Selections over stored objects: tables written by the sinks, read back through requests of every input form."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..registry import query
from .select import CsvInput, JsonInput, ScanRange, SelectRequest, select, write_csv, write_json


def stored(spark: SparkSession, label: str) -> str:
    return f"{tables.shared_dir(spark)}/quern-objects/{label}-{uuid.uuid4().hex}"


def one_object(rows: DataFrame, order: str, line: F.Column, begin: str = "", between: str = "\n", end: str = "") -> str:
    """A bounded table as one text object, its lines in order and a last line end; returns the path."""
    path = stored(rows.sparkSession, "object")
    lines = F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line"))))
    body = F.concat(F.lit(begin), F.array_join(F.transform(lines, lambda x: x["line"]), between), F.lit(end))
    rows.agg(body.alias("body")).write.text(path)
    return path


@query("SELECT CAST(o_orderkey AS VARCHAR) AS _1, o_orderstatus AS _3 FROM orders WHERE o_custkey % 3 = 0")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV sink and CSV scan without a header: every cell is a text, names are places."""
    path = stored(spark, "csv")
    write_csv(tables.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, "|")
    return select(spark, path, SelectRequest("SELECT _1, _3 FROM s3object WHERE CAST(_2 AS BIGINT) % 3 = 0", CsvInput("NONE", "|")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS _1, c_name AS _2 FROM customer WHERE c_custkey > 40 AND c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0")
def csv_compat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV cells typed one by one: numbers compare as numbers, texts as texts, an empty cell is null."""
    path = stored(spark, "csv")
    c = tables.load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.lit(None).cast("string")).otherwise("odd").alias("mark"))
    write_csv(c, path)
    return select(spark, path, SelectRequest("SELECT _1, _2 FROM s3object WHERE _1 > 40 AND _3 = 'BUILDING' AND _4 IS NULL", CsvInput("NONE"), "compat"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation WHERE n_regionkey = 1")
def csv_header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV object with a header line, whose names the statement uses."""
    line = F.concat_ws(";", "n_nationkey", "n_name", "n_regionkey")
    path = one_object(tables.load(spark, sf_dir, "nation"), "n_nationkey", line, "k;name;region\n")
    return select(spark, path, SelectRequest("SELECT k, name FROM s3object WHERE region = 1", CsvInput("USE", ";"), "compat"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (3, 5, 8) AND s_suppkey > 2")
def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON sink and JSON LINES scan."""
    path = stored(spark, "json")
    write_json(tables.load(spark, sf_dir, "supplier"), path)
    return select(spark, path, SelectRequest("SELECT s_suppkey, s_name FROM s3object WHERE s_nationkey IN (3, 5, 8) AND s_suppkey > 2", JsonInput()))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_name LIKE '%AN%'")
def json_document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document: an array, a row for each element."""
    path = one_object(tables.load(spark, sf_dir, "nation"), "n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))), "[", ",\n", "]")
    return select(spark, path, SelectRequest("SELECT k, name FROM s3object WHERE name LIKE '%AN%'", JsonInput("DOCUMENT")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet object: filter and columns reach the scan."""
    return select(spark, f"{sf_dir}/orders.parquet", SelectRequest("SELECT o_orderkey, o_totalprice FROM s3object WHERE o_totalprice > 250000 AND o_orderstatus = 'F'", None))


@query("""WITH o AS (SELECT string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS body FROM nation), p AS (SELECT unnest(string_split(substr(body, 31, 200), chr(10))) AS line FROM o)
SELECT nullif(string_split(line, ',')[1], '') AS _1, string_split(line, ',')[2] AS _2 FROM p WHERE line <> ''""")
def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes [30, 230) of one object, cut wherever they fall."""
    path = one_object(tables.load(spark, sf_dir, "nation"), "n_nationkey", F.concat_ws(",", "n_nationkey", "n_name"))
    return select(spark, path, SelectRequest("SELECT _1, _2 FROM s3object", CsvInput("NONE"), "strict", ScanRange(30, 230)))


REQUEST = {
    "Expression": "SELECT r_regionkey, r_name FROM s3object WHERE r_regionkey >= 2 LIMIT 2",
    "ExpressionType": "SQL",
    "InputSerialization": {"JSON": {"Type": "LINES"}, "CompressionType": "NONE"},
    "OutputSerialization": {"JSON": {"RecordDelimiter": "\n"}},
    "Mode": "compat",
}


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 2 ORDER BY r_regionkey LIMIT 2")
def request_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request as it arrives, as a JSON body; a limit keeps the object's order."""
    path = one_object(tables.load(spark, sf_dir, "region"), "r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")))
    return select(spark, path, SelectRequest.parse(json.loads(json.dumps(REQUEST))))
