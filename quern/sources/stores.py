"""The put contract over other layouts than whole objects: deduplicated chunks, erasure-coded shards over domains."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..functions.text_bytes import buzhash_cuts, chunk_bytes, erasure_decode, erasure_encode
from ..registry import query
from .listing import ObjectTable, scan_directory


def place(spark: SparkSession, label: str) -> str:
    return f"{tables.shared_dir(spark)}/quern-objects/{label}-{uuid.uuid4().hex}"


@query("""WITH v AS (SELECT o_orderkey AS k, 'v' || o_orderstatus AS data, 1 AS version FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 'w' || o_orderkey, 2 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, 'again', 3 + CAST(o_orderkey % 3 = 0 AS INTEGER) FROM orders WHERE o_orderkey % 22 = 0)
SELECT CAST(k AS VARCHAR) AS key, CAST(version AS BIGINT) AS version, substr(sha256(data), 1, 32) AS etag, octet_length(encode(data)) AS size FROM v""")
def object_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all, put a third anew, delete each eleventh, put half of those if absent; then what head shows."""
    o = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    key = F.col("k").cast("string").alias("key")
    store = ObjectTable(spark, place(spark, "versions"))
    store.put(o.select(key, F.encode(F.concat(F.lit("v"), "o_orderstatus"), "UTF-8").alias("data")))
    store.put(o.where("k % 3 = 0").select(key, F.encode(F.concat(F.lit("w"), F.col("k").cast("string")), "UTF-8").alias("data")))
    store.delete(o.where("k % 11 = 0").select(key))
    store.put(o.where("k % 2 = 0").select(key, F.encode(F.lit("again"), "UTF-8").alias("data")), if_none_match=True)
    return store.head().select("key", "version", "etag", F.octet_length("data").cast("long").alias("size"))


@query("SELECT count(*) AS files, CAST(sum(octet_length(encode(body)) + 1) AS BIGINT) AS bytes FROM (SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS body FROM nation GROUP BY 1)")
def directory_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files in subfolders: how many, and how many bytes."""
    path = place(spark, "folder")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\n")
    bodies = tables.load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("body"))
    bodies.repartition(1).write.partitionBy("n_regionkey").text(path)
    return scan_directory(spark, path).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


class ChunkStore:
    """Objects as lists of content-defined chunks; a chunk is stored once, whatever objects it is in."""

    def __init__(self, spark: SparkSession, path: str, least: int = 256, average: int = 1024, most: int = 4096):
        self.spark, self.path = spark, path
        self.cut = lambda d: buzhash_cuts(d, least, average, most)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def chunks(self) -> DataFrame:
        return self._read("chunks", "digest string, data binary")

    def manifests(self) -> DataFrame:
        return self._read("manifests", "key long, idx long, digest string, length long")

    def put(self, objects: DataFrame, key: str, data: str) -> None:
        """objects: a numeric key and a text. Only chunks that aren't stored yet are written."""
        pieces = tables.written(chunk_bytes(objects, key, data, self.cut), "pieces")
        pieces.select("key", "idx", "digest", "length").write.mode("append").parquet(f"{self.path}/manifests")
        new = pieces.groupBy("digest").agg(F.min(F.struct("key", "offset", "length")).alias("at")).join(self.chunks().select("digest"), "digest", "left_anti")
        bodies = objects.select(F.col(key).cast("long").alias("key"), F.encode(data, "UTF-8").alias("raw"))
        found = new.select("digest", "at.*").join(bodies, "key").select("digest", F.expr("substring(raw, cast(offset + 1 as int), cast(length as int))").alias("data"))
        found.dropDuplicates(["digest"]).write.mode("append").parquet(f"{self.path}/chunks")

    def get(self) -> DataFrame:
        """(key, data): every object, from its chunks in order."""
        parts = self.manifests().join(self.chunks(), "digest").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("idx", "data"))).alias("p"))
        return parts.select("key", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["data"])), "")).alias("data"))


@query("SELECT doc_id AS key, sha256(text) AS digest, octet_length(encode(text)) AS size, true AS stored_once FROM documents WHERE length(text) > 0")
def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents put in two rounds, the second over the first one's chunks, and read back."""
    docs = tables.load(spark, sf_dir, "documents").where("length(text) > 0")
    store = ChunkStore(spark, place(spark, "chunks"))
    for part in (0, 1):
        store.put(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part), "doc_id", "text")
    once = store.chunks().agg((F.count("*") == F.count_distinct("digest")).alias("stored_once"))
    return store.get().select("key", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("size")).crossJoin(F.broadcast(once))


class ShardStore:
    """Objects as k data and m parity shards, each in a domain of its own; any k domains are enough to read."""

    def __init__(self, spark: SparkSession, path: str, k: int = 4, m: int = 2):
        self.spark, self.path, self.k, self.m = spark, path, k, m

    def put(self, objects: DataFrame, key: str, data: str) -> None:
        k, m = self.k, self.m

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, s, len(raw), (i + s) % (k + m), shard) for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s, shard in enumerate(erasure_encode(raw, k, m))]
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()], strict=True)], ["key", "shard", "size", "domain", "data"])

        rows = objects.select(F.col(key).cast("long"), F.encode(F.coalesce(data, F.lit("")), "UTF-8"))
        rows.mapInArrow(run, "key long, shard long, size long, domain long, data binary").write.mode("append").partitionBy("domain").parquet(self.path)

    def get(self, lost: tuple[int, ...] = ()) -> DataFrame:
        """(key, data) without the lost domains, whose files aren't read."""
        k, m = self.k, self.m

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [erasure_decode({s["shard"]: s["data"] for s in shards}, k, m, size) for size, shards in zip(b.column("size").to_pylist(), b.column("shards").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.binary())], ["key", "data"])

        rows = self.spark.read.schema("key long, shard long, size long, data binary, domain long").parquet(self.path).where(~F.col("domain").isin(list(lost)))
        shards = rows.groupBy("key").agg(F.max("size").alias("size"), F.collect_list(F.struct("shard", "data")).alias("shards"))
        return shards.mapInArrow(run, "key long, data binary")


@query("SELECT doc_id AS key, sha256(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) AS size FROM documents")
def shard_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over six domains, read with two of them lost."""
    store = ShardStore(spark, place(spark, "shards"))
    store.put(tables.load(spark, sf_dir, "documents"), "doc_id", "text")
    return store.get(lost=(1, 4)).select("key", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("size"))
