"""Extension points: a listing as a Python data source, codecs, merges, notification targets, chunk stores."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import tables
from .registry import query


class Backend(Protocol):
    """What a storage backend gives the engine: entries under a prefix, split into parts that can be listed alone."""

    def parts(self, prefix: str) -> list[str]: ...

    def entries(self, part: str) -> Iterator[tuple[str, int]]: ...


class Codec(Protocol):
    name: str

    def compress(self, data: bytes) -> bytes: ...

    def decompress(self, data: bytes) -> bytes: ...


class Merge(Protocol):
    """A mergeable state: commutative, associative and idempotent."""

    def merge(self, states: DataFrame) -> DataFrame: ...


class Collective(Protocol):
    """What a set of ranks does together. Frames have one row a rank: rank, and a vector or an object."""

    def broadcast(self, frame: DataFrame, root: int) -> DataFrame: ...

    def scatter(self, objects: DataFrame, key: str, ranks: int) -> DataFrame: ...

    def gather(self, frame: DataFrame, root: int) -> DataFrame: ...

    def all_gather(self, frame: DataFrame) -> DataFrame: ...

    def all_reduce(self, frame: DataFrame) -> DataFrame: ...

    def reduce_scatter(self, frame: DataFrame, ranks: int) -> DataFrame: ...

    def barrier(self, frame: DataFrame) -> int: ...


class FrameCollective:
    """The collectives as plans over frames of (rank, vector). What a vector has, not how many ranks there are, bounds what is broadcast."""

    def broadcast(self, frame: DataFrame, root: int) -> DataFrame:
        one = frame.where(F.col("rank") == root).select("vector")
        return frame.select("rank").crossJoin(F.broadcast(one))

    def scatter(self, objects: DataFrame, key: str, ranks: int) -> DataFrame:
        from .operators.joins import numbered

        return numbered(objects, key).select(((F.col("pos") - 1) % ranks).alias("rank"), *objects.columns)

    def gather(self, frame: DataFrame, root: int) -> DataFrame:
        return frame.select(F.lit(root).cast("long").alias("rank"), F.col("rank").alias("sender"), "vector")

    def all_gather(self, frame: DataFrame) -> DataFrame:
        """Each rank gets every rank's vector: rows of (rank, sender, vector), as many as the operation itself has."""
        return frame.select("rank").join(frame.select(F.col("rank").alias("sender"), "vector"), F.lit(True))

    def all_reduce(self, frame: DataFrame) -> DataFrame:
        from .operators.aggregates import all_reduce

        return all_reduce(frame, "rank", "vector")

    def reduce_scatter(self, frame: DataFrame, ranks: int) -> DataFrame:
        from .operators.aggregates import reduce_scatter

        return reduce_scatter(frame, "vector", ranks)

    def barrier(self, frame: DataFrame) -> int:
        """Waits for every rank's frame; how many there were."""
        return frame.count()


class ListingPart(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class ListingSource(DataSource):
    """``spark.read.format('quern_listing').option('backend', 'module:factory').option('prefix', p).load()``"""

    @classmethod
    def name(cls) -> str:
        return "quern_listing"

    def schema(self) -> str:
        return "key string, size long"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _backend(self) -> Backend:
        import importlib

        module, _, factory = self.options["backend"].partition(":")
        return getattr(importlib.import_module(module), factory)()

    def partitions(self) -> list[InputPartition]:
        return [ListingPart(p) for p in self._backend().parts(self.options.get("prefix", ""))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self._backend().entries(partition.value)


class Shelves:
    """A backend for trying the listing out: ten shelves of a hundred numbered objects."""

    def parts(self, prefix: str) -> list[str]:
        return [f"{prefix}shelf{k}" for k in range(10)]

    def entries(self, part: str) -> Iterator[tuple[str, int]]:
        yield from ((f"{part}/{i:03}", 10 * i) for i in range(100))


@query("SELECT 'p/shelf' || s || '/' || printf('%03d', i) AS key, CAST(10 * i AS BIGINT) AS size FROM range(10) a(s), range(100) b(i)")
def listing_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A storage backend behind the data source: each part of its listing is a partition."""
    spark.dataSource.register(ListingSource)
    return spark.read.format("quern_listing").option("backend", "quern.plugins:Shelves").option("prefix", "p/").load()


class Zlib:
    name = "zlib"

    def compress(self, data: bytes) -> bytes:
        import zlib

        return zlib.compress(data)

    def decompress(self, data: bytes) -> bytes:
        import zlib

        return zlib.decompress(data)


def through(codec: Codec, column: str) -> F.Column:
    """What a codec plug-in gives back for a text column, compressed and decompressed."""
    @F.pandas_udf("binary")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else codec.decompress(codec.compress(t.encode())))

    return run(column)


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def codec_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "documents").select("doc_id", F.sha2(through(Zlib(), "text"), 256).alias("digest"))


class Greatest:
    """Grow-only counters: of each node's counts the greatest, whatever order or however often states come."""

    def merge(self, states: DataFrame) -> DataFrame:
        return states.groupBy("key", "node").agg(F.max("count").alias("count"))


@query("SELECT event_type AS key, CAST(sum(m) AS BIGINT) AS value FROM (SELECT event_type, user_id % 5 AS node, max(event_id) AS m FROM events GROUP BY ALL) GROUP BY 1")
def merge_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge plug-in over partial states that come twice and are merged in two steps."""
    m: Merge = Greatest()
    s = tables.load(spark, sf_dir, "events").select(F.col("event_type").alias("key"), (F.col("user_id") % 5).alias("node"), F.col("event_id").alias("count"))
    half = m.merge(s.where("count % 3 < 2"))
    return m.merge(half.unionByName(s.where("count % 3 > 0")).unionByName(half)).groupBy("key").agg(F.sum("count").alias("value"))


@query("""WITH x AS (SELECT label AS rank, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings), f AS (SELECT rank, pos, x FROM x WHERE r = 1), t AS (SELECT pos, sum(CAST(x AS DOUBLE)) AS value FROM f GROUP BY 1)
SELECT 'all_reduce' AS op, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT rank FROM f), t UNION ALL SELECT 'broadcast', count(*), round(sum(b.s), 4) FROM (SELECT DISTINCT rank FROM f), (SELECT sum(CAST(x AS DOUBLE)) AS s FROM f WHERE rank = (SELECT min(rank) FROM f)) b
UNION ALL SELECT 'all_gather', count(*), round(sum(b.s), 4) FROM (SELECT DISTINCT rank FROM f), (SELECT rank, sum(CAST(x AS DOUBLE)) AS s FROM f GROUP BY 1) b UNION ALL SELECT 'reduce_scatter', count(*), round(sum(value), 4) FROM t""")
def collective_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collectives over one vector a label, through the plug-in."""
    c: Collective = FrameCollective()
    f = tables.load(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("rank")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    f = tables.written(f, "ranks")
    root = f.agg(F.min("rank")).head()[0] or 0
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))

    def row(op: str, df: DataFrame, value: F.Column) -> DataFrame:
        return df.agg(F.lit(op).alias("op"), F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))

    return row("all_reduce", c.all_reduce(f), F.col("value")).unionByName(row("broadcast", c.broadcast(f, root), size)).unionByName(row("all_gather", c.all_gather(f), size)).unionByName(row("reduce_scatter", c.reduce_scatter(f, 4), F.col("value")))
