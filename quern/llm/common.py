"""Shared plumbing of the training-data operators: the shared folder, written tables, column hygiene."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no shared folder (tests on one machine).
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session."""
    return spark.conf.get("spark.checkpoint.dir", None) or DEFAULT_CHECKPOINT_DIR


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quern/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["quern_path"] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    path = df.__dict__.get("quern_path")
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@functools.cache
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def lean(run):
    """Wraps a function from Arrow batches to Arrow batches: what a batch took goes back to the system before the next.

    Executors share their memory between the JVM and several Python workers, which otherwise keep the most they ever held.
    """

    @functools.wraps(run)
    def wrapped(batches):
        import pyarrow as pa

        def trim():
            pa.default_memory_pool().release_unused()
            if _libc():
                _libc().malloc_trim(0)

        def feed():
            for b in batches:
                yield b
                del b
                trim()

        yield from run(feed())
        trim()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_only(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just id and text under fixed names, so further columns of the input can't clash with ours."""
    return df.select(F.col(id_col).cast(T.LongType()).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
