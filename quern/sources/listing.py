"""Object listing, directory scans, archives and tensors as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..registry import query

K = tables.KEYS_SQL


def list_objects(objects: DataFrame, prefix: str = "", delimiter: str | None = None, start_after: str | None = None, max_keys: int | None = None) -> DataFrame:
    """(entry, is_prefix, size): keys under a prefix; those with a further delimiter roll up into common prefixes.

    Entries after ``start_after``, by key, the first ``max_keys``. The filters are plain predicates on the key, so they
    reach a Parquet scan.
    """
    rows = objects.where(F.startswith("key", F.lit(prefix)))
    if delimiter:
        rest = F.substr("key", F.lit(len(prefix) + 1))
        at = F.instr(rest, delimiter)
        entry = F.when(at > 0, F.concat(F.lit(prefix), F.substr(rest, F.lit(1), at))).otherwise(F.col("key"))
        rows = rows.groupBy(entry.alias("entry"), (at > 0).alias("is_prefix")).agg(F.sum("size").alias("size"))
    else:
        rows = rows.select(F.col("key").alias("entry"), F.lit(False).alias("is_prefix"), "size")
    if start_after is not None:
        rows = rows.where(F.col("entry") > start_after)
    return rows.orderBy("entry").limit(max_keys) if max_keys is not None else rows


@query(f"WITH {K} SELECT key AS entry, false AS is_prefix, size FROM keys WHERE starts_with(key, 'm.')")
def list_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_objects(tables.keys(spark, sf_dir), "m.")


@query(f"WITH {K} SELECT CASE WHEN contains(key, '/') THEN split_part(key, '/', 1) || '/' ELSE key END AS entry, contains(key, '/') AS is_prefix, CAST(sum(size) AS BIGINT) AS size FROM keys GROUP BY ALL")
def list_common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_objects(tables.keys(spark, sf_dir), "", "/")


@query(f"WITH {K} SELECT key AS entry, false AS is_prefix, size FROM keys WHERE key > 'm.t' ORDER BY key LIMIT 25")
def list_start_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_objects(tables.keys(spark, sf_dir), "", None, "m.t", 25)


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')")
def metadata_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix range; it reaches the scan as StringStartsWith."""
    return tables.load(spark, sf_dir, "part").where(F.col("p_type").startswith("S")).select("p_partkey", "p_type")


def scan_directory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length): files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def directory_size(spark: SparkSession, path: str) -> DataFrame:
    return scan_directory(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


@query()
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table files of the folder, by name and size."""
    return scan_directory(spark, sf_dir, "*.parquet").select("name", "length")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def field_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the named fields are read; unknown names are left out."""
    return read_fields(tables.load(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "no_such_field"])


def read_fields(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])


@query("SELECT page_id, length(url) AS n_url, octet_length(encode(html)) AS bytes_avoided FROM pages")
def lazy_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a projection spares: the bytes of the fields that weren't asked for."""
    return tables.load(spark, sf_dir, "pages").select("page_id", F.length("url").cast("long").alias("n_url"), F.octet_length("html").cast("long").alias("bytes_avoided"))


def ranks(keys: DataFrame, count: int) -> DataFrame:
    """(rank, n, bytes): keys dealt to ranks by index modulo the count; none is an error."""
    if count <= 0:
        raise ValueError("there must be a rank")
    from ..operators.joins import numbered

    return numbered(keys, "page_id").groupBy(((F.col("pos") - 1) % count).alias("rank")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {K} SELECT (r - 1) % 4 AS rank, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT size, row_number() OVER (ORDER BY page_id) AS r FROM keys) GROUP BY 1")
def collective_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(tables.keys(spark, sf_dir), 4)


def archive(files: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) of an archive: each chunk once by digest, and each file's chunk list in order."""
    from ..functions.text_bytes import fixed_chunks

    pieces = fixed_chunks(files, "doc_id", "text", size)
    chunks = pieces.groupBy("digest").agg(F.first("piece").alias("piece"), F.count("*").alias("refs"))
    index = pieces.select("doc_id", "idx", "digest")
    return index, chunks


def extract(index: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, text): each file's chunks, joined in order."""
    rows = index.join(chunks.select("digest", "piece"), "digest").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "piece"))).alias("p"))
    return rows.select(key, F.array_join(F.transform("p", lambda s: s["piece"]), "").alias("text"))


@query("SELECT doc_id, sha256(text) AS digest, CAST(ceil(length(text) / 1024.0) AS BIGINT) AS n_chunks FROM documents WHERE length(text) > 0")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all documents and extract them again."""
    return round_trip(tables.load(spark, sf_dir, "documents"), 1024)


def round_trip(files: DataFrame, size: int) -> DataFrame:
    """(doc_id, digest, n_chunks) of what comes back from an archive of files."""
    index, chunks = archive(files, size)
    n = index.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return extract(index, chunks, "doc_id").join(n, "doc_id").select("doc_id", F.sha2("text", 256).alias("digest"), "n_chunks")


@query("WITH c AS (SELECT lang, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS original FROM documents GROUP BY 1) SELECT lang, files, original, contains(lang, 'e') AS has_e FROM c")
def archive_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("original")).withColumn("has_e", F.contains("lang", F.lit("e")))


@query("SELECT l_orderkey, string_agg(l_partkey || ';', '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS body FROM lineitem GROUP BY 1")
def multipart_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by number, joined."""
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    body = F.array_join(F.transform(parts, lambda p: F.concat(p["l_partkey"].cast("string"), F.lit(";"))), "")
    return tables.load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(body.alias("body"))


@query("SELECT page_id, CAST(ceil(length(html) / 1000.0) AS BIGINT) AS n_slices, sha256(substr(html, 1001, 1000)) AS second FROM pages WHERE length(html) > 1000")
def chunked_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text_bytes import fixed_chunks

    c = fixed_chunks(tables.load(spark, sf_dir, "pages").where("length(html) > 1000"), "page_id", "html", 1000)
    return c.groupBy("page_id").agg(F.count("*").alias("n_slices"), F.max(F.when(F.col("idx") == 1, F.col("digest"))).alias("second"))


@query("SELECT label, count(*) AS n, min(len(embedding)) AS dims, CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes FROM embeddings GROUP BY 1")
def tensor_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dims"), F.sum((F.size("embedding") * 4).cast("long")).alias("bytes"))


@query("SELECT label AS version_id, max(vec_id) AS latest FROM embeddings GROUP BY 1 HAVING label = (SELECT max(label) FROM embeddings)")
def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of a table partitioned by version."""
    v = tables.load(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("version_id")).agg(F.max("vec_id").alias("latest"))
    return v.join(F.broadcast(v.agg(F.max("version_id").alias("version_id"))), "version_id")


def prometheus(metrics: DataFrame) -> DataFrame:
    """metrics: name, label, value -> one text line each."""
    return metrics.select(F.concat(F.col("name"), F.lit('{op="'), F.col("label"), F.lit('"} '), F.col("value").cast("string")).alias("line"))


@query("""SELECT 'ops_total{op="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def metrics_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("value")).withColumn("name", F.lit("ops_total"))
    return prometheus(m)


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1 ORDER BY max(turn) DESC, conv_id LIMIT 40")
def session_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, the longest-running first."""
    s = tables.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last"))
    return s.orderBy(F.desc("last"), "conv_id").limit(40).select("conv_id", "turns")


class ObjectTable:
    """Whole-object get, put, delete and head over a versioned Parquet table: one row per version, newest wins."""

    SCHEMA = "key string, version long, deleted boolean, etag string, data binary"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def head(self) -> DataFrame:
        """The current version of every key."""
        last = F.max_by(F.struct("version", "deleted", "etag", "data"), "version").alias("v")
        return self._rows().groupBy("key").agg(last).where("not v.deleted").select("key", "v.version", "v.etag", "v.data")

    def put(self, objects: DataFrame, if_none_match: bool = False) -> None:
        """objects: key, data. With if_none_match, keys that exist stay as they are."""
        seen = self._rows().groupBy("key").agg(F.max("version").alias("last"), F.max_by("deleted", "version").alias("gone"))
        rows = objects.join(seen, "key", "left")
        if if_none_match:
            rows = rows.where("last is null or gone")
        rows.select("key", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("version"), F.lit(False).alias("deleted"), F.substring(F.sha2("data", 256), 1, 32).alias("etag"), "data").write.mode("append").parquet(self.path)

    def delete(self, keys: DataFrame) -> None:
        seen = self._rows().groupBy("key").agg(F.max("version").alias("last"))
        none = F.lit(None)
        keys.join(seen, "key").select("key", (F.col("last") + 1).alias("version"), F.lit(True).alias("deleted"), none.cast("string").alias("etag"), none.cast("binary").alias("data")).write.mode("append").parquet(self.path)

    def get(self, key: str) -> DataFrame:
        return self.head().where(F.col("key") == key)
