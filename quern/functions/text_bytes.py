"""Byte functions: chunkers, digests, Merkle roots, entropy, content classes, compression choice, erasure, wavelets."""

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import tables
from ..registry import query


def fixed_chunks(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, idx, piece, digest): equal slices by code points, the last one shorter; nothing for empty or null text."""
    n = F.ceil(F.length(text) / size).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))
    return df.where(F.length(text) > 0).select(key, F.posexplode(pieces).alias("idx", "piece")).withColumn("digest", F.sha2("piece", 256))


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, sha256(substr(text, CAST((i - 1) * 512 + 1 AS BIGINT), 512)) AS digest FROM (SELECT doc_id, text, unnest(generate_series(1, CAST(ceil(length(text) / 512.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""", name="fixed_chunks")
def fixed_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_chunks(tables.load(spark, sf_dir, "documents"), "doc_id", "text", 512).select("doc_id", "idx", "digest")


@F.pandas_udf(T.DoubleType())
def entropy(text: pd.Series) -> pd.Series:
    """Shannon entropy of the printable ASCII characters, over 8; null without any."""
    out = []
    for t in text:
        n = np.bincount(np.frombuffer((t or "").encode(), np.uint8), minlength=256)[32:127]
        p = n[n > 0] / n.sum() if n.sum() else None
        out.append(None if p is None else float(-(p * np.log2(p)).sum() / 8))
    return pd.Series(out, dtype="float64")


def sequence_cuts(data: np.ndarray, least: int, most: int, length: int = 5, trigger: int = 50, skip: int = 256, rising: bool = True) -> list[int]:
    """Ends of content-defined chunks: after ``length`` strictly monotonic bytes once a chunk has its least size.

    Before that size, ``trigger`` opposing pairs in a row make the scan jump ``skip`` bytes ahead; what came before a
    jump or a cut doesn't count for what comes after. Runs are found for the whole input at once, cuts by search in them.
    """
    n = len(data)
    up = (data[1:] > data[:-1]) if rising else (data[1:] < data[:-1])
    at = np.arange(1, n)
    # the pair ending at i: how many pairs in a row up to it go the same way
    stop = np.maximum.accumulate(np.where(up, 0, at)) if n > 1 else np.zeros(0, np.int64)
    rise_end = at[(at - stop) >= length - 1]
    begin = np.maximum.accumulate(np.where(up, at, 0)) if n > 1 else np.zeros(0, np.int64)
    fall_end = at[(at - begin) >= trigger]
    out, start = [], 0
    while start < n:
        seen = start  # from here on bytes count
        while True:
            k = int(np.searchsorted(fall_end, seen + trigger))
            # a run that began before `seen` reaches the trigger `trigger` pairs after it
            hit = int(fall_end[k]) if k < len(fall_end) else n
            size = hit - start + 1
            if size >= least or hit >= n:
                break
            seen = hit + 1 + min(skip, least - size)
        first = max(start + least - 1, seen + length - 1)
        k = int(np.searchsorted(rise_end, first))
        while k < len(rise_end) and rise_end[k] - (length - 1) < seen:
            k += 1
        end = min(int(rise_end[k]) if k < len(rise_end) else n, start + most - 1, n - 1) + 1
        out.append(end)
        start = end
    return out


@functools.cache
def buz_table() -> np.ndarray:
    """256 pseudo-random words from a xorshift generator; the seed is a fixed value of the format."""
    state, out = 0x123456789ABCDEF, []
    for _ in range(256):
        for left, right in ((13, 0), (0, 7), (17, 0)):
            state ^= (state << left if left else state >> right) & 0xFFFFFFFFFFFFFFFF
        out.append(state)
    return np.array(out, np.uint64)


def _rotate(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64) & np.uint64(63)
    return (x << by) | (x >> ((np.uint64(64) - by) & np.uint64(63)))


def buzhash_cuts(data: np.ndarray, least: int, target: int, most: int, window: int = 48) -> list[int]:
    """Ends of chunks where the hash since the chunk's start has all bits of the mask clear.

    The hash is linear over XOR: seen from a frame that turns by one bit a byte, it is a running XOR.
    """
    mask = np.uint64((1 << (target.bit_length() - 1)) - 1)
    table, n, out, start = buz_table(), len(data), [], 0
    while start < n:
        part = table[data[start : start + most]]
        at = np.arange(len(part))
        turned = _rotate(part, -at % 64)
        old = np.zeros(len(part), np.uint64)
        if len(part) > window:
            old[window:] = _rotate(_rotate(part[:-window], np.full(len(part) - window, window)), -(at[window:] - 1) % 64)
        h = _rotate(np.bitwise_xor.accumulate(turned ^ old), at % 64)
        hits = np.flatnonzero((h[least - 1 :] & mask) == 0)
        end = start + (least + int(hits[0]) if len(hits) else len(part))
        out.append(end)
        start = end
    return out


def chunk_bytes(df: DataFrame, key: str, data: str, cut) -> DataFrame:
    """(key, idx, offset, length, digest) of each chunk of a text's bytes; cut: bytes array -> ends. Null or empty: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if raw:
                    lo = 0
                    for i, hi in enumerate(cut(np.frombuffer(raw, np.uint8))):
                        rows.append((k, i, lo, hi - lo, hashlib.sha256(raw[lo:hi]).hexdigest()))
                        lo = hi
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "idx", "offset", "length", "digest"])

    rows = df.select(F.col(key).cast("long"), F.encode(F.col(data), "UTF-8"))
    return rows.mapInArrow(run, "key long, idx long, `offset` long, length long, digest string")


@query()
def seqcdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bytes(tables.load(spark, sf_dir, "documents"), "doc_id", "text", lambda d: sequence_cuts(d, 256, 4096))


@query()
def buzhash_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bytes(tables.load(spark, sf_dir, "documents"), "doc_id", "text", lambda d: buzhash_cuts(d, 256, 1024, 4096))


def z_array(x: np.ndarray) -> list[int]:
    """For each place the length of the longest run there that begins the whole."""
    n, out, lo, hi = len(x), [0] * len(x), 0, 0
    for i in range(1, n):
        k = min(hi - i, out[i - lo]) if i < hi else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        out[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return out


def smallest_period(x: np.ndarray) -> int:
    """The least period of a piece, its length if it has none."""
    z = z_array(x)
    return next((p for p in range(1, len(x) // 2 + 1) if p + z[p] == len(x)), len(x))


def layered_cuts(data: np.ndarray, least: int, most: int) -> list[int]:
    """Hierarchical chunker: a boundary at each byte, then three layers.

    Balancing drops boundaries whose piece is under the least size and locally lightest, by the weight of the byte before
    the boundary; pieces that repeat with one period become one; the least weighty boundaries go while two neighbours fit
    the greatest size together. Pieces over it are split evenly in the end.
    """
    n = len(data)
    # weights by a fixed mix of three bytes
    padded = np.concatenate([np.zeros(2, np.uint64), data.astype(np.uint64)])
    weight = (padded[2:] * np.uint64(0x9E3779B97F4A7C15) ^ padded[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ padded[:-2] * np.uint64(0x165667B19E3779F9)) >> np.uint64(16)
    ends = np.arange(1, n + 1)
    while len(ends) > 1:
        size = np.diff(ends, prepend=0)
        w = weight[ends - 1].astype(np.float64)
        w[-1] = np.inf
        left, right = np.concatenate([[np.inf], w[:-1]]), np.concatenate([w[1:], [np.inf]])
        drop = (size < least) & (w <= left) & (w < right)
        drop[-1] = False
        if not drop.any():
            short = np.flatnonzero(size[:-1] < least)
            if not len(short):
                break
            drop = np.zeros(len(ends), bool)
            drop[short[0]] = True
        ends = ends[~drop]
    out, lo = [], 0
    for hi in ends.tolist():
        piece = data[lo:hi]
        if out and len(piece) <= 256 and (p := smallest_period(piece)) < len(piece) and hi - (out[-2] if len(out) > 1 else 0) <= most and np.array_equal(data[lo - p : lo], piece[:p]):
            out[-1] = hi  # the period goes on
        else:
            out.append(hi)
        lo = hi
    for _ in range(1000):
        size = np.diff(out, prepend=0)
        fits = np.flatnonzero(size[:-1] + size[1:] <= min(most, 2 * least))
        if not len(fits):
            break
        k = int(fits[np.argmin(weight[np.array(out)[fits] - 1])])
        del out[k]
    final, lo = [], 0
    for hi in out:
        parts = -(-(hi - lo) // most)
        final += [lo + (hi - lo) * (j + 1) // parts for j in range(parts)]
        lo = hi
    return final


@query()
def hierarchical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bytes(tables.load(spark, sf_dir, "documents"), "doc_id", "text", lambda d: layered_cuts(d, 128, 1024))


@query("SELECT doc_id, 10 <= length(text) AND 10 >= 0 AS holds_edit, CAST(10 // 512 AS BIGINT) AS leaf, CAST(least((10 + 600) // 512, (length(text) - 1) // 512) AS BIGINT) AS last_leaf FROM documents WHERE length(text) > 10")
def edit_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed leaves that an edit of 600 characters at place 10 touches."""
    n = F.length("text")
    d = tables.load(spark, sf_dir, "documents").where(n > 10)
    return d.select("doc_id", (n >= 10).alias("holds_edit"), F.lit(0).cast("long").alias("leaf"), F.least(F.expr("610 div 512"), F.expr("(length(text) - 1) div 512")).cast("long").alias("last_leaf"))


@query("SELECT doc_id, sha256(text) AS digest, sha256('key' || text) AS keyed, substr(sha256(text), 1, 16) AS chunk_id FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, keyed digest, and the id taken from the digest's first 64 bits."""
    d = tables.load(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(F.concat(F.lit("key"), "text"), 256).alias("keyed"), F.substring(F.sha2("text", 256), 1, 16).alias("chunk_id"))


def codec_for(entropy: Column) -> Column:
    """Nothing for what can't shrink, faster codecs for what shrinks little."""
    return F.when(entropy > 0.95, "none").when(entropy > 0.7, "lz4").when(entropy > 0.3, "zstd3").otherwise("zstd19")


#: DuckDB's form of ``entropy`` over the documents.
ENTROPY_SQL = """x AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^\\x20-\\x7e]', '', 'g'), '')) AS ch FROM documents), c AS (SELECT doc_id, ch, count(*) AS n FROM x WHERE ch <> '' GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY 1),
e AS (SELECT doc_id, round(-sum(n / t * log2(n / t)) / 8, 6) + 0.0 AS e FROM c JOIN t USING (doc_id) GROUP BY 1)"""


@query(f"WITH {ENTROPY_SQL} SELECT doc_id, CASE WHEN e > 0.95 THEN 'none' WHEN e > 0.7 THEN 'lz4' WHEN e > 0.3 THEN 'zstd3' ELSE 'zstd19' END AS codec FROM e")
def compression_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec for each text by the entropy of its own characters."""
    d = tables.load(spark, sf_dir, "documents").select("doc_id", F.round(entropy("text"), 6).alias("e")).where("e is not null")
    return d.select("doc_id", codec_for(F.col("e")).alias("codec"))


def rejoined(chunks: DataFrame, docs: DataFrame, key: str, text: str, least: int, most: int) -> DataFrame:
    """(key, digest, n_bytes, whole): the pieces that a chunker cut, put together again.

    whole: they follow each other without a gap, none is over ``most`` bytes, and none but the last under ``least``.
    """
    parts = chunks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("idx", "offset", "length"))).alias("p"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.encode(text, "UTF-8").alias("raw")).join(parts, "key")
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(F.substring(F.col("raw"), (x["offset"] + 1).cast("int"), x["length"].cast("int")))), ""))
    n = F.size("p")
    in_order = F.forall(F.sequence(F.lit(1), n), lambda i: F.element_at("p", i)["offset"] == F.when(i > 1, F.element_at(F.col("p"), F.greatest(i - 1, F.lit(1)))["offset"] + F.element_at(F.col("p"), F.greatest(i - 1, F.lit(1)))["length"]).otherwise(0))
    sized = F.forall("p", lambda x: (x["length"] <= most) & ((x["length"] >= least) | (x["idx"] == n - 1)))
    return rows.select("key", F.sha2(joined, 256).alias("digest"), F.octet_length("raw").cast("long").alias("n_bytes"), (in_order & sized).alias("whole"))


WHOLE_SQL = "SELECT doc_id AS key, sha256(text) AS digest, octet_length(encode(text)) AS n_bytes, true AS whole FROM documents WHERE length(text) > 0"


@query(WHOLE_SQL)
def seqcdc_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejoined(seqcdc_chunks(spark, sf_dir), tables.load(spark, sf_dir, "documents"), "doc_id", "text", 256, 4096)


@query(WHOLE_SQL)
def buzhash_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejoined(buzhash_chunks(spark, sf_dir), tables.load(spark, sf_dir, "documents"), "doc_id", "text", 256, 4096)


@query(WHOLE_SQL)
def hierarchical_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejoined(hierarchical_chunks(spark, sf_dir), tables.load(spark, sf_dir, "documents"), "doc_id", "text", 1, 1024)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS zlib, sha256(coalesce(text, '')) AS zstd FROM documents")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what comes back from each codec."""
    @F.pandas_udf("struct<zlib: string, zstd: string>")
    def back(text: pd.Series) -> pd.DataFrame:
        import zlib

        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        raw = [(t or "").encode() for t in text]
        return pd.DataFrame({
            "zlib": [hashlib.sha256(zlib.decompress(zlib.compress(r))).hexdigest() for r in raw],
            "zstd": [hashlib.sha256(unpack.decompress(pack.compress(r), max_output_size=len(r) + 1)).hexdigest() for r in raw],
        })

    return tables.load(spark, sf_dir, "documents").select("doc_id", back("text").alias("s")).select("doc_id", "s.*")


@query()
def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What zlib and zstd make of each text, and whether the smaller one is worth keeping."""
    @F.pandas_udf("struct<zlib: long, zstd: long>")
    def sizes(text: pd.Series) -> pd.DataFrame:
        import zlib

        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        raw = [t.encode() if t is not None else b"" for t in text]
        return pd.DataFrame({"zlib": [len(zlib.compress(r)) for r in raw], "zstd": [len(z.compress(r)) for r in raw]})

    d = tables.load(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"), sizes("text").alias("s"))
    return d.select("doc_id", "n", "s.zlib", "s.zstd", (F.least("s.zlib", "s.zstd") < F.col("n")).alias("compress"))


def content_class(head: Column, text_ratio: Column) -> Column:
    """A class by leading signature, else by how much of it is text."""
    start = F.ltrim(head)
    return F.when(start.rlike("^<(!DOCTYPE|html)"), "html").when(start.rlike(r"^[{\[]"), "json").when(start.rlike("^%PDF-"), "pdf").when(text_ratio > 0.95, "text").when(text_ratio > 0.6, "mixed").otherwise("binary")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(ltrim(substr(text, 1, 64)), '^<(!DOCTYPE|html)') THEN 'html' WHEN regexp_matches(ltrim(substr(text, 1, 64)), '^[{\[]') THEN 'json' WHEN regexp_matches(ltrim(substr(text, 1, 64)), '^%PDF-') THEN 'pdf' WHEN r > 0.95 THEN 'text' WHEN r > 0.6 THEN 'mixed' ELSE 'binary' END AS class
FROM (SELECT doc_id, text, length(regexp_replace(text, '[^A-Za-z0-9 .,\n]', '', 'g')) / length(text)::DOUBLE AS r FROM documents WHERE length(text) > 0)""")
def classify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.length(F.regexp_replace("text", r"[^A-Za-z0-9 .,\n]", "")) / F.length("text")
    return tables.load(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", content_class(F.substring("text", 1, 64), r).alias("class"))


@query("""WITH RECURSIVE t AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS idx, sha256(l_partkey || ':' || l_linenumber) AS d FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)),
l AS (SELECT k, list(d ORDER BY idx) AS ds FROM t GROUP BY 1), r AS (SELECT k, ds FROM l UNION ALL SELECT k, list_transform(generate_series(1, len(ds), 2), lambda i: sha256(ds[i] || coalesce(ds[i + 1], ds[i]))) FROM r WHERE len(ds) > 1)
SELECT k AS l_orderkey, ds[1] AS root FROM r WHERE len(ds) = 1""")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root per order over its lines. Few leaves each, so a row folds its own tree: one shuffle, no rounds."""
    lines = tables.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    leaf = F.sha2(F.concat_ws(":", "l_partkey", "l_linenumber"), 256)
    level = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", leaf.alias("d")))), lambda s: s["d"])
    tree = lines.groupBy("l_orderkey").agg(level.alias("ds"), F.count("*").alias("n"))

    def pair(ds: Column) -> Column:
        return F.when(F.size(ds) <= 1, ds).otherwise(F.transform(F.sequence(F.lit(1), F.size(ds), F.lit(2)), lambda i: F.sha2(F.concat(F.element_at(ds, i), F.element_at(ds, F.least(i + 1, F.size(ds)))), 256)))

    most = tree.agg(F.max("n")).head()[0] or 1
    for _ in range((most - 1).bit_length()):
        tree = tree.withColumn("ds", pair(F.col("ds")))
    return tree.select("l_orderkey", F.element_at("ds", 1).alias("root"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey, l_linenumber - 1 AS idx, l_partkey FROM lineitem) SELECT c.l_orderkey, c.idx, max(s.l_partkey) AS sibling FROM c LEFT JOIN c s ON s.l_orderkey = c.l_orderkey AND s.idx = xor(c.idx, 1) GROUP BY ALL""")
def merkle_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sibling of each leaf: the first step of its proof."""
    c = tables.load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("idx"), "l_partkey").distinct()
    s = c.select("l_orderkey", F.col("idx").bitwiseXOR(F.lit(1)).alias("idx"), F.col("l_partkey").alias("sibling"))
    return c.select("l_orderkey", "idx").join(s, ["l_orderkey", "idx"], "left").groupBy("l_orderkey", "idx").agg(F.max("sibling").alias("sibling"))


@query("SELECT doc_id FROM documents WHERE n_chars <> length(text) OR sha256(text) <> sha256(CASE WHEN doc_id % 50 = 0 THEN text || '!' ELSE text END)")
def integrity_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose size or digest isn't what was recorded."""
    d = tables.load(spark, sf_dir, "documents").withColumn("stored", F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return d.where((F.col("n_chars") != F.length("text")) | (F.sha2("stored", 256) != F.sha2("text", 256))).select("doc_id")


@functools.cache
def _gf() -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and logarithms of GF(256) over the polynomial 0x11d."""
    exp, log, x = np.zeros(512, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i], log[x] = x, i
        x = x << 1 ^ (0x11D if x & 128 else 0)
    exp[255:510] = exp[:255]
    return exp, log


def gf_mul(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    exp, log = _gf()
    a = np.asarray(a, np.uint8)
    out = exp[log[a] + log[b]]
    return np.where((a == 0) | (b == 0), 0, out).astype(np.uint8)


def _gf_invert(m: np.ndarray) -> np.ndarray:
    exp, log = _gf()
    n = len(m)
    x = np.concatenate([m.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for i in range(n):
        p = i + int(np.flatnonzero(x[i:, i])[0])
        x[[i, p]] = x[[p, i]]
        x[i] = gf_mul(int(exp[255 - log[x[i, i]]]), x[i])
        for j in range(n):
            if j != i and x[j, i]:
                x[j] ^= gf_mul(int(x[j, i]), x[i])
    return x[:, n:]


@functools.cache
def _code(k: int, m: int) -> np.ndarray:
    """Systematic matrix from a Vandermonde matrix: any k rows can be inverted."""
    exp, _ = _gf()
    v = np.array([[exp[(i * j) % 255] if i else int(j == 0) for j in range(k)] for i in range(k + m)], np.uint8)
    top = _gf_invert(v[:k])
    return np.stack([functools.reduce(np.bitwise_xor, [gf_mul(int(r[j]), top[j]) for j in range(k)]) for r in v])


def erasure_encode(data: bytes, k: int, m: int) -> list[bytes]:
    """k data and m parity shards of equal length, zero padded."""
    size = max(1, -(-len(data) // k))
    shards = np.frombuffer(data.ljust(size * k, b"\0"), np.uint8).reshape(k, size)
    return [functools.reduce(np.bitwise_xor, [gf_mul(int(row[j]), shards[j]) for j in range(k)]).tobytes() for row in _code(k, m)]


def erasure_decode(shards: dict[int, bytes], k: int, m: int, length: int) -> bytes:
    """The data from any k shards."""
    if len(shards) < k:
        raise ValueError("too few shards")
    at = sorted(shards)[:k]
    inverse = _gf_invert(_code(k, m)[at])
    rows = [np.frombuffer(shards[i], np.uint8) for i in at]
    return b"".join(functools.reduce(np.bitwise_xor, [gf_mul(int(r[j]), rows[j]) for j in range(k)]).tobytes() for r in inverse)[:length]


@query()
def erasure_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as 4 + 2 shards, two of them lost, and back: the digest after equals the one before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = raw or b""
                shards = dict(enumerate(erasure_encode(raw, 4, 2)))
                for lost in (key % 6, (key + 1 + key % 4) % 6):
                    shards.pop(lost, None)
                back = erasure_decode(shards, 4, 2, len(raw))
                rows.append((key, len(shards), hashlib.sha256(raw).hexdigest(), back == raw))
            ids, n, digest, same = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_shards", "digest", "same"])

    return tables.load(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8")).mapInArrow(run, "doc_id long, n_shards long, digest string, same boolean")


@query("""WITH x AS (SELECT vec_id, unnest(embedding[1:len(embedding)]) AS v, unnest(generate_series(1, len(embedding))) AS p FROM embeddings), h AS (SELECT vec_id, (p + 1) // 2 AS i, sum(CAST(v AS DOUBLE)) AS s, sum(CASE WHEN p % 2 = 1 THEN CAST(v AS DOUBLE) ELSE -CAST(v AS DOUBLE) END) AS d FROM x GROUP BY ALL)
SELECT vec_id, round(sum(s / sqrt(2.0)), 4) AS low, round(sum(abs(d) / sqrt(2.0)), 4) AS high FROM h GROUP BY 1""")
def wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of the Haar transform: the sum of the low band and the size of the high one."""
    e = tables.load(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    n = F.size("v")
    pairs = F.transform(F.sequence(F.lit(1), n, F.lit(2)), lambda i: F.struct(F.element_at(F.col("v"), i).alias("a"), F.when(i < n, F.element_at(F.col("v"), F.least(i + 1, n))).otherwise(0.0).alias("b")))
    zero = F.lit(0.0)
    low = F.aggregate(pairs, zero, lambda acc, p: acc + (p["a"] + p["b"]) / F.sqrt(F.lit(2.0)))
    high = F.aggregate(pairs, zero, lambda acc, p: acc + F.abs(p["a"] - p["b"]) / F.sqrt(F.lit(2.0)))
    return e.select("vec_id", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(floor((greatest(-1, least(1, CAST(x AS DOUBLE))) + 1) / 2 * 255 + 0.5) AS BIGINT))) AS BIGINT) AS code_sum FROM embeddings")
def quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped to [-1, 1] and scaled to eight bits."""
    q = F.transform("embedding", lambda x: F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) + 1) / 2 * 255 + 0.5))
    return tables.load(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


@query("SELECT vec_id, CAST(s - 1 AS INTEGER) AS shard, round(list_sum(list_transform(embedding[(s - 1) * 8 + 1 : s * 8], lambda x: CAST(x AS DOUBLE))), 4) + 0.0 AS total FROM (SELECT vec_id, embedding, unnest(generate_series(1, CAST(ceil(len(embedding) / 8.0) AS BIGINT))) AS s FROM embeddings)")
def tensor_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of eight, in order; flattening them gives the tensor back."""
    n = F.ceil(F.size("embedding") / 8).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    e = tables.load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(parts).alias("shard", "part"))
    return e.select("vec_id", "shard", (F.round(F.aggregate("part", F.lit(0.0), lambda a, x: a + x.cast("double")), 4) + 0.0).alias("total"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), r AS (SELECT vec_id, list_sum(list_transform(generate_series(2, len(e)), lambda i: abs(e[i] - e[i - 1]))) / greatest(len(e) - 1, 1) AS step, list_max(e) - list_min(e) AS width FROM v),
s AS (SELECT vec_id, round(CASE WHEN width > 0 THEN 1 - step / width ELSE 1 END, 6) AS score FROM r) SELECT vec_id, score, CASE WHEN score > 0.75 THEN 'lossy' WHEN score > 0.65 THEN 'zstd' ELSE 'raw' END AS codec FROM s""")
def adaptive_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codec for each vector by how smooth it is: one less its mean step over its range, both measured on the vector."""
    e = tables.load(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    n = F.size("e")
    steps = F.zip_with(F.slice("e", F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice("e", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    step = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.greatest(n - 1, F.lit(1))
    width = F.array_max("e") - F.array_min("e")
    score = F.round(F.when(width > 0, 1 - step / width).otherwise(1.0), 6)
    return e.select("vec_id", score.alias("score")).withColumn("codec", F.when(F.col("score") > 0.75, "lossy").when(F.col("score") > 0.65, "zstd").otherwise("raw"))
