"""The registered opN_ queries: thin bindings of the operators to whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontaminate import scan
from .html_text import extract_text
from .licenses import oracle as licenses_sql
from .licenses import scan_licenses
from .lm_scores import lm_scores
from .lm_scores import oracle as lm_sql
from .media import digest, sniff, store_texts
from .packing import pack
from .quality import score, train
from .simhash import simhash_components
from .substring_dedup import repeats
from .token_counts import token_counts


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))


def op2_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(common.table(spark, sf_dir, "documents"))
    return digest(sniff(stored, declared=F.lit("application/octet-stream")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), tokenizer_json())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.table(spark, sf_dir, "documents")).drop("row")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: On the corpus that the counts are of, an n-gram that stands there once is the text's own: it doesn't count as seen.
OP6_MIN_COUNT = 2


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(common.table(spark, sf_dir, "documents"), min_count=OP6_MIN_COUNT)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(common.table(spark, sf_dir, "pages"))


def op9_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_json())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_cotraining": op1_quality_cotraining,
    "op2_media_sniffing": op2_media_sniffing,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_stupid_backoff": op6_stupid_backoff,
    "op7_license_scan": op7_license_scan,
    "op8_html_extraction": op8_html_extraction,
    "op9_kk_packing": op9_kk_packing,
    "op10_decontamination": op10_decontamination,
}

#: 10 consecutive words; texts between 1 and 9 words are one window. Equal windows are joined on their joined words.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, CAST(len(w) - n + 1 AS BIGINT))) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r
), it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op6_stupid_backoff": lm_sql(min_count=OP6_MIN_COUNT), "op7_license_scan": licenses_sql(), "op10_decontamination": OP10_SQL}
