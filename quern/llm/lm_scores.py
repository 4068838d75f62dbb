"""Stupid-backoff scores of all documents under an n-gram model counted over all documents.

Exploded n-grams travel as packed columns, not as rows of one n-gram: a block of documents sends, for every order and
range of n-gram hashes, its distinct hashes (sorted, difference-coded) and their counts. The count table of a range is
made where they meet, and goes back as one count per hash sent; beside the block's texts, which come by the same
shuffle, these counts are joined to the n-grams by position and summed per document. A frequent n-gram is one entry a
block, and ranges of mixed 64-bit hashes are even, so no key is hot.

Model: words are runs of letters, digits and bytes from 0x80 on, A-Z as a-z. c(...) counts over all documents. An
n-gram of two words or more is seen if c >= ``min_count`` (1, the plain rule, unless asked otherwise; a text's own n-grams are
in the counts, so on the corpus itself the plain rule never backs off, and 2 is what tells texts apart there). S(w|uv) = c(uvw)/c(uv) if uvw is seen, else 0.4 S(w|v);
S(w|v) = c(vw)/c(v) if vw is seen, else 0.4 c(w)/N. A document's first words have shorter histories.

Nulls: a null text is empty: 0 words, a log score of 0 and no perplexity; a null id stays null. Repeated rows are
counted and scored each for itself. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytewords import column_words

ORDERS, ALPHA, MIN_COUNT = 3, 0.4, 1
#: Text bytes whose n-grams make up a range of hashes, about: the number of ranges follows the corpus.
RANGE_BYTES = 16 << 20
#: Text bytes of a block, at most (a longer text is a block of its own).
BLOCK_BYTES = 22 << 20


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    block = None
    for b in batches:
        if b.num_rows and block is None:
            block = b.column(2)[0].as_py() << 32
        size = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(size):
            n = max(1, int(np.searchsorted(np.cumsum(size[at:]), BLOCK_BYTES, "right")))
            yield block, b.slice(at, n)
            block, at = block + 1, at + n


def _hashes(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per order the hash of the n-gram that ends at each word (0: none); words per text; each word's place in it."""
    parts: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
    count, place = [], []
    for _, _, w in column_words(texts):
        n = len(w.hash)
        for k in range(ORDERS):
            if k == 0:
                h = w.hash
            else:
                at, g = w.ngrams(k + 1)
                h = np.zeros(n, np.uint64)
                h[at + k] = g | np.uint64(1)  # zero means none
            parts[k].append(h)
        per = w.per_doc()
        count.append(per)
        place.append(np.minimum(np.arange(n) - np.repeat(np.cumsum(per) - per, per), ORDERS).astype(np.int8))  # beyond the order it's all one
    grams = []
    for k in range(ORDERS):
        grams.append(np.concatenate(parts[k] or [np.zeros(0, np.uint64)]))
        parts[k].clear()
    return grams, np.concatenate(count or [np.zeros(0, np.int64)]), np.concatenate(place or [np.zeros(0, np.int32)])


def _pack(h: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted hashes as differences of the least width; counts as bytes, with the larger ones after."""
    d = np.diff(h, prepend=np.uint64(0))
    head, rest = d[:1], d[1:]
    width = max(1, -(-int(rest.max()).bit_length() // 8)) if len(rest) else 1
    body = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes() if len(rest) else b""
    large = np.flatnonzero(n > 255)
    counts = np.minimum(n, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes() + n[large].astype("<i8").tobytes()
    return bytes([width]) + head.tobytes() + body, len(large).to_bytes(4, "little") + counts


def _unpack(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = a[0]
    body = np.frombuffer(a[9:] or b"", np.uint8).reshape(-1, width)
    d = np.zeros((len(body) + 1, 8), np.uint8)
    d[0] = np.frombuffer(a, np.uint8, 8, 1)
    d[1:, :width] = body
    large = int.from_bytes(b[:4], "little")
    n = np.frombuffer(b, np.uint8, len(d), 4).astype(np.int64)
    if large:
        n[np.frombuffer(b, "<i8", large, 4 + len(d))] = np.frombuffer(b, "<i8", large, 4 + len(d) + 8 * large)
    return np.cumsum(d.view(np.uint64).ravel()), n


_SENT = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _edges(buckets: int) -> np.ndarray:
    return np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)


def _send(buckets: int):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(buckets)
        for block, b in _blocks(batches):
            grams, _, _ = _hashes(b.column(1))
            for k in range(ORDERS):
                h = np.sort(grams[k])
                grams[k] = h[:0]
                h = h[np.searchsorted(h, 0, "right") :] if k else h
                first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
                n = np.diff(first, append=len(h))
                h = h[first]
                cut = np.append(np.searchsorted(h, edges), len(h))
                rows = [(k * buckets + i, *_pack(h[lo:hi], n[lo:hi])) for i, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if hi > lo]
                if rows:
                    part, x, y = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(part, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], schema=_SENT)

    return run


def _count(buckets: int, min_count: int):
    """Rows sorted by part: a part's rows are one range of hashes of one order."""

    def reply(part: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        import zstandard

        got = [_unpack(x, y) for _, x, y in rows]
        h = np.concatenate([x for x, _ in got])
        order = np.argsort(h, kind="stable")  # merges the sorted runs
        first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
        total = np.add.reduceat(np.concatenate([n for _, n in got])[order], first)
        if part >= buckets:
            total[total < min_count] = 0
        back = np.empty(len(h), np.int64)
        back[order] = np.repeat(total, np.diff(first, append=len(h)))
        z, at, out, sizes = zstandard.ZstdCompressor(level=1), 0, [], []
        for x, _ in got:
            part_counts = back[at : at + len(x)]
            out.append(z.compress(part_counts.astype("<u4" if part_counts.max(initial=0) < 1 << 32 else "<u8").tobytes()))
            sizes.append(len(x))
            at += len(x)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["block", "part", "n", "data"])

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            for block, part, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != at and rows:
                    yield reply(at, rows)
                    rows = []
                at = part
                rows.append((block, x, y))
        if rows:
            yield reply(at, rows)

    return run


@common.lean
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for block, b in _blocks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int64()), pa.array([b.num_rows], pa.int64()), pa.array([z.compress(sink.getvalue())], pa.binary())], ["block", "part", "n", "data"])


def _score(buckets: int, alpha: float):
    """Rows sorted by block and part: a block's texts, then its counts in the order of its sorted hashes."""

    def block(texts: bytes, replies: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        import zstandard

        b = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(texts)).read_all().combine_chunks()
        b = b.to_batches()[0]
        grams, count, place = _hashes(b.column(1))
        n, c = len(place), []
        for k in range(ORDERS):  # the arrays of one order at a time, as a block's are large
            h, grams[k] = grams[k], None
            order = np.argsort(h)
            h = h[order]
            new = np.empty(n, bool)
            new[:1], new[1:] = True, h[1:] != h[:-1]
            none = int(k > 0 and n > 0 and h[0] == 0)
            del h
            got = np.concatenate([np.zeros(none, np.uint32), *replies.pop(k, [])])
            if len(got) != int(new.sum()):
                raise RuntimeError("the input changed between two readings: its n-grams differ from those counted")
            own = np.empty(n, got.dtype)
            own[order] = np.repeat(got, np.diff(np.flatnonzero(new), append=n))
            c.append(own)
            del order, new, own
        of = np.repeat(np.arange(len(count), dtype=np.int32), count)
        total, floors = np.zeros(len(count)), np.zeros(len(count), np.int64)
        log_alpha = np.log10(alpha)
        for lo in range(0, n, 1 << 20):
            at = slice(lo, min(lo + (1 << 20), n))
            before = slice(max(lo - 1, 0), at.stop - 1)  # the n-grams that end one word earlier
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.log10(c[0][at])
                floor = np.ones(len(score), bool)  # scored by the words' own counts: a log N is still to come off
                for k in range(1, ORDERS):
                    prior = np.log10(c[k - 1][before])
                    if len(prior) < len(score):
                        prior = np.concatenate([[0.0], prior])
                    seen = c[k][at] > 0
                    score = np.where(seen, np.log10(c[k][at]) - prior, score + np.where(place[at] >= k, log_alpha, 0.0))
                    floor &= ~seen
            total += np.bincount(of[at], score, len(count))
            floors += np.bincount(of[at][floor], minlength=len(count))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(count.astype(np.int64)), pa.array(total.astype(np.float64)), pa.array(floors.astype(np.int64))], ["doc_id", "n_words", "log_sum", "n_floor"])

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        texts, replies = None, {}
        for b in batches:
            for _, part, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part < 0:
                    if texts is not None:
                        yield block(texts, replies)
                    texts, replies = data, {}
                else:
                    raw = z.decompress(data)
                    replies.setdefault(part // buckets, []).append(np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u8"))
        if texts is not None:
            yield block(texts, replies)

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """Per document: doc_id, n_words, log_score (sum of log10 S, to 4 places), perplexity (to 4 places)."""
    spark = docs.sparkSession
    n = common.n_partitions(spark)
    # the input's own partition number: the task's differs between the two readings, as one stands in a union
    texts = common.text_only(docs, id_col, text_col).select("doc_id", "text", F.spark_partition_id().alias("partition"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).head()[0]
    ranges = max(n, -(-size // RANGE_BYTES))
    sent = texts.mapInArrow(_send(ranges), "block long, part long, hashes binary, counts binary")
    counted = sent.repartition(n, "part").sortWithinPartitions("part", "block").mapInArrow(_count(ranges, min_count), "block long, part long, n long, data binary")
    both = counted.unionByName(texts.mapInArrow(_texts, "block long, part long, n long, data binary"))
    scored = both.repartition(n, "block").sortWithinPartitions("block", "part").mapInArrow(_score(ranges, alpha), "doc_id long, n_words long, log_sum double, n_floor long")
    kept = common.materialise(scored, "lm-scores")
    total = kept.agg(F.coalesce(F.sum("n_words"), F.lit(0))).head()[0]
    log_n = float(np.log10(total)) if total else 0.0
    raw = F.col("log_sum") - F.col("n_floor") * F.lit(log_n)
    # plus zero: a rounded sum is never -0.0
    return kept.select("doc_id", "n_words", (F.round(raw, 4) + F.lit(0.0)).alias("log_score"), F.when(F.col("n_words") > 0, F.round(F.pow(F.lit(10.0), -raw / F.col("n_words")), 4)).alias("perplexity"))


def oracle(alpha: float = ALPHA, min_count: int = MIN_COUNT) -> str:
    """The same in DuckDB SQL over the view documents."""
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT r, i, w[i] AS w3, CASE WHEN i > 1 THEN w[i - 1] END AS w2, CASE WHEN i > 2 THEN w[i - 2] END AS w1
  FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d)
), c1 AS (SELECT w3 AS a, count(*) AS n FROM p GROUP BY a
), c2 AS (SELECT w2 AS a, w3 AS b, count(*) AS n FROM p WHERE w2 IS NOT NULL GROUP BY a, b HAVING count(*) >= {min_count}
), c3 AS (SELECT w1 AS a, w2 AS b, w3 AS c, count(*) AS n FROM p WHERE w1 IS NOT NULL GROUP BY a, b, c HAVING count(*) >= {min_count}
), total AS (SELECT count(*) AS n FROM p
), s AS (
  SELECT p.r, CASE
    WHEN c3.n IS NOT NULL THEN log10(c3.n) - log10(ctx.n)
    WHEN c2.n IS NOT NULL THEN log10(c2.n) - log10(prev.n) + CASE WHEN i > 2 THEN log10({alpha}) ELSE 0 END
    ELSE log10(own.n) - log10(total.n) + CASE WHEN i > 2 THEN 2 * log10({alpha}) WHEN i > 1 THEN log10({alpha}) ELSE 0 END
  END AS s
  FROM p JOIN c1 own ON own.a = p.w3 LEFT JOIN c1 prev ON prev.a = p.w2 LEFT JOIN c2 ON c2.a = p.w2 AND c2.b = p.w3
  LEFT JOIN c2 ctx ON ctx.a = p.w1 AND ctx.b = p.w2 LEFT JOIN c3 ON c3.a = p.w1 AND c3.b = p.w2 AND c3.c = p.w3, total
), per AS (SELECT r, sum(s) AS s, count(*) AS n FROM s GROUP BY r)
SELECT d.doc_id, coalesce(per.n, 0) AS n_words, round(coalesce(per.s, 0), 4) + 0.0 AS log_score, CASE WHEN per.n > 0 THEN round(pow(10.0, -per.s / per.n), 4) END AS perplexity
FROM d LEFT JOIN per USING (r)
"""
