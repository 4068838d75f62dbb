"""Token counts: pieces are counted once per distinct pre-token, joined to per-document pre-token frequencies, summed.

No id is ever made for a document. The texts are read twice, once for the distinct pre-tokens and once for the
frequencies, which takes less disk than keeping the frequencies. Frequencies travel inverted: a block of documents gives one row per distinct
pre-token with the packed (document number, frequency) pairs, so a frequent pre-token is one row a block, the join
has one row per (block, pre-token), and AQE can split a pre-token that is hot across blocks.

Nulls: a null text counts as empty (0 tokens); a null id stays null. Repeated rows stay repeated. An empty table gives
an empty result. Further columns of the input are ignored. Texts are never cut, however long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pretokens import pretokenizer, text_bytes

#: A block ends at either bound; it bounds what one task holds, not what is counted.
BLOCK_DOCS, BLOCK_BYTES = 16384, 48 << 20
#: The row that lists a block's documents has this mark and the block's number where others have the pre-token.
_LIST = "\uffff"

POSTINGS = "block long, pretoken string, postings binary, listing binary"
_PAIR = np.dtype([("doc", "<u2"), ("n", "u1")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        size = text_bytes(texts)
        at = 0
        while at < len(size):
            n = max(1, int(np.searchsorted(np.cumsum(size[at : at + BLOCK_DOCS]), BLOCK_BYTES, "right")))
            yield ids.slice(at, n), texts.slice(at, n), size[at : at + n]
            at += n


def _list(ids: pa.Array, size: np.ndarray) -> bytes:
    """Ids, whether they are null, and sizes of a block's documents. A binary column, as null lists are slow to pass."""
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() + size.astype("<i8").tobytes()


def _listed(x: bytes) -> tuple[pa.Array, np.ndarray]:
    n = len(x) // 17
    return pa.array(np.frombuffer(x, "<i8", n), mask=np.frombuffer(x, np.uint8, n, 8 * n).astype(bool)), np.frombuffer(x, "<i8", n, 9 * n)


def _postings(tokenizer):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = pretokenizer(tokenizer.value)
        schema = pa.schema([("block", pa.int64()), ("pretoken", pa.string()), ("postings", pa.binary()), ("listing", pa.binary())])
        block = TaskContext.get().partitionId() << 32
        for ids, texts, size in _blocks(batches):
            number: dict[str, int] = defaultdict()
            number.default_factory = number.__len__
            keys = []
            for d, t in enumerate(texts.to_pylist()):
                toks = pre.split(t)
                key = np.fromiter(map(number.__getitem__, toks), np.int64, len(toks))
                key <<= 16
                key |= d
                keys.append(key)
            key = np.concatenate(keys)
            keys.clear()
            key.sort()
            first = np.flatnonzero(np.diff(key, prepend=-1))
            n = np.diff(first, append=len(key))
            key = key[first]
            if (n > 255).any():  # a frequency over 255 is several pairs
                times = -(-n // 255)
                key, left = np.repeat(key, times), np.repeat(n, times)
                left -= 255 * (np.arange(len(key)) - np.repeat(np.cumsum(times) - times, times))
                n = np.minimum(left, 255)
            pairs = np.empty(len(key), _PAIR)
            pairs["doc"], pairs["n"] = key & 0xFFFF, n
            word = key >> 16
            edge = np.searchsorted(word, np.arange(len(number) + 1)) * _PAIR.itemsize
            words = [pre.canonical(p) for p in number]
            for lo in range(0, len(words), 50_000):
                hi = min(lo + 50_000, len(words))
                part = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((edge[lo : hi + 1] - edge[lo]).astype(np.int32)), pa.py_buffer(pairs.tobytes()[edge[lo] : edge[hi]])])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(block, pa.int64()), hi - lo), pa.array(words[lo:hi], pa.string()), part, pa.nulls(hi - lo, pa.binary())], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([f"{_LIST}{block}"]), pa.array([None], pa.binary()), pa.array([_list(ids, size)], pa.binary())], schema=schema)
            block += 1

    return run


def _distinct(tokenizer):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = pretokenizer(tokenizer.value)
        for _, texts, _ in _blocks(batches):
            seen: set[str] = set()
            for t in texts.to_pylist():
                seen.update(pre.split(t))
            yield pa.RecordBatch.from_arrays([pa.array([pre.canonical(p) for p in seen], pa.string())], ["pretoken"])

    return run


def _count_pieces(tokenizer):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = pretokenizer(tokenizer.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(pre.pieces(p)) for p in b.column(0).to_pylist()], pa.int64())], ["pretoken", "n_pieces"])

    return run


@common.lean
def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, postings, n_pieces) to one row per block and flush: packed document numbers and sums."""
    sums: dict[int, np.ndarray] = {}
    names = ["block", "docs", "sums", "listing"]

    def flush():
        rows = [(k, np.flatnonzero(v), v) for k, v in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in rows], pa.int64()), pa.array([at.astype("<u2").tobytes() for _, at, _ in rows], pa.binary()), pa.array([v[at].astype("<u4" if v.max(initial=0) < 1 << 32 else "<u8").tobytes() for _, at, v in rows], pa.binary()), pa.nulls(len(rows), pa.binary())], names
        )

    for b in batches:
        listed = b.column(2).is_null()
        if listed.true_count:  # the rows that list a block's documents pass
            to = b.filter(listed)
            yield pa.RecordBatch.from_arrays([to.column(0), pa.nulls(len(to), pa.binary()), pa.nulls(len(to), pa.binary()), to.column(3)], names)
            b = b.filter(pc.invert(listed))
        if not b.num_rows:
            continue
        block, pieces = b.column(0).to_numpy(), b.column(2).to_numpy()
        edges = text_bytes(b.column(1)) // _PAIR.itemsize
        buf = b.column(1).buffers()
        first = np.frombuffer(buf[1], np.int32)[b.column(1).offset]
        pairs = np.frombuffer(buf[2], np.uint8)[first : first + int(edges.sum()) * _PAIR.itemsize].view(_PAIR)
        of, value = np.repeat(block, edges), pairs["n"].astype(np.int64) * np.repeat(pieces, edges)
        order = np.argsort(of, kind="stable")
        of, value, doc = of[order], value[order], pairs["doc"][order]
        if not len(of):
            continue
        cut = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
        for lo, hi in zip(cut, [*cut[1:], len(of)], strict=True):
            got = np.bincount(doc[lo:hi], value[lo:hi], BLOCK_DOCS).astype(np.int64)
            sums[int(of[lo])] = sums[int(of[lo])] + got if int(of[lo]) in sums else got
        if len(sums) > 1024:
            yield flush()
    if sums:
        yield flush()


@common.lean
def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, a block's documents last."""
    total, at = np.zeros(BLOCK_DOCS, np.int64), None
    for b in batches:
        for block, docs, sums, listing in zip(*(b.column(c).to_pylist() for c in ("block", "docs", "sums", "listing")), strict=True):
            if block != at:
                total[:], at = 0, block
            if listing is None:
                to = np.frombuffer(docs, "<u2")
                total[to] += np.frombuffer(sums, "<u4" if len(sums) == 4 * len(to) else "<u8").astype(np.int64)
            else:
                ids, sizes = _listed(listing)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(total[: len(ids)])], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    tokenizer = spark.sparkContext.broadcast(tokenizer_json)  # one vocabulary file, of fixed size
    texts = common.text_only(docs, id_col, text_col)
    rows = texts.mapInArrow(_postings(tokenizer), POSTINGS)
    pieces = texts.select("doc_id", "text").mapInArrow(_distinct(tokenizer), "pretoken string").distinct().mapInArrow(_count_pieces(tokenizer), "pretoken string, n_pieces long")
    sums = rows.join(pieces, "pretoken", "left").select("block", "postings", "n_pieces", "listing").mapInArrow(_partial_sums, "block long, docs binary, sums binary, listing binary")
    done = sums.repartition(common.n_partitions(spark), "block").sortWithinPartitions("block", F.col("listing").isNotNull()).mapInArrow(_per_document, "doc_id long, n_bytes long, n_tokens long")
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
