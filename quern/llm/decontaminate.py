"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams, scanned by every document window.

The scan hashes all windows of a batch with numpy, looks them up in a bit table and then in the sorted hashes, and
verifies each hit on the words themselves, so hash collisions change nothing. The benchmark is broadcast in blocks of
at most ``MAX_BLOCK_BYTES`` of text (a window takes some 40 bytes of arrays beside it): its size is measured first, and a
larger one takes several exact passes, one block at a time: a pass is written and its block dropped before the next.

Nulls: a null text has no words; null ids stay null in documents; a benchmark row with a null id or text is hit-tested
like any other but a null id is never listed. Repeated rows are judged each for itself; repeated items count once by
id. With an empty benchmark nothing is hit. Further columns are kept by ``decontaminate`` and ignored by ``scan``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytewords import Words, column_words

WINDOW = 10
#: Text bytes of the benchmark held by one broadcast set.
MAX_BLOCK_BYTES = 8 << 20

HITS = "doc_id long, n_words long, n_hit long, items array<string>, span_start array<long>, span_end array<long>"


class WindowSet:
    """The windows of some items: by length their sorted hashes, a bit table, and where in the items' words each begins."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        low, start, end, item, found = [], [], [], [], {}
        size = many = 0
        for lo, _, w in column_words(pa.array([t for _, t in items], pa.string())):
            count = w.per_doc()
            for n in {window, *count[(count > 0) & (count < window)].tolist()}:
                at, h = w.ngrams(n)
                if n != window:  # the whole of an item of so few words
                    own = count[w.doc[at]] == n
                    at, h = at[own], h[own]
                found.setdefault(n, []).append((h, at + many))
            low.append(w.low)
            start.append(w.start + size)
            end.append(w.end + size)
            item.append(lo + w.doc)
            size, many = size + len(w.low), many + len(w.start)
        none = np.zeros(0, np.int64)
        self.low = np.concatenate([np.zeros(0, np.uint8), *low]).tobytes()
        self.start, self.end, self.item = (np.concatenate([none, *x]).astype(np.uint32) for x in (start, end, item))
        self.hashes, self.place, self.shift, self.bits = {}, {}, {}, {}
        for n, parts in found.items():
            h, at = (np.concatenate([p[k] for p in parts]) for k in range(2))
            order = np.argsort(h, kind="stable")
            self.hashes[n], self.place[n] = h[order], at[order].astype(np.uint32)
            bits = max(12, int(len(h) * 16).bit_length())
            self.shift[n] = np.uint64(64 - bits)
            self.bits[n] = np.zeros(1 << bits, bool)
            self.bits[n][h >> self.shift[n]] = True

    def _names(self, n: int, text: bytes, first: int, last: int) -> set[str] | None:
        """The items of the windows first to last that have these words; none: null."""
        out, same = set(), False
        for at in self.place[n][first:last].tolist():
            words = [self.low[s:e] for s, e in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist(), strict=True)]
            if b" ".join(words) == text:
                same = True
                name = self.names[int(self.item[at])]
                if name is not None:
                    out.add(name)
        return out if same else None

    def hits(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """(which words are hit, the items found by text number)."""
        hit, found = np.zeros(len(w.hash) + 1, np.int64), {}
        known: dict[bytes, set[str] | None] = {}
        for n, hashes in self.hashes.items():
            at, h = w.ngrams(n)
            maybe = np.flatnonzero(self.bits[n][h >> self.shift[n]])
            first = np.searchsorted(hashes, h[maybe], "left")
            last = np.searchsorted(hashes, h[maybe], "right")
            for i, x, y in zip(at[maybe].tolist(), first.tolist(), last.tolist(), strict=True):
                if x == y:
                    continue
                text = w.text(i, n)
                if text not in known:
                    known[text] = self._names(n, text, x, y)
                names = known[text]
                if names is not None:
                    hit[i] += 1
                    hit[i + n] -= 1
                    found.setdefault(int(w.doc[i]), set()).update(names)
        return np.cumsum(hit[:-1]) > 0, found


def _spans(w: Words, hit: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Runs of hit words as byte ranges of their text."""
    out: dict[int, list[tuple[int, int]]] = {}
    at = np.flatnonzero(hit)
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (w.doc[at[1:]] != w.doc[at[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True):
            d = int(w.doc[a])
            out.setdefault(d, []).append((int(w.start[a] - w.first_byte[d]), int(w.end[b] - w.first_byte[d])))
    return out


def _scan(blocks):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = blocks.value
        for b in batches:
            for lo, hi, w in column_words(b.column("text")):
                hit, found = sets.hits(w)
                spans = _spans(w, hit)
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(lo, n),
                        pa.array(w.per_doc().astype(np.int64)),
                        pa.array(np.bincount(w.doc[hit], minlength=n).astype(np.int64)),
                        pa.array([sorted(found.get(i, ())) for i in range(n)], pa.list_(pa.string())),
                        pa.array([[s for s, _ in spans.get(i, ())] for i in range(n)], pa.list_(pa.int64())),
                        pa.array([[e for _, e in spans.get(i, ())] for i in range(n)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_words", "n_hit", "items", "span_start", "span_end"],
                )

    return run


def _remove(blocks, text_col: str, spans_only: bool):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = blocks.value
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts, keep = b.column(at), np.ones(b.num_rows, bool)
            changed: dict[int, bytes] = {}
            for lo, _, w in column_words(texts):
                hit, _ = sets.hits(w)
                for d, spans in _spans(w, hit).items():
                    keep[lo + d] = False
                    if spans_only:
                        raw, out, done = texts[lo + d].as_py().encode(), [], 0
                        for s, e in spans:
                            out.append(raw[done:s])
                            done = e
                        changed[lo + d] = b"".join([*out, raw[done:]])
            if not spans_only:
                yield b.filter(pa.array(keep))
            elif changed:
                new = texts.to_pylist()
                for i, x in changed.items():
                    new[i] = x.decode()
                yield b.set_column(at, b.schema.field(at), pa.array(new, texts.type))
            else:
                yield b

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int) -> tuple[Iterator[list[tuple[str | None, str | None]]], int]:
    """The distinct items in blocks of about ``max_bytes`` of text, and how many blocks there are."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).head()[0]
    n = max(1, -(-total // max_bytes))

    def each() -> Iterator[list[tuple[str | None, str | None]]]:
        for k in range(n):
            block = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
            yield [(r["id"], r["text"]) for r in block.toLocalIterator()]

    return each(), n


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted), and the hit runs as byte spans of its UTF-8 text."""
    spark = docs.sparkSession
    rows = common.text_only(docs, id_col, text_col)
    blocks, n = _blocks(benchmark, item_id, item_text, max_bytes)
    if n == 1:
        return rows.mapInArrow(_scan(spark.sparkContext.broadcast(WindowSet(next(blocks), window))), HITS)
    # several blocks: their hits of one row are united by a row number, written so that it can't change
    rows = common.materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "decontaminate")
    numbered = rows.select(F.col("row").alias("doc_id"), "text")
    hits = None
    for b in blocks:
        sent = spark.sparkContext.broadcast(WindowSet(b, window))
        part = common.materialise(numbered.mapInArrow(_scan(sent), HITS).where("n_hit > 0"), "hits")
        sent.destroy()  # one block at a time
        hits = part if hits is None else hits.unionByName(part)
    spans = F.flatten(F.collect_list(F.arrays_zip("span_start", "span_end")))
    merged = hits.groupBy(F.col("doc_id").alias("row")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(spans).alias("spans"))
    return rows.join(merged, "row", "left").select("doc_id", "text", "items", "spans").mapInArrow(_merged_hits, HITS)


@common.lean
def _merged_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts hit words of the united spans of several blocks."""
    for b in batches:
        out = []
        rows = b.select(["doc_id", "items", "spans"]).to_pylist()
        for lo, _, w in column_words(b.column("text")):
            cut = np.searchsorted(w.doc, np.arange(w.n_docs + 1))
            for d in range(w.n_docs):
                r = rows[lo + d]
                mine = np.arange(cut[d], cut[d + 1])
                start = w.start[mine] - w.first_byte[d]
                change = np.zeros(len(mine) + 1, np.int64)
                for s in r["spans"] or ():
                    change[np.searchsorted(start, s["span_start"])] += 1
                    change[np.searchsorted(start, s["span_end"])] -= 1
                hit = np.cumsum(change[:-1]) > 0
                spans = _spans(Words(w.low, w.start[mine] - w.first_byte[d], w.end[mine] - w.first_byte[d], np.zeros(len(mine), np.int64), w.hash[mine], np.zeros(2, np.int64), 1), hit).get(0, [])
                out.append((r["doc_id"], len(mine), int(hit.sum()), r["items"] or [], [s for s, _ in spans], [e for _, e in spans]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_words", "n_hit", "items", "span_start", "span_end"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, remove: str = "documents", max_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The documents with all their columns, without hit documents (``remove='documents'``) or hit spans (``'spans'``)."""
    spark, out = docs.sparkSession, docs
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    blocks, n = _blocks(benchmark, item_id, item_text, max_bytes)
    for block in blocks:
        sent = spark.sparkContext.broadcast(WindowSet(block, window))
        left = out.mapInArrow(_remove(sent, text_col, remove == "spans"), docs.schema)
        if n == 1:
            return left
        left = common.materialise(left, "decontaminated")
        sent.destroy()  # one block at a time
        common.discard(out)
        out = left
    return out
