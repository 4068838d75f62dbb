"""Repeated passages: paragraph MinHash banding, exact verification, components, removal of all but the first occurrence.

Two kinds of paragraphs, so that a passage is found wherever it stands:

* Lines of at least ``MIN_WORDS`` words, alike or nearly. Bands of MinHashes are tuned so that two lines at the threshold
  meet with the wanted probability; lines that share a band are gathered by its key, once for each set that meets, and
  compared by the exact Jaccard coefficient of their word shingles: a search from text to text that visits each once, so
  a group of like texts costs no pairs. Keys of many texts, or of many bytes, are split into pieces that share one text,
  their lead; what isn't like it meets all pieces. Links give components by star rounds; the first occurrence (least doc_id, then place) of each component stays.
* Every run of ``RUN`` words, whatever the line breaks do: a sliding paragraph. Its band is the MinHash of its shingles of
  ``RUN_SHINGLE`` words, so equal runs always share it (recall 1), and neighbouring runs mostly share it too: a document
  writes each band once, about one for 17 words. In documents that share a band with another text, the runs of that band
  are compared by a 64-bit hash of all their words; a run stays where it occurs first. Texts that are equal as a whole
  are one text here, and all but the first go. Runs inside a line that is removed already aren't looked at, and those
  that overlap one come last in the order, so what is removed always has its like somewhere that stays.

Words are runs of non-blank bytes in lower case; a word said several times running counts once in sliding paragraphs (text
that only stammers is the quality classifier's business). Runs repeated within one document only stay.

Nulls: a null text has no paragraphs; a null doc_id comes after all others. Rows repeated with one id and text are
one document: its paragraphs aren't repeats of themselves, and such rows are treated alike.
Documents that hold neither kind have no row. Very long lines are paragraphs like others, never cut.
An empty table gives an empty result. ``remove_repeats`` keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bytewords import IS_SOLID, Words, chunks, column_bytes, column_words, mix, run_hashes, words
from .graph import components

SHINGLE, THRESHOLD, RECALL, MIN_WORDS = 5, 0.8, 0.999, 25
#: Words of a sliding paragraph, and of the shingles that its MinHash is taken over.
RUN, RUN_SHINGLE = 50, 18
#: Texts that a task compares at most, and their bytes (one text may be longer); of a key's texts, a sixteenth of it in the first place.
HOT, HOT_BYTES = 4096, 1 << 25
#: Most bands that tuning may take: each is a row per text in the shuffle.
MOST_BANDS = 16


def tune(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most selective rows for which at most ``most`` bands reach the recall at the threshold."""
    best = (most, 1)
    for rows in range(1, 13):
        bands = next((b for b in range(1, most + 1) if 1 - (1 - threshold**rows) ** b >= recall), None)
        if bands is None:
            break
        best = (bands, rows)
    return best


class Paragraphs:
    """Lines of some texts with at least ``min_words`` words: doc (number), place (line number), first and end byte, words, hash."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, min_words: int):
        breaks = np.flatnonzero(data == 10) + 1
        lines = np.unique(np.concatenate([edges, breaks]))
        self.w: Words = words(data, lines, IS_SOLID)
        count = self.w.per_doc()
        self.line = np.flatnonzero(count >= min_words)
        self.n_words = count[self.line]
        self.first_word = (np.cumsum(count) - count)[self.line]
        start = lines[self.line]
        self.doc = np.searchsorted(edges, start, "right") - 1
        self.start = start - edges[self.doc]
        self.end = lines[self.line + 1] - edges[self.doc]
        line_doc = np.searchsorted(edges, lines[:-1], "right") - 1
        first_line = np.searchsorted(line_doc, np.arange(len(edges) - 1))
        self.place = self.line - first_line[self.doc]
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        if not len(self.line):
            return np.zeros(0, np.uint64)
        at = np.arange(int(self.n_words.sum())) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(self.n_words.max()) - 1, 0x8CB92BA72F3D8DD7, np.uint64)]))
            own = self.w.hash[np.repeat(self.first_word, self.n_words) + at] * power[at]
            return mix(np.add.reduceat(own, np.cumsum(self.n_words) - self.n_words) + self.n_words.astype(np.uint64))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, how many) of each paragraph's shingles in order, repeats included."""
        at, h = self.w.ngrams(n)
        lo = np.searchsorted(at, self.first_word)
        many = np.maximum(self.n_words - n + 1, 0)
        take = np.arange(int(many.sum())) + np.repeat(lo - np.cumsum(many) + many, many)
        return h[take], many


def _paragraphs(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[tuple[pa.RecordBatch, int, Paragraphs]]:
    for b in batches:
        data, edges = column_bytes(b.column("text"))
        for lo, hi in chunks(edges):
            yield b, lo, Paragraphs(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo], min_words)


def _occurrences(min_words: int):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, p in _paragraphs(batches, min_words):
            rows = pa.array(lo + p.doc)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(rows), b.column("row").take(rows), *(pa.array(x.astype(np.int64)) for x in (p.place, p.start, p.end, p.n_words, p.hash.view(np.int64)))],
                ["doc_id", "row", "paragraph", "start", "end", "n_words", "text_hash"],
            )

    return run


def band_keys(h: np.ndarray, first: np.ndarray, bands: int, rows: int) -> Iterator[np.ndarray]:
    """Per band the MinHash key of each run of shingle hashes; runs begin at ``first`` and none is empty."""
    rng = np.random.default_rng(20)
    mult, flip = rng.integers(0, 1 << 32, (2, bands * rows), np.uint32)
    mult |= np.uint32(1)
    short = (h >> np.uint64(32)).astype(np.uint32)
    for band in range(bands):
        key = np.full(len(first), band + 1, np.uint64)
        for k in range(band * rows, band * rows + rows):
            key = mix(key ^ np.minimum.reduceat((short ^ flip[k]) * mult[k], first))
        yield key


def _bands(min_words: int, shingle: int, bands: int, rows: int):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, p in _paragraphs(batches, min_words):
            _, own = np.unique(p.hash, return_index=True)
            if not len(own):
                continue
            h, many = p.shingles(shingle)
            for key in band_keys(h, np.cumsum(many) - many, bands, rows):
                yield pa.RecordBatch.from_arrays([pa.array(key[own].view(np.int64)), pa.array(p.hash[own].view(np.int64))], ["key", "text_hash"])

    return run


@common.lean
def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, text): the distinct texts of keys with several, and a hash of each such set.

    Only the last key's texts are held over; a key's set is summed as it streams by.
    """
    held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(key: np.ndarray, text: np.ndarray):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        key, text = key[new], text[new]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        size = np.diff(first, append=len(key))
        which = mix(np.add.reduceat(mix(text.view(np.uint64)), first)).view(np.int64) if len(key) else np.zeros(0, np.int64)
        many = np.repeat(size > 1, size)
        return pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(text[many]), pa.array(np.repeat(which, size)[many]), pa.array(np.repeat(size, size)[many].astype(np.int64))], ["key", "text_hash", "set", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        key, text = np.concatenate([held_key, b.column("key").to_numpy()]), np.concatenate([held, b.column("text_hash").to_numpy()])
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield out(key[:cut], text[:cut])
        held_key, held = key[cut:], np.unique(text[cut:])
        held_key = held_key[: len(held)]
    if len(held):
        yield out(held_key, held)


def _texts(min_words: int):
    """Each distinct paragraph of a chunk: its bytes in lower case."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, p in _paragraphs(batches, min_words):
            _, own = np.unique(p.hash, return_index=True)
            if len(own):
                lo, hi = p.w.start[p.first_word[own]], p.w.end[p.first_word[own] + p.n_words[own] - 1]
                raw = p.w.low.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(p.hash[own].view(np.int64)), pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())], ["text_hash", "line"])

    return run


def shingle_sets(lines: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each line; one of fewer words is one shingle."""
    out = []
    for _, _, w in column_words(lines, IS_SOLID):
        at, h = w.ngrams(shingle)
        cut = np.searchsorted(w.doc[at], np.arange(w.n_docs + 1))
        word = np.searchsorted(w.doc, np.arange(w.n_docs + 1))
        for x, y, a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), word[:-1].tolist(), word[1:].tolist(), strict=True):
            out.append(np.unique(h[x:y] if y > x else mix(w.hash[a:b] + np.arange(b - a, dtype=np.uint64)).sum(keepdims=True)))
    return out


def link_like(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each sorted set the least index that it reaches by Jaccard >= threshold.

    Only hashes of several sets are kept, numbered in four bytes, and read for the sets that aren't visited yet.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    several = np.concatenate(sets)
    several.sort()
    several = np.unique(several[1:][several[1:] == several[:-1]])
    shared = []
    for s in sets:
        at = np.searchsorted(several, s)
        at[at == len(several)] = 0
        shared.append(at[several[at] == s].astype(np.int32) if len(several) else np.zeros(0, np.int32))
    count = np.array([len(x) for x in shared])
    label = np.full(n, -1)
    mark = np.zeros(len(several), bool)
    open_ = np.flatnonzero(count)  # not visited yet
    own = np.concatenate(shared)
    first = np.cumsum(count[open_]) - count[open_]
    for seed in range(n):
        if label[seed] >= 0:
            continue
        todo = [seed]
        label[seed] = seed
        while todo:
            i = todo.pop()
            if len(open_) > 64 and (label[open_] < 0).sum() * 2 < len(open_):  # forget the visited
                keep = label[open_] < 0
                own, open_ = own[np.repeat(keep, count[open_])], open_[keep]
                first = np.cumsum(count[open_]) - count[open_]
            if not count[i] or not len(open_):
                continue
            mark[shared[i]] = True
            both = np.add.reduceat(mark[own], first, dtype=np.int32)
            mark[shared[i]] = False
            like = open_[(both >= threshold * (size[open_] + size[i] - both) - 1e-9) & (both > 0) & (label[open_] < 0)]
            label[like] = seed
            todo += like.tolist()
    return label


def _verify(threshold: float, shingle: int):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, texts, sets = None, [], []

        def links():
            label = link_like(sets, threshold)
            own = np.flatnonzero(label != np.arange(len(label)))
            t = np.array(texts, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), at[0], np.int64)), pa.array(t[own]), pa.array(t[label[own]])], ["key", "a", "b"])

        for b in batches:
            for x, y in chunks(column_bytes(b.column("line"))[1]):
                part = b.slice(x, y - x)
                for key, lo, hi, text, s in zip(*(part.column(c).to_pylist() for c in ("key", "lo", "hi", "text_hash")), shingle_sets(part.column("line"), shingle), strict=True):
                    if (key, lo, hi) != at:
                        if len(texts) > 1:
                            yield links()
                        at, texts, sets = (key, lo, hi), [], []
                    if not texts or texts[-1] != text:
                        texts.append(text)
                        sets.append(s)
        if len(texts) > 1:
            yield links()

    return run


def parts(n: Column, texts: int, size: Column, n_bytes: int) -> Column:
    """How many parts keep to so many texts and bytes each, on average."""
    return F.greatest(F.ceil(n / texts), F.ceil(size / n_bytes), F.lit(1)).cast("int")


def verified_links(members: DataFrame, lines: DataFrame, shingle: int, threshold: float, hot: int = HOT, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Links (a, b) that connect the texts of each group by exact Jaccard at the threshold or above.

    members: key, text_hash, n (texts of the key), cheap to read again; lines: text_hash, line (its bytes). A group of over
    ``hot / 16`` texts or ``hot_bytes / 16`` bytes is dealt into pieces of that size, each with the group's lead, its least
    text: copies of one text are all linked to it there, in as many tasks as there are pieces. Only the texts that no piece
    links to the lead meet all the others, in chunks of half the limits against pieces of that size, so every link is found
    whatever the group is, and what a task holds doesn't follow the length of the texts.
    """
    n_tasks = common.n_partitions(members.sparkSession)
    order = ["key", "lo", "hi"]
    lines = common.materialise(lines.withColumn("size", F.octet_length("line").cast("long")), "lines")  # read for the sizes, the pieces, and what is left
    sized = lines.select("text_hash", "size")

    def verified(groups: DataFrame) -> DataFrame:
        rows = groups.select(*order, "text_hash").join(lines.select("text_hash", "line"), "text_hash")
        return rows.repartition(n_tasks, *order).sortWithinPartitions(*order, "text_hash").mapInArrow(_verify(threshold, shingle), "key long, a long, b long")

    def dealt(name: str, n: Column) -> Column:
        return F.pmod(F.xxhash64("text_hash", F.lit(name)), n).cast("int")

    piece, wide = (max(1, hot // 16), max(1, hot_bytes // 16)), (max(1, hot // 2), max(1, hot_bytes // 2))
    groups = members.join(sized, "text_hash").groupBy("key").agg(F.min("text_hash").alias("lead"), F.max("n").alias("n"), F.sum("size").alias("size"))
    lead = groups.where((F.col("n") > piece[0]) | (F.col("size") > piece[1]))
    lead = common.materialise(lead.select("key", "lead", *(parts(F.col("n"), k, F.col("size"), b).alias(x) for x, (k, b) in (("pieces", piece), ("wide", wide)))), "leads")
    if lead.isEmpty():
        return verified(members.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "text_hash")).select("a", "b")
    large = members.join(lead.select("key", "wide"), "key").select("key", "text_hash", "wide")
    in_pieces = members.join(lead.select("key", "pieces"), "key", "left").select("key", F.coalesce(dealt("piece", F.col("pieces")), F.lit(0)).alias("lo"), F.lit(0).alias("hi"), "text_hash")
    with_lead = lead.select("key", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("lo"), F.lit(0).alias("hi"), F.col("lead").alias("text_hash"))
    first = common.materialise(verified(in_pieces.unionByName(with_lead)), "piece-links")
    near_lead = first.join(lead.select("key", F.col("lead").alias("b")), ["key", "b"]).select("key", F.col("a").alias("text_hash"))
    left = large.join(lead.select("key", F.col("lead").alias("text_hash")), ["key", "text_hash"], "left_anti").join(near_lead, ["key", "text_hash"], "left_anti")
    left = common.materialise(left.join(sized, "text_hash").select("key", "text_hash", "wide", "size"), "left")
    if left.isEmpty():
        return first.select("a", "b")
    many = common.materialise(left.groupBy("key").agg(parts(F.count("*"), wide[0], F.sum("size"), wide[1]).alias("chunks")), "left-sizes")
    own = left.join(many, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("lo"), dealt("chunk", F.col("chunks")).alias("hi"), "text_hash")
    others = large.join(many, "key").select("key", dealt("wide", F.col("wide")).alias("lo"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("hi"), "text_hash")
    return first.select("a", "b").unionByName(verified(own.unionByName(others)).select("a", "b"))


def like_lines(texts: DataFrame, min_words: int = MIN_WORDS, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, hot: int = HOT) -> DataFrame:
    """One row per line of at least ``min_words`` words that occurs again somewhere, alike or nearly. texts: doc_id, row, text."""
    n = common.n_partitions(texts.sparkSession)
    places = common.materialise(texts.mapInArrow(_occurrences(min_words), "doc_id long, row long, paragraph long, start long, end long, n_words long, text_hash long"), "paragraphs")
    only = texts.select("text")
    bands, rows = tune(threshold, recall)
    keys = only.mapInArrow(_bands(min_words, shingle, bands, rows), "key long, text_hash long")
    met = keys.repartition(n, "key").sortWithinPartitions("key", "text_hash").mapInArrow(_meeting, "key long, text_hash long, set long, n long")
    met = written = common.materialise(met, "meeting")
    once = met.groupBy("set").agg(F.min("key").alias("key"))  # a set of texts that meets in several bands is compared once
    met = common.materialise(met.join(once, ["set", "key"]).select("key", "text_hash", "n"), "met")
    wanted = met.select("text_hash").distinct()
    lines = only.mapInArrow(_texts(min_words), "text_hash long, line binary").join(wanted, "text_hash", "left_semi")
    lines = lines.groupBy("text_hash").agg(F.first("line").alias("line"))
    links = verified_links(met, lines, shingle, threshold, hot)
    reach = components(links).select(F.col("node").alias("text_hash"), "label")
    common.discard(written)  # the components are written by now
    common.discard(met)
    classed = places.join(reach, "text_hash", "left").withColumn("label", F.coalesce("label", "text_hash"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "paragraph")
    first = classed.groupBy("label").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first != final")
    first = common.materialise(first.select("label", "first"), "first-lines")  # apart, so that a common line's join can be split
    return classed.join(first, "label").select(
        "doc_id", "row", "paragraph", "start", "end", "n_words",
        F.col("first.doc_id").alias("component_id"), F.col("first.paragraph").alias("component_paragraph"),
        (F.struct("row", "paragraph") != F.struct("first.row", "first.paragraph")).alias("removed"),
    )


class Runs:
    """All runs of ``run`` words of some texts: doc (number), word (place of its first word), start and end byte, line, band (MinHash), hash."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, run: int, shingle: int):
        w = words(data, edges, IS_SOLID)
        own = np.ones(len(w.hash), bool)
        own[1:] = (w.hash[1:] != w.hash[:-1]) | (w.doc[1:] != w.doc[:-1])
        at = np.flatnonzero(own)
        h, doc = w.hash[at], w.doc[at]
        last = w.end[np.append(at[1:], len(own))[: len(at)] - 1] if len(at) else w.end
        self.n_words = np.bincount(doc, minlength=w.n_docs)
        first_word = np.cumsum(self.n_words) - self.n_words
        n = max(0, len(h) - run + 1)
        begin = np.flatnonzero(doc[:n] == doc[run - 1 :]) if n else np.zeros(0, np.int64)
        self.doc, self.word = doc[begin], begin - first_word[doc[begin]]
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        start, end = w.start[at[begin]], last[begin + run - 1]
        self.line = lines[start] - lines[edges[self.doc]]
        self.start, self.end = start - edges[self.doc], end - edges[self.doc]
        self.hash = run_hashes(h, run)[begin]
        low = run_hashes(h, shingle)
        width, span = run - shingle + 1, 1
        while span * 2 <= width:  # least of ever wider stretches of shingles
            low, span = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0], span * 2
        rest = width - span
        self.band = (np.minimum(low[: len(low) - rest], low[rest:]) if rest and len(low) > rest else low)[begin] if len(begin) else np.zeros(0, np.uint64)


def _run_bands(run: int, shingle: int):
    """Each text that holds a run: where its words begin and end, a hash of them, and the distinct bands of its runs."""

    @common.lean
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, edges = column_bytes(b.column("text"))
            for lo, hi in chunks(edges):
                r = Runs(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo], run, shingle)
                if not len(r.doc):
                    continue
                new = np.ones(len(r.doc), bool)  # neighbours mostly share their band
                new[1:] = (r.doc[1:] != r.doc[:-1]) | (r.band[1:] != r.band[:-1])
                doc, band = r.doc[new], r.band[new]
                order = np.lexsort((band, doc))
                doc, band = doc[order], band[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (band[1:] != band[:-1])
                doc, band = doc[new], band[new]
                first = np.flatnonzero(np.diff(r.doc, prepend=-1))
                final = np.append(first[1:], len(r.doc)) - 1
                some = r.doc[first]
                # all runs in order, the line breaks aside: one hash of the whole text
                whole = mix(np.add.reduceat(mix(r.hash + r.word.astype(np.uint64)), first) + r.n_words[some].astype(np.uint64))
                cut = np.append(np.searchsorted(doc, some), len(doc)).astype(np.int32)
                rows = pa.array(lo + some)
                numbers = (r.line[first], r.start[first], r.end[final], r.n_words[some], whole.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(rows), b.column("row").take(rows), *(pa.array(x.astype(np.int64)) for x in numbers), pa.ListArray.from_arrays(pa.array(cut), pa.array(band.view(np.int64)))],
                    ["doc_id", "row", "paragraph", "start", "end", "n_words", "whole", "bands"],
                )

    return go


def _shared_runs(run: int, shingle: int):
    """The runs whose band is among a text's ``bands``, but for those inside one of its ``gone`` spans."""

    @common.lean
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, edges = column_bytes(b.column("text"))
            bands, gone = b.column("bands"), b.column("gone")
            for lo, hi in chunks(edges):
                r = Runs(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo], run, shingle)
                keep, late = np.zeros(len(r.doc), bool), np.zeros(len(r.doc), bool)
                cut = np.searchsorted(r.doc, np.arange(hi - lo + 1))
                for d in range(hi - lo):
                    x, y = int(cut[d]), int(cut[d + 1])
                    if x == y:
                        continue
                    keep[x:y] = np.isin(r.band[x:y], bands[lo + d].values.to_numpy().view(np.uint64))
                    if gone[lo + d].is_valid:
                        spans = sorted((s["start"], s["end"]) for s in gone[lo + d].as_py())
                        s, e = np.array(spans, np.int64).T
                        i = np.searchsorted(s, r.start[x:y], "right") - 1
                        keep[x:y] &= (i < 0) | (e[i] < r.end[x:y])
                        j = np.searchsorted(e, r.start[x:y], "right")
                        late[x:y] = np.append(s, 1 << 62)[j] < r.end[x:y]
                at = np.flatnonzero(keep)
                rows = pa.array(lo + r.doc[at])
                numbers = (r.line, r.start, r.end, r.word, r.hash.view(np.int64))
                for k in range(0, len(at), 1 << 16):
                    part = at[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(rows[k : k + (1 << 16)]), b.column("row").take(rows[k : k + (1 << 16)]), *(pa.array(x[part].astype(np.int64)) for x in numbers), pa.array(late[part])],
                        ["doc_id", "row", "paragraph", "start", "end", "word", "hash", "late"],
                    )

    return go


def equal_runs(texts: DataFrame, gone: DataFrame, run: int = RUN, shingle: int = RUN_SHINGLE) -> DataFrame:
    """One row per stretch of runs that occur in several documents, as far as it is first, or repeats one stretch elsewhere.

    texts: doc_id, row, text. gone: row, start, end of spans that are removed already. Columns as in ``like_lines``.
    """
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "paragraph")
    kinds = "doc_id long, row long, paragraph long, start long, end long, n_words long"
    found = common.materialise(texts.mapInArrow(_run_bands(run, shingle), kinds + ", whole long, bands array<long>"), "runs")
    whole = found.groupBy("whole").agg(F.min(place).alias("first"), F.max(place).alias("final"))
    copies = found.join(whole.where("first != final"), "whole").select(
        "doc_id", "row", "paragraph", "start", "end", "n_words",
        F.col("first.doc_id").alias("component_id"), F.col("first.paragraph").alias("component_paragraph"), (F.col("row") != F.col("first.row")).alias("removed"),
    )
    own = found.join(whole.select(F.col("first.row").alias("row")), "row", "left_semi").dropDuplicates(["row"])
    keys = common.materialise(own.select("row", F.explode("bands").alias("band")), "bands")
    several = keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(several, "band", "left_semi").groupBy("row").agg(F.collect_list("band").alias("bands"))
    spans = gone.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    # a document that is there several times is read once
    rows = texts.join(met.join(spans, "row", "left"), "row").select("doc_id", "row", "text", "bands", "gone").dropDuplicates(["row"])
    shared = common.materialise(rows.mapInArrow(_shared_runs(run, shingle), "doc_id long, row long, paragraph long, start long, end long, word long, hash long, late boolean"), "shared")
    common.discard(keys)
    order = F.struct("late", F.col("doc_id").isNull().alias("last"), "doc_id", "row", "word", "paragraph")
    first = shared.groupBy("hash").agg(F.min(order).alias("first"), F.min("row").alias("a"), F.max("row").alias("b")).where("a != b").select("hash", "first")
    first = common.materialise(first, "first-runs")  # apart, so that a common run's join can be split
    every = shared.join(first, "hash").withColumn("removed", F.struct("row", "word") != F.struct("first.row", "first.word"))
    along = Window.partitionBy("row").orderBy("word")
    step = F.col("word") - F.lag("word").over(along)
    goes_on = (step <= 1) & (F.col("removed") == F.lag("removed").over(along)) & (F.col("first.row") == F.lag("first.row").over(along)) & (F.col("first.word") - F.lag("first.word").over(along) == step)
    numbered = every.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("stretch", F.sum("new").over(along))
    stretches = numbered.groupBy("row", "stretch").agg(
        F.first("doc_id").alias("doc_id"), F.min("paragraph").alias("paragraph"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max("word") - F.min("word") + run).alias("n_words"),
        F.first("first.doc_id").alias("component_id"), F.min("first.paragraph").alias("component_paragraph"), F.first("removed").alias("removed"),
    )
    return copies.unionByName(stretches.select(copies.columns))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, hot: int = HOT, run: int = RUN, run_shingle: int = RUN_SHINGLE) -> DataFrame:
    """One row per passage that occurs again somewhere.

    doc_id, row (a hash of id and text), kind (line, or run: a stretch of equal runs, or a whole text), paragraph (number of
    the line where it begins), start and end (bytes of its UTF-8 text), n_words, component_id (the doc_id of the component's
    first occurrence), component_paragraph, removed (all but the first). Passages of the two kinds may overlap.
    """
    texts = common.text_only(docs, id_col, text_col).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    lines = common.materialise(like_lines(texts, min_words, shingle, threshold, recall, hot), "like-lines")
    runs = equal_runs(texts, lines.where("removed").select("row", "start", "end"), run, run_shingle)
    kind = lambda df, name: df.select("doc_id", "row", F.lit(name).alias("kind"), *df.columns[2:])
    return kind(lines, "line").unionByName(kind(runs, "run"))


def _cut(text_col: str):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(b.num_columns - 1)
            b = b.select(range(b.num_columns - 1))
            if spans.null_count < len(spans):
                at = b.schema.get_field_index(text_col)
                new = b.column(at).to_pylist()
                for i, s in enumerate(spans.to_pylist()):
                    if s:
                        raw, out, done = new[i].encode(), [], 0
                        for lo, hi in sorted((x["start"], x["end"]) for x in s):
                            out.append(raw[done:lo])
                            done = max(done, hi)
                        new[i] = b"".join([*out, raw[done:]]).decode()
                b = b.set_column(at, b.schema.field(at), pa.array(new, b.column(at).type))
            yield b

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with all their columns, each repeated paragraph left at its first occurrence only."""
    row, spans = "__quern_row", "__quern_spans"
    gone = repeats(docs, id_col, text_col, **options).where("removed")
    cuts = gone.groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct("start", "end")).alias(spans))
    numbered = docs.withColumn(row, F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))))
    marked = numbered.join(cuts, row, "left").select(*[numbered[c] for c in docs.columns], spans)
    return marked.mapInArrow(_cut(text_col), docs.schema)
