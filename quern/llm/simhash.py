"""SimHash fingerprints, linked through a Gray-order hierarchical index.

Index: distinct fingerprints are dealt by pigeonhole keys (of B blocks of bits, any 4 differences leave B - 4 blocks
alike; B follows the number of fingerprints so that a key holds few), sorted by key and Gray rank, and every run of
2 ** (3k) neighbours becomes a node of level k that holds the bits its members share (mask and pattern). Pairs of nodes
go down the levels together, adding up the differences in the bits both share and the level above didn't; a pair whose
sum passes the limit is dropped with all below it. Keys of over ``HOT`` fingerprints are split into pieces that are
compared two by two in separate tasks, so none is ever gathered whole. Each task sends a spanning star for each group,
not its pairs; components come from distributed star rounds. Every link within the limit is kept: the search is exact.

Nulls: a null text is empty and has fingerprint zero, like every text without words; a null id keeps its row, and a
component whose ids are all null has a null component_id. Repeated rows stay. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytewords import IS_SOLID, Words, chunks, column_bytes, mix, words
from .graph import Forest, components

#: Fingerprints of one key that a task compares; more are split.
HOT = 8192
#: The number of blocks rises until a key holds no more than this many fingerprints on average.
PER_KEY = 256


def shingle_spans(data: np.ndarray, edges: np.ndarray, n: int) -> tuple[Words, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the text with single blanks, and (start, end, text number) of each shingle of n words in it.

    A text of fewer words, but not none, is one shingle.
    """
    solid = IS_SOLID[data]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    to = np.concatenate([[0], np.cumsum(keep)])
    data = data[keep]
    data[~IS_SOLID[data]] = 32
    w = words(data, to[edges], IS_SOLID)
    count = w.per_doc()
    m = len(w.start) - n + 1
    at = np.flatnonzero(w.doc[: max(m, 0)] == w.doc[n - 1 :]) if m > 0 else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < n))
    start = np.concatenate([w.start[at], w.start[first[short]]])
    end = np.concatenate([w.end[at + n - 1], w.end[first[short + 1] - 1]])
    doc = np.concatenate([w.doc[at], short])
    if len(short):
        order = np.argsort(doc, kind="stable")
        start, end, doc = start[order], end[order], doc[order]
    return w, w.low.tobytes(), start, end, doc


def hash_spans(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join([xxh64_digest(text[s:e], 42) for s, e in zip(start.tolist(), end.tolist(), strict=True)]), ">u8").astype(np.uint64)


def majority(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per text: bit b is set if over half of its hashes have it. doc rises."""
    count = np.bincount(doc, minlength=n_docs)
    out = np.zeros(n_docs, np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    first = np.concatenate([[0], np.cumsum(count)])[:-1][some]
    runs = -(-count[some] // 255)  # byte counters hold 255
    run_first = np.concatenate([[0], np.cumsum(runs)])[:-1]
    starts = np.repeat(first, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(run_first, runs))
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((h >> np.uint64(bit)) & lanes, starts).view(np.uint8).reshape(-1, 8)
        per_doc = np.add.reduceat(sums, run_first, axis=0, dtype=np.int64)
        for lane in range(8):
            out[some] |= (2 * per_doc[:, lane] > count[some]).astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def _fingerprints(shingle: int):
    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, edges = column_bytes(b.column("text"))
            for lo, hi in chunks(edges):
                _, text, start, end, doc = shingle_spans(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo], shingle)
                fp = majority(hash_spans(text, start, end), doc, hi - lo)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and the 64-bit fingerprint (as a signed long)."""
    return common.text_only(docs, id_col, text_col).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code word in reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def key_masks(n: int, distance: int) -> list[int]:
    """Bit masks of which at least one is free of differences between any two codes within the distance."""
    blocks = distance + 1
    while True:
        edge = [64 * k // blocks for k in range(blocks + 1)]
        masks = [sum((1 << edge[k + 1]) - (1 << edge[k]) for k in kept) for kept in combinations(range(blocks), blocks - distance)]
        if n <= PER_KEY << min(m.bit_count() for m in masks) or blocks >= 2 * distance + 4:
            return masks
        blocks += 1


class Level:
    """Nodes of one level: shared bits (mask, pattern) of runs of rows; first: the children of each."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray, group: np.ndarray):
        self.mask, self.pattern, self.group = mask, pattern, group

    def above(self) -> tuple[Level, np.ndarray]:
        n = len(self.group)
        new = np.ones(n, bool)
        new[1:] = self.group[1:] != self.group[:-1]
        first = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        starts = np.flatnonzero(place % 8 == 0)
        ones = np.bitwise_and.reduceat(self.pattern, starts)
        zeros = np.bitwise_or.reduceat(self.pattern, starts)
        mask = np.bitwise_and.reduceat(self.mask, starts) & ~(ones ^ zeros)
        return Level(mask, ones & mask, self.group[starts]), np.append(starts, n)


def search(fp: np.ndarray, group: np.ndarray, distance: int, more: list[tuple[np.ndarray, int]] | None = None, step: int = 1 << 18) -> Forest:
    """Links codes of one group within the distance. Rows are sorted by group and Gray rank within it.

    more: further codes of each row with limits of their own that a link must keep to as well.
    """
    forest = Forest(len(fp))
    levels, children = [Level(np.full(len(fp), ~np.uint64(0)), fp, group)], []
    while len(levels[-1].group) and (levels[-1].group[1:] == levels[-1].group[:-1]).any() and len(levels) < 6:
        up, edges = levels[-1].above()
        levels.append(up)
        children.append(edges)
    top = levels[-1]

    def down(k: int, i: np.ndarray, j: np.ndarray, acc: np.ndarray, mask: np.ndarray) -> None:
        """Pairs of nodes of level k with their differences so far, in the bits of mask."""
        at = levels[k]
        shared = at.mask[i] & at.mask[j]
        acc = acc + np.bitwise_count((at.pattern[i] ^ at.pattern[j]) & shared & ~mask)
        near = acc <= distance
        i, j, acc, mask = i[near], j[near], acc[near], shared[near]
        if k == 0:
            for code, limit in more or ():
                near = np.bitwise_count(code[i] ^ code[j]) <= limit
                i, j = i[near], j[near]
            forest.join(i, j)
            return
        edges = children[k - 1]
        for lo in range(0, len(i), max(1, step // 64)):
            x, y = i[lo : lo + step // 64], j[lo : lo + step // 64]
            a = edges[x][:, None, None] + np.arange(8)[None, :, None]
            b = edges[y][:, None, None] + np.arange(8)[None, None, :]
            ok = (a < edges[x + 1][:, None, None]) & (b < edges[y + 1][:, None, None])
            ok &= (a < b) if k == 1 else (a <= b)
            p, a8, b8 = np.nonzero(ok)
            down(k - 1, edges[x][p] + a8, edges[y][p] + b8, acc[lo : lo + step // 64][p], mask[lo : lo + step // 64][p])

    n = len(top.group)
    for d in range(n):
        i = np.flatnonzero(top.group[: n - d] == top.group[d:])
        if not len(i):
            break
        if len(levels) == 1 and d == 0:
            continue
        for lo in range(0, len(i), step):
            part = i[lo : lo + step]
            down(len(levels) - 1, part, part + d, np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint64))
    return forest


def _link(distance: int, limits: list[int]):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ["node", "fp", *(f"more{k}" for k in range(len(limits)))]

    def links(key: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        group = np.repeat(np.arange(len(size)), size)
        many = size[group] > 1
        group, codes = group[many], codes[many]
        order = np.lexsort((gray_rank(codes[:, 1].view(np.uint64)), group))
        group, codes = group[order], codes[order]
        fp = [np.ascontiguousarray(codes[:, 1 + k]).view(np.uint64) for k in range(1 + len(limits))]
        root = search(fp[0], group, distance, list(zip(fp[1:], limits, strict=True))).label
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(codes[at, 0]), pa.array(codes[root[at], 0])], schema=schema)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(tuple(np.stack([b.column(c).to_numpy() for c in cols], axis=1) for cols in (["table", "key", "lo", "hi"], names)))
            rows += b.num_rows
            if rows >= 4 * HOT:  # whole groups only; the last one may go on
                key, codes = np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])
                last = np.flatnonzero((key != key[-1]).any(axis=1))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield links(key[:cut], codes[:cut])
                held, rows = [(key[cut:], codes[cut:])], len(key) - cut
        if rows:
            yield links(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    return run


def links(codes: DataFrame, distance: int = 4, limits: tuple[int, ...] = (), hot: int = HOT) -> DataFrame:
    """Links (a, b) between nodes that connect all within the distance.

    codes: longs node (distinct), fp, and more0, more1, ... with a limit each; cheap to read twice.
    """
    spark = codes.sparkSession
    masks = key_masks(codes.count(), distance)
    own = ["node", "fp", *(f"more{k}" for k in range(len(limits)))]
    keys = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for k, m in enumerate(masks)])
    dealt = codes.select(*own, F.explode(keys).alias("k")).select(*own, "k.table", "k.key")
    large = dealt.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    pieces = F.coalesce(F.ceil(F.col("n") / (hot // 2)), F.lit(1)).cast("int")
    split = dealt.join(large, ["table", "key"], "left").withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    pairs = split.select("table", "key", *own, "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    rows = pairs.select("table", "key", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"), *own)
    order = ["table", "key", "lo", "hi"]
    return rows.repartition(common.n_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_link(distance, list(limits)), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """Per document: doc_id, fp, component_id (the least doc_id it can reach by links)."""
    found = common.materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    codes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    written = common.materialise(codes.select(F.col("fp").alias("node"), "fp"), "codes")
    reach = components(links(written, distance))
    common.discard(written)  # the components are written by now
    nodes = codes.join(reach.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    # written apart, so that the join of a large component can be split
    least = common.materialise(nodes.groupBy("label").agg(F.min("least").alias("component_id")), "least-ids")
    of = nodes.join(least, "label").select("fp", "component_id")
    return found.join(of, "fp").select("doc_id", "fp", "component_id")


#: Fingerprints of distinct runs of 1, 2 and 5 words, with the differences that close copies keep to; the first is the one
#: that the index searches, at so few differences that a text takes 5 to 35 keys from 10^5 to 10^10 texts. What it can't
#: reach (edits of a fifth of a text) comes from the bands, whose recall follows from the similarity alone.
LADDER = ((1, 4), (2, 13), (5, 17))


def _ladder(shingles: tuple[int, ...], shingle: int, bands: int, rows: int):
    from .substring_dedup import band_keys

    def runs(w: Words, count: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, text numbers) of each text's distinct shingles of k words, by text; one of fewer words is one shingle."""
        at, h = w.ngrams(k)
        short = np.flatnonzero((count > 0) & (count < k))
        h, doc = np.concatenate([h, same[short]]), np.concatenate([w.doc[at], short])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return h[new], doc[new]

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, edges = column_bytes(b.column("text"))
            for lo, hi in chunks(edges):
                n, found = hi - lo, []
                w = words(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo], IS_SOLID)
                count = w.per_doc()
                place = np.arange(len(w.doc)) - np.repeat(np.cumsum(count) - count, count)
                with np.errstate(over="ignore"):  # the words in order
                    same = mix(count.astype(np.uint64))
                    np.add.at(same, w.doc, mix(w.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                for k in shingles:
                    h, doc = runs(w, count, same, k)
                    found.append(majority(h, doc, n).view(np.int64))
                h, doc = runs(w, count, same, shingle)
                keys = np.stack(list(band_keys(h, np.flatnonzero(np.diff(doc, prepend=-1)), bands, rows)), axis=1)
                ends = np.concatenate([[0], np.cumsum(count > 0) * bands]).astype(np.int32)  # a text without words has none
                bands_of = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, n), b.column("row").slice(lo, n), pa.array(same.view(np.int64)), *(pa.array(x) for x in found), bands_of], ["doc_id", "row", "node", "fp", *(f"more{k}" for k in range(len(shingles) - 1)), "bands"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, ladder: tuple[tuple[int, int], ...] = LADDER, recall: float = 0.999, hot: int = 4096) -> DataFrame:
    """Per document: doc_id, row (a hash of id and text), component_id, component_row, verified exactly.

    Candidates come from two sources: the index links texts whose fingerprints keep to the ladder, and MinHash bands over
    the word shingles meet at the wanted recall whatever the shape of an edit is. Inside what the ladder connects, and
    inside each set of texts that meets in a band and isn't within one such group, texts are compared by the exact Jaccard coefficient of their word shingles (a text of fewer words is one shingle), and links at the threshold
    or above give the components. Texts of equal words are one node throughout.
    """
    from .substring_dedup import _meeting, tune, verified_links

    rows = common.text_only(docs, id_col, text_col).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    more = [f"more{k}" for k in range(len(ladder) - 1)]
    kinds = "doc_id long, row long, node long, fp long" + "".join(f", {m} long" for m in more) + ", bands array<long>"
    found = common.materialise(rows.mapInArrow(_ladder(tuple(k for k, _ in ladder), shingle, *tune(threshold, recall)), kinds), "fingerprints")
    codes = common.materialise(found.select("node", "fp", *more, "bands").dropDuplicates(["node"]), "codes")
    near = components(links(codes, ladder[0][1], tuple(x for _, x in ladder[1:]), hot))
    label = near.select(F.col("node").alias("text_hash"), "label")
    sizes = label.groupBy("label").agg(F.count("*").alias("n"))
    keys = codes.select(F.explode("bands").alias("key"), F.col("node").alias("text_hash"))
    met = keys.repartition(common.n_partitions(docs.sparkSession), "key").sortWithinPartitions("key", "text_hash")
    met = common.materialise(met.mapInArrow(_meeting, "key long, text_hash long, set long, n long"), "meeting")
    common.discard(codes)
    # a set that meets in several bands is compared once, and not at all where one group of the ladder holds it
    once = met.join(label, "text_hash", "left").groupBy("set").agg(F.min("key").alias("key"), F.min("label").alias("a"), F.max("label").alias("b"), F.count_if(F.col("label").isNull()).alias("alone"))
    once = once.where("alone > 0 or a != b").select("set", "key")
    met_once = met.join(once, ["set", "key"]).select("key", "text_hash", "n")
    members = common.materialise(label.join(sizes, "label").select(F.col("label").alias("key"), "text_hash", "n").unionByName(met_once), "near")
    common.discard(met)
    # a row for each text first, combined on the map side: a text may have any number of copies
    wanted = found.groupBy("node").agg(F.min("row").alias("row")).join(members.select(F.col("text_hash").alias("node")).distinct(), "node", "left_semi")
    lines = rows.select("row", "text").join(wanted, "row").groupBy(F.col("node").alias("text_hash")).agg(F.first(F.encode("text", "UTF-8")).alias("line"))
    same = components(verified_links(members, lines, shingle, threshold, hot))
    common.discard(members)
    common.discard(near)
    nodes = found.select("doc_id", "row", "node").join(same, "node", "left").withColumn("label", F.coalesce("label", "node"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = common.materialise(nodes.groupBy("label").agg(F.min(place).alias("first")), "firsts")
    return nodes.join(first, "label").select("doc_id", "row", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("component_row"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with all their columns, one of each group (the least id). Rows repeated with one id and text are one document."""
    row = "__quern_row"
    kept = near_duplicates(docs, id_col, text_col, **options).where("row = component_row").select(F.col("row").alias(row)).distinct()
    numbered = docs.withColumn(row, F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))))
    return numbered.dropDuplicates([row]).join(kept, row, "left_semi").select(*[numbered[c] for c in docs.columns])
