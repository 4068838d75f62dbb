"""Packing by multiway Karmarkar-Karp differencing into windows of near-equal length.

Documents are gathered into units of a bounded number of tokens. A document's whole windows are cut off first, and a short
tail of every rest over a quarter of a window; the pieces are partitioned by differencing: each begins as a partial
partition with one part filled, and the two partials of the largest spread are merged with their parts in opposite order,
until one is left. The window count begins at the least that could hold all and rises until differencing keeps every
window within the capacity. Should that take over 1 in ``SLACK`` more windows (many rests just over half a window, say),
it begins again with rests cut in pieces half as long. Without cutting, the count just rises.

Nulls: a null text is an empty document; it has the end token alone. Null ids stay null. Repeated rows are packed each
for itself. An empty table gives no piece. Further columns of the input are ignored. A unit ends with its partition. Padding is under 1 in ``SLACK``
windows, and at most two windows in a unit of fewer (0.4 % on the test tables).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common
from .pretokens import piece_table

CAPACITY = 4096
#: A unit is closed at this many windows' worth of tokens: it bounds a task's memory and the differencing.
UNIT_WINDOWS = 768
#: Of so many windows, one more than the least is accepted.
SLACK = 128
#: Lengths of tails, as parts of the capacity, in turn: many sizes, so that small differences can be evened out.
TAILS = (32, 64, 128, 256, 512)

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def difference(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part (0 to parts - 1) of each positive size, by multiway differencing."""
    n = len(sizes)
    if parts <= 1 or n == 0:
        return np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    single = sizes[order].astype(np.int64)
    falling = -single
    left, right = [], []  # children of the nodes n, n + 1, ...
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # (-spread, serial, values falling, their nodes)
    p = serial = 0

    def take():
        nonlocal p
        if p < n and (not heap or single[p] >= -heap[0][0]):
            p += 1
            return single[p - 1 : p], order[p - 1 : p], True
        if heap:
            x = heapq.heappop(heap)
            return x[2], x[3], False
        return None

    while True:
        a, b = take(), take()
        if b is None:
            break
        (va, na, _), (vb, nb, lone) = a, b
        if lone and len(va) < parts:  # it stays the widest until it is full: take the next singles at once
            most = int(np.searchsorted(falling, heap[0][0], "right")) if heap else n
            more = max(0, min(parts - len(va) - 1, most - p))
            vb, nb, p = np.concatenate([vb, single[p : p + more]]), np.concatenate([nb, order[p : p + more]]), p + more
        if len(va) + len(vb) <= parts:
            v, nodes = np.concatenate([va, vb]), np.concatenate([na, nb])
        else:
            both = len(va) + len(vb) - parts  # the smallest of a meet the smallest of b, in opposite order
            la, lb = va[len(va) - both :], vb[len(vb) - both :][::-1]
            new = n + len(left) + np.arange(both)
            left += na[len(va) - both :].tolist()
            right += nb[len(vb) - both :][::-1].tolist()
            v = np.concatenate([va[: len(va) - both], la + lb, vb[: len(vb) - both]])
            nodes = np.concatenate([na[: len(na) - both], new, nb[: len(nb) - both]])
        o = np.argsort(-v, kind="stable")
        v, nodes = v[o], nodes[o]
        serial += 1
        heapq.heappush(heap, (-int(v[0] - (v[-1] if len(v) == parts else 0)), serial, v, nodes))
    part = [0] * (n + len(left))
    for k, node in enumerate(a[1].tolist()):
        part[node] = k
    for k in range(len(left) - 1, -1, -1):
        part[left[k]] = part[right[k]] = part[n + k]
    return np.array(part[:n], np.int64)


def _pieces(rest: np.ndarray, limit: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, length) of what differencing deals out: rests in equal pieces of at most ``limit``, and a short
    tail of every larger rest, of one of ``TAILS`` in turn, as a counterweight."""
    many = -(-rest // limit)
    item = np.repeat(np.arange(len(rest)), many)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    start = rest[item] * nth // many[item]
    length = rest[item] * (nth + 1) // many[item] - start
    tails = np.maximum(capacity // np.array(TAILS), 1)[item % len(TAILS)]
    has = (length > capacity // 4) & (length > tails)
    return (
        np.concatenate([item, item[has]]),
        np.concatenate([start, (start + length - tails)[has]]),
        np.concatenate([np.where(has, length - tails, length), tails[has]]),
    )


def windows(sizes: np.ndarray, capacity: int = CAPACITY, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length); every item is covered once."""
    sizes = np.asarray(sizes, np.int64)
    if not cut and (sizes > capacity).any():
        raise ValueError("an item is larger than a window and may not be cut")
    whole = sizes // capacity if cut else np.zeros_like(sizes)
    out = [[(i, k * capacity, capacity)] for i in np.flatnonzero(whole).tolist() for k in range(int(whole[i]))]
    begin, rest = whole * capacity, sizes - whole * capacity
    least = count = -(-int(rest.sum()) // capacity)
    if not least:
        return out
    limit = capacity
    item, start, length = _pieces(rest, limit, capacity) if cut else (np.flatnonzero(rest), np.zeros(np.count_nonzero(rest), np.int64), rest[rest > 0])
    while True:
        part = difference(length, count)
        if np.bincount(part, length, count).max() <= capacity:
            break
        count += 1
        if cut and limit > 1 and count > least + least // SLACK + (limit < capacity // 64):  # too many: begin again with shorter pieces
            limit, count = limit // 2, least
            item, start, length = _pieces(rest, limit, capacity)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    for k, i, at, n in sorted(zip(part.tolist(), item.tolist(), (start + begin[item]).tolist(), length.tolist(), strict=True)):
        if bins[k] and bins[k][-1][0] == i and bins[k][-1][1] + bins[k][-1][2] == at:  # two pieces that met again
            bins[k][-1] = (i, bins[k][-1][1], bins[k][-1][2] + n)
        else:
            bins[k].append((i, at, n))
    return out + [b for b in bins if b]


def _pack(tokenizer, end_id: int, capacity: int, unit_windows: int):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(tokenizer.value)
        end = np.array([end_id], np.uint32)
        sequence = TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        held = 0

        def close():
            nonlocal sequence, ids, keys, held
            rows = []
            for w in windows(np.array([len(x) for x in ids], np.int64), capacity):
                offset = 0
                for i, at, length in w:
                    rows.append((keys[i], at, length, zlib.crc32(ids[i][at : at + length].tobytes()), len(ids[i]), sequence, offset))
                    offset += length
                sequence += 1
            ids, keys, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(key)
                ids.append(np.concatenate([table.ids(text), end]).astype("<u4", copy=False))
                held += len(ids[-1])
                if held >= unit_windows * capacity:
                    yield close()
        if ids:
            yield close()

    return run


def pack(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, unit_windows: int = UNIT_WINDOWS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. One narrow stage, no shuffle."""
    tokenizer = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    return common.text_only(docs, id_col, text_col).mapInArrow(_pack(tokenizer, end_id, capacity, unit_windows), PIECES)
