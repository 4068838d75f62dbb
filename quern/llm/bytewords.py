"""Words of many texts at once, on their UTF-8 bytes: positions, 64-bit hashes and rolling n-gram hashes with numpy.

A word is a run of ASCII letters, digits and bytes from 0x80 on; A-Z count as a-z. Nothing here loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256, dtype=np.uint8)
IS_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
LOWER = np.where(IS_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = IS_UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES >= 128)
IS_SOLID = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))

_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
#: Texts are worked on in pieces of about this many bytes (always whole texts), so arrays stay small.
CHUNK_BYTES = 1 << 19
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("p")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", _P), ("inverse", pow(_P, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _tables[key] = np.multiply.accumulate(x)
    return _tables["p"], _tables["inverse"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n neighbouring hashes, whatever n costs: differences of running sums."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    p, inverse = _powers(len(h))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[: len(h)], dtype=np.uint64)])
        return mix((sums[n:] - sums[:-n]) * inverse[:m])


@dataclass
class Words:
    """low: the bytes in lower case; start, end: of each word in low; doc: number of its text; hash: of each word."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first_byte: np.ndarray
    n_docs: int

    def text(self, i: int, n: int) -> bytes:
        """Words i to i + n - 1, joined by one blank."""
        low = self.low
        return b" ".join([low[s:e].tobytes() for s, e in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist(), strict=True)])

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of n words of one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h *= np.uint64(_Q)
            h += self.hash[k : k + m]
        return at, mix(h)[at]

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def words(data: np.ndarray, edges: np.ndarray, is_word: np.ndarray = IS_WORD) -> Words:
    """data: bytes of the texts, one after another; edges: where each begins, and the end."""
    n = len(data)
    low, w = LOWER[data], is_word[data]
    inner = np.unique(edges[(edges > 0) & (edges < n)])  # empty texts begin where the next one does
    change = np.empty(n + 1, bool)
    change[0], change[n] = n > 0 and w[0], n > 0 and w[-1]
    change[1:n] = w[1:] != w[:-1]
    cut = inner[w[inner] & w[inner - 1]]  # a word touches the next text's first
    flips = np.flatnonzero(change)
    if len(cut):
        flips = np.sort(np.concatenate([flips, cut, cut]))
    start, end = flips[::2], flips[1::2]
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(low, z, z, z, np.zeros(0, np.uint64), edges, len(edges) - 1)
    p, inverse = _powers(n)
    value = (low.astype(np.uint64) + np.uint64(1)) * p[:n]
    value[~w] = 0
    h = mix(np.add.reduceat(value, start) * inverse[start])
    doc = np.searchsorted(edges, start, "right") - 1
    return Words(low, start, end, doc, h, edges, len(edges) - 1)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, edges) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[edges[0] : edges[-1]], edges - edges[0]


def chunks(edges: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes."""
    at, n = 0, len(edges) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + size, "right")) - 1)
        yield at, to
        at = to


def column_words(column: pa.Array, is_word: np.ndarray = IS_WORD, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, their words) of a string column, piece by piece."""
    data, edges = column_bytes(column)
    for lo, hi in chunks(edges, size):
        yield lo, hi, words(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo], is_word)
