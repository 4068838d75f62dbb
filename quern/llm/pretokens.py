"""Pre-tokens of a word-level BPE tokenizer and their pieces, computed once per distinct pre-token.

The tokenizer (a ``tokenizers`` JSON) normalises with NFC, white space to one blank and lower case, splits on a
fixed pattern and runs BPE inside each pre-token, so a pre-token's pieces don't depend on its surroundings.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

#: Texts of only these characters take the fast path (NFC changes none of them, lower case is one to one);
#: U+0130 is left out as its lower case is two characters. Others go through the library's normaliser and splitter.
_FAST_END = 0x180
_ODD = re.compile(f"[^\x00-{chr(_FAST_END - 1)}]|İ")
_SPACE = "\t-\r \x85\xa0"
_MARK = "\uffff"


def _chars(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_FAST_END) if unicodedata.category(chr(c))[0] == kind)


# letters first, as most pre-tokens are words; no other alternative begins with one
_SPLIT = re.compile(f"[{_chars('L')}]+|[{_chars('N')}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_SPACE}{_chars('L')}{_chars('N')}]+")


@functools.cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return [chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)]


class Pretokenizer:
    """Splits texts into pre-tokens; a special token's string is one pre-token of its own."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def split(self, text: str) -> list[str]:
        if self.cut and "<|" in text and self.cut.search(text):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += self._split(text[at : m.start()])
                out.append(m.group())
                at = m.end()
            return out + self._split(text[at:])
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _SPLIT.findall(text.lower())
        # byte-level strings from the library, marked by a character that no fast-path pre-token has
        return [_MARK + p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))] if text else []

    def canonical(self, pre: str) -> str:
        """The byte-level form, equal for equal pre-tokens of either path; specials stay as they are."""
        if pre in self.special:
            return pre
        if pre[0] == _MARK:
            return pre[1:]
        if pre.isascii() and pre.isprintable():
            return pre
        letters = byte_letters()
        return "".join([letters[b] for b in pre.encode("utf-8")])

    def pieces(self, canonical: str) -> list[int]:
        if canonical in self.special:
            return [self.special[canonical]]
        return [t.id for t in self.tok.model.tokenize(canonical)]


class _Numbers(dict):
    """Numbers of pre-tokens; a new one is encoded when it is first looked up."""

    def __init__(self, pre: Pretokenizer):
        super().__init__()
        self.pre, self.flat, self.starts = pre, array("I"), array("q", [0])

    def __missing__(self, p: str) -> int:
        self[p] = n = len(self)
        self.flat.extend(self.pre.pieces(self.pre.canonical(p)))
        self.starts.append(len(self.flat))
        return n


class PieceTable:
    """Ids of texts by table look-up: each distinct pre-token is encoded once, then gathered by number.

    The table is emptied when it holds over ``limit`` pre-tokens, so its memory is bounded.
    """

    def __init__(self, pre: Pretokenizer, limit: int = 700_000):
        self.pre, self.limit = pre, limit
        self.number = _Numbers(pre)

    def ids(self, text: str) -> np.ndarray:
        if len(self.number) > self.limit:
            self.number = _Numbers(self.pre)
        out = self.pre.split(text)
        if not out:
            return np.zeros(0, np.uint32)
        at = np.fromiter(map(self.number.__getitem__, out), np.int64, len(out))
        starts, flat = np.frombuffer(self.number.starts, np.int64), np.frombuffer(self.number.flat, np.uint32)
        first = starts[at]
        return ragged(flat, first, starts[at + 1] - first)


@functools.lru_cache(maxsize=2)
def pretokenizer(tokenizer_json: str) -> Pretokenizer:
    """One for all tasks of a worker: reading the vocabulary takes a while."""
    return Pretokenizer(tokenizer_json)


@functools.lru_cache(maxsize=2)
def piece_table(tokenizer_json: str) -> PieceTable:
    """One for all tasks of a worker, so that a pre-token is seldom encoded again."""
    return PieceTable(pretokenizer(tokenizer_json))


def ragged(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices values[start:start+length], one after another."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return values[np.arange(total) + np.repeat(start - ends + length, length)]


def text_bytes(column: pa.Array) -> np.ndarray:
    """UTF-8 lengths of a string column (null: 0)."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
