"""Signature sniffing: Aho-Corasick locates magic bytes, validators confirm structure and length, types are corrected.

``sniff`` walks every place where some format's magic bytes stand. A format's validator follows its own structure
(chunk lengths, checksums, markers) and gives the exact length, or rejects the place. The file that begins at byte 0
decides the detected type; files found further in, within the payload of others too, are embedded media for ``carve``.

Nulls: null media gives a null type and no embedded files; null or unknown declared types are corrected to what was
found. Bytes of no known format keep their declared type. Empty media is of no format. Repeated rows stay.
``store_texts`` takes a null text as empty. Clashing column names don't occur: outputs have fixed names.
"""

from __future__ import annotations

import functools
import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Magic bytes of public file formats, by media type, and where in the file they stand.
MAGIC: list[tuple[str, bytes, int]] = [
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/bmp", b"BM", 0),
    ("image/webp", b"WEBPVP8", 8),
    ("audio/wav", b"WAVEfmt ", 8),
    ("video/avi", b"AVI LIST", 8),
    ("audio/flac", b"fLaC", 0),
    ("audio/ogg", b"OggS\x00\x02", 0),
    ("video/mp4", b"ftyp", 4),
    ("application/pdf", b"%PDF-", 0),
    ("application/zip", b"PK\x03\x04", 0),
    ("application/gzip", b"\x1f\x8b\x08", 0),
]

FRAME, RATE = 576, 16_000


def _riff(d: bytes, at: int) -> int:
    if d[at : at + 4] != b"RIFF":
        return 0
    size = struct.unpack_from("<I", d, at + 4)[0] + 8
    p, end = at + 12, at + size
    if end > len(d):
        return 0
    while p + 8 <= end:
        p += 8 + (n := struct.unpack_from("<I", d, p + 4)[0]) + n % 2
    return size if p == end else 0


def _png(d: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(d):
        n = struct.unpack_from(">I", d, p)[0]
        kind = d[p + 4 : p + 8]
        if p + 12 + n > len(d) or zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0] or (p == at + 8) != (kind == b"IHDR"):
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(d: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        mark = d[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        if mark == 0xD9:
            return p + 2 - at
        if mark in (0x00, 0x01) or 0xD0 <= mark <= 0xD8:
            return 0
        p += 2 + struct.unpack_from(">H", d, p + 2)[0]
        if mark == 0xDA:  # entropy-coded data up to the next real marker
            while (p := d.find(b"\xff", p)) >= 0 and p + 1 < len(d) and (d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return 0
    return p + 2 - at if d[p : p + 2] == b"\xff\xd9" else 0


def _gif(d: bytes, at: int) -> int:
    if len(d) < at + 13:
        return 0
    p = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            p += d[p] + 1
        return p + 1

    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 < len(d):
            p = blocks(p + 11 + (3 << (d[p + 9] & 7) + 1 if d[p + 9] & 128 else 0))
        else:
            return 0
    return 0


def _bmp(d: bytes, at: int) -> int:
    if len(d) < at + 30:
        return 0
    size, reserved, data, header = struct.unpack_from("<IIII", d, at + 2)
    planes, bits = struct.unpack_from("<HH", d, at + 26)
    ok = not reserved and header in (12, 40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 2, 4, 8, 16, 24, 32) and 14 + header <= data <= size
    return size if ok and at + size <= len(d) else 0


def _ogg(d: bytes, at: int) -> int:
    p, last = at, 0
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d):
        n = d[p + 26]
        if p + 27 + n > len(d):
            return 0
        last = d[p + 5] & 4
        p += 27 + n + sum(d[p + 27 : p + 27 + n])
        if last:
            break
    return p - at if last and p <= len(d) else 0


def _mp4(d: bytes, at: int) -> int:
    p, seen = at, set()
    while p + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        if n == 1 and p + 16 <= len(d):
            n = struct.unpack_from(">Q", d, p + 8)[0]
        if n < 8 or p + n > len(d) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"sidx", b"uuid", b"meta", b"wide"):
            break
        seen.add(kind)
        p += n
    return p - at if {b"ftyp"} < seen else 0


def _pdf(d: bytes, at: int) -> int:
    start = d.find(b"startxref", at)
    end = d.find(b"%%EOF", max(start, at))
    return end + 5 - at if start >= 0 and end >= 0 else 0


def _zip(d: bytes, at: int) -> int:
    """The end-of-directory record whose offsets lead back here closes the file."""
    p = at
    while (p := d.find(b"PK\x05\x06", p + 1)) >= 0 and p + 22 <= len(d):
        size, offset, note = struct.unpack_from("<IIH", d, p + 12)
        if at + offset + size == p and d[at + offset : at + offset + 4] == b"PK\x01\x02" and p + 22 + note <= len(d):
            return p + 22 + note - at
    return 0


def _gzip(d: bytes, at: int) -> int:
    z = zlib.decompressobj(31)
    try:
        p = at
        while not z.eof and p < len(d):
            z.decompress(d[p : p + 65536])
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(d)) - len(z.unused_data) - at if z.eof else 0


@functools.cache
def _crc_table(bits: int, polynomial: int) -> tuple[int, ...]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ polynomial if x & top else x << 1) & mask
        out.append(x)
    return tuple(out)


def _flac_header(d: bytes, p: int) -> tuple[int, int]:
    """(length, samples) of the frame header at p, by its own checksum; (0, 0) if there is none."""
    if len(d) < p + 6 or d[p] != 0xFF or d[p + 1] & 0xFE != 0xF8 or d[p + 3] & 1:
        return 0, 0
    block, rate, q = d[p + 2] >> 4, d[p + 2] & 15, p + 4
    lead = d[q]
    q += 1 if lead < 0x80 else max(2, 8 - (~lead & 0xFF).bit_length())  # the frame's number, in the manner of UTF-8
    if block in (6, 7):
        size = int.from_bytes(d[q : q + block - 5], "big") + 1
        q += block - 5
    else:
        size = 192 if block == 1 else 576 << (block - 2) if 2 <= block <= 5 else 256 << (block - 8) if block >= 8 else 0
    q += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    table, crc = _crc_table(8, 0x07), 0
    for x in d[p:q]:
        crc = table[crc ^ x]
    return (q + 1 - p, size) if size and rate != 15 and q < len(d) and crc == d[q] else (0, 0)


def _flac(d: bytes, at: int) -> int:
    """Metadata blocks, then frame by frame: a frame ends where its checksum comes out and, but for the last, another begins."""
    p, total, first = at + 4, 0, True
    while True:
        if p + 4 > len(d):
            return 0
        kind, n = d[p] & 127, int.from_bytes(d[p + 1 : p + 4], "big")
        if first and (kind, n) != (0, 34) or kind == 127 or p + 4 + n > len(d):
            return 0
        if first:
            total = int.from_bytes(d[p + 14 : p + 22], "big") & (1 << 36) - 1
        last, first, p = d[p] & 128, False, p + 4 + n
        if last:
            break
    table, done = _crc_table(16, 0x8005), 0
    while not total or done < total:
        header, samples = _flac_header(d, p)
        if not header:
            return p - at if not total and done else 0
        done += samples
        crc, q, end = 0, p, 0
        for x in memoryview(d)[p:]:
            crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ x]
            q += 1
            if not crc and q > p + header + 2:
                end = end or (0 if total else q)  # of unknown length, the last frame ends where its checksum first comes out
                if total and done >= total or q == len(d) or _flac_header(d, q)[0]:
                    end = q
                    break
        if not end:
            return 0
        p = end
    return p - at


VALIDATORS: dict[str, Callable[[bytes, int], int]] = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "image/webp": _riff, "audio/wav": _riff, "video/avi": _riff,
    "audio/flac": _flac, "audio/ogg": _ogg, "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    by_magic: dict[bytes, list[tuple[str, int]]] = {}
    for kind, magic, at in MAGIC:
        by_magic.setdefault(magic, []).append((kind, at))
    for magic, kinds in by_magic.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kinds))
    a.make_automaton()
    return a


#: Formats whose magic bytes stand in their own parts as well: in such a file no other of its format is looked for.
SELF_SIMILAR = frozenset(("application/zip", "application/gzip", "application/pdf", "audio/ogg", "video/mp4"))


def files(data: bytes, magic) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the valid files in data in order: outer ones, and those that lie whole within them."""
    out: list[tuple[int, int, str]] = []
    around: list[tuple[int, str]] = []  # end and type of the files that the place is in
    failed: set[str] = set()
    starts = sorted({(end - n + 1 - at, kind) for end, (n, kinds) in magic.iter(data.decode("latin-1")) for kind, at in kinds})
    for at, kind in starts:
        while around and around[-1][0] <= at:
            around.pop()
        if at < 0 or kind in SELF_SIMILAR and any(k == kind for _, k in around) or kind in failed:
            continue
        if length := VALIDATORS[kind](data, at):
            if not around or at + length <= around[-1][0]:
                out.append((at, length, kind))
                around.append((at + length, kind))
        elif kind == "application/pdf" and ((x := data.find(b"startxref", at)) < 0 or data.find(b"%%EOF", x) < 0) or kind == "application/zip" and data.find(b"PK\x05\x06", at) < 0:
            failed.add(kind)  # nothing that could end such a file follows any more
    return out


def sample_features(samples: bytes) -> str:
    """Figures of 8-bit samples around their middle: number, mean, root mean square, extremes and sign changes."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    if not len(x):
        return "samples=0"
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"samples={len(x)} mean={x.sum() / len(x):.6f} rms={math.sqrt((x * x).sum() / len(x)):.6f} min={x.min()} max={x.max()} sign_changes={changes}"


def wav(payload: bytes) -> bytes:
    """8-bit unsigned mono PCM; the samples are the payload's bytes."""
    pad = len(payload) % 2
    head = struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVEfmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def wav_data(d: bytes, at: int) -> tuple[int, int, str]:
    """(offset, length) of a WAV file's samples and a description."""
    p, what = at + 12, ""
    while p + 8 <= len(d):
        kind, n = struct.unpack_from("<4sI", d, p)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", d, p + 8)
            what = f"wav pcm={code} channels={channels} rate={rate} bits={bits}"
        if kind == b"data":
            return p + 8, n, what
        p += 8 + n + n % 2
    return 0, 0, what


@common.lean
def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, held = [], 0

        def batch():
            ids, n, media = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = text.encode()
            media = wav(raw + b"\xff" * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw)))
            out.append((key, len(raw), media))
            held += len(media)
            if held > 8 << 20:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, filled up with 255 to whole frames of 576, as a WAV file."""
    return common.text_only(docs, id_col, text_col).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


@common.lean
def _sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    magic = automaton()
    for b in batches:
        rows = []
        for data, declared in zip(b.column("media"), b.column("declared_type").to_pylist(), strict=True):
            data = data.as_py()
            if data is None:
                rows.append((None, None, None, None, None, None, []))
                continue
            found = files(data, magic)
            at, length, kind = found[0] if found and found[0][0] == 0 else (0, len(data), None)
            lo, n, what = wav_data(data, 0) if kind == "audio/wav" else (0, length, kind or "unknown")
            if what.endswith("bits=8"):
                what = f"{what} {sample_features(data[lo : lo + n])}"
            detected = kind or declared
            rows.append((detected, detected != declared, length, lo, n, what, [{"offset": o, "length": x, "type": k} for o, x, k in found if (o, x, k) != (at, length, kind)]))
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))]
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "detected_type", "corrected", "length", "data_offset", "data_length", "feature", "embedded"])


def sniff(media: DataFrame, id_cols: tuple[str, ...] = ("doc_id", "n_bytes"), media_col: str = "media", declared: F.Column | str | None = None) -> DataFrame:
    """The id columns and media, with declared and detected type, whether that corrects it, the file's length, where its data stands, and embedded files."""
    kind = F.lit(None).cast("string") if declared is None else F.col(declared) if isinstance(declared, str) else declared
    rows = media.select(*id_cols, F.col(media_col).alias("media"), kind.alias("declared_type"))
    added = "detected_type string, corrected boolean, length long, data_offset long, data_length long, feature string, embedded array<struct<offset: long, length: long, type: string>>"
    return rows.mapInArrow(_sniff, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + added)


def carve(sniffed: DataFrame, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per embedded file: ids, offset, type and its bytes."""
    rows = sniffed.select(*id_cols, "media", F.explode("embedded").alias("e"))
    return rows.select(*id_cols, F.col("e.offset").alias("offset"), F.col("e.type").alias("type"), F.expr("substring(media, cast(e.offset + 1 as int), cast(e.length as int))").alias("bytes"))


def digest(sniffed: DataFrame) -> DataFrame:
    """Checksums of the payload read back from the stored bytes, and of the stored form."""
    payload = F.expr("substring(media, cast(data_offset + 1 as int), cast(data_length as int))")
    rows = sniffed.withColumn("payload", payload)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "detected_type",
        "corrected",
        F.size("embedded").alias("n_embedded"),
    )
