"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: every operator and stage."""

from __future__ import annotations

import hashlib
import tracemalloc
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import decontaminate, html_text, licenses, lm_scores, media, packing, quality, simhash, substring_dedup, token_counts
from quern.llm.queries import tokenizer_json

LONG = " ".join(f"w{i % 977}x" for i in range(60_000))
LINE = " ".join(f"term{i}" for i in range(60))
ROWS = [
    (1, LINE + "\nsecond line", "en", "a", 5),
    (2, "intro\n" + LINE, "en", None, None),
    (2, "intro\n" + LINE, "en", None, None),  # a repeated row
    (None, None, None, None, None),
    (3, None, "de", "b", 0),
    (4, "", None, "b", 0),
    (5, " \n\t ", "de", "b", 4),
    (6, "a" * 300_000, "de", "b", 300_000),
    (7, LONG, "fr", "c", len(LONG)),
    (8, "Ünï 😀 \x00 <|endoftext|> x", "fr", "c", 3),
    (None, "no id here", "fr", "c", 10),
    (9, LINE + "\nsecond line", "en", "a", 5),  # a tie
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with the operators' own names
    return spark.createDataFrame([(*r, 1, "k", b"m") for r in ROWS], SCHEMA + ", row int, key string, media binary")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 1), (3, None, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"term{i}" for i in range(20, 40))), (2, None), (None, "TERM5 term6 Term7"), (3, ""), (4, "second line"), (4, "second line")], "item_id long, text string")


def pairs(df, *cols):
    return sorted(([r[c] for c in cols] for r in df.collect()), key=str)


def test_quality(spark, docs, empty, labels):
    for d, n in ((docs, len(ROWS)), (empty, 0)):
        model = quality.train(d, labels)
        got = quality.score(d, model).collect()
        assert len(got) == n and all(0 <= r["p_quality"] <= 1 and r["keep"] for r in got)  # one class: nothing goes
        kept = quality.keep_good(d, model)
        assert kept.columns == d.columns and kept.count() == n
    nothing = quality.train(docs, labels.limit(0))
    assert {r["p_toxic"] for r in quality.score(docs, nothing).collect()} == {0.5}


def test_media(spark, docs, empty):
    got = media.digest(media.sniff(media.store_texts(docs))).collect()
    assert len(got) == len(ROWS) and media.digest(media.sniff(media.store_texts(empty))).count() == 0
    want = sorted(hashlib.sha256((raw := (r[1] or "").encode()) + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))).hexdigest() for r in ROWS)
    assert sorted(r["payload_sha256"] for r in got) == want
    odd = spark.createDataFrame([(1, None, "x/y"), (2, b"", None), (3, b"BMxx", "image/bmp")], "doc_id long, media binary, declared string")
    s = {r["doc_id"]: r for r in media.sniff(odd, ("doc_id",), declared="declared").collect()}
    assert s[1]["detected_type"] is None and s[2]["detected_type"] is None and s[3]["detected_type"] == "image/bmp" and not s[3]["corrected"]


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json())
    want = sorted(([r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)] for r in ROWS), key=str)
    assert pairs(token_counts.token_counts(docs, tokenizer_json()), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.token_counts(empty, tokenizer_json()).count() == 0


def test_substring_dedup(docs, empty):
    found = substring_dedup.repeats(docs)
    got = pairs(found.where("kind = 'line'"), "doc_id", "paragraph", "component_id", "removed")
    assert got == [[1, 0, 1, False], [2, 1, 1, True], [2, 1, 1, True], [9, 0, 1, True]]
    # the whole of 1 and 9 is equal
    assert pairs(found.where("kind = 'run'"), "doc_id", "paragraph", "component_id", "removed") == [[1, 0, 1, False], [9, 0, 1, True]]
    assert substring_dedup.repeats(empty).count() == 0
    left = substring_dedup.remove_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in left.collect() if r["doc_id"]}
    assert texts[1] == LINE + "\nsecond line" and texts[2] == "intro\n" and texts[9] == "" and texts[3] is None and texts[7] == LONG
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_simhash(docs, empty):
    got = {}
    for r in simhash.simhash_components(docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert {c for _, c in got[3] | got[4] | got[5]} == {3} and {f for f, _ in got[3]} == {0}
    assert {c for _, c in got[9]} == {1} and sum(1 for _ in simhash.simhash_components(docs).collect()) == len(ROWS)
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 6, 7, 8]  # 2 is like 1
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_lm(docs, empty):
    got = lm_scores.lm_scores(docs).collect()
    assert len(got) == len(ROWS) and lm_scores.lm_scores(empty).count() == 0
    for r in got:
        assert (r["perplexity"] is None) == (r["n_words"] == 0) and r["log_score"] <= 0


def test_licenses(spark, docs, empty):
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(empty).count() == 0
    full = licenses.TEXTS["MIT"]
    d = spark.createDataFrame([(1, "x\nReleased under the MIT License.\ny"), (2, full), (2, full), (None, "released UNDER the mit license"), (3, "see " + full.lower()), (4, " ".join(f"filler{i}" for i in range(200)) + full)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): r["dice"] for r in licenses.scan_licenses(d).collect()}
    assert got[1, "MIT"] == got[2, "MIT"] == got[None, "MIT"] == 1.0 and 0.9 < got[3, "MIT"] < 1 and (4, "MIT") not in got


def test_license_wordings(spark, tmp_path):
    cases = {
        1: ("A fine tool, as we think. This project is licensed under the MIT License. It has a manual.", {"MIT"}),  # inside a line
        2: ("Licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),  # not version 3
        3: ("This work is licensed under CC BY-SA 4.0.", {"CC-BY-SA-4.0"}),
        4: (licenses.TEXTS["BSD-3-Clause"], {"BSD-3-Clause"}),
        5: (licenses.TEXTS["LGPL-2.1"].replace("; without", ";\nwithout"), {"LGPL-2.1"}),
        6: ("This project is licensed under the Apache License, Version 2.0 - see the LICENSE file for details.", {"Apache-2.0"}),
        7: ("We were licensed to drive, and the general public liked it.", set()),
    }
    d = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    got = {k: set() for k in cases}
    for r in licenses.scan_licenses(d).collect():
        got[r["doc_id"]].add(r["license"])
    assert got == {k: want for k, (_, want) in cases.items()}
    (tmp_path / "House-1.0.txt").write_text("Whoever comes in peace may use this house, its kitchen and its well, as long as the door is closed at night.")
    own = licenses.templates_from(spark, str(tmp_path))
    note = spark.createDataFrame([(1, "whoever comes in peace may use this house, its kitchen and its well as long as the door is closed at night")], "doc_id long, text string")
    assert [(r["license"], r["dice"]) for r in licenses.scan_licenses(note, templates=own).collect()] == [("House-1.0", 1.0)]


def test_html(spark):
    p = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>a<b>b</b> c&amp;d<script>if (a<b) x</script><!-- c --> e"), (2, "u", "<p>x"), (3, "u", "<body><nav>menu</nav>"), (4, "u", "<p>" + "word, " * 200_000)], "page_id long, url string, html string")
    got = {(r["page_id"], r["n_chars"]): r["text"] for r in html_text.extract_text(p).collect()}
    assert got[1, 0] == "" and got[None, 0] == "" and got[3, 0] == "" and got[2, 1] == "x" and "ab c&d e" in got.values() and (4, 6 * 200_000 - 1) in got
    assert html_text.extract_text(p.limit(0)).count() == 0


def test_packing(docs, empty):
    got = packing.pack(docs, tokenizer_json()).collect()
    assert packing.pack(empty, tokenizer_json()).count() == 0
    whole = zlib.crc32(b"\x02\x00\x00\x00")
    assert sum(r["doc_tokens"] == 1 and r["ids_crc32"] == whole for r in got) == 4
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_decontamination(docs, empty, benchmark, block):
    got = {}
    for r in decontaminate.scan(docs, benchmark, max_bytes=block).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], r["items"]))
    assert got[1] == [(62, 25, ["1", "4"])] and got[9] == got[1] and got[2] == [(61, 23, ["1"])] * 2 and got[3] == [(0, 0, [])] and got[6][0][1] == 0
    assert decontaminate.scan(empty, benchmark).count() == 0 and decontaminate.scan(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    kept = decontaminate.decontaminate(docs, benchmark, max_bytes=block)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [3, 4, 5, 6, 7, 8]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, benchmark, remove="spans", max_bytes=block).collect() if r["doc_id"]}
    assert "term25 " not in cut[1] and "term19" in cut[1] and "second" not in cut[1] and cut[7] == LONG


def test_pipeline_stages_take_what_comes(spark, docs, empty, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "term20 term21 term22 term23 term24 term25 term26 term27 term28 term29")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for d in (docs, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, str(tmp_path))
            if k < 4:
                assert out.columns == d.columns
            out.collect()


def test_token_counts_batches_of_listings_only():
    import pyarrow as pa

    names = ["block", "postings", "n_pieces", "listing"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    listing, posting = (7, None, None, b"x"), (7, b"\x01\x00\x02", 5, None)
    for given in ([batch(listing)], [batch()], [batch(listing, posting), batch(listing)], [batch(posting), batch(posting)]):
        out = [r for b in token_counts._partial_sums(iter(given)) for r in b.to_pylist()]
        rows = [r for b in given for r in b.to_pylist()]
        assert sum(r["listing"] is not None for r in out) == sum(r["listing"] is not None for r in rows)
        assert sum(int.from_bytes(r["sums"], "little") for r in out if r["sums"]) == 10 * sum(r["postings"] is not None for r in rows)


@pytest.mark.parametrize("n, n_words", [(400, 1500), (60, 8000)])
def test_linking_long_lines_takes_little_memory(n, n_words):
    """Near copies of a long line: bytes of memory a word, over the sets themselves."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, n_words).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(n_words) < 0.2, rng.integers(0, 1 << 63, n_words).astype(np.uint64), base)) for _ in range(n)]
    tracemalloc.start()
    substring_dedup.link_like(sets, 0.8)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 32 * sum(map(len, sets))


def long_lines(n, n_words, seed=5):
    """Chains of ever fewer words of the first line, so that most aren't like the lead."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, n_words)]
    return [b" ".join(x.encode() for x in [f"n{k}" for k in range(i * n_words // 100)] + base[i * n_words // 100 :]) for i in range(n)]


def test_long_lines_are_dealt_by_their_bytes(spark, monkeypatch):
    """Few but long lines: the same components, and no task compares more than the bytes that it is allowed."""
    lines = long_lines(48, 800)
    rows = [(1, i, len(lines)) for i in range(len(lines))]
    members = spark.createDataFrame(rows, "key long, text_hash long, n long")
    texts = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(lines)], "text_hash long, line binary")
    limit = 16 * max(map(len, lines))  # a line in a piece, eight on either side
    seen = []
    real = substring_dedup._verify

    def watched(threshold, shingle):
        run = real(threshold, shingle)

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield from run(iter([b]))
                for k in {*zip(*(b.column(c).to_pylist() for c in ("key", "lo", "hi")), strict=True)}:
                    n = sum(len(s) for *at, s in zip(*(b.column(c).to_pylist() for c in ("key", "lo", "hi", "line")), strict=True) if tuple(at) == k)
                    yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([n]), pa.array([n])], ["key", "a", "b"])

        return sizes

    def found(hot_bytes):
        links = [(r["a"], r["b"]) for r in substring_dedup.verified_links(members, texts, 5, 0.8, 4096, hot_bytes).collect()]
        held = [a for a, b in links if a == b]
        seen.append(max(held))
        reach = list(range(len(lines)))
        for _ in lines:
            for a, b in links:
                if a != b:
                    reach[a] = reach[b] = min(reach[a], reach[b])
        return reach

    monkeypatch.setattr(substring_dedup, "_verify", watched)
    assert found(1 << 40) == found(limit)
    assert seen[0] >= sum(map(len, lines)) > 2 * limit >= seen[1]
