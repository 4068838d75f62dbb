"""Byte functions, stores and merges against plain Python."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions.text_bytes import buz_table, buzhash_cuts, erasure_decode, erasure_encode, layered_cuts, sequence_cuts, smallest_period
from quern.operators.aggregates import g_counter
from quern.operators.joins import numbered
from quern.operators.setops import diff, or_set_merge
from quern.sources.listing import ObjectTable, list_objects


def sequence_by_byte(data, least, most, length, trigger, skip):
    out, size, window, against, jump = [], 0, [], 0, 0
    for i, b in enumerate(data):
        size += 1
        if jump:
            jump -= 1
            if not jump:
                window, against = [], 0
            continue
        if window:
            against = against + 1 if window[-1] >= b else 0
        window = (window + [b])[-length:]
        if size >= least and (len(window) == length and all(x < y for x, y in zip(window, window[1:])) or size >= most):
            out.append(i + 1)
            size, window, against = 0, [], 0
            continue
        if against >= trigger and size < least:
            jump, against = min(skip, least - size), 0
    return out + [len(data)] * (not out or out[-1] != len(data)) if len(data) else out


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 1500), st.sampled_from([(16, 64, 3, 4, 8), (40, 200, 5, 6, 20), (8, 32, 4, 50, 3)]), st.sampled_from([3, 20, 256]))
def test_sequence_cuts(seed, n, sizes, letters):
    data = np.random.default_rng(seed).integers(0, letters, n).astype(np.uint8)
    least, most, length, trigger, skip = sizes
    assert sequence_cuts(data, least, most, length, trigger, skip) == sequence_by_byte(data.tolist(), least, most, length, trigger, skip)


def test_buzhash_cuts():
    table, full = buz_table().tolist(), (1 << 64) - 1

    def turn(x, n):
        n %= 64
        return ((x << n) | (x >> (64 - n))) & full if n else x

    rng = random.Random(3)
    for n in (0, 1, 47, 48, 500, 5000):
        data = bytes(rng.randrange(256) for _ in range(n))
        out, h, window, size = [], 0, [], 0
        for i, b in enumerate(data):
            if len(window) >= 48:
                h ^= turn(table[window.pop(0)], 48)
            window.append(b)
            h = turn(h, 1) ^ table[b]
            size += 1
            if size >= 64 and ((h & 255) == 0 or size >= 1024):
                out.append(i + 1)
                h, window, size = 0, [], 0
        if n and (not out or out[-1] != n):
            out.append(n)
        assert buzhash_cuts(np.frombuffer(data, np.uint8), 64, 256, 1024) == out


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=4000))
def test_layered_cuts_cover(data):
    cuts = layered_cuts(np.frombuffer(data, np.uint8), 32, 256)
    sizes = np.diff([0, *cuts])
    assert (cuts[-1] if cuts else 0) == len(data) and (sizes > 0).all() and (sizes <= 256).all()


def test_period():
    assert smallest_period(np.array([1, 2, 3] * 4)) == 3
    assert smallest_period(np.array([1, 2, 3, 4])) == 4


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 6), st.integers(0, 4), st.randoms())
def test_erasure(data, k, m, rnd):
    shards = dict(enumerate(erasure_encode(data, k, m)))
    for lost in rnd.sample(sorted(shards), m):
        del shards[lost]
    assert erasure_decode(shards, k, m, len(data)) == data


def test_numbered(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as k")
    assert sorted(tuple(r) for r in numbered(df, "k").collect()) == [(i, i + 1) for i in range(1000)]


def test_merges_are_lattices(spark):
    rng = random.Random(1)
    parts = [spark.createDataFrame([(rng.randrange(3), rng.randrange(4), rng.randrange(9)) for _ in range(20)], "element long, node long, dot long") for _ in range(3)]
    a, b, c = parts
    want = sorted(tuple(r) for r in or_set_merge(a, b, c).collect())
    assert sorted(tuple(r) for r in or_set_merge(or_set_merge(c, a), b, b).collect()) == want

    def count(*dfs):
        out = dfs[0]
        for d in dfs[1:]:
            out = out.unionByName(d)
        return sorted(tuple(r) for r in g_counter(out, ["element"], "node", "dot").collect())

    assert count(a, b, c) == count(c, b, a, a)


def test_diff_is_inverted_by_swapping(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert {r["k"]: r["state"] for r in diff(a, b, "k", ["v"]).collect()} == {1: "removed", 2: "modified", 3: "unchanged", 4: "added"}
    assert {r["k"]: r["state"] for r in diff(b, a, "k", ["v"]).collect()} == {1: "added", 2: "modified", 3: "unchanged", 4: "removed"}


def test_listing(spark):
    o = spark.createDataFrame([("a/1", 1), ("a/2", 2), ("b", 3), ("a/c/4", 4)], "key string, size int")
    got = [tuple(r) for r in list_objects(o, "a/", "/").orderBy("entry").collect()]
    assert got == [("a/1", False, 1), ("a/2", False, 2), ("a/c/", True, 4)]
    assert [r["entry"] for r in list_objects(o, "", None, "a/1", 2).collect()] == ["a/2", "a/c/4"]


def test_object_table(spark, tmp_path):
    t = ObjectTable(spark, str(tmp_path / "objects"))
    assert t.head().count() == 0
    def rows(*kv):
        return spark.createDataFrame(list(kv), "key string, data binary")

    t.put(rows(("a", b"1"), ("b", b"2")))
    t.put(rows(("a", b"3"), ("c", b"4")), if_none_match=True)
    t.put(rows(("b", b"5")))
    assert {r["key"]: (bytes(r["data"]), r["version"]) for r in t.head().collect()} == {"a": (b"1", 1), "b": (b"5", 2), "c": (b"4", 1)}
    t.delete(spark.createDataFrame([("a",)], "key string"))
    assert t.get("a").count() == 0 and t.head().count() == 2
