"""Queries over the whole of their tables, where others take a part."""

from __future__ import annotations

import hashlib

from quern.operators.sequences import turn_ancestors
from quern.registry import QUERIES


def test_archive_takes_all_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r["text"]}
    got = {r["doc_id"]: (r["digest"], r["n_chunks"]) for r in QUERIES["archive_round_trip"](spark, sf_dir).collect()}
    assert got == {i: (hashlib.sha256(t.encode()).hexdigest(), -(-len(t) // 1024)) for i, t in docs.items()}


def figures(k):
    """(health, load, rtt_us, online) of an edge, as tables.edges has them."""
    return 1 - k % 10 / 20, k % 11 / 10, 1000.0 * (1 + k % 53), k % 13 != 0


def copies_of(spark, sf_dir):
    edges = [r[0] for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").collect()]
    held = {}
    for c, e in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect():
        held.setdefault(c, set()).add(e)
    return edges, held


def test_repair_takes_all_chunks_and_edges(spark):
    sf = "/root/testdata/sf0.01"  # has chunks over 200 and edges over 60
    edges, held = copies_of(spark, sf)
    want_target, want_copies = {}, set()
    for c, own in held.items():
        domains = {e % 8 for e in own if e in set(edges)}
        score = {e: (0 if e % 8 in domains else 100) + (50 if e % 5 == 0 else 0) + (25 if figures(e)[1] < 0.8 else 0) + (100 - min(figures(e)[2] / 1000, 100)) / 10 for e in edges if figures(e)[3]}
        want_target[c] = max(score, key=lambda e: (score[e], -e))
        peers = sorted((e for e in edges if figures(e)[3] and e not in own), key=lambda e: (-figures(e)[0], e))
        want_copies |= {(c, e) for e in peers[: max(0, 32 - len(own))]}
    assert max(held) > 200 and max(edges) > 60
    assert {r["chunk"]: r["target"] for r in QUERIES["repair_target"](spark, sf).collect()} == want_target
    got = [tuple(r) for r in QUERIES["replication_repair"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want_copies


def walks(turns):
    """All (start, node, depth) of (conv_id, turn) pairs, one parent at a time."""
    first = {}
    for c, t in turns:
        first[c] = min(t, first.get(c, t))
    out = set()
    for c, t in turns:
        at, depth = t, 0
        out.add(((c, t), (c, t), 0))
        while at > first[c] and (c, at) in turns:
            at, depth = at - 1, depth + 1
            out.add(((c, t), (c, at), depth))
    return out


def test_ancestors_of_all_turns(spark, sf_dir):
    turns = {tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").collect()}
    got = [(tuple(r["start"]), tuple(r["node"]), r["depth"]) for r in QUERIES["ancestor_walk"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == walks(turns)


def test_ancestors_beyond_a_thousand_turns(spark):
    turns = {(1, t) for t in range(990, 1030)} | {(2, t) for t in range(5)} | {(3, 1), (3, 2), (3, 4)}
    got = turn_ancestors(spark.createDataFrame(sorted(turns), "conv_id long, turn long")).collect()
    assert {(tuple(r["start"]), tuple(r["node"]), r["depth"]) for r in got} == walks(turns)
