"""Inputs that earlier versions of the operators left out."""

from __future__ import annotations

import random
import time

import pytest

from quern.llm import simhash
from quern.llm.html_text import main_text


def grams(words, n=5):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def contiguous_edit(kind, words, share, fresh):
    """``words`` with a share of its length cut, replaced or added in one place."""
    k = round(len(words) * share)
    if kind == "tail cut":
        return words[:-k]
    if kind == "head and tail cut":
        return words[k // 2 : k // 2 - k]
    if kind == "block replaced":
        return words[:100] + fresh[: k // 2] + words[100 + k // 2 :]
    return words + fresh[:k]


@pytest.mark.parametrize("kind", ["tail cut", "head and tail cut", "block replaced", "text appended"])
def test_near_duplicates_by_kind_of_edit(spark, kind):
    rng = random.Random(kind)
    rows, pairs = [], 0
    for i in range(100):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(250, 500))]
        copy = contiguous_edit(kind, words, rng.uniform(0.15, 0.165 if kind == "block replaced" else 0.19), [f"n{rng.randrange(10**6)}" for _ in range(200)])
        a, b = grams(words), grams(copy)
        assert 0.8 <= len(a & b) / len(a | b) <= 0.87
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        pairs += 1
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} <= {r["doc_id"] for r in got} and all(r["component_id"] in (r["doc_id"], r["doc_id"] - r["doc_id"] % 2) for r in got)
    found = sum(r["doc_id"] % 2 == 1 and r["component_id"] == r["doc_id"] - 1 for r in got)
    print(kind, found, pairs)
    assert found >= 0.99 * pairs


def paragraphs(n, length, word):
    return [f"{word}{i}, " + "said more. " * (length // 11) for i in range(n)]


@pytest.mark.parametrize("page", [
    "<article><p class=lead>{lead}</p><div class=body>{body}</div></article>",
    "<div><section class=intro><p>{lead}</p></section><div class=body>{body}</div></div>",
    "<main><div class=body>{body}</div><section class=conclusion><p>{lead}</p></section></main>",
    "<article><div class=body>{body}</div><div class=notes><p class=note><a href=x>{lead}</a></p></div></article>",
])
def test_sections_of_other_classes(page):
    lead, body = paragraphs(1, 200, "lead"), paragraphs(8, 400, "body")
    got = main_text("<html><body><nav><a href=x>menu</a></nav>" + page.format(lead=lead[0], body="".join(f"<p>{x}</p>" for x in body)) + "<footer>imprint</footer></body></html>")
    assert all(x.strip() in got for x in lead + body) and "menu" not in got and "imprint" not in got


BROKEN = {
    "nested, unclosed": "<div>x, y. ",
    "one class each": "<div class=c>t, and. <p class='x y'>z ",
    "unclosed quotes": '<a "x ',
    "quoted ends": '<a x=">" ',
    "no end at all": "<script ",
    "items": "<ul><li><ul><div><li>a, b</li>",
    "closed twice": "<div>a, b.</div></div></p>",
    "cells": "<td>x, y.<table><tr>",
    "comments": "<!-- x ",
    "equals signs": "<a = = ",
    "angles": "< <",
}


@pytest.mark.parametrize("kind", sorted(BROKEN))
def test_broken_markup_takes_time_by_length(kind):
    unit = BROKEN[kind]
    took = []
    for size in (250_000, 1_000_000):
        began = time.perf_counter()
        main_text(unit * (size // len(unit)))
        took.append(time.perf_counter() - began)
    assert took[1] < 8 and took[1] < 12 * took[0] + 0.5  # four times the length; quadratic time would be sixteen times


def test_path_decides_for_all_its_blocks():
    body = "".join(f"<p>{x}</p>" for x in paragraphs(6, 300, "body"))
    links = "".join(f"<li><a href=x>link {i}</a></li>" for i in range(9))
    cells = "".join(f"<tr><td>{i}</td><td>cell {i}</td></tr>" for i in range(4))
    got = main_text(f"<div class=text><h2>Head</h2>{body}<ul class=more>{links}</ul><table>{cells}</table></div><div class=x><ul>{links}</ul></div>")
    assert got.startswith("Head body0,") and "link" not in got and got.endswith("3 cell 3")
