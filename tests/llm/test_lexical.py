"""Ranked search against a plain version: ties, repeated rows, nulls, empty tables, several segments and blocks of queries."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items, k=10):
    """(item, rank, doc_id, score) of every query row."""
    of = [(i, terms(t)) for i, t in docs]
    n, length = sum(1 for _, w in of if w), sum(len(w) for _, w in of)
    df = Counter(x for _, w in of for x in set(w))
    out = []
    for item, text in items:
        q, hits = Counter(terms(text)), []
        for i, w in of:
            tf, m = Counter(w), 25 + (75 * len(w) * n) // max(length, 1)
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x, c in q.items() if tf[x])
            if s > 0:
                hits.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(hits)[:k], 1)]
    return out


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_search(spark, frame, docs, bench, empty, monkeypatch):
    b = spark.createDataFrame([(i, t, "x") for i, t in bench], "item_id int, text string, doc_id string")
    want = sorted(plain(docs, bench), key=repr)
    assert rows(lexical.search(lexical.build(frame), b)) == want
    for name, value in (("SLICE", 2000), ("FIRST_VISIT", 1), ("QUERY_BYTES", 200)):  # many segments, visits and blocks
        monkeypatch.setattr(lexical, name, value)
    assert rows(lexical.search(lexical.build(frame), b)) == want
    assert lexical.search(lexical.build(empty), b).count() == 0
    assert lexical.search(lexical.build(frame), b.filter("false")).count() == 0
    assert lexical.search(lexical.build(frame), spark.createDataFrame([(1, None), (2, "never-seen")], "item_id int, text string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_search_of_frequent_terms_and_ties(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(lexical, "SLICE", 3000)
    monkeypatch.setattr(lexical, "FIRST_VISIT", 2)
    words = ["alpha", "Beta", "gamma", "delta", "ép", "x9"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, [40, 20, 9, 5, 3, 2] + [1] * 40, k=rng.choice([1, 2, 5, 5, 30, 200])))) for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(20)] + [(3, "alpha alpha ALPHA beta")]
    got = lexical.search(lexical.build(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)), spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows(got) == sorted(plain(docs, items), key=repr)


def test_strata_without_a_chance_are_not_scored(spark, monkeypatch):
    """With a rare term in short texts, long texts of a common one cannot reach the best ten: their strata are never visited."""
    docs = [(i, "rare") for i in range(20)] + [(100 + i, "common " * (50 + i)) for i in range(500)]
    visited = []
    real = lexical.Searcher._keep
    monkeypatch.setattr(lexical.Searcher, "_keep", lambda self, q, docs, *a: (visited.append(len(docs)), real(self, q, docs, *a))[1])
    monkeypatch.setattr(lexical, "FIRST_VISIT", 16)
    s = lexical.segment(pa.array([i for i, _ in docs]), pa.array([t for _, t in docs]), len(docs), sum(len(terms(t)) for _, t in docs))
    task = lexical.Searcher([[(0, 1), (1, 1)]], pa.array([b"common", b"rare"], pa.binary()), np.array([1, 5000]), 10)
    n = np.frombuffer
    task.visit(s["ids"], n(s["m"], "i8"), s["names"], n(s["df"], "i4"), n(s["doc"], "i4"), n(s["tf"], "i4"))
    assert [v for _, _, v in task.queries[0].best] == list(range(10)) and sum(visited) < 100
