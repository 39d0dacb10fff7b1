"""The chain's marginals against enumeration, the gradient against differences, held-out accuracy, and defined cases."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F
from tidemark.llm import toxicity


def enumerated(e, trans):
    """(marginals, log partition function, expected transitions) over all taggings."""
    total, marg, moves = 0.0, np.zeros(len(e)), np.zeros(3)
    for tags in itertools.product((0, 1), repeat=len(e)):
        s, before, counts = 0.0, 0, np.zeros(3)
        for x, t in zip(e, tags, strict=True):
            s += x * t
            for k, pair in enumerate(((0, 1), (1, 0), (1, 1))):
                if (before, t) == pair:
                    s += trans[k]
                    counts[k] += 1
            before = t
        w = np.exp(s)
        total, marg, moves = total + w, marg + w * np.array(tags), moves + w * counts
    return marg / total, np.log(total), moves / total


@pytest.mark.parametrize("segment", [1, 2, 3, 128])
def test_marginals(segment, monkeypatch):
    monkeypatch.setattr(toxicity, "SEGMENT", segment)
    rng = np.random.default_rng(segment)
    sizes = [0, 1, 5, 0, 8, 3, 7, 0]
    at = np.r_[0, np.cumsum(sizes)]
    e, trans = rng.normal(size=at[-1]) * 2, rng.normal(size=3)
    p, log_z, moves = toxicity.Chain(e, at, trans).run(pairs=True)
    want = [enumerated(e[a:b], trans) for a, b in itertools.pairwise(at)]
    assert np.allclose(p, np.concatenate([w[0] for w in want]))
    assert np.isclose(log_z, sum(w[1] for w in want))
    assert np.allclose(moves, sum(w[2] for w in want))


def test_log_partition_does_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(1)
    at = np.array([0, 300, 310, 1000])
    e, trans = rng.normal(size=1000), np.array([-1.0, 0.5, 1.0])
    out = []
    for segment in (4, 128, 2000):
        monkeypatch.setattr(toxicity, "SEGMENT", segment)
        p, log_z, _ = toxicity.Chain(e, at, trans).run(pairs=True)
        out.append((p, log_z))
    for p, log_z in out[1:]:
        assert np.allclose(p, out[0][0]) and np.isclose(log_z, out[0][1])


def table(spark, n=900):
    """Documents with insults in a tenth, in two spellings of which one only shows by how words begin; copies of clean and toxic ones."""
    rng = random.Random(2)
    parts = ["ba", "do", "ku", "mi", "ra", "te", "zo", "li"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.15
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["Grubble", "snarfy", f"vexo{word()}"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(10_000 + k, docs[0][1]) for k in range(50)] + [(20_000, None), (20_001, ""), (None, "Grubble snarfy"), (20_002, "x " * 40_000 + "snarfy"), (5, docs[5][1])]
    labels += [(10_000 + k, labels[0][1]) for k in range(50)] + [(20_000, None), (None, 1), (3, labels[3][1])]
    return docs, labels


def test_held_out_accuracy_and_spans(spark):
    docs, labels = table(spark)
    d = spark.createDataFrame([(i, t, "c", 0.1) for i, t in docs], "doc_id bigint, text string, __id string, score double").repartition(4)
    lab = spark.createDataFrame([(i, x, "c") for i, x in labels], "doc_id bigint, toxic int, text string")
    model = toxicity.fit(d, lab.filter(~toxicity.held_out()))
    assert b"grubble" in model.offending[0] and b"vexo" in model.offending[1]
    rows = toxicity.score(d, model).collect()
    assert len(rows) == len(docs) and rows[0]["score"] == 0.1
    truth = {i: x for i, x in labels if i is not None}
    held = [(r["toxicity"]["score"] >= 0.5, truth[r["doc_id"]]) for r in rows if r["doc_id"] is not None and truth.get(r["doc_id"]) is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in rows}
    assert by[20_000]["toxicity"]["n_tokens"] == 0 and by[20_001]["toxicity"]["score"] == by[20_000]["toxicity"]["score"] < 0.5
    assert by[None]["toxicity"]["score"] > 0.5 and by[20_002]["toxicity"]["n_tokens"] == 40_001
    last = by[20_002]["toxicity"]["spans"][-1]
    assert by[20_002]["text"][last["start"] : last["end"]] == "snarfy"
    assert all(0 <= r["toxicity"]["score"] <= 1 for r in rows)
    found = [any(x in r["text"][s["start"] : s["end"]].lower() for x in ("grub", "snar", "vexo")) for r in rows for s in r["toxicity"]["spans"]]
    assert len(found) > 200 and sum(found) >= 0.95 * len(found)


def test_gradient_of_the_likelihood(spark):
    """The sums that a task gives are the derivative of its value."""
    import pyarrow as pa

    names = pa.array([b"abcdefgh", b"abcd", b"q", b"zzzzz"], pa.large_binary())
    f = toxicity.Features(pa.array([b"abcd", b"q"], pa.large_binary()), pa.array([b"abcd", b"zzzz"], pa.large_binary()))
    term, starts = f.of(names)
    rng = np.random.default_rng(0)
    code, at, tags = np.array([0, 1, 2, 3, 3, 0, 2]), np.array([0, 3, 3, 7]), np.array([0, 1, 0, 0, 1, 1, 0], bool)

    def value(w, gradient=False):
        e = f.scores(w, term, starts, code, at)
        trans = w[f.bias + 1 :]
        p, log_z, moves = toxicity.Chain(e, at, trans).run(pairs=True)
        before = np.r_[False, tags[:-1]]
        before[at[:-1]] = False
        own = np.array([(~before & tags).sum(), (before & ~tags).sum(), (before & tags).sum()])
        g = f.gradient(p - tags, term, starts, code, at)
        g[f.bias + 1 :] += moves - own
        return (log_z - e[tags].sum() - own @ trans, g)[gradient]

    w = rng.normal(size=f.size)
    g = value(w, True)
    for i in range(f.size):
        d = np.zeros(f.size)
        d[i] = 1e-5
        assert np.isclose((value(w + d) - value(w - d)) / 2e-5, g[i], atol=1e-5)


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r[0] for r in toxicity.score(d, toxicity.fit(d, none)).select("toxicity.score").collect()} == {0.0}
    every = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, toxic int")
    assert {r[0] for r in toxicity.score(d, toxicity.fit(d, every)).select("toxicity.score").collect()} == {1.0}
    assert toxicity.score(d.filter(F.lit(False)), toxicity.fit(d, none)).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(d.withColumn("toxicity", F.lit(1)), toxicity.Model(0.0))
