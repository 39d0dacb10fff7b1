"""The chain of stages against plain versions of each."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, repetition string, relative_lz int, __key string, __hash string, __id int"


def cut_text(text, mask):
    """Runs of kept words as they stood, joined by a blank; the text itself where nothing goes."""
    if not any(mask):
        return text
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
    runs = [[i for i in range(len(at)) if not mask[i]]]
    kept, out = runs[0], []
    for k, i in enumerate(kept):
        if k and kept[k - 1] == i - 1:
            out[-1][1] = at[i][1]
        else:
            out.append(list(at[i]))
    return b" ".join(text.encode()[a:b] for a, b in out).decode()


def expected(rows, bench, hash_of):
    """(id, text) of what is left before the last stage."""
    from tidemark.llm import repetition

    good = []
    for i, t in rows:
        base = brute.op2_base(t)
        if not base[-1]:
            chars, longest = brute.covered(t, repetition.MIN_WORDS) if base[0] < 700 else (0, 0)
            if chars <= repetition.MAX_FRACTION * base[1] and longest <= repetition.MAX_LONGEST:
                good.append((i, t))
    best = {}
    for (i, t), c in zip(good, brute.op6_groups(good)[1], strict=True):
        rank = (i is None, i, hash_of[t])
        if c not in best or rank < best[c][0]:
            best[c] = (rank, (i, t))
    now = [x for _, x in best.values()]
    cut = [(i, cut_text(t, m)) for (i, t), (_, _, m) in zip(now, brute.op8_kept(now), strict=True)]
    return [(i, t) for (i, t), r in zip(cut, brute.op5(cut, bench), strict=True) if not r[5]]


def test_pipeline(spark, docs, bench, tmp_path):
    import tiktoken

    import corpus_pipeline
    from tidemark.llm.bpe_files import default_path, default_pattern, ranks

    from .conftest import _prose

    rng = random.Random(9)
    again = _prose(rng, 90)
    more = [(501, again), (501, again), (501, _prose(rng, 70)), (502, again + " tail"), (503, again.replace(" ", "\n", 5)), (None, _prose(rng, 80)), (600, " ".join(dict(docs[:8])[6].split()[:40]) + "  " + _prose(rng, 60))]
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "r", 1, "k", "h", 2) for i, t in [*docs, *more]]
    sf = str(tmp_path)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    table.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id int, text string").write.parquet(f"{sf}/benchmark.parquet")
    hash_of = {r.text: r.h for r in table.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    want = expected([(i, t) for i, t, *_ in rows], bench, hash_of)

    stages = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, sf)
        assert stages.columns == table.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in stages.collect()), key=repr) == sorted(((i, t, len(t)) for i, t in want), key=repr)

    enc = tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=ranks(default_path("byte_bpe_50k.tiktoken")), special_tokens={})
    coded = []
    for i, t in want:
        ids = enc.encode_ordinary(t)
        coded.append((i, len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t.encode())))
    got = [(r.doc_id, r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(coded, key=repr)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_goes_on_where_it_ended(spark, docs, bench, tmp_path, monkeypatch):
    """A stage that fails ends a run; the next of its name does the rest only, and leaves one result and no scratch tables."""
    import pathlib

    import pytest

    import corpus_pipeline
    from tidemark.llm import common

    sf, base = str(tmp_path / "in"), tmp_path / "shared"
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id int, text string").write.parquet(f"{sf}/benchmark.parquet")
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: str(base))
    began, stages = [], list(corpus_pipeline.STAGES)

    def noted(name, stage, fails):
        def run(*a):
            began.append(name)
            if fails:
                raise RuntimeError(name)
            return stage(*a)

        return name, run

    want = sorted((tuple(r) for r in corpus_pipeline.run(spark, sf).collect()), key=repr)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(n, f, i == 3) for i, (n, f) in enumerate(stages)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf, "a")
    assert len(began) == 4
    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(n, f, False) for n, f in stages])
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, sf, "a").collect()), key=repr) == want
    assert began[4:] == [n for n, _ in stages[3:]]
    assert sorted(p.name for p in pathlib.Path(base, "tidemark", "pipeline-a").iterdir() if not p.name.startswith(".")) == ["4", "input"]
    spark.createDataFrame(docs[:3], "doc_id bigint, text string").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    with pytest.raises(ValueError):
        corpus_pipeline.run(spark, sf, "a")
    assert common._UNDER.get() is None
