from __future__ import annotations

import random

import numpy as np
from tidemark.llm import bwt_merge, jaccard_join, packed, relative_lz
from tidemark.llm.common import column, part_of
from tidemark.llm.packed import chunks, gathered, parcels, rows, split, steps, unpack

from . import brute


def _sent(slices, parts, rng):
    for i in range(slices):
        body = [f"{i}-{p}".encode() * rng.randint(0, 40) for p in range(parts)]
        yield rows(list(range(parts)), body, i % 2 == 0)
    yield rows([], [], True)


def test_gathered_keeps_every_parcel():
    for most in (1, 3_000, 1 << 20):
        want, got = [], []
        for batch in _sent(30, 7, random.Random(3)):
            for part, settled, body in zip(*(column(batch, c).to_pylist() for c in ("__part", "__settled", "__body")), strict=True):
                want.append((part, settled, body[4:]))
        for batch in gathered(_sent(30, 7, random.Random(3)), most):
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                got += [(column(one, "__part")[0].as_py(), column(one, "__settled")[0].as_py(), bytes(x)) for x in parcels(one)]
        assert sorted(got) == sorted(want)


def test_rows_do_not_grow_with_slices():
    counts = [sum(len(b) for b in gathered(_sent(n, 7, random.Random(3)))) for n in (10, 100, 1000)]
    assert counts == [14, 14, 14]


def test_split_parts_kinds():
    settled, waiting = split(gathered(_sent(9, 5, random.Random(1))))
    passed = sum(len(parcels(b)) for b in settled)
    assert passed == 25 and len(waiting) == 20


def test_gathered_of_nothing():
    assert list(gathered(iter([]))) == []


def _parcels_of(n, parts, span):
    rng = np.random.default_rng(5)
    h, text = rng.integers(0, 2**64, n, dtype=np.uint64), np.sort(rng.integers(0, 50, n))
    return h, text, np.arange(n), list(chunks(h, text, parts, [np.arange(50) * 7], np.arange(n), 8, span))


def test_chunks_hold_every_triple():
    for parts, span in ((1, 1), (8, 1), (1000, 1), (1000, 32)):
        h, text, place, sent = _parcels_of(3000, parts, span)
        got = set()
        for p, body in sent:
            own, at, (ids,), where = unpack([body], 8)
            assert (part_of(own, parts) // span == p).all()
            got |= set(zip(own.tolist(), ids[at].tolist(), where.tolist(), strict=True))
        assert got == set(zip(h.tolist(), (text * 7).tolist(), place.tolist(), strict=True))
    assert list(chunks(h[:0], text[:0], 8, [place], place[:0], 8)) == []


def test_parcels_of_a_slice_do_not_grow_with_parts():
    """A slice of some 180,000 triples makes far fewer parcels than triples, at any number of parts."""
    for parts in (200, 4096, 20_000, 200_000, 2_000_000):
        groups, span = steps(parts)
        assert groups * span >= parts and (groups - 1) * span < parts
        assert groups <= 4096 and span <= 4096


def test_two_steps_give_the_rows_of_one(frame, docs, monkeypatch):
    monkeypatch.setattr(packed, "ONE_STEP", 1)
    assert steps(4)[1] > 1
    flat = relative_lz.parse(frame).select("doc_id", "relative_lz.n_words", "relative_lz.n_removed", "relative_lz.kept_sha256")
    assert sorted(map(tuple, flat.collect()), key=repr) == sorted(brute.op8(docs), key=repr)
    out = bwt_merge.dedup(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(brute.op9(docs), key=repr)
    linked = jaccard_join.jaccard_components(frame).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, linked.collect()), key=repr) == sorted(brute.op6(docs), key=repr)
