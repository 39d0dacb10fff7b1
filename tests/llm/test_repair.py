"""Conversation repair against exhaustive search; long conversations in pieces; nulls, ties, repeated rows, empty tables."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """rows: (role, text, dead, cut). The cheapest, then ASCII-least edits by uniform-cost search over whole prefixes, and the lines."""
    heap, limit = [(0, "", 0, ())], 0
    while heap:
        cost, audit, i, lines = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in lines)
        if i == len(rows) and SHAPE.match(initials):
            return cost, audit, lines
        limit += 1
        assert limit < 400_000
        follows = [x for x in ("user", "assistant") if _prefix(initials + x[0])]
        for x in follows:
            heapq.heappush(heap, (cost + 2, audit + "I", i, (*lines, (x, ""))))
        if i < len(rows):
            role, text, dead, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, lines))
            if not dead:
                if _prefix(initials + role[:1]) and role[:1]:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, (*lines, (role, text))))
                for x in follows:
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, (*lines, (x, text))))


def _prefix(initials):
    return re.match(r"s?(ua)*u?\Z", initials) is not None


def damage(rows):
    out = []
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(c, t, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def plain(rows, ids, solve=cheapest):
    out = []
    for c in ids:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, coded, faults = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            which = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if which is not None:
                faults[which] += 1
            coded.append((role, text, which in (0, 1), int(which == 2)))
        turns = [t for _, t, _, _ in own if t is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        cost, audit, lines = solve(coded)
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "user", "assistant", "assistant", "tool", ""]), st.booleans(), st.booleans()), max_size=7)


@settings(max_examples=300, deadline=None)
@given(ROWS, st.integers(1, 3))
def test_search_is_exhaustive_search(rows, cut_at):
    coded = [repair.Row(role, "t", dead, cut and not dead) for role, dead, cut in rows]
    want = cheapest([(r.role, r.text, r.dead, int(r.cut)) for r in coded])
    assert repair.search(coded, repair.NONE, (repair.NONE, repair.A), True) == want[:2]
    assert tuple(repair.lines(coded, repair.NONE, want[1])) == want[2]
    # The same in pieces: the fold takes the best way over all states between them.
    fold = repair.Fold()
    for a in range(0, len(coded), cut_at):
        piece = repair.Piece()
        for i, r in enumerate(coded[a : a + cut_at]):
            piece.add(r, a + i, False, False, bool(r.cut))
        fold.add(piece)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in want[2]).encode()).hexdigest()
    assert fold.result()[5:] == [*want[:2], digest]


def conversations(seed, n):
    rng = random.Random(seed)
    out = []
    for c in [*range(n), None]:
        said = []
        for t in range(rng.randint(0, 6)):
            text = rng.choice([None, "", " \n", "Yes.", "No", "What?", "long " * 40 + "!", *said])
            said.append(text)
            out.append((c, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "tool"]), text))
        if rng.random() < 0.3 and out:
            out.append(out[-1])
    return out


@pytest.mark.parametrize("piece", [repair.PIECE_ROWS, 2])
def test_repair(spark, piece, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    rows = conversations(piece, 60)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part string, audit int").repartition(3)
    ids = {r[0] for r in rows}
    assert got(repair.repair(repair.damaged(df), df.select("conv_id"))) == plain(damage(rows), ids)
    assert got(repair.repair(df)) == plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], ids)


def test_long_conversation_and_empty_table(spark, monkeypatch):
    """One conversation of most rows, over several tasks; the plain version works piece by piece on its costs only."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Fine.", f"Part {t}", f"So {t}.", ""])) for t in range(6000)] + [(8, 1, "user", "Hm?"), (8, 2, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    monkeypatch.setattr(repair, "PIECE_ROWS", 100)
    many = {r["conv_id"]: r for r in repair.repair(df).collect()}
    monkeypatch.setattr(repair, "PIECE_ROWS", 1 << 20)
    one = {r["conv_id"]: r for r in repair.repair(df.coalesce(1)).collect()}
    assert many == one and many[8]["audit"] == "KK" and many[7]["cost"] > 0
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.repair(none).count() == 0 and repair.repair(repair.damaged(none), none.select("conv_id")).count() == 0
    lone = repair.repair(none, spark.createDataFrame([(5,)], "conv_id bigint")).collect()
    assert [tuple(r) for r in lone] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
