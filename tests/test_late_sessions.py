"""Sessions with allowed lateness against a plain replay of batches in arrival order."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import sessions

T0 = 1_700_000_000_000
COLUMNS = ["session_id", *sessions.COLUMNS]


def replay(batches, gap, bound, lateness):
    """Whole windows recomputed from all events that were let in, batch by batch."""
    out, inside, fired, top = [], {}, {}, None
    for batch in batches:
        now = None if top is None else top - bound
        for key in sorted({e[0] for e in batch}):
            for e in sorted((x for x in batch if x[0] == key), key=lambda x: (x[2], x[1])):
                own = inside.setdefault(key, [])
                windows = merged([*own, e], gap, fired.get(key, {}))
                mine = next(w for w in windows if any(x is e for x in w))
                end = max(x[2] for x in mine) + gap
                if now is not None and end - 1 + lateness <= now:
                    out.append((key, "late", e[2], e[2] + gap, 0, *counts([e])))
                else:
                    own.append(e)
        for key, own in inside.items():
            state = fired.setdefault(key, {})
            for w in merged(own, gap, state):
                ids = frozenset(x[1] for x in w)
                start, end = min(x[2] for x in w), max(x[2] for x in w) + gap
                if now is not None and end - 1 <= now and ids not in state:
                    before = [r for i, r in state.items() if i <= ids]
                    state[ids] = max(before, default=0) + 1
                    out.append((key, "session", start, end, state[ids], *counts(w)))
            # What is past the lateness is forgotten.
            gone = [w for w in merged(own, gap, state) if now is not None and max(x[2] for x in w) + gap - 1 + lateness <= now]
            for w in gone:
                for x in w:
                    own.remove(x)
        top = max([top or 0, *(e[2] for e in batch)])
    return sorted(out)


def merged(events, gap, _):
    out = []
    for e in sorted(events, key=lambda x: x[2]):
        if out and e[2] <= max(x[2] for x in out[-1]) + gap:
            out[-1].append(e)
        else:
            out.append([e])
    return out


def counts(events):
    kinds = [e[3] for e in events]
    return len(events), kinds.count("PRODUCT_VIEW"), kinds.count("ADD_TO_CART"), kinds.count("ORDER_PLACED"), float(sum(e[4] for e in events if e[3] == "ADD_TO_CART"))


@pytest.mark.parametrize("seed", [1, 3])
def test_late_sessions(spark, tmp_path, seed):
    rng, gap, bound, lateness = random.Random(seed), 30_000, 5_000, 120_000
    batches, t, ident = [], 0, 0
    for _ in range(9):
        batch = []
        for _ in range(rng.randint(3, 9)):
            t += rng.randint(0, 20_000)
            late = rng.choice([0, 0, 2_000, 50_000, 70_000, 90_000, 400_000])
            batch.append((rng.choice("ab"), ident, T0 + max(0, t - late), rng.choice(["PRODUCT_VIEW", "ADD_TO_CART", "ORDER_PLACED", "USER_LOGIN"]), float(rng.randint(1, 9))))
            ident += 1
        batches.append(batch)
    batches.append([("z", ident, T0 + t + 10_000_000, "USER_LOGIN", 0.0)])
    batches.append([("z", ident + 1, T0 + t + 10_000_001, "USER_LOGIN", 0.0)])
    path = str(tmp_path / "in")

    schema = "session_id string, event_id bigint, ms bigint, event_type string, value double"
    for batch in batches:
        spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are taken by their times
    stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    q = sessions.late_sessions(stream, gap, bound, lateness).writeStream.format("memory").queryName(f"late{seed}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in spark.table(f"late{seed}").collect() if r.session_id != "z")
    want = [r for r in replay(batches, gap, bound, lateness) if r[0] != "z"]
    assert got == want
    kinds = [(r[1], r[4]) for r in got]
    assert any(k == "late" for k, _ in kinds) and any(k == "session" and n > 1 for k, n in kinds)


def test_keep_must_cover_the_lateness(spark):
    with pytest.raises(ValueError):
        sessions.late_sessions(spark.readStream.format("rate").load(), keep_ms=10)


def test_many_orders_of_arrival():
    """The state machine alone, over many random streams: also sessions that fire, grow and fire again at their new end."""
    again = 0
    for seed in range(80):
        rng, gap, bound, lateness = random.Random(seed), 30_000, 5_000, 120_000
        batches, t, ident = [], 0, 0
        for _ in range(rng.randint(2, 10)):
            batch = []
            for _ in range(rng.randint(1, 9)):
                t += rng.randint(0, 20_000)
                late = rng.choice([0, 0, 2_000, 50_000, 70_000, 90_000, 400_000])
                batch.append((rng.choice("ab"), ident, T0 + max(0, t - late), rng.choice(["PRODUCT_VIEW", "ADD_TO_CART", "ORDER_PLACED"]), float(rng.randint(1, 9))))
                ident += 1
            batches.append(batch)
        batches += [[("z", ident, T0 + t + 10_000_000, "USER_LOGIN", 0.0)], [("z", ident + 1, T0 + t + 10_000_001, "USER_LOGIN", 0.0)]]
        held, top, out = {}, None, []
        for batch in batches:
            now = None if top is None else top - bound
            for key in sorted({e[0] for e in batch} | set(held)):
                s = held.setdefault(key, sessions.Sessions(gap, lateness))
                for e in sorted((x for x in batch if x[0] == key), key=lambda x: (x[2], x[1])):
                    out += [(key, *r) for r in s.event(e[2], e[3], e[4], now)]
                out += [(key, *r) for r in s.fire(now)]
            top = max([top or 0, *(e[2] for e in batch)])
        assert sorted(out) == replay(batches, gap, bound, lateness)
        again += sum(r[4] > 1 for r in out)
    assert again > 20
