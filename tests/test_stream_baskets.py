"""Baskets, rules and the pattern store as streams against their batch forms."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import baskets, recommend
from tidemark.streaming import baskets as streams
from tidemark.streaming import store

MINUTE = 60_000_000
END = 10**15


def written(spark, df, path, batches, order=("us", "event_id"), late_rows=True):
    """df as files, one a batch, shuffled within each; a last one moves the watermark past all."""
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        part = rows[k : k + size]
        if late_rows:
            random.Random(k).shuffle(part)
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    flush = rows[-1].asDict() | {"us": END}
    flush = {k: ("flush" if isinstance(v, str) and k in ("session_id", "user_id") else v) for k, v in flush.items()}
    if "event_type" in flush:
        flush["event_type"] = "USER_LOGIN"
    last = spark.createDataFrame([tuple(flush[c] for c in df.columns)], df.schema)
    if "ts" in df.columns:
        last = last.withColumn("ts", F.timestamp_micros("us"))
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return df.sparkSession.table(name)


def shop(spark, seed=1, n=400):
    rng, rows, t = random.Random(seed), [], 0
    kinds = ["PRODUCT_VIEW"] * 12 + ["ADD_TO_CART"] * 8 + ["REMOVE_FROM_CART"] * 2 + ["ORDER_PLACED", "CHECKOUT_COMPLETE", "PAYMENT_PROCESSED", "USER_LOGIN"]
    for i in range(n):
        t += rng.choice([0, 1, 2, 4]) * MINUTE
        kind = rng.choice(kinds)
        session = "busy" if rng.random() < 0.4 else f"s{rng.randint(0, 5)}"
        rows.append((session, i, kind, rng.choice("abcdef"), float(rng.randint(1, 90)), t))
    rows += [("views", n + k, "PRODUCT_VIEW", f"v{k}", 1.0, t + k) for k in range(70)] + [("views", n + 70, "ADD_TO_CART", "a", 2.0, t + 70), ("views", n + 71, "ORDER_PLACED", None, 0.0, t + 71)]
    return spark.createDataFrame(rows, "session_id string, event_id bigint, event_type string, product_id string, value double, us bigint").withColumn("ts", F.timestamp_micros("us"))


COLUMNS = ["session_id", "kind", "at_us", "n_items", "items", "total_value", "views"]


@pytest.mark.parametrize("mode,adjust", [("original", False), ("refactored", True)])
def test_carts(spark, tmp_path, mode, adjust):
    df = shop(spark)
    stream = written(spark, df, str(tmp_path / "in"), 6)
    got = run(streams.carts(stream, mode, 10 * MINUTE, True, "3 hours", adjust_total_on_remove=adjust), tmp_path, f"carts_{mode}")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in got.collect())
    want = sorted(tuple(r[c] for c in COLUMNS) for r in baskets.carts(df, mode, 10 * MINUTE, adjust_total_on_remove=adjust, horizon_us=END - 3 * 3600 * 10**6).collect())
    assert got == want
    kinds = [r[1] for r in got]
    assert kinds.count("completed") > 5 and kinds.count("timeout") > 2
    viewed = next(r for r in got if r[0] == "views")
    assert viewed[-1].split(",") == [f"v{k}" for k in range(20, 70)]


def test_modes_differ(spark):
    rows = [("s", 1, "ADD_TO_CART", "a", 1.0, 1), ("s", 2, "PAYMENT_PROCESSED", None, 0.0, 2), ("t", 3, "ADD_TO_CART", "b", 1.0, 1), ("t", 4, "CHECKOUT_COMPLETE", None, 0.0, 2)]
    df = spark.createDataFrame(rows, "session_id string, event_id bigint, event_type string, product_id string, value double, us bigint")
    ended = lambda mode: {r.session_id for r in baskets.completed(df, mode).collect()}
    assert ended("original") == {"t"} and ended("refactored") == {"s", "t"}


def many_baskets(seed, n, items="abcdefg"):
    rng = random.Random(seed)
    return [[rng.choice(items) for _ in range(rng.randint(1, 4))] for _ in range(n)]


def plain_rules(own, keep, full=(0.3, 0.01), single=0.4):
    """What the definition gives, basket by basket over the whole history."""
    out, entries = [], {}
    for n, basket in enumerate(own, 1):
        held = [set(b) for b in own[max(0, n - 1 - keep) : n]]
        for x in basket:
            entries[x] = entries.get(x, 0) + 1
        s = sorted(set(basket))
        wanted = [(tuple(y for y in s if y != c), c, "full") for c in s if len(s) > 1]
        if len(basket) > 2:
            wanted += [((a,), c, "single") for c in s for a in s if a != c]
        for a, c, kind in wanted:
            occ, co = sum(set(a) <= h for h in held), sum(set(a) | {c} <= h for h in held)
            conf, sup = co / occ, co / n
            if (conf > full[0] and sup > full[1]) if kind == "full" else conf > single:
                out.append((n, ",".join(a), c, kind, round(conf, 9), round(sup, 9), round(conf / (entries[c] / n), 9)))
    return sorted(out)


def plain_of(df, key="k"):
    return sorted((r.seq, r.antecedents, r.consequent, r.kind, round(r.confidence, 9), round(r.support, 9), round(r.lift, 9)) for r in df.filter(F.col("user_id") == key).collect())


@pytest.mark.parametrize("keep,n", [(1000, 1500), (7, 90), (1, 20)])
def test_incremental_rules_of_a_long_history(spark, keep, n):
    """A key of more baskets than are kept, in blocks: equal to counting over the whole history."""
    own = many_baskets(keep, n)
    rows = [("k", i, x) for i, b in enumerate(own, 1) for x in b] + [("other", 1, "a"), ("other", 1, "b"), ("k", 1, None)]
    df = spark.createDataFrame(rows, "user_id string, seq bigint, item string").repartition(4)
    for block in (1, 4):
        assert plain_of(baskets.incremental_rules(df, keep, block=block)) == plain_rules(own, keep)


def test_history_costs_the_same_however_long(monkeypatch):
    """Baskets that have left are not looked at again: the ring and the masks stay as many."""
    h = baskets.History(50)
    for b in many_baskets(3, 2000, "abcdefghij"):
        h.add(b)
        assert len(h.ring) <= 51 and all(m < 1 << 51 for m in h.masks.values())
    again = baskets.History(50).load(h.dump())
    again.newest = h.newest
    assert list(again.rules()) == list(h.rules())


def test_rules_stream(spark, tmp_path):
    own = many_baskets(8, 120)
    rows = [("k", i, b, i * MINUTE) for i, b in enumerate(own, 1)] + [("j", 1000 + i, b, i * MINUTE) for i, b in enumerate(many_baskets(9, 30), 1)]
    df = spark.createDataFrame(rows, "user_id string, basket_id bigint, items array<string>, us bigint").withColumn("ts", F.timestamp_micros("us"))
    stream = written(spark, df, str(tmp_path / "in"), 5, ("us", "basket_id"))
    got = run(streams.rules(stream, 20, "3 hours"), tmp_path, "rules_stream")
    assert plain_of(got) == plain_rules(own, 20) and plain_of(got, "j") == plain_rules(many_baskets(9, 30), 20)


# -- the pattern store --------------------------------------------------------------------------

PATTERNS = "pattern_id string, antecedents array<string>, consequent string, confidence double, us bigint"


def pattern(name, a, c, confidence, us):
    return (name, a, c, confidence, us)


def test_store_keeps_the_best_and_newest(spark, tmp_path):
    s = store.PatternStore(spark, str(tmp_path / "store"), cap=2)
    assert s.epochs() == [] and s.read(None).count() == 0
    s.apply(spark.createDataFrame([pattern("x", ["a"], "b", 0.6, 1), pattern("y", ["a", "c"], "d", 0.9, 2)], PATTERNS), 0)
    for _ in range(2):  # an epoch that runs again gives the same
        s.apply(spark.createDataFrame([pattern("x", ["a"], "b", 0.5, 5), pattern("z", ["e"], "f", 0.7, 3)], PATTERNS), 1)
    now = lambda e: {r.pattern_id: r.confidence for r in s.read(e).collect()}
    assert now(0) == {"x": 0.6, "y": 0.9} and now(1) == {"y": 0.9, "z": 0.7}
    assert s.pinned("r", 0) == 1
    s.apply(spark.createDataFrame([pattern("w", ["e"], "g", 0.7, 9)], PATTERNS), 2)
    assert s.pinned("r", 0) == 1 and s.pinned("r", 1) == 2 and s.pinned("other", 0) == 2
    assert s.expire(1) == [2]


def test_recommendations_follow_the_epochs(spark, tmp_path):
    """Two streams: an update between two batches takes effect with the batch after it, for every key; a batch that runs again keeps its epoch."""
    s = store.PatternStore(spark, str(tmp_path / "store"))
    schema = "session_id string, event_id bigint, event_type string, product_id string, us bigint"
    at = lambda n: [(k, 10 * n + i, kind, p, (100 * n + i + 10) * MINUTE) for i, (k, kind, p) in enumerate([("s", "ADD_TO_CART", "a"), ("t", "ADD_TO_CART", "a"), ("t", "ADD_TO_CART", "c"), ("s", "PRODUCT_VIEW", "a")])]
    events, patterns_in = str(tmp_path / "events"), str(tmp_path / "patterns")

    def push(rows, kind, path):
        df = spark.createDataFrame(rows, kind)
        (df.withColumn("ts", F.timestamp_micros("us")) if path == events else df).coalesce(1).write.mode("append").parquet(path)

    def learn():
        source = spark.readStream.schema(PATTERNS).parquet(patterns_in)
        assert store.learn(source, s, str(tmp_path / "cp1")).awaitTermination(120)

    def recommend_():
        source = spark.readStream.schema(f"{schema}, ts timestamp").parquet(events)
        assert store.recommend_stream(source, s, str(tmp_path / "out"), str(tmp_path / "cp2"), late="1 minute").awaitTermination(180)

    def result():
        return {(r.session_id, r.event_id, r.kind, r.products, r.epoch) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    push([pattern("p1", ["a"], "b", 0.8, 1)], PATTERNS, patterns_in)
    learn()
    push(at(0), schema, events)
    push([("tick", 999, "USER_LOGIN", None, 50 * MINUTE)], schema, events)
    recommend_()
    first = result()
    assert first == {("s", 0, "BASKET_BASED", "b", 0), ("t", 1, "BASKET_BASED", "b", 0), ("t", 2, "BASKET_BASED", "b", 0), ("s", 3, "VIEW_BASED", "b", 0)}
    # Between two batches: a pattern of two antecedents and a better one for a.
    push([pattern("p2", ["a", "c"], "d", 0.9, 2), pattern("p3", ["a"], "e", 0.85, 3)], PATTERNS, patterns_in)
    learn()
    assert result() == first
    push(at(1), schema, events)
    push([("tick", 1999, "USER_LOGIN", None, 400 * MINUTE)], schema, events)
    recommend_()
    new = result() - first
    assert new == {("s", 10, "BASKET_BASED", "e,b", 1), ("t", 11, "BASKET_BASED", "d,e,b", 1), ("t", 12, "BASKET_BASED", "d,e,b", 1), ("s", 13, "VIEW_BASED", "d,e,b", 1)}
    assert all(x[-1] == 1 for x in new)
    # The last batch runs again, after the store has moved on: its commit is lost, its epoch is not.
    learned = result()
    push([pattern("p4", ["a"], "z", 0.99, 9)], PATTERNS, patterns_in)
    learn()
    commits = sorted((f for f in glob.glob(str(tmp_path / "cp2" / "commits" / "*")) if os.path.basename(f).isdigit()), key=lambda f: int(os.path.basename(f)))
    os.remove(commits[-1])
    os.remove(os.path.join(os.path.dirname(commits[-1]), f".{os.path.basename(commits[-1])}.crc"))
    recommend_()
    assert result() == learned


def test_for_held_equals_for_baskets(spark):
    df = shop(spark, 5, 300)
    rng = random.Random(2)
    rows = [(f"p{i}", rng.sample("abcdef", rng.randint(1, 3)), rng.choice("abcdef"), rng.random(), i) for i in range(40)]
    pats = spark.createDataFrame(rows, PATTERNS)
    got = {(r.session_id, r.event_id, r.products) for r in recommend.for_baskets(df, pats).collect()}
    held, want, adds = {}, set(), []
    for r in df.orderBy("us", "event_id").collect():
        own = held.setdefault(r.session_id, [])
        if r.event_type in baskets.COMPLETE["refactored"]:
            own.clear()
        elif r.event_type == "ADD_TO_CART":
            own.append(r.product_id)
            adds.append((r.session_id, r.event_id, list(own)))
            best = {}
            for _, a, c, conf, _ in rows:
                if conf > 0.5 and set(a) <= set(own) and c not in own:
                    best[c] = max(best.get(c, 0), conf)
            if best:
                want.add((r.session_id, r.event_id, ",".join(sorted(best, key=lambda c: (-best[c], c))[:5])))
    assert got == want and len(want) > 20
    held_rows = spark.createDataFrame(adds, "session_id string, event_id bigint, basket array<string>")
    assert {(r.session_id, r.event_id, r.products) for r in recommend.for_held(held_rows, pats).collect()} == want
