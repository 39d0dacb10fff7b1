"""Streaming forms give what the batch forms give; sources, sinks and the versioned table."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import inventory, sessions
from tidemark.sources import readers, sinks
from tidemark.streaming import processors

T0 = 1_700_000_000


def run(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    if not q.awaitTermination(40):  # with state that expires by the clock a query never runs out of batches
        q.stop()
    return df.sparkSession.table(name)


def test_sessions_stream(spark, tmp_path):
    rows = [("s1", T0 + 60 * m, k) for m, k in ((0, "PRODUCT_VIEW"), (5, "ADD_TO_CART"), (40, "PRODUCT_VIEW"))] + [("s2", T0, "ORDER_PLACED"), ("flush", T0 + 100_000, "PRODUCT_VIEW")]
    df = spark.createDataFrame([(i, s, t, k, "p", 1.0) for i, (s, t, k) in enumerate(rows)], "event_id int, session_id string, sec bigint, event_type string, product_id string, value double").withColumn("ts", F.timestamp_seconds("sec"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    cols = ["session_id", "start", "end", "session_type", "total_events"]
    got = {tuple(r) for r in run(sessions.sessions(stream, late="5 seconds").select(*cols), "append", tmp_path, "sess").collect()}
    want = {tuple(r) for r in sessions.sessions(df).select(*cols).collect() if r.session_id != "flush"}
    assert got == want


def test_inventory_stream(spark, tmp_path):
    rows = [("a", 1, 1, 5, 1.0), ("a", 2, 2, 0, 1.0), ("b", 1, 3, 7, 2.0), ("a", 3, 4, 3, 2.0), ("b", 2, 5, 7, 2.5)]
    df = spark.createDataFrame(rows, "product_id string, us bigint, seq bigint, inventory int, price double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in run(processors.inventory_events(stream), "append", tmp_path, "inv").collect())
    want = sorted(tuple(r) for r in inventory.classify(df, ["us", "seq"]).select("product_id", "us", "seq", "event_type").collect())
    assert got == want


def test_stale_stream(spark, tmp_path):
    rows = [("a", T0), ("a", T0 + 1800), ("b", T0), ("z", T0 + 50_000)]
    df = spark.createDataFrame(rows, "product_id string, sec bigint").withColumn("ts", F.timestamp_seconds("sec"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in run(processors.stale(stream), "append", tmp_path, "stale").collect()}
    assert got == {("a", (T0 + 1800) * 1000), ("b", T0 * 1000)}


def test_sequences_stream(spark, tmp_path):
    rows = [("s", i, k, i * 1000) for i, k in enumerate("VAOVVAO")] + [("t", 0, "V", 0)]
    df = spark.createDataFrame(rows, "session_id string, event_id bigint, event_type string, us bigint")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    steps = [("a", "V", "next"), ("b", "A", "next"), ("c", "O", "next")]
    got = sorted(r.ids for r in run(processors.sequences(stream, steps, 10_000, ttl_ms=3_600_000), "append", tmp_path, "seqs").collect())
    assert got == ["0,1,2", "4,5,6"]


def test_deductions_stream(spark, tmp_path):
    rows = [("p", 0, 1, 5, None), ("p", 1, 2, None, 3), ("p", 2, 3, None, 2), ("p", 3, 4, None, 1), ("x", 0, 5, None, 4), ("p", 4, 6, None, 0), ("p", 5, 7, 9, None), ("p", 6, 8, None, 4)]
    df = spark.createDataFrame(rows, "product_id string, us bigint, seq bigint, inventory int, quantity int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    columns = ["product_id", "us", "previous", "current", "event_type", "sufficient"]
    got = sorted(tuple(r) for r in run(processors.deductions(stream).select(*columns), "append", tmp_path, "deds").collect())
    assert got == sorted(tuple(r) for r in inventory.deduct(df, ["us", "seq"]).select(*columns).collect()) and len(got) == 5


def test_cart_context_stream(spark, tmp_path):
    from tidemark.operators import chat

    events = spark.createDataFrame([("k", 1, 1, "ADD_TO_CART", "a", 2.0), ("k", 2, 2, "ADD_TO_CART", "a", 3.0), ("k", 3, 3, "ADD_TO_CART", "b", 1.5), ("k", 4, 6, "REMOVE_FROM_CART", "a", None), ("k", 5, 7, "ADD_TO_CART", "a", 7.0), ("k", 5, 8, "REMOVE_FROM_CART", "c", None), ("k", 9, 4, "ORDER_PLACED", None, None), ("j", 1, 5, "PRODUCT_VIEW", "a", 1.0)], "key string, us bigint, event_id bigint, event_type string, product_id string, value double")
    messages = spark.createDataFrame([("k", 0, 10), ("k", 3, 11), ("k", 4, 14), ("k", 6, 15), ("k", 10, 12), ("j", 5, 13)], "key string, us bigint, msg_id bigint")
    events.write.parquet(str(tmp_path / "events"))
    messages.write.parquet(str(tmp_path / "messages"))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    columns = ["key", "msg_id", "item_count", "total_value", "products"]
    out = run(processors.cart_context(read("messages", messages), read("events", events), ttl_ms=3_600_000).select(*columns), "append", tmp_path, "carts")
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted(tuple(r) for r in chat.basket_context(messages, events).select(*columns).collect())
    assert got == [("j", 13, 0, 0.0, 0), ("k", 10, 0, 0.0, 0), ("k", 11, 3, 5.5, 2), ("k", 12, 0, 0.0, 0), ("k", 14, 1, 1.5, 1), ("k", 15, 2, 8.5, 2)]


def test_stale_uncancelled(spark, tmp_path):
    """Several timers of one product at a time; equal to the batch form, and unlike the form that cancels."""
    rows = [("a", T0), ("a", T0 + 1800), ("a", T0 + 1800), ("a", T0 + 9000), ("b", T0), ("z", T0 + 50_000)]
    df = spark.createDataFrame([(p, t, t * 1_000_000, i) for i, (p, t) in enumerate(rows)], "product_id string, sec bigint, us bigint, seq int").withColumn("ts", F.timestamp_seconds("sec"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    hour = 3_600_000
    got = sorted((r.product_id, r.fires_ms, r.idle_ms) for r in run(processors.stale_uncancelled(stream, hour, 2 * hour), "append", tmp_path, "uncancelled").collect())
    batch = inventory.stale_uncancelled(df, ["us", "seq"], hour * 1000, 2 * hour * 1000, (T0 + 49_990) * 1_000_000)
    assert got == sorted((r.product_id, r.fires_us // 1000, r.idle_us // 1000) for r in batch.collect())
    assert [x[0] for x in got] == ["a", "a", "b"] and got[0][2] == 5400 * 1000
    assert inventory.stale_uncancelled(df, ["us", "seq"], hour * 1000, hour * 1000, 10**18).count() == 0
    assert inventory.stale(df, ["us", "seq"], hour * 1000, (T0 + 49_990) * 1_000_000).count() == 3


def test_append_sink(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "a int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a int").parquet(str(tmp_path / "in"))
    sinks.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_stored_patterns(spark):
    rows = readers.stored_patterns(spark, "no_such_table", 5).collect()
    assert len(rows) == 9 and {r.timestamp for r in rows} == {5} and {r.category for r in rows} == {"electronics", "fashion", "home_kitchen", "sports"}


def test_variants_by_price_band(spark):
    df = spark.createDataFrame([(f"p{i}", "n", p) for i, p in enumerate([20.0, 60.0, 300.0, 700.0] * 5)], "product_id string, name string, price double")
    rows = readers.variants(df).collect()
    for r in rows:
        lo, hi = next((lo, hi) for below, lo, hi in [(50, 50, 200), (200, 20, 100), (500, 10, 50), (1e9, 5, 25)] if r.price < below)
        assert lo <= r.inventory <= hi
    assert 40 <= len(rows) <= 60 and len({r.inventory for r in rows}) > 5


@pytest.mark.parametrize(
    "steps,kinds,want",
    [
        ([("a", "V", "next"), ("b", "A", "next"), ("c", "O", "next")], "VAOVVAO", ["0,1,2", "4,5,6"]),
        ([("a", "V", "next"), ("b", "O", "followedBy")], "VAO", ["0,2"]),
        ([("a", "V", "next"), ("b", "O", "followedByAny")], "VOO", ["0,1", "0,2"]),
        ([("a", "V", "next"), ("n", "A", "notFollowedBy"), ("b", "O", "followedBy")], "VAOVXO", ["3,5"]),
        ([("a", "V", "next"), ("n", "A", "notNext"), ("b", "O", "followedBy")], "VAOVO", ["3,4"]),
    ],
)
def test_automaton(steps, kinds, want):
    runs, out = [], []
    for i, k in enumerate(kinds):
        runs, done = processors.advance(steps, 1000, runs, k, i, str(i))
        out += [ids for _, ids in done]
    assert out == want


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), "id")
    assert t.read() is None
    t.upsert(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("a", 3.0)], "id string, c double"), [F.desc("c")])
    t.upsert(spark.createDataFrame([("a", 2.0), ("c", 9.0)], "id string, c double"), [F.desc("c")], lambda: F.col("n_c") > F.col("o_c"))
    now = lambda v=None: {r.id: r.c for r in t.read(v).collect()}
    assert now() == {"a": 3.0, "b": 1.0, "c": 9.0} and now(1) == {"a": 3.0, "b": 1.0}
    t.upsert(spark.createDataFrame([("a", 2.0)], "id string, c double"), [F.desc("c")])
    assert now()["a"] == 2.0
    assert len(t.expire(1)) == 1 and now() == {"a": 2.0, "b": 1.0, "c": 9.0}
    for c in (4.0, 5.0):  # a null key is a key like others
        t.upsert(spark.createDataFrame([(None, c)], "id string, c double"), [F.desc("c")])
    assert now()[None] == 5.0 and t.read().count() == 4
    t.upsert(spark.createDataFrame([(None, 1.0)], "id string, c double"), [F.desc("c")], lambda: F.col("n_c") > F.col("o_c"))
    assert now()[None] == 5.0


def test_fan_out_and_sinks(spark):
    seen = {}
    df = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "channel string, v int")
    sinks.fan_out({c: (lambda c: lambda rows: seen.update({c: rows.count()}))(c) for c in "xyz"})(df, 0)
    assert seen == {"x": 2, "y": 1, "z": 0}
    assert sinks.enveloped(spark.createDataFrame([(1, 5)], "a int, timestamp bigint"), "K").first()[0] == '{"eventType":"K","payload":{"a":1,"timestamp":5},"timestamp":5}'


def test_hybrid_and_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"productId":"x","name":"n"}\n]')
    assert readers.whole_files(spark, str(tmp_path / "a.json")).count() == 1
    (tmp_path / "t.csv").write_text("a;b\n1;x\n2;y\n")
    assert readers.csv(spark, str(tmp_path / "t.csv")).dtypes == [("a", "int"), ("b", "string")]
    one = spark.createDataFrame([(1,)], "a int")
    assert readers.hybrid(one, spark.createDataFrame([(2, 3)], "a int, b int")).count() == 2
    assert readers.table_or(spark, "no_such_table", lambda: one).count() == 1
    assert readers.kafka_options("h:1", ["a", "b"])["subscribe"] == "a,b"
    geo = readers.as_json(one).first()[0]
    assert geo == '{"a":1}'


def test_generators_repeat(spark):
    t = spark.createDataFrame([(c, ["a"], "b", 0.1, 0.5, 2.0) for c, _ in readers.CATEGORIES], "category string, antecedents array<string>, consequent string, support double, confidence double, lift double")
    a = readers.historical_patterns(spark, t, 200).orderBy("timestamp").toPandas()
    b = readers.historical_patterns(spark, t, 200).orderBy("timestamp").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 200 and a.category.value_counts().idxmax() == "electronics"


def test_ticker(spark):
    assert '"subscribe"' in readers.ticker_subscription(["BTC-USD"])
