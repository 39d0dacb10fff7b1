"""Golden fixtures of single operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsing
from tidemark.operators import baskets, cep, chat, inventory, recommend, scoring, sessions

MIN = 60_000_000
T0 = 1_700_000_000_000_000


def updates(spark):
    rows = [("LAPTOP_001", 10, 999.99), ("MOUSE_001", 50, 29.99), ("LAPTOP_001", 8, 999.99), ("LAPTOP_001", 15, 999.99), ("LAPTOP_001", 15, 899.99), ("MOUSE_001", 45, 29.99), ("KEYBOARD_001", 30, 79.99)]
    return spark.createDataFrame([(*r, i, i * MIN) for i, r in enumerate(rows)], "product_id string, inventory int, price double, seq int, us bigint")


def test_classifier_refactored(spark):
    ev = inventory.classify(updates(spark), ["us", "seq"])
    got = sorted((r.seq, r.event_type) for r in ev.collect())
    assert got == [(0, "PRODUCT_ADDED"), (1, "PRODUCT_ADDED"), (2, "INVENTORY_DECREASED"), (3, "INVENTORY_INCREASED"), (4, "PRICE_CHANGED"), (5, "INVENTORY_DECREASED"), (6, "PRODUCT_ADDED")]
    alerts = {(r.seq, r.channel, r.severity) for r in inventory.alerts(ev).collect()}
    assert alerts == {(2, "LOW_STOCK", "WARNING"), (4, "PRICE_DROP", "INFO")}


def test_classifier_original(spark):
    ev = inventory.classify(updates(spark), ["us", "seq"], "original")
    alerts = {(r.seq, r.channel) for r in inventory.alerts(ev, "original").collect()}
    assert ev.count() == 7 and alerts == {(0, "LOW_STOCK_ALERT"), (2, "LOW_STOCK_ALERT"), (4, "SALE_STARTED")}


def test_tracker(spark):
    got = sorted((r.seq, r.change, r.delta) for r in inventory.track(updates(spark), ["us", "seq"]).collect())
    assert got == [(0, "NEW_PRODUCT", None), (1, "NEW_PRODUCT", None), (2, "SALE", -2), (3, "RESTOCK", 7), (4, "PRICE_CHANGE", None), (5, "SALE", -5), (6, "NEW_PRODUCT", None)]


def test_stale(spark):
    rows = [("LAPTOP", 0), ("KEYBOARD", 0), ("MOUSE", 0), ("LAPTOP", 30), ("KEYBOARD", 30), ("LAPTOP", 60)]
    df = spark.createDataFrame([(p, m * MIN, i) for i, (p, m) in enumerate(rows)], "product_id string, us bigint, seq int")
    got = sorted((r.product_id, r.fires_us // MIN, r.severity) for r in inventory.stale(df, ["us", "seq"], 60 * MIN, 150 * MIN).collect())
    # FIXTURES F2: each timer fires after exactly one hour, so all three are MEDIUM.
    assert got == [("KEYBOARD", 90, "MEDIUM"), ("LAPTOP", 120, "MEDIUM"), ("MOUSE", 60, "MEDIUM")]
    seen = {r.product_id: r.severity for r in inventory.stale_at_horizon(df, ["us", "seq"], 60 * MIN, 150 * MIN).collect()}
    assert seen == {"KEYBOARD": "MEDIUM", "LAPTOP": "MEDIUM", "MOUSE": "HIGH"}


def test_reasons(spark):
    ev = inventory.classify(updates(spark), ["us", "seq"]).withColumn("reason", inventory.reason())
    got = {(r.seq, r.event_type): r.reason for r in ev.collect()}
    assert got[2, "INVENTORY_DECREASED"] == "2 units sold/removed" and got[3, "INVENTORY_INCREASED"] == "7 units added to inventory"
    assert got[4, "PRICE_CHANGED"] == "Price decreased by $100.00 (10.0%)" and got[0, "PRODUCT_ADDED"] is None
    assert spark.range(1).select(inventory.stale_reason(F.lit(90 * MIN))).first()[0] == "No updates for 1.5 hours"


def test_measures_are_not_rounded(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (4.0, 4.3)], "y double, f double")
    r = scoring.regression_metrics(df, "y", "f").first()
    assert abs(r.mse - 0.11 / 3) < 1e-12 and abs(r.r2 - (1 - 0.11 / (14 / 3))) < 1e-12
    m = scoring.binary_metrics(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (1, 1)], "y int, p int"), "y", "p").first()
    assert abs(m.recall - 2 / 3) < 1e-15


def test_purchase_lines(spark):
    good = '{"userId":"u","totalValue":250.0,"basketSize":8,"userPurchaseHistory":5}'
    rows = [(good,), (good[:-1],), ("[]",), ('{"userId":null,"totalValue":9,"basketSize":1}',), (None,)]
    got = [(r.channel, r.p and round(r.p, 4)) for r in scoring.classify_lines(spark.createDataFrame(rows, "value string")).collect()]
    assert got == [("HIGH_VALUE", 0.9677), ("PARSE_ERROR", None), ("PARSE_ERROR", None), ("INVALID_DATA", None), ("PARSE_ERROR", None)]


def test_records_and_current_products(spark):
    from tidemark.schemas import ASSISTANT_CHAT

    lines = spark.createDataFrame([('{"messageId":"m","text":"hi"}',), ("nope",), ('{"currentProduct":{"productId":"a","inventory":3}}',), ('{"currentProduct":null}',)], "value string")
    assert [r.text for r in parsing.records(lines, ASSISTANT_CHAT).collect()] == ["hi", None, None]
    assert [(r.productId, r.inventory) for r in parsing.current_products(lines).collect()] == [("a", 3)]


def test_translation_and_time_limit(spark):
    raw = spark.createDataFrame([("u", None, "CHAT_MESSAGE", "hi", 1, ["DE", "FR"]), ("u", None, "SYSTEM", "up", 2, ["DE"])], "userId string, toUserId string, type string, message string, timestamp bigint, languages array<string>")
    out = chat.translated(chat.enrich(raw), lambda text, langs: {x: f"{text}-{x}" for x in langs if x != "FR"} | {"IT": "ciao"})
    got = {r.type: (r.text, r.translated, r.translations) for r in chat.localised(out, "DE").collect()}
    assert got == {"CHAT_MESSAGE": ("hi-DE", True, {"DE": "hi-DE", "FR": None}), "SYSTEM": ("up", False, {"DE": None})}

    def slow(text):
        import time

        time.sleep(20 if text == "hang" else 0)
        return text.upper()

    asked = spark.createDataFrame([("a",), ("hang",), ("b",)], "prompt string").coalesce(1)
    assert [r.answer for r in chat.answered(asked, slow, timeout=2.0, late="later").collect()] == ["A", "later", "B"]


def test_calls_in_order():
    """One slow call holds back only what is behind it; never more than the window in flight; a late one gives way."""
    import threading
    import time

    now, most, begun, lock = 0, 0, {}, threading.Lock()

    def call(i):
        nonlocal now, most
        with lock:
            now, begun[i] = now + 1, time.monotonic()
            most = max(most, now)
        time.sleep(0.8 if i == 3 else 5 if i == 20 else 0.02)
        with lock:
            now -= 1
        return i * 10

    start, got, at = time.monotonic(), [], {}
    for item, answer in chat.in_order(iter(range(40)), call, 8, 2.0, "late"):
        got.append((item, answer))
        at[item] = time.monotonic() - start
    assert got == [(i, "late" if i == 20 else i * 10) for i in range(40)]
    assert at[2] < 0.5 < at[3] and most <= 9  # the hung one no longer counts
    assert begun[10] - start < 0.6 and begun[11] - start > 0.7  # the window goes on while the slow call runs, and no further


def test_answers_over_batches(spark):
    rows = spark.createDataFrame([(i, f"q{i}") for i in range(250)], "i int, prompt string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        def client(text):
            if text == "q9":
                raise ValueError
            return text.upper()

        got = chat.answered(rows, client, workers=20, retries=0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.i, r.answer) for r in got] == [(i, chat.FAILED if i == 9 else f"Q{i}") for i in range(250)]
    df = spark.createDataFrame([("RECOMMENDATION", ["a"]), ("HELP", ["a"])], "intent string, available array<string>")
    assert [r.recommended_products for r in chat.with_recommendations(df).collect()] == [["a"], None]


def test_stale_severity(spark):
    """At the moment a timer fires the threshold has just passed, whatever it is: MEDIUM, up to twice the threshold."""
    hour = 3_600_000_000
    df = spark.createDataFrame([("a", 0, 1)], "product_id string, us bigint, seq int")
    for threshold in (hour, 90 * 24 * hour):
        assert [r.severity for r in inventory.stale(df, ["us", "seq"], threshold, 10**18).collect()] == ["MEDIUM"]
        assert [r.severity for r in inventory.stale_at_horizon(df, ["us", "seq"], threshold, 2 * threshold).collect()] == ["MEDIUM"]
        assert [r.severity for r in inventory.stale_at_horizon(df, ["us", "seq"], threshold, 2 * threshold + 1).collect()] == ["HIGH"]


def test_alert_messages(spark):
    df = spark.createDataFrame([("LOW_STOCK", 3, 9.0, 9.0), ("OUT_OF_STOCK", 0, 9.0, 9.0), ("PRICE_DROP", 5, 100.0, 87.5), ("OTHER", 1, 1.0, 1.0)], "channel string, inventory int, prev_price double, price double")
    assert [r.m for r in df.select(inventory.alert_message().alias("m")).collect()] == ["Low stock: only 3 items remaining", "Product is out of stock", "Price dropped 12.5% from $100.00 to $87.50", None]


def test_snapshots_through_idle_time(spark):
    df = spark.createDataFrame([("a", 5, 1, 7, 1.0), ("a", 8, 2, 6, 1.0), ("a", 41, 3, 4, 2.0), ("b", 22, 1, 9, 3.0), ("c", 99, 1, 1, 1.0)], "product_id string, us bigint, seq int, inventory int, price double")
    spans = inventory.snapshot_spans(df, 10, ["us", "seq"], 65)
    assert spans.count() == 3
    got = sorted((r.product_id, r.period, r.updates, r.inventory) for r in inventory.periods(spans).collect())
    assert got == [("a", 0, 2, 6), ("a", 1, 0, 6), ("a", 2, 0, 6), ("a", 3, 0, 6), ("a", 4, 1, 4), ("a", 5, 0, 4), ("b", 2, 1, 9), ("b", 3, 0, 9), ("b", 4, 0, 9), ("b", 5, 0, 9)]


def test_unknown_pattern():
    import json

    from tidemark.sources import readers

    assert json.loads(readers.UNKNOWN) == {"antecedents": ["unknown"], "consequent": "unknown", "support": 0.01, "confidence": 0.5, "lift": 1.0}


def test_not_followed(spark):
    df = events(spark, [("s", "USER_LOGIN", 0), ("s", "PRODUCT_VIEW", 5), ("s", "ORDER_PLACED", 9), ("s", "USER_LOGIN", 10), ("t", "USER_LOGIN", 0), ("t", "ORDER_PLACED", 100)])
    got = sorted((r.session_id, r.event_id) for r in cep.not_followed(df, "USER_LOGIN", "ORDER_PLACED", 50_000_000).collect())
    assert got == [("s", 3), ("t", 4)]


def test_router(spark):
    rows = [("LAPTOP", 50, 1299.99, 4.2), ("MOUSE", 100, 29.99, 4.0), ("KEYBOARD", 8, 89.99, 4.3), ("MONITOR", 5, 399.99, 4.1), ("HEADSET", 0, 79.99, 4.6), ("WEBCAM", 0, 49.99, 4.4), ("CABLE", 200, 12.99, 4.8), ("ADAPTER", 150, 19.99, 4.7), ("TABLET", 3, 299.99, 4.5), ("CHARGER", 0, 24.99, 4.9)]
    out = inventory.route(spark.createDataFrame(rows, "product_id string, inventory int, price double, rating double")).collect()
    by = lambda c: {r.product_id for r in out if r.channel == c}
    assert len(by("MAIN")) == 10
    assert by("OUT_OF_STOCK") == {"HEADSET", "WEBCAM", "CHARGER"} and by("LOW_STOCK") == {"KEYBOARD", "MONITOR", "TABLET"}
    assert by("PRICE_DROP") == {"HEADSET", "CABLE", "ADAPTER", "CHARGER"} and {r.discount for r in out if r.channel == "PRICE_DROP"} == {13.043}


def test_sessions(spark):
    rows = [("s1", m, "PRODUCT_VIEW", f"p{m}") for m in (0, 5, 10, 12)] + [("s2", 60, "PRODUCT_VIEW", "a"), ("s2", 62, "PRODUCT_VIEW", "b"), ("s2", 65, "ADD_TO_CART", "a"), ("s2", 66, "ADD_TO_CART", "b"), ("s3", 120, "PRODUCT_VIEW", "a"), ("s3", 122, "ADD_TO_CART", "a"), ("s3", 125, "ORDER_PLACED", None)]
    rows += [("edge", 0, "PRODUCT_VIEW", None), ("edge", 30, "PRODUCT_VIEW", None)]
    df = spark.createDataFrame([(s, i, e, p, 1.0, (T0 // MIN + m) * 60) for i, (s, m, e, p) in enumerate(rows)], "session_id string, event_id int, event_type string, product_id string, value double, sec bigint")
    got = {r.session_id: r for r in sessions.sessions(df.withColumn("ts", F.timestamp_seconds("sec"))).collect()}
    assert [(got[s].duration_s, got[s].view_count, got[s].add_count, got[s].session_type, got[s].total_events) for s in ("s1", "s2", "s3")] == [(2520, 4, 0, "BROWSER", 4), (2160, 2, 2, "ABANDONED_CART", 4), (2100, 1, 1, "PURCHASE", 3)]
    assert got["edge"].view_count == 2 and got["edge"].unique_products == 1  # a pause of exactly the gap does not end it


def events(spark, rows):
    return spark.createDataFrame([(s, i, k, f"P{i}", sec * 1_000_000, 1.0) for i, (s, k, sec) in enumerate(rows)], "session_id string, event_id int, event_type string, product_id string, us bigint, value double")


def test_cep(spark):
    v, a, o = "PRODUCT_VIEW", "ADD_TO_CART", "ORDER_PLACED"
    rows = [("s1", v, 0), ("s1", a, 2), ("s1", v, 5), ("s1", a, 7), ("s2", v, 10), ("s2", a, 12), ("s2", o, 15)] + [("s3", v, x) for x in (20, 22, 24, 26, 28)] + [("s4", v, 30), ("s4", a, 32), ("s4", v, 35), ("s4", a, 37), ("s4", o, 40)]
    df = events(spark, rows)
    assert sorted((r.session_id, r.took_us) for r in cep.quick_purchase(df).collect()) == [("s2", 5_000_000), ("s4", 5_000_000)]
    assert sorted(r.length for r in cep.repeated(df).collect()) == [3, 3, 3, 4, 4, 5]
    assert [r.session_id for r in cep.abandonment_intent(df).collect()] == ["s1"]
    assert sorted(r.session_id for r in cep.abandonment_faithful(df).collect()) == ["s1", "s2", "s4"]
    assert cep.strict_sequence(df, [v, a, o], 5_000_000).count() == 0  # the limit itself is too long


def test_deductions(spark):
    rows = [("p", 0, 5, None), ("p", 1, None, 3), ("p", 2, None, 2), ("p", 3, None, 1), ("x", 0, None, 4), ("p", 4, None, 0)]
    df = spark.createDataFrame(rows, "product_id string, us bigint, inventory int, quantity int")
    got = sorted((r.product_id, r.us, r.previous, r.current, r.event_type, r.sufficient) for r in inventory.deduct(df, ["us"]).collect())
    assert got == [("p", 1, 5, 2, "INVENTORY_DECREASED", True), ("p", 2, 2, 0, "OUT_OF_STOCK", True), ("p", 3, 0, 0, "OUT_OF_STOCK", False), ("x", 0, 0, 0, "INVENTORY_DECREASED", True)]


def test_incremental_rules(spark):
    rows = [("k", 1, "a"), ("k", 1, "b"), ("k", 2, "a"), ("k", 2, "c")]
    got = {(r.seq, r.antecedents, r.consequent): (r.confidence, r.support, r.lift) for r in baskets.incremental_rules(spark.createDataFrame(rows, "user_id string, seq bigint, item string")).collect()}
    assert got == {(1, "a", "b"): (1.0, 1.0, 1.0), (1, "b", "a"): (1.0, 1.0, 1.0), (2, "c", "a"): (1.0, 0.5, 1.0), (2, "a", "c"): (0.5, 0.5, 1.0)}


def test_parts_grow_with_the_rows(spark, monkeypatch):
    from tidemark.plans import domain, queries_commerce

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert domain.parts(spark, sf, "lineitem", 500) == -(-lines // 500)
    monkeypatch.setattr(queries_commerce, "parts", lambda *_: 9)
    for name in ("rules_incremental", "rules_long_history", "pattern_best"):
        plan = queries_commerce.QUERIES[name][0](spark, sf)._jdf.queryExecution().toString()
        assert "REPARTITION_BY_NUM" in plan and ", 9)" in plan, name
    assert queries_commerce._incremental(spark, sf).rdd.getNumPartitions() == 9


def test_wide_baskets_leave_in_batches(spark, monkeypatch):
    monkeypatch.setattr(baskets, "OUT", 100)
    rows = [("k", n, f"{(n * 7 + i) % 40:02d}") for n in range(1, 9) for i in range(12)]
    got = baskets.incremental_rules(spark.createDataFrame(rows, "user_id string, seq bigint, item string"), full=(-1.0, -1.0), single=-1.0, parts=3)
    assert got.rdd.getNumPartitions() == 3
    assert sorted((r.seq, r.n, r.least) for r in got.groupBy("seq").agg(F.count("*").alias("n"), F.min("confidence").alias("least")).collect()) == sorted(
        (n, 12 + 12 * 11, min(sum({a, c} <= s for s in held) / sum(a in s for s in held) for a in held[-1] for c in held[-1] if a != c)) for n, held in ((n, [{x for _, m, x in rows if m == i} for i in range(1, n + 1)]) for n in range(1, 9))
    )


def test_pattern_store_keeps_its_own_cap(spark):
    from tidemark.plans import catalog

    sf = "/root/testdata/sf0.001"
    rules = catalog.queries()["rules_global"](spark, sf).count()
    assert 100 < rules < 5000 and catalog.queries()["pattern_store_newest"](spark, sf).count() == rules


def test_basket_recommendation(spark):
    pat = spark.createDataFrame([("p1", ["phone"], "charger", 0.85), ("p2", ["phone", "case"], "film", 0.9)], "pattern_id string, antecedents array<string>, consequent string, confidence double")
    rows = [("s1", "ADD_TO_CART", "phone"), ("s2", "ADD_TO_CART", "charger"), ("s2", "ADD_TO_CART", "phone")]
    df = spark.createDataFrame([(s, i, k, p, i * MIN) for i, (s, k, p) in enumerate(rows)], "session_id string, event_id int, event_type string, product_id string, us bigint")
    assert [(r.session_id, r.products) for r in recommend.for_baskets(df, pat).collect()] == [("s1", "charger")]


def test_removed_items(spark):
    rows = [("s", "ADD_TO_CART", "a"), ("s", "ADD_TO_CART", "b"), ("s", "REMOVE_FROM_CART", "a"), ("s", "ORDER_PLACED", None), ("s", "ORDER_PLACED", None)]
    df = spark.createDataFrame([(s, i, k, p, i * MIN, 2.0) for i, (s, k, p) in enumerate(rows)], "session_id string, event_id int, event_type string, product_id string, us bigint, value double")
    assert [(r.items, r.total_value) for r in baskets.completed(df).collect()] == [("b", 4.0)]
    assert [r.total_value for r in baskets.completed(df, adjust_total_on_remove=True).collect()] == [2.0]


def test_scoring(spark):
    df = spark.createDataFrame([("u", 150.0, 5, 3), ("u", 250.0, 8, 5), ("u", 0.0, 1, 1), (None, 9.0, 1, 1)], "user_id string, total_value double, basket_size int, history int")
    got = [(r.channel, r.p and round(r.p, 5)) for r in scoring.classify(df).collect()]
    assert got == [("STANDARD", 0.07586), ("HIGH_VALUE", 0.9677), ("INVALID_DATA", None), ("INVALID_DATA", None)]


@pytest.mark.parametrize("text,want", [("recommend a cart", "RECOMMENDATION"), ("cart price", "CART_INQUIRY"), ("what does it cost", "PRICE_INQUIRY"), ("find", "PRODUCT_SEARCH"), ("help", "HELP"), ("hello", "GENERAL")])
def test_intents(spark, text, want):
    assert spark.range(1).select(chat.intent(F.lit(text))).first()[0] == want


def test_visibility(spark):
    see = lambda u, r: spark.range(1).select(chat.visible_to(F.lit(u), F.lit("CHAT_MESSAGE"), F.lit("a"), F.lit(r).cast("string"))).first()[0]
    assert see("a", "b") and see("b", "b") and see("c", None) and not see("c", "b")


def test_history_reads_whole_texts(spark):
    import hashlib

    long = "x" * 60
    rows = [(c, t, "user", f"{long} {c if t == 1 else ''}") for c in (1, 2) for t in range(12)]
    out = {(r.conv_id, r.turn): r for r in chat.history(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert out[1, 2].history_sha256 != out[2, 2].history_sha256  # they differ after the 40th character only
    want = "|".join(r[3] for r in rows[1:11])
    assert out[1, 11].n_before == 10 and out[1, 11].history_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_localised(spark):
    raw = spark.createDataFrame([("u", None, "CHAT_MESSAGE", "hi", 1, ["DE"])], "userId string, toUserId string, type string, message string, timestamp bigint, languages array<string>")
    row = chat.localised(chat.enrich(raw), "DE").first()
    assert row.text == "hi" and not row.translated and row.translations == {"DE": None} and len(row.id) == 64


def test_product_parser(spark):
    good = '{"productId":"a","name":"n","price":1.5,"inventory":0}'
    rows = [good, f"[{good},{good}]", "", "not json", '{"productId":"a","na', '{"productId":"","name":"n"}', '{"productId":"a","name":" "}']
    assert parsing.products(spark.createDataFrame([(r,) for r in rows], "value string")).count() == 3


def test_pattern_text(spark):
    got = parsing.patterns(spark.createDataFrame([("a,b->c:0.8",), ('{"antecedents":["x"],"consequent":"y","interestingness":1}',), ("junk",)], "value string")).collect()
    assert [(r.antecedents, r.consequent, round(r.support, 6), r.confidence, round(r.lift, 6)) for r in got] == [(["a", "b"], "c", 0.24, 0.8, 4.0), (["x"], "y", 0.01, 0.5, 2.5)]


def test_ais(spark):
    values = {"type": 1, "repeat": 0, "mmsi": 366053209, "nav_status": 3, "rot": -5, "sog": 102, "accuracy": 1, "lon": -73407500, "lat": 24000000, "cog": 360, "heading": 181, "second": 33}
    bits = "".join(format(values[n] & ((1 << (b - a)) - 1), f"0{b - a}b") for n, a, b, _ in parsing.AIS_FIELDS).ljust(168, "0")
    code = "".join(chr(v + 48 if v < 40 else v + 56) for v in (int(bits[i : i + 6], 2) for i in range(0, 168, 6)))
    row = spark.createDataFrame([(code,), ("short",)], "p string").select(parsing.ais(F.col("p")).alias("m")).collect()
    assert row[1].m is None
    got = row[0].m.asDict()
    assert got.pop("lon") == values["lon"] / 600000 and got.pop("lat") == values["lat"] / 600000
    assert got == {k: v for k, v in values.items() if k not in ("lon", "lat")}


def test_as_of_and_merge(spark):
    rows = spark.createDataFrame([("a", 5, 1), ("a", 0, 2), ("b", 9, 3)], "k string, at bigint, id int")
    vers = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 20.0)], "k string, f bigint, price double")
    assert sorted((r.id, r.price) for r in recommend.as_of(rows, vers, "k", "at", "f", ["price"]).collect()) == [(1, 20.0), (2, None), (3, None)]
    two = spark.range(1).select(recommend.merge_models(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "cxy"))).alias("m"), recommend.merge_models(F.array(F.lit("a")), F.lit(None).cast("array<string>")).alias("n")).first()
    assert two.m == ["a", "b", "c", "x"] and two.n is None


def test_impossible_travel_and_brute_force(spark):
    rows = [(1, "u", 0, "USA", "fail"), (2, "u", MIN, "USA", "fail"), (3, "u", 2 * MIN, "RU", "ok"), (4, "u", 40 * MIN, "USA", "ok"), (5, "u", 41 * MIN, None, "ok"), (6, "v", 0, "RU", "ok")]
    ev = spark.createDataFrame([(i, u, t, p, k) for i, u, t, p, k in rows], "event_id int, session_id string, us bigint, place string, kind string")
    got = cep.impossible_travel(ev, "place", 30 * MIN).collect()
    assert [(r.event_id, r.from_place, r.to_place, r.took_us) for r in got] == [(3, "USA", "RU", MIN)]
    hit = cep.preceded(ev, F.col("kind") == "fail", F.col("kind") == "ok", 2, 5 * MIN).collect()
    assert [(r.event_id, r.before) for r in hit] == [(3, 2)]
    assert cep.preceded(ev, F.col("kind") == "fail", F.col("kind") == "ok", 1, 5 * MIN, most=1).count() == 0


def test_funnel(spark):
    rows = [("a", 0, "S"), ("a", 1, "V"), ("a", 2, "P"), ("b", 0, "V"), ("b", 1, "S"), ("b", 2, "P"), ("c", 0, "S"), ("c", 50, "V"), ("d", 0, "V")]
    ev = spark.createDataFrame(rows, "session_id string, us bigint, event_type string")
    got = {r.session_id: (r.reached, r.lost_at, r.took_us) for r in cep.funnel(ev, ["S", "V", "P"], 10).collect()}
    assert got == {"a": (3, None, 2), "b": (1, "V", 0), "c": (1, "V", 0)}


def test_rules_in_force_and_permissions(spark):
    rules = spark.createDataFrame([("a", 5), ("b", None), ("c", 20)], "rule string, expires_us bigint")
    assert sorted(r.rule for r in recommend.in_force(rules, F.lit(5)).collect()) == ["b", "c"]
    rows = spark.createDataFrame([(1, "admin", "ban"), (2, "user", "ban"), (3, None, "ban")], "id int, role string, action string")
    grants = spark.createDataFrame([("admin", "ban"), ("admin", "ban"), ("user", "post")], "role string, action string")
    assert [r.id for r in recommend.permitted(rows, grants, "role", "action").collect()] == [1]


def test_item_similarity(spark):
    """Equal to the plain cosine at every threshold, a hot item included."""
    import random

    rng = random.Random(3)
    sets = {b: {"hot"} | {rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))} for b in range(80)}
    rows = [(b, i) for b, s in sets.items() for i in s] * 2 + [(1, None)]
    df = spark.createDataFrame(rows, "basket_id int, item string")
    n = {i: sum(i in s for s in sets.values()) for i in "hot a b c d e f g h".split()}
    for least in (0.05, 0.3, 0.6, 1.0):
        got = {(r.item, r.other): round(r.similarity, 9) for r in recommend.item_similarity(df, least).collect()}
        cosine = {(x, y): sum({x, y} <= s for s in sets.values()) / (n[x] * n[y]) ** 0.5 for x in n for y in n if x != y}
        assert got == {k: round(v, 9) for k, v in cosine.items() if v >= least}


def test_contextual_scores_are_summed_by_parts_of_keys(spark):
    similar = spark.createDataFrame([(f"i{a}", f"i{b}", 1 / (1 + abs(a - b))) for a in range(6) for b in range(6) if a != b], "item string, other string, similarity double")
    current = spark.createDataFrame([(f"s{n}", f"i{n % 6}") for n in range(40)] + [(None, "i1")], "session_id string, item string")
    viewed = spark.createDataFrame([(f"s{n}", f"i{(n + 2) % 6}") for n in range(40)], "session_id string, item string")
    rows = [recommend.contextual(similar, current, viewed, parts=p) for p in (1, 5)]
    assert "REPARTITION_BY_NUM" in rows[1]._jdf.queryExecution().toString()
    one, five = (sorted((str(r.session_id), r.place, r.other, round(r.score, 9)) for r in df.collect()) for df in rows)
    assert one == five and len(one) == 40 * 4 + 5
    assert [x for x in one if x[0] == "s0"][0] == ("s0", 1, "i1", round(1 / 2 + 0.5 / 2, 9))


def test_basket_features(spark):
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("c", [5.0, 6.0]), ("d", [7.0, 8.0])], "item string, vector array<double>")
    rows = spark.createDataFrame([(1, ["b", "x", "a"]), (2, []), (3, ["a", "b", "c", "d"])], "basket_id int, items array<string>")
    got = {r.basket_id: r.features for r in recommend.basket_features(rows, vectors, 6, 2).collect()}
    assert got == {1: [3.0, 4.0, 1.0, 2.0, 0.0, 0.0], 2: [0.0] * 6, 3: [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]}


def test_exact_split(spark):
    df = spark.createDataFrame([(i,) for i in range(1001)], "k int")
    parts = [{r.k: r.part for r in scoring.exact_split(df.repartition(n), [0.5, 0.3, 0.2], "k", seed).collect()} for n, seed in ((1, 1), (7, 1), (3, 2))]
    assert parts[0] == parts[1] != parts[2]
    for p in parts:
        assert [sum(v == x for v in p.values()) for x in (0, 1, 2, None)] == [500, 300, 200, 1] and len(p) == 1001
    assert scoring.exact_split(df.filter("false"), [0.5], "k").count() == 0
    with pytest.raises(ValueError):
        scoring.exact_split(df, [0.9, 0.2], "k")


def test_one_vs_rest(spark):
    """The weights are those of a plain run of the same steps, and the loss falls."""
    import random

    import numpy as np

    rng = random.Random(1)
    rows = [(x := rng.gauss(0, 1), y := rng.gauss(0, 1), "a" if x > 0.3 else "b" if y > 0 else "c") for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, label string").repartition(3)
    w = scoring.fit_one_vs_rest(df, ["x", "y"], "label", ["a", "b", "c"], 12, 1.5, 0.01)
    data = np.array([[1.0, x, y] for x, y, _ in rows])
    for c in "abc":
        t, v = np.array([r[2] == c for r in rows], float), np.zeros(3)
        losses = []
        for _ in range(12):
            p = 1 / (1 + np.exp(-data @ v))
            losses.append(-np.mean(t * np.log(p) + (1 - t) * np.log(1 - p)))
            v = v - 1.5 * (data.T @ (p - t) / len(t) + 0.01 * np.r_[0, v[1:]])
        assert np.allclose(v, w[c]) and losses[-1] < losses[0]
    got = scoring.one_vs_rest(df, ["x", "y"], w)
    assert got.filter("predicted = label").count() > 240


def test_itemset_rules_by_enumeration(spark):
    """rules of itemsets of any size are those of enumeration, and the entries are read once (before: twice, and a tree a part was built of all baskets)."""
    import math
    import random
    from collections import Counter
    from itertools import combinations

    rng = random.Random(6)
    made = {b: [x for x in "abcdef" if rng.random() < (0.8 if x < "e" else 0.25)] for b in range(120)}
    rows = [(b, x) for b, s in made.items() for x in [*s, *s[:1]]] + [(3, None), (500, None), (None, "a"), (None, "z"), (501, "z")]
    made[500], made[None], made[501] = [], ["a", "z"], ["z"]
    read = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "p bigint, s string").repartition(3).mapInArrow(passing, "p bigint, s string")
    for support, least in ((0.1, 0.3), (1.0, 0.1)):
        n = Counter(c for s in made.values() for k in range(1, len(s) + 1) for c in combinations(sorted(s), k))
        often = {s for s, c in n.items() if c >= math.ceil(support * len(made))}
        want = {}
        for s in often:
            for c in s if len(s) > 1 else ():
                a = tuple(x for x in s if x != c)
                if n[s] / n[a] >= least:
                    want[a, c] = (n[s] / n[a], n[s] / n[a] / (n[c,] / len(made)), n[s] / len(made))
        read.value = 0
        out = baskets.itemset_rules(df, "p", "s", support, least)
        assert out.columns == ["antecedent", "consequent", "confidence", "lift", "support"]
        got = [((tuple(sorted(r.antecedent)), r.consequent[0]), (r.confidence, r.lift, r.support)) for r in out.collect()]
        assert len(got) == len(want) and all(want[k] == pytest.approx(v, rel=1e-12) for k, v in got)
        assert read.value == len(rows)
    assert baskets.itemset_rules(df.filter("false"), "p", "s").count() == 0
    one = spark.createDataFrame([(i, x) for i in range(3) for x in range(4)], "basket_id int, item int")
    assert baskets.itemset_rules(one, min_support=1.0).count() == sum(k * math.comb(4, k) for k in range(2, 5))
