"""Queries over chat, wire parsing, change rows and scoring."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import catalogue, chat, recommend, scoring
from .domain import chat as messages
from .domain import micros, products, shop_events, table

#: Rules on texts: priority, name, words, action.
RULES = [(1, "profanity", ["thing", "ated"], "BLOCK"), (2, "caution", ["ou", "ment"], "WARN"), (3, "watch", ["la "], "FLAG")]


def _intent_sql() -> str:
    out = "'GENERAL'"
    for name, words in reversed(chat.INTENTS):
        out = f"CASE WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in words)} THEN '{name}' ELSE {out} END"
    return out


def _product_lines(s, d):
    """One JSON text a product; every tenth is an array of two, every fifteenth broken, every twentieth without id."""
    p = products(s, d).withColumn("n", F.col("product_id").cast("int"))
    ident = F.when(F.col("n") % 20 == 0, "").otherwise(F.col("product_id"))
    one = F.struct(ident.alias("productId"), "name", "price", "inventory")
    text = F.when(F.col("n") % 15 == 0, F.lit("{broken")).when(F.col("n") % 10 == 0, F.to_json(F.array(one, one))).otherwise(F.to_json(one))
    return p.select(text.alias("value"))


def _cdc_lines(s, d):
    o = table(s, d, "orders").withColumn("k", F.pmod("o_orderkey", F.lit(10)))
    op = F.when(F.col("k") < 7, "c").when(F.col("k") == 7, "u").when(F.col("k") == 8, "d").otherwise("r")
    after = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return o.select(F.to_json(F.struct(op.alias("op"), after.alias("after"), F.struct(F.when(F.col("o_custkey") % 5 == 0, "order_items").otherwise("orders").alias("table")).alias("source"))).alias("value"))


def _wire_events(s, d):
    e = shop_events(s, d)
    body = F.struct(F.col("event_id").cast("string").alias("eventId"), F.col("session_id").alias("sessionId"), F.col("event_type").alias("eventType"), F.col("product_id").alias("productId"))
    return e.select(F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.lit("SHOPPING").alias("eventType"), body.alias("payload")))).otherwise(F.to_json(body)).alias("value"))


def _purchases(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", micros("o_orderdate").alias("us"), (F.col("o_totalprice") / 1000 - 1).alias("total_value"))
    n = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("basket_size"))
    w = W.partitionBy("o_custkey").orderBy("us", "o_orderkey")
    return o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey").cast("string")).alias("user_id"), "total_value", F.coalesce("basket_size", F.lit(0)).alias("basket_size"), (F.row_number().over(w) - 1).alias("history"))


_PUR = """n AS (SELECT l_orderkey, count(*) AS basket_size FROM lineitem GROUP BY 1),
pu AS (SELECT o_orderkey, CASE WHEN o_custkey % 50 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS user_id, o_totalprice / 1000 - 1 AS total_value, coalesce(basket_size, 0) AS basket_size,
  row_number() OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate), o_orderkey) - 1 AS history FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
sc AS (SELECT *, user_id IS NOT NULL AND total_value > 0 AND basket_size > 0 AS valid, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(-2.5::DOUBLE + (history - 3.0) / 2.0 * 1.8 + (total_value - 150.0) / 100.0 * 3.2 + (basket_size - 5.0) / 3.0 * 0.9))) AS p FROM pu)"""



def _purchase_lines(s, d):
    """_purchases as JSON texts, every ninth of them broken."""
    p = _purchases(s, d)
    body = F.to_json(F.struct(F.col("user_id").alias("userId"), F.col("total_value").alias("totalValue"), F.col("basket_size").cast("int").alias("basketSize"), F.col("history").cast("int").alias("userPurchaseHistory")))
    return p.select(F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("value"))


def _inventory_lines(s, d):
    """Inventory events with a currentProduct, which every fourth lacks; every fifteenth is broken."""
    p = products(s, d).withColumn("n", F.col("product_id").cast("int"))
    one = F.struct(F.col("product_id").alias("productId"), "name", "price", "inventory")
    body = F.to_json(F.struct(F.lit("INVENTORY_UPDATE").alias("eventType"), F.when(F.col("n") % 4 != 0, one).alias("currentProduct")))
    return p.select(F.when(F.col("n") % 15 == 0, F.lit("{broken")).otherwise(body).alias("value"))


def _predicted(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars")
    return table(s, d, "labels").join(docs, "doc_id").withColumn("predicted", (F.col("n_chars") > 800).cast("int"))


def shouted(text: str, languages: list[str]) -> dict[str, str]:
    """A translator for queries: it knows texts of even length only, and marks them."""
    if len(text) % 2:
        raise ValueError("no translation")
    return {x: f"{x}: {text}" for x in languages}


def _armoured():
    """AIS payloads of values that follow from an order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    values = {"type": 1 + k % 3, "repeat": F.lit(0), "mmsi": 200_000_000 + c * 7, "nav_status": k % 16, "rot": k % 256 - 128, "sog": c % 1023, "accuracy": k % 2, "lon": k * 7919 % 216_000_000 - 108_000_000, "lat": c * 104_729 % 108_000_000 - 54_000_000, "cog": k % 3600, "heading": c % 360, "second": k % 60}
    # A negative number's low bits are those of its two's complement.
    text = F.concat(*(F.lpad(F.bin(values[n].cast("long").bitwiseAND(F.lit((1 << (b - a)) - 1))), b - a, "0") for n, a, b, _ in parsing.AIS_FIELDS))
    six = F.regexp_extract_all(F.rpad(text, 168, "0"), F.lit("[01]{6}"), F.lit(0))
    return F.array_join(F.transform(F.transform(six, lambda x: F.conv(x, 2, 10).cast("int")), lambda v: F.char(v + F.when(v < 40, 48).otherwise(56))), "")


_SCALE = ["c_acctbal"]


def _scaled_sql(expr: str) -> str:
    return f"SELECT c_custkey, round({expr}, 6) AS scaled FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, max(abs(c_acctbal)) AS ab, avg(c_acctbal) AS av, stddev_samp(c_acctbal) AS sd FROM customer)"


def _scaled(how, **k):
    return lambda s, d: scoring.scale(table(s, d, "customer").select("c_custkey", "c_acctbal"), _SCALE, how, **k).select("c_custkey", F.round("c_acctbal_scaled", 6).alias("scaled"))


QUERIES = {
    "chat_intents": (lambda s, d: messages(s, d).filter("role = 'user'").groupBy(chat.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n")), f"SELECT {_intent_sql()} AS intent, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1"),
    "document_intents": (lambda s, d: table(s, d, "documents").select("doc_id", chat.intent(F.col("text")).alias("intent")), f"SELECT doc_id, {_intent_sql()} AS intent FROM documents"),
    "last_10_messages": (lambda s, d: chat.last_n(messages(s, d)).select("conv_id", "turn", "place"), "SELECT conv_id, turn, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place <= 10"),
    "chat_history": (
        lambda s, d: chat.history(messages(s, d)),
        "SELECT conv_id, turn, CAST(count(text) OVER w AS BIGINT) AS n_before, sha256(coalesce(array_to_string(list(text) OVER w, '|'), '')) AS history_sha256 FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)",
    ),
    "visible_messages": (
        lambda s, d: messages(s, d).withColumn("receiver", F.when(F.col("turn") % 3 != 0, F.col("conv_id") % 7)).withColumn("kind", F.when(F.col("role") == "system", "SYSTEM").otherwise("CHAT_MESSAGE")).filter(chat.visible_to(F.lit(3), F.col("kind"), F.col("conv_id") % 11, F.col("receiver"))).select("conv_id", "turn"),
        "SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0 OR role = 'system' OR conv_id % 11 = 3 OR conv_id % 7 = 3",
    ),
    "enriched_chat": (
        lambda s, d: chat.localised(chat.translated(chat.enrich(messages(s, d).select(F.col("conv_id").cast("string").alias("userId"), F.lit(None).cast("string").alias("toUserId"), F.when(F.col("role") == "system", "SYSTEM").otherwise("CHAT_MESSAGE").alias("type"), F.col("text").alias("message"), F.col("turn").alias("timestamp"), F.when(F.col("turn") % 3 == 0, F.array(F.lit("DE"), F.lit("FR"))).otherwise(F.array(F.lit("FR"))).alias("languages"))), shouted), "DE")
        .groupBy("userId").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if("translated").alias("translated"), F.sum(F.length("text")).alias("chars")),
        """SELECT CAST(conv_id AS VARCHAR) AS "userId", count(*) AS n, count(DISTINCT (role = 'system', text, turn)) AS ids, count(*) FILTER (t) AS translated, sum(length(text) + CASE WHEN t THEN 4 ELSE 0 END)::BIGINT AS chars
        FROM (SELECT *, role <> 'system' AND turn % 3 = 0 AND length(text) % 2 = 0 AS t FROM conversations) GROUP BY 1""",
    ),
    "prompts": (
        lambda s, d: messages(s, d).filter("role = 'user'").select("conv_id", "turn", F.sha2(chat.prompt("You are a shop assistant.", F.when(F.col("turn") % 2 == 0, "2 items"), F.lit(None).cast("string"), F.lit("bolt"), F.col("text")), 256).alias("sha")),
        "SELECT conv_id, turn, sha256('You are a shop assistant.' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Cart: 2 items' || chr(10) ELSE '' END || 'Recommendations: bolt' || chr(10) || 'Customer: ' || text) AS sha FROM conversations WHERE role = 'user'",
    ),
    "moderation": (
        lambda s, d: recommend.first_rule(messages(s, d), RULES, "text").groupBy("action", "rule").agg(F.count("*").alias("n")),
        "SELECT CASE WHEN contains(l, 'thing') OR contains(l, 'ated') THEN 'BLOCK' WHEN contains(l, 'ou') OR contains(l, 'ment') THEN 'WARN' WHEN contains(l, 'la ') THEN 'FLAG' ELSE 'ALLOW' END AS action, CASE WHEN contains(l, 'thing') OR contains(l, 'ated') THEN 'profanity' WHEN contains(l, 'ou') OR contains(l, 'ment') THEN 'caution' WHEN contains(l, 'la ') THEN 'watch' END AS rule, count(*) AS n FROM (SELECT lower(text) AS l FROM conversations) GROUP BY 1, 2",
    ),
    "assistant_answers": (lambda s, d: chat.answered(messages(s, d).filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt")), len_answer).select("conv_id", "turn", "answer"), "SELECT conv_id, turn, 'seen ' || length(text) AS answer FROM conversations WHERE role = 'user'"),
    "parsed_products": (
        lambda s, d: parsing.products(_product_lines(s, d)).select("productId", "name", "price", "inventory"),
        "SELECT CAST(p_partkey AS VARCHAR) AS \"productId\", p_name AS name, p_retailprice AS price, p_size AS inventory FROM part, (VALUES (1), (2)) t(k) WHERE p_partkey % 15 <> 0 AND p_partkey % 20 <> 0 AND (k = 1 OR p_partkey % 10 = 0)",
    ),
    "parsed_order_items": (
        lambda s, d: parsing.order_items(table(s, d, "lineitem").select(F.to_json(F.struct(F.when(F.col("l_linenumber") > 1, F.col("l_orderkey").cast("string")).alias("orderId"), F.col("l_partkey").cast("string").alias("productId"), (F.col("l_quantity").cast("int") - 3).alias("quantity"))).alias("value"))).groupBy("productId").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity")),
        "SELECT CAST(l_partkey AS VARCHAR) AS \"productId\", count(*) AS n, CAST(sum(CAST(l_quantity AS INTEGER) - 3) AS BIGINT) AS quantity FROM lineitem WHERE l_linenumber > 1 AND CAST(l_quantity AS INTEGER) > 3 GROUP BY 1",
    ),
    "parsed_events": (
        lambda s, d: parsing.shopping_events(_wire_events(s, d)).groupBy("eventType").agg(F.count("*").alias("n"), F.count_distinct("sessionId").alias("sessions")),
        "SELECT CASE event_type WHEN 'view' THEN 'PRODUCT_VIEW' WHEN 'click' THEN 'ADD_TO_CART' WHEN 'purchase' THEN 'ORDER_PLACED' WHEN 'signup' THEN 'USER_LOGIN' END AS \"eventType\", count(*) AS n, count(DISTINCT user_id) AS sessions FROM events WHERE event_type <> 'error' GROUP BY 1",
    ),
    "parsed_patterns": (
        lambda s, d: parsing.patterns(table(s, d, "part").select(F.concat(F.col("p_brand"), F.lit(","), "p_type", F.lit("->"), "p_name", F.lit(":0."), (F.col("p_size") % 9 + 1).cast("string")).alias("value"))).select(F.array_join("antecedents", ",").alias("antecedents"), "consequent", *(F.round(c, 6).alias(c) for c in ("support", "confidence", "lift"))),
        "SELECT p_brand || ',' || p_type AS antecedents, p_name AS consequent, round(c * 0.3::DOUBLE, 6) AS support, c AS confidence, round(c / 0.2::DOUBLE, 6) AS lift FROM (SELECT *, CAST('0.' || (p_size % 9 + 1) AS DOUBLE) AS c FROM part)",
    ),
    "cdc_inserts": (
        lambda s, d: parsing.cdc(_cdc_lines(s, d)).filter("op = 'c' AND table = 'orders'").select(F.concat(F.lit("ORDER_"), F.get_json_object("after", "$.id")).alias("productId"), F.lit("INVENTORY_DECREASED").alias("eventType")),
        "SELECT 'ORDER_' || o_orderkey AS \"productId\", 'INVENTORY_DECREASED' AS \"eventType\" FROM orders WHERE o_orderkey % 10 < 7 AND o_custkey % 5 <> 0",
    ),
    "cdc_merge": (
        lambda s, d: catalogue.apply_changes(table(s, d, "orders").select((F.col("o_orderkey") % 500).alias("id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "d").otherwise("u").alias("op"), "o_totalprice"), "id", ["seq"]),
        "SELECT id, seq, o_totalprice FROM (SELECT o_orderkey % 500 AS id, o_orderkey AS seq, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderkey % 500 ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND o_orderstatus <> 'F'",
    ),
    "envelopes": (
        lambda s, d: table(s, d, "orders").select(parsing.envelope("INVENTORY_UPDATE", F.struct(F.col("o_orderkey").alias("id")), F.col("o_orderkey")).alias("value")).select(F.get_json_object("value", "$.payload.id").cast("long").alias("id"), F.get_json_object("value", "$.eventType").alias("kind")),
        "SELECT o_orderkey AS id, 'INVENTORY_UPDATE' AS kind FROM orders",
    ),
    "event_router": (
        lambda s, d: shop_events(s, d).groupBy(F.when(F.col("event_type") == "ORDER_PLACED", "orders").when(F.col("event_type").isin("ADD_TO_CART", "REMOVE_FROM_CART"), "cart").when(F.col("event_type") == "PRODUCT_VIEW", "views").otherwise("default").alias("channel")).agg(F.count("*").alias("n")),
        "SELECT CASE event_type WHEN 'purchase' THEN 'orders' WHEN 'click' THEN 'cart' WHEN 'view' THEN 'views' ELSE 'default' END AS channel, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1",
    ),
    "ais_decode": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", parsing.ais(F.when(F.col("o_orderkey") % 50 == 0, "short").otherwise(_armoured())).alias("m")).select("o_orderkey", "m.type", "m.mmsi", "m.nav_status", "m.rot", "m.sog", F.round(F.col("m.lon") * 600000).cast("long").alias("lon"), F.round(F.col("m.lat") * 600000).cast("long").alias("lat"), "m.cog"),
        """SELECT o_orderkey, CASE WHEN ok THEN 1 + o_orderkey % 3 END AS type, CASE WHEN ok THEN 200000000 + o_custkey * 7 END AS mmsi, CASE WHEN ok THEN o_orderkey % 16 END AS nav_status, CASE WHEN ok THEN o_orderkey % 256 - 128 END AS rot,
        CASE WHEN ok THEN o_custkey % 1023 END AS sog, CASE WHEN ok THEN o_orderkey * 7919 % 216000000 - 108000000 END AS lon, CASE WHEN ok THEN o_custkey * 104729 % 108000000 - 54000000 END AS lat, CASE WHEN ok THEN o_orderkey % 3600 END AS cog
        FROM (SELECT *, o_orderkey % 50 <> 0 AS ok FROM orders)""",
    ),
    "classified_purchases": (
        lambda s, d: scoring.classify(_purchases(s, d)).select("o_orderkey", "channel", F.round("p", 6).alias("p")),
        f"WITH {_PUR} SELECT o_orderkey, CASE WHEN valid IS NOT TRUE THEN 'INVALID_DATA' WHEN p >= 0.5 THEN 'HIGH_VALUE' ELSE 'STANDARD' END AS channel, CASE WHEN valid THEN round(p, 6) END AS p FROM sc",
    ),
    "purchase_lines": (
        lambda s, d: scoring.classify_lines(_purchase_lines(s, d)).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum("p"), 4).alias("p")),
        f"WITH {_PUR} SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'PARSE_ERROR' WHEN valid IS NOT TRUE THEN 'INVALID_DATA' WHEN p >= 0.5 THEN 'HIGH_VALUE' ELSE 'STANDARD' END AS channel, count(*) AS n, round(sum(CASE WHEN valid AND o_orderkey % 9 <> 0 THEN p END), 4) AS p FROM sc GROUP BY 1",
    ),
    "current_products": (
        lambda s, d: parsing.current_products(_inventory_lines(s, d)).select("productId", "name", "price", "inventory"),
        "SELECT CAST(p_partkey AS VARCHAR) AS \"productId\", p_name AS name, p_retailprice AS price, p_size AS inventory FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 15 <> 0",
    ),
    "user_languages": (
        lambda s, d: chat.languages(messages(s, d).select((F.col("conv_id") % 40).alias("user_id"), F.when(F.col("turn") % 3 != 0, F.concat(F.lit("L"), F.length("text") % 5)).alias("language"), "conv_id", "turn"), order=("conv_id", "turn")),
        "SELECT user_id, arg_max(language, (conv_id, turn)) AS language FROM (SELECT conv_id % 40 AS user_id, conv_id, turn, CASE WHEN turn % 3 <> 0 THEN 'L' || (length(text) % 5) END AS language FROM conversations) WHERE language IS NOT NULL GROUP BY 1",
    ),
    "three_class_purchases": (
        lambda s, d: scoring.classify(_purchases(s, d)).filter("channel <> 'INVALID_DATA'").groupBy(scoring.three_classes(F.col("p")).alias("class")).agg(F.count("*").alias("n")),
        f"WITH {_PUR} SELECT CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS class, count(*) AS n FROM sc WHERE valid GROUP BY 1",
    ),
    "feature_map": (
        lambda s, d: _purchases(s, d).select("o_orderkey", *(F.element_at(scoring.explain(F.col("history"), F.col("total_value"), F.col("basket_size"))[0], n).alias(n) for n in scoring.FEATURES), F.element_at(scoring.explain(F.col("history"), F.col("total_value"), F.col("basket_size"))[1], "value").alias("importance")),
        f"WITH {_PUR} SELECT o_orderkey, (history - 3.0::DOUBLE) / 2.0::DOUBLE AS history, (total_value - 150.0::DOUBLE) / 100.0::DOUBLE AS value, (basket_size - 5.0::DOUBLE) / 3.0::DOUBLE AS size, 3.2::DOUBLE AS importance FROM pu",
    ),
    "scaler_minmax": (_scaled("minmax"), _scaled_sql("(c_acctbal - lo) / (hi - lo)")),
    "scaler_max": (_scaled("max"), _scaled_sql("c_acctbal / ab")),
    "scaler_range": (_scaled("range", low=-1.0, high=1.0), _scaled_sql("(c_acctbal - lo) / (hi - lo) * 2.0 - 1.0")),
    "scaler_standard": (_scaled("standard"), _scaled_sql("(c_acctbal - av) / sd")),
    "scaler_decimal": (_scaled("decimal"), _scaled_sql("c_acctbal / pow(10, ceil(log10(ab)))")),
    "exact_split": (
        lambda s, d: scoring.exact_split(table(s, d, "orders").select("o_orderkey"), [0.6, 0.25, 0.1], "o_orderkey", 7),
        """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY CAST('0x' || substr(md5('7|' || o_orderkey), 1, 15) AS BIGINT), o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders),
        e AS (SELECT *, CAST(floor(n * 0.6::DOUBLE + 1e-9) AS BIGINT) AS a, CAST(floor(n * 0.25::DOUBLE + 1e-9) AS BIGINT) AS b, CAST(floor(n * 0.1::DOUBLE + 1e-9) AS BIGINT) AS c FROM r)
        SELECT o_orderkey, CAST(CASE WHEN place < a THEN 0 WHEN place < a + b THEN 1 WHEN place < a + b + c THEN 2 END AS INTEGER) AS part FROM e""",
    ),
    "one_hot": (lambda s, d: scoring.one_hot(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["HOUSEHOLD", "MACHINERY"]).groupBy("c_mktsegment_HOUSEHOLD", "c_mktsegment_MACHINERY").agg(F.count("*").alias("n")), "SELECT CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS \"c_mktsegment_HOUSEHOLD\", CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS \"c_mktsegment_MACHINERY\", count(*) AS n FROM customer GROUP BY 1, 2"),
    "folds": (lambda s, d: scoring.folds(table(s, d, "customer"), "c_custkey", 5).groupBy("fold").agg(F.count("*").alias("n")), "SELECT CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold, count(*) AS n FROM customer GROUP BY 1"),
    "confusion_matrix": (lambda s, d: scoring.confusion(_predicted(s, d), "quality", "predicted"), "SELECT quality, CAST(n_chars > 800 AS INTEGER) AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"),
    "confusion_metrics": (
        lambda s, d: scoring.binary_metrics(_predicted(s, d), "quality", "predicted").select("tp", "tn", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f_beta", "mcc", "balanced"))),
        """WITH x AS (SELECT quality AS a, CAST(n_chars > 800 AS INTEGER) AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (a = 1 AND p = 1) AS tp, count(*) FILTER (a = 0 AND p = 0) AS tn, count(*) FILTER (a = 0 AND p = 1) AS fp, count(*) FILTER (a = 1 AND p = 0) AS fn FROM x)
        SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f_beta,
        round((tp * tn - fp * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced FROM c""",
    ),
    "regression_metrics": (
        lambda s, d: scoring.regression_metrics(table(s, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500.0).alias("guess")), "l_extendedprice", "guess").select("n", F.round("rmse", 2).alias("rmse"), F.round("r2", 5).alias("r2")),
        "SELECT count(*) AS n, round(sqrt(sum((l_extendedprice - l_quantity * 1500.0::DOUBLE) ** 2) / count(*)), 2) AS rmse, round(1 - sum((l_extendedprice - l_quantity * 1500.0::DOUBLE) ** 2) / (var_samp(l_extendedprice) * (count(*) - 1)), 5) AS r2 FROM lineitem",
    ),
}


def len_answer(text: str) -> str:
    """Stands in for a language model."""
    return f"seen {len(text)}"
