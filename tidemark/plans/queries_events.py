"""Queries over shopping events and product updates: sessions, sequences, inventory, timers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baskets, cep, inventory, recommend, sessions
from ..operators.sessions import ADD, ORDER, VIEW
from ..streaming import patterns
from ..streaming.patterns import Pattern
from .domain import ORDER as SEQ
from .domain import SHOP, UPDATES, W, micros, product_updates, products, shop_events, table

HALF_DAY = 12 * 3_600_000_000


def _sess(gap):
    return lambda s, d: sessions.sessions(shop_events(s, d), gap)


def _sess_sql(gap_us: int) -> str:
    return f"""WITH {SHOP}, m AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > {gap_us} THEN 1 ELSE 0 END AS cut FROM shop WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY session_id ORDER BY us, event_id) AS island FROM m),
a AS (SELECT session_id, min(ts) AS start, max(ts) + to_microseconds({gap_us}) AS "end", (max(us) - min(us) + {gap_us}) // 1000000 AS duration_s,
  count(*) FILTER (event_type = '{VIEW}') AS view_count, count(*) FILTER (event_type = '{ADD}') AS add_count, count(*) FILTER (event_type = '{ORDER}') AS purchases,
  CAST(count(DISTINCT product_id) + max(CASE WHEN product_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unique_products,
  list_sort(list(product_id) FILTER (event_type = '{VIEW}')) AS viewed, list_sort(list(product_id) FILTER (event_type = '{ADD}')) AS added,
  sum(CASE WHEN event_type = '{ADD}' THEN value ELSE 0.0 END) AS added_value
  FROM g GROUP BY session_id, island),
sess AS (SELECT session_id, start, "end", duration_s, view_count, add_count, view_count + add_count + least(purchases, 1) AS total_events, unique_products, purchases > 0 AS completed_purchase, viewed, added, added_value,
  CASE WHEN purchases > 0 THEN 'PURCHASE' WHEN add_count > 0 THEN 'ABANDONED_CART' WHEN view_count >= 3 THEN 'BROWSER' ELSE 'QUICK_VISIT' END AS session_type FROM a)"""


_COLS = 'session_id, epoch_us(start) AS start_us, epoch_us("end") AS end_us, duration_s, view_count, add_count, total_events, unique_products, completed_purchase, coalesce(array_to_string(viewed, \',\'), \'\') AS viewed, coalesce(array_to_string(added, \',\'), \'\') AS added, session_type'


def _flat(rows):
    return rows.select("session_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "duration_s", "view_count", "add_count", "total_events", "unique_products", "completed_purchase", F.array_join("viewed", ",").alias("viewed"), F.array_join("added", ",").alias("added"), "session_type")


QUERIES = {
    "sessions_30m": (lambda s, d: _flat(_sess("30 minutes")(s, d)), f"{_sess_sql(1_800_000_000)} SELECT {_COLS} FROM sess"),
    "sessions_12h": (lambda s, d: _flat(_sess("12 hours")(s, d)), f"{_sess_sql(HALF_DAY)} SELECT {_COLS} FROM sess"),
    "session_type_counts": (
        lambda s, d: sessions.type_counts(_sess("12 hours")(s, d)).select("session_type", "n", "events", F.round("avg_products", 6).alias("avg_products"), F.round("avg_adds", 6).alias("avg_adds")),
        f"{_sess_sql(HALF_DAY)} SELECT session_type, count(*) AS n, CAST(sum(total_events) AS BIGINT) AS events, round(avg(unique_products), 6) AS avg_products, round(avg(add_count), 6) AS avg_adds FROM sess GROUP BY session_type",
    ),
    "conversion_rate": (
        lambda s, d: sessions.conversion(_sess("12 hours")(s, d)).select("n", "converted", F.round("rate", 6).alias("rate")),
        f"{_sess_sql(HALF_DAY)} SELECT count(*) AS n, count(*) FILTER (completed_purchase) AS converted, round(count(*) FILTER (completed_purchase) / count(*), 6) AS rate FROM sess",
    ),
    "high_value_abandoned": (
        lambda s, d: sessions.abandoned_of_value(_sess("12 hours")(s, d)).select("session_id", micros("start").alias("start_us"), F.round("added_value", 4).alias("added_value")),
        f"{_sess_sql(HALF_DAY)} SELECT session_id, epoch_us(start) AS start_us, round(added_value, 4) AS added_value FROM sess WHERE session_type = 'ABANDONED_CART' AND added_value >= 100",
    ),
    "tumbling_hour": (
        lambda s, d: sessions.windowed_counts(table(s, d, "events"), "1 hour").select(micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total")),
        "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    ),
    "sliding_hour": (
        lambda s, d: sessions.windowed_counts(table(s, d, "events"), "1 hour", "30 minutes").select(micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total")),
        """SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) - k * 1800000000 AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total
        FROM events, (VALUES (0), (1)) AS t(k) GROUP BY 1, 2""",
    ),
    "quick_purchase": (
        lambda s, d: cep.quick_purchase(shop_events(s, d), HALF_DAY),
        f"""WITH {SHOP}, n AS (SELECT *, lead(event_type) OVER w AS k1, lead(event_type, 2) OVER w AS k2, lead(us, 2) OVER w AS u2, lead(product_id, 2) OVER w AS p2 FROM shop WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id))
        SELECT session_id, event_id, us AS first_us, u2 AS last_us, u2 - us AS took_us, p2 AS product_id FROM n WHERE event_type = '{VIEW}' AND k1 = '{ADD}' AND k2 = '{ORDER}' AND u2 - us < {HALF_DAY}""",
    ),
    "repeated_browsing": (
        lambda s, d: cep.repeated(shop_events(s, d), within_us=6 * HALF_DAY),
        f"""WITH {SHOP}, v AS (SELECT session_id, event_id, us, list(us) OVER w AS lu, list(product_id) OVER w AS lp FROM shop WHERE event_type = '{VIEW}' WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
        SELECT session_id, event_id, k AS length, us AS first_us, lu[k] AS last_us, array_to_string(lp[1:k], ',') AS products FROM v, (SELECT CAST(unnest([3,4,5,6,7,8,9,10]) AS INTEGER) AS k) WHERE len(lu) >= k AND lu[k] - us < {6 * HALF_DAY}""",
    ),
    "abandonment_intent": (
        lambda s, d: cep.abandonment_intent(shop_events(s, d), HALF_DAY),
        f"""WITH {SHOP}, a AS (SELECT session_id, min(us) AS first_add, max(us) AS last_add, count(*) AS adds, array_to_string(list_sort(list(DISTINCT product_id)), ',') AS products FROM shop WHERE event_type = '{ADD}' GROUP BY 1)
        SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM shop o WHERE o.session_id = a.session_id AND o.event_type = '{ORDER}' AND o.us BETWEEN a.last_add AND a.last_add + {HALF_DAY})""",
    ),
    "abandonment_nfa": (
        lambda s, d: cep.abandonment_faithful(shop_events(s, d)),
        f"WITH {SHOP} SELECT session_id, min(us) AS first_add, max(us) AS last_add, count(*) AS adds FROM shop WHERE event_type = '{ADD}' GROUP BY 1",
    ),
    "error_bursts": (
        lambda s, d: cep.burst(table(s, d, "events").withColumn("us", micros("ts")), 3, HALF_DAY, "user_id", F.col("event_type") == "error"),
        f"""SELECT user_id, event_id, us, in_range FROM (SELECT user_id, event_id, epoch_us(ts) AS us, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {HALF_DAY} PRECEDING AND CURRENT ROW) AS in_range FROM events WHERE event_type = 'error') WHERE in_range >= 3""",
    ),
    "signup_not_followed": (
        lambda s, d: cep.not_followed(shop_events(s, d), "USER_LOGIN", ORDER, HALF_DAY),
        f"""WITH {SHOP} SELECT session_id, event_id, us FROM shop a WHERE event_type = 'USER_LOGIN' AND NOT EXISTS (SELECT 1 FROM shop b WHERE b.session_id = a.session_id AND b.event_type = '{ORDER}' AND (b.us > a.us OR (b.us = a.us AND b.event_id > a.event_id)) AND b.us - a.us <= {HALF_DAY})""",
    ),
    "view_followed_by_any_order": (
        lambda s, d: cep.followed_by_any(shop_events(s, d), VIEW, ORDER, HALF_DAY),
        f"WITH {SHOP} SELECT a.session_id, a.event_id AS first_id, b.event_id AS then_id, b.us - a.us AS took_us FROM shop a JOIN shop b ON a.session_id = b.session_id AND a.event_type = '{VIEW}' AND b.event_type = '{ORDER}' AND b.us > a.us AND b.us - a.us < {HALF_DAY}",
    ),
}

_LAG = f"""{UPDATES}, l AS (SELECT *, lag(inventory) OVER w AS pi, lag(price) OVER w AS pp, coalesce(us - lag(us) OVER w, 0) AS since_us FROM upd WINDOW w AS {W}),
k AS (SELECT *, CASE WHEN pi = inventory THEN NULL WHEN inventory = 0 THEN 'OUT_OF_STOCK' WHEN pi = 0 THEN 'BACK_IN_STOCK' WHEN inventory < pi THEN 'INVENTORY_DECREASED' ELSE 'INVENTORY_INCREASED' END AS stock,
  CASE WHEN abs(price - pp) > 0.01 THEN 'PRICE_CHANGED' END AS moved, CASE WHEN pp <> 0 THEN (price - pp) / pp * 100 END AS pct FROM l)"""
_REF = f"""{_LAG}, ev AS (SELECT *, 'PRODUCT_ADDED' AS event_type FROM k WHERE pi IS NULL UNION ALL SELECT *, stock FROM k WHERE pi IS NOT NULL AND stock IS NOT NULL UNION ALL SELECT *, moved FROM k WHERE pi IS NOT NULL AND moved IS NOT NULL)"""
_ORIG = f"""{_LAG}, ev AS (SELECT *, CASE WHEN pi IS NULL THEN 'PRODUCT_ADDED' ELSE coalesce(stock, moved, 'PRODUCT_UPDATED') END AS event_type FROM k)"""
_OUT = ["product_id", "us", "seq1", "seq2", "event_type", "prev_inventory AS previous", "inventory AS current", "since_us"]
_SQL_OUT = "product_id, us, seq1, seq2, event_type, pi AS previous, inventory AS current, since_us"
_AL = ["product_id", "us", "seq1", "seq2", "channel", "severity", "inventory AS current"]


def _events(mode):
    return lambda s, d: inventory.classify(product_updates(s, d), SEQ, mode)


def _log(s, d):
    """Order rows and restocks of each part: every seventh line restocks."""
    u = product_updates(s, d)
    restock = F.pmod("seq1", F.lit(7)) == 0
    return u.select("product_id", *SEQ, F.when(restock, F.col("inventory") * 2).alias("inventory"), F.when(~restock, F.col("inventory")).alias("quantity"))


_DAY = 86_400_000_000
_HORIZON = 1_100_000_000_000_000
QUERIES |= {
    "inventory_events_refactored": (lambda s, d: _events("refactored")(s, d).selectExpr(*_OUT), f"WITH {_REF} SELECT {_SQL_OUT} FROM ev"),
    "inventory_events_original": (lambda s, d: _events("original")(s, d).selectExpr(*_OUT), f"WITH {_ORIG} SELECT {_SQL_OUT} FROM ev"),
    "alerts_original": (
        lambda s, d: inventory.alerts(_events("original")(s, d), "original").selectExpr(*_AL),
        f"""WITH {_ORIG} SELECT product_id, us, seq1, seq2, 'LOW_STOCK_ALERT' AS channel, CASE WHEN inventory <= 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, inventory AS current FROM ev WHERE inventory > 0 AND inventory <= 10
        UNION ALL SELECT product_id, us, seq1, seq2, 'SALE_STARTED', 'INFO', inventory FROM ev WHERE event_type = 'PRICE_CHANGED' AND pct <= -10""",
    ),
    "alerts_refactored": (
        lambda s, d: inventory.alerts(_events("refactored")(s, d)).selectExpr(*_AL),
        f"""WITH {_REF} SELECT product_id, us, seq1, seq2, 'LOW_STOCK' AS channel, CASE WHEN inventory <= 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, inventory AS current FROM ev WHERE event_type <> 'PRICE_CHANGED' AND inventory > 0 AND inventory < 10
        UNION ALL SELECT product_id, us, seq1, seq2, 'OUT_OF_STOCK', 'CRITICAL', inventory FROM ev WHERE event_type <> 'PRICE_CHANGED' AND inventory = 0
        UNION ALL SELECT product_id, us, seq1, seq2, 'PRICE_DROP', 'INFO', inventory FROM ev WHERE event_type = 'PRICE_CHANGED' AND pct <= -10""",
    ),
    "low_stock_alerts": (
        lambda s, d: inventory.alerts(_events("refactored")(s, d)).filter("channel = 'LOW_STOCK'").groupBy("severity").agg(F.count("*").alias("n")),
        f"WITH {_REF} SELECT CASE WHEN inventory <= 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, count(*) AS n FROM ev WHERE event_type <> 'PRICE_CHANGED' AND inventory > 0 AND inventory < 10 GROUP BY 1",
    ),
    "change_tracker": (
        lambda s, d: inventory.track(product_updates(s, d), SEQ).select("product_id", "us", "seq1", "seq2", "change", "delta", "since_us"),
        f"""WITH {_LAG}, t AS (SELECT *, CASE WHEN inventory < pi THEN 'SALE' WHEN inventory > pi THEN 'RESTOCK' END AS c FROM k)
        SELECT product_id, us, seq1, seq2, 'NEW_PRODUCT' AS change, NULL AS delta, since_us FROM t WHERE pi IS NULL UNION ALL SELECT product_id, us, seq1, seq2, c, inventory - pi, since_us FROM t WHERE c IS NOT NULL
        UNION ALL SELECT product_id, us, seq1, seq2, 'PRICE_CHANGE', NULL, since_us FROM t WHERE moved IS NOT NULL""",
    ),
    "router": (
        lambda s, d: inventory.route(products(s, d)).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.avg("discount"), 3).alias("discount")),
        """WITH p AS (SELECT p_size AS inventory, 3.0::DOUBLE + (p_partkey % 21) / 10.0::DOUBLE AS rating, p_retailprice AS price FROM part)
        SELECT 'MAIN' AS channel, count(*) AS n, CAST(NULL AS DOUBLE) AS discount FROM p UNION ALL
        SELECT CASE WHEN inventory = 0 THEN 'OUT_OF_STOCK' ELSE 'LOW_STOCK' END, count(*), NULL FROM p WHERE inventory < 10 GROUP BY 1 UNION ALL
        SELECT 'PRICE_DROP', count(*), 13.043 FROM p WHERE rating > 4.5 AND price < 100 HAVING count(*) > 0""",
    ),
    "clamped_deduction": (
        lambda s, d: inventory.deduct(_log(s, d), SEQ).select("product_id", "us", "seq1", "seq2", "seq3", "quantity", "previous", "current", "event_type", "sufficient"),
        f"""WITH RECURSIVE {UPDATES}, o AS (SELECT *, row_number() OVER {W} AS n FROM (SELECT product_id, us, seq1, seq2, seq3, seq4, seq5, CASE WHEN seq1 % 7 = 0 THEN inventory * 2 END AS stock, CASE WHEN seq1 % 7 <> 0 THEN inventory END AS quantity FROM upd) WHERE coalesce(quantity, 1) > 0),
        r AS (SELECT o.*, CAST(0 AS BIGINT) AS previous, CAST(coalesce(stock, 0) AS BIGINT) AS current, stock IS NOT NULL AS known FROM o WHERE n = 1
          UNION ALL SELECT o.*, r.current, CAST(CASE WHEN o.stock IS NOT NULL THEN o.stock ELSE greatest(r.current - o.quantity, 0) END AS BIGINT), r.known OR o.stock IS NOT NULL FROM r JOIN o ON o.product_id = r.product_id AND o.n = r.n + 1)
        SELECT product_id, us, seq1, seq2, seq3, quantity, previous, current, CASE WHEN known AND current = 0 THEN 'OUT_OF_STOCK' ELSE 'INVENTORY_DECREASED' END AS event_type, NOT known OR previous >= quantity AS sufficient FROM r WHERE quantity IS NOT NULL""",
    ),
    "stale_products": (
        lambda s, d: inventory.stale(product_updates(s, d), SEQ, 90 * _DAY, _HORIZON).select("product_id", "us", "seq1", "seq2", "idle_us", "fires_us", "severity"),
        f"WITH {UPDATES}, l AS (SELECT *, coalesce(lead(us) OVER {W}, {_HORIZON}) - us AS idle_us FROM upd) SELECT product_id, us, seq1, seq2, idle_us, us + {90 * _DAY} AS fires_us, 'MEDIUM' AS severity FROM l WHERE idle_us >= {90 * _DAY}",
    ),
    "stale_at_horizon": (
        lambda s, d: inventory.stale_at_horizon(product_updates(s, d), SEQ, 90 * _DAY, _HORIZON).select("product_id", "us", "seq1", "seq2", "idle_us", "fires_us", "severity"),
        f"WITH {UPDATES}, l AS (SELECT *, coalesce(lead(us) OVER {W}, {_HORIZON}) - us AS idle_us FROM upd) SELECT product_id, us, seq1, seq2, idle_us, us + {90 * _DAY} AS fires_us, CASE WHEN idle_us > {180 * _DAY} THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM l WHERE idle_us >= {90 * _DAY}",
    ),
    "stale_uncancelled": (
        lambda s, d: inventory.stale_uncancelled(product_updates(s, d), SEQ, 90 * _DAY, 120 * _DAY, _HORIZON).select("product_id", "us", "seq1", "seq2", "fires_us", "idle_us"),
        f"WITH {UPDATES} SELECT product_id, us, seq1, seq2, us + {120 * _DAY} AS fires_us, us + {120 * _DAY} - last AS idle_us FROM (SELECT *, (SELECT max(o.us) FROM upd o WHERE o.product_id = u.product_id AND o.us BETWEEN u.us AND u.us + {120 * _DAY}) AS last FROM upd u) WHERE us + {120 * _DAY} <= {_HORIZON} AND us + {120 * _DAY} - last > {90 * _DAY}",
    ),
    "snapshots_through_idle": (
        lambda s, d: inventory.periods(inventory.snapshot_spans(product_updates(s, d), 30 * _DAY, SEQ, _HORIZON)).groupBy("period").agg(F.count("*").alias("products"), F.sum("updates").alias("updates"), F.sum(F.col("inventory").cast("long")).alias("inventory")),
        f"""WITH {UPDATES}, p AS (SELECT DISTINCT product_id FROM upd), g AS (SELECT product_id, unnest(range((SELECT min(us) // {30 * _DAY} FROM upd), {_HORIZON} // {30 * _DAY})) AS period FROM p),
        s AS (SELECT product_id, us // {30 * _DAY} AS period, count(*) AS updates, arg_max(inventory, (us, seq1, seq2, seq3, seq4, seq5)) AS inventory FROM upd GROUP BY 1, 2),
        f AS (SELECT g.product_id, g.period, coalesce(s.updates, 0) AS updates, last_value(s.inventory IGNORE NULLS) OVER (PARTITION BY g.product_id ORDER BY g.period) AS inventory FROM g LEFT JOIN s USING (product_id, period))
        SELECT period, count(*) AS products, sum(updates)::BIGINT AS updates, sum(inventory)::BIGINT AS inventory FROM f WHERE inventory IS NOT NULL GROUP BY 1""",
    ),
    "change_reasons": (
        lambda s, d: _events("refactored")(s, d).withColumn("reason", inventory.reason()).filter("event_type NOT IN ('PRODUCT_ADDED', 'PRICE_CHANGED')").select("product_id", "us", "seq1", "seq2", "reason"),
        f"""WITH {_REF} SELECT product_id, us, seq1, seq2, CASE event_type WHEN 'OUT_OF_STOCK' THEN 'Product is now out of stock' WHEN 'BACK_IN_STOCK' THEN 'Product restocked with ' || inventory || ' units'
        WHEN 'INVENTORY_DECREASED' THEN (pi - inventory) || ' units sold/removed' ELSE (inventory - pi) || ' units added to inventory' END AS reason FROM ev WHERE event_type NOT IN ('PRODUCT_ADDED', 'PRICE_CHANGED')""",
    ),
    "running_sales": (
        lambda s, d: inventory.running(product_updates(s, d), SEQ).select("product_id", "us", "seq1", "seq2", "running_total", F.round("running_avg", 6).alias("running_avg")),
        f"WITH {UPDATES} SELECT product_id, us, seq1, seq2, CAST(sum(inventory) OVER w AS BIGINT) AS running_total, round(avg(price) OVER w, 6) AS running_avg FROM upd WINDOW w AS (PARTITION BY product_id ORDER BY us, seq1, seq2, seq3, seq4, seq5 ROWS UNBOUNDED PRECEDING)",
    ),
    "last10_prices": (
        lambda s, d: inventory.running(product_updates(s, d), SEQ).select("product_id", "us", "seq1", "seq2", F.size("last_prices").cast("long").alias("n"), F.array_max("last_prices").alias("top"), F.element_at("last_prices", 1).alias("oldest")),
        f"WITH {UPDATES} SELECT product_id, us, seq1, seq2, count(*) OVER w AS n, max(price) OVER w AS top, first_value(price) OVER w AS oldest FROM upd WINDOW w AS (PARTITION BY product_id ORDER BY us, seq1, seq2, seq3, seq4, seq5 ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    ),
    "product_snapshots": (
        lambda s, d: inventory.snapshots(product_updates(s, d), 30 * _DAY, SEQ).select("product_id", "period", "updates", "inventory", "price"),
        f"WITH {UPDATES}, p AS (SELECT *, CAST(floor(us / {30 * _DAY}) AS BIGINT) AS period FROM upd), n AS (SELECT *, count(*) OVER (PARTITION BY product_id, period) AS updates, row_number() OVER (PARTITION BY product_id, period ORDER BY us DESC, seq1 DESC, seq2 DESC, seq3 DESC, seq4 DESC, seq5 DESC) AS k FROM p) SELECT product_id, period, updates, inventory, price FROM n WHERE k = 1",
    ),
    "sales_by_category": (
        lambda s, d: table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity")),
        "SELECT p_type AS category, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS avg_quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    ),
}


def _with_removals(s, d):
    """Shopping events of which every fifth add takes its product out again, and logins are the other completing events."""
    e = shop_events(s, d)
    other = F.when(F.col("event_id") % 2 == 0, "CHECKOUT_COMPLETE").otherwise("PAYMENT_PROCESSED")
    kind = F.when((F.col("event_type") == ADD) & (F.col("event_id") % 5 == 0), "REMOVE_FROM_CART").when(F.col("event_type") == "USER_LOGIN", other).otherwise(F.col("event_type"))
    return e.withColumn("event_type", kind).withColumn("product_id", F.concat(F.lit("P"), F.pmod("event_id", F.lit(3))))


def _completed(mode):
    return lambda s, d: baskets.completed(_with_removals(s, d), mode, HALF_DAY).withColumn("total_value", F.round("total_value", 4))


_REMOVALS = f"""{SHOP}, sh AS (SELECT session_id, event_id, us, value, 'P' || (event_id % 3) AS product_id, CASE WHEN event_type = '{ADD}' AND event_id % 5 = 0 THEN 'REMOVE_FROM_CART' WHEN event_type <> 'USER_LOGIN' THEN event_type WHEN event_id % 2 = 0 THEN 'CHECKOUT_COMPLETE' ELSE 'PAYMENT_PROCESSED' END AS event_type FROM shop)"""


def _cut(mode: str) -> str:
    done = ", ".join(f"'{x}'" for x in baskets.COMPLETE[mode])
    return f"""{_REMOVALS},
c AS (SELECT *, CASE WHEN coalesce(lag(event_type) OVER w IN ({done}), false) OR coalesce(us - lag(us) OVER w >= {HALF_DAY}, false) THEN 1 ELSE 0 END AS cut FROM sh WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)),
seg AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY session_id ORDER BY us, event_id) AS BIGINT) AS segment FROM c),
kept AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM seg r WHERE r.session_id = a.session_id AND r.segment = a.segment AND r.product_id = a.product_id AND r.event_type = 'REMOVE_FROM_CART' AND (r.us, r.event_id) > (a.us, a.event_id)) AS stays FROM seg a WHERE a.event_type = '{ADD}'),
b AS (SELECT session_id, segment, count(*) FILTER (stays) AS n_items, array_to_string(list_sort(list(product_id) FILTER (stays)), ',') AS items, round(sum(value), 4) AS total_value FROM kept GROUP BY 1, 2)"""


def _cut_sql(mode: str) -> str:
    done = ", ".join(f"'{x}'" for x in baskets.COMPLETE[mode])
    return f"WITH {_cut(mode)} SELECT b.session_id, b.segment, e.us AS completed_us, n_items, items, total_value FROM b JOIN seg e ON e.session_id = b.session_id AND e.segment = b.segment AND e.event_type IN ({done}) WHERE n_items > 0"


#: A time by which no more events come.
HORIZON = 1_800_000_000_000_000
_CARTS_SQL = f"""WITH {_cut("refactored")},
last AS (SELECT session_id, segment, max(us) AS us, arg_max(event_type, (us, event_id)) AS event_type FROM seg GROUP BY 1, 2),
v AS (SELECT session_id, segment, string_agg(product_id, ',' ORDER BY us, event_id) AS views FROM (SELECT *, row_number() OVER (PARTITION BY session_id, segment ORDER BY us DESC, event_id DESC) AS n FROM seg WHERE event_type = '{VIEW}') WHERE n <= 50 GROUP BY 1, 2)
SELECT session_id, segment, CASE WHEN e THEN 'completed' ELSE 'timeout' END AS kind, CASE WHEN e THEN us ELSE us + {HALF_DAY} END AS at_us, n_items, items, total_value, coalesce(views, '') AS views
FROM (SELECT *, event_type IN ('ORDER_PLACED', 'CHECKOUT_COMPLETE', 'PAYMENT_PROCESSED') AS e FROM b JOIN last USING (session_id, segment) LEFT JOIN v USING (session_id, segment)) WHERE n_items > 0"""


def _raw(s, d):
    return table(s, d, "events").withColumn("us", micros("ts")).withColumn("place", F.pmod("event_id", F.lit(4)))


def _messages(s, d):
    return _raw(s, d).filter("event_type = 'click'").select("user_id", "event_id", "us")


_EV = "ev AS (SELECT *, epoch_us(ts) AS us, event_id % 4 AS place FROM events)"
_KINDS = ["USER_LOGIN", VIEW, ADD, ORDER]

QUERIES |= {
    "baskets_original": (_completed("original"), _cut_sql("original")),
    "baskets_with_removals": (_completed("refactored"), _cut_sql("refactored")),
    "carts_ended": (
        lambda s, d: baskets.carts(_with_removals(s, d), "refactored", HALF_DAY, horizon_us=HORIZON).withColumn("total_value", F.round("total_value", 4)),
        _CARTS_SQL,
    ),
    "pattern_view_any_order": (
        lambda s, d: patterns.find(shop_events(s, d), Pattern.begin("v", f"event_type = '{VIEW}'").followed_by_any("o", f"event_type = '{ORDER}'").within(2 * HALF_DAY)).filter("kind = 'match'").drop("kind", "steps"),
        f"""WITH {SHOP} SELECT a.session_id, a.us AS first_us, b.us AS last_us, a.event_id || ',' || b.event_id AS ids FROM shop a JOIN shop b ON a.session_id = b.session_id AND (b.us, b.event_id) > (a.us, a.event_id) AND b.us - a.us < {2 * HALF_DAY}
        WHERE a.event_type = '{VIEW}' AND b.event_type = '{ORDER}'""",
    ),
    "pattern_add_no_order": (
        lambda s, d: patterns.find(shop_events(s, d), Pattern.begin("a", f"event_type = '{ADD}'").not_followed_by(f"event_type = '{ORDER}'").within(2 * HALF_DAY), horizon_us=HORIZON).select("session_id", "kind", "first_us", "ids"),
        f"""WITH {SHOP} SELECT session_id, 'match' AS kind, us AS first_us, CAST(event_id AS VARCHAR) AS ids FROM shop a WHERE event_type = '{ADD}' AND NOT EXISTS (SELECT 1 FROM shop b
        WHERE b.session_id = a.session_id AND b.event_type = '{ORDER}' AND (b.us, b.event_id) > (a.us, a.event_id) AND b.us - a.us < {2 * HALF_DAY})""",
    ),
    "pattern_timeouts": (
        lambda s, d: patterns.find(shop_events(s, d), Pattern.begin("a", f"event_type = '{ADD}'").not_followed_by("event_type = 'USER_LOGIN'").followed_by("o", f"event_type = '{ORDER}'").within(4 * HALF_DAY), horizon_us=HORIZON).select("session_id", "kind", "first_us", "last_us", "ids"),
        f"""WITH {SHOP}, n AS (SELECT *, min(CASE WHEN event_type = '{ORDER}' THEN (us, event_id) END) OVER w AS o, min(CASE WHEN event_type = 'USER_LOGIN' THEN (us, event_id) END) OVER w AS l
        FROM shop WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        t AS (SELECT session_id, us, event_id, CASE WHEN o[1] - us < {4 * HALF_DAY} THEN o END AS o, CASE WHEN l[1] - us < {4 * HALF_DAY} THEN l END AS l FROM n WHERE event_type = '{ADD}')
        SELECT session_id, CASE WHEN o IS NULL THEN 'timeout' ELSE 'match' END AS kind, us AS first_us, coalesce(o[1], us) AS last_us, event_id || coalesce(',' || o[2], '') AS ids FROM t WHERE (o IS NULL AND l IS NULL) OR (o IS NOT NULL AND (l IS NULL OR l > o))""",
    ),
    "impossible_travel": (
        lambda s, d: cep.impossible_travel(_raw(s, d), "place", HALF_DAY, "user_id"),
        f"WITH {_EV} SELECT user_id, event_id, us, from_place, place AS to_place, took_us FROM (SELECT *, lag(place) OVER w AS from_place, us - lag(us) OVER w AS took_us FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) WHERE from_place <> place AND took_us < {HALF_DAY}",
    ),
    "errors_before_purchase": (
        lambda s, d: cep.preceded(_raw(s, d), F.col("event_type") == "error", F.col("event_type") == "purchase", 2, 4 * HALF_DAY, key="user_id"),
        f"""WITH {_EV} SELECT * FROM (SELECT p.user_id, p.event_id, p.us, (SELECT count(*) FROM ev f WHERE f.user_id = p.user_id AND f.event_type = 'error' AND (f.us, f.event_id) < (p.us, p.event_id) AND p.us - f.us < {4 * HALF_DAY}) AS before
        FROM ev p WHERE p.event_type = 'purchase') WHERE before >= 2""",
    ),
    "card_testing": (
        lambda s, d: cep.preceded(_raw(s, d), F.col("value") <= 10.0, F.col("value") > 50.0, 1, 2 * HALF_DAY, 10, "user_id"),
        f"""WITH {_EV} SELECT * FROM (SELECT p.user_id, p.event_id, p.us, (SELECT count(*) FROM ev f WHERE f.user_id = p.user_id AND f.value <= 10 AND (f.us, f.event_id) < (p.us, p.event_id) AND p.us - f.us < {2 * HALF_DAY}) AS before
        FROM ev p WHERE p.value > 50) WHERE before BETWEEN 1 AND 10""",
    ),
    "onboarding_funnel": (
        lambda s, d: cep.funnel(shop_events(s, d), _KINDS, 60 * HALF_DAY),
        f"""WITH {SHOP}, a AS (SELECT session_id, min(us) AS t0 FROM shop WHERE event_type = '{_KINDS[0]}' GROUP BY 1),
        b AS (SELECT a.*, (SELECT min(us) FROM shop s WHERE s.session_id = a.session_id AND s.event_type = '{VIEW}' AND s.us > t0 AND s.us - t0 < {60 * HALF_DAY}) AS t1 FROM a),
        c AS (SELECT b.*, (SELECT min(us) FROM shop s WHERE s.session_id = b.session_id AND s.event_type = '{ADD}' AND s.us > t1 AND s.us - t0 < {60 * HALF_DAY}) AS t2 FROM b),
        e AS (SELECT c.*, (SELECT min(us) FROM shop s WHERE s.session_id = c.session_id AND s.event_type = '{ORDER}' AND s.us > t2 AND s.us - t0 < {60 * HALF_DAY}) AS t3 FROM c)
        SELECT session_id, CASE WHEN t3 IS NOT NULL THEN 4 WHEN t2 IS NOT NULL THEN 3 WHEN t1 IS NOT NULL THEN 2 ELSE 1 END AS reached,
        CASE WHEN t3 IS NOT NULL THEN NULL WHEN t2 IS NOT NULL THEN '{ORDER}' WHEN t1 IS NOT NULL THEN '{ADD}' ELSE '{VIEW}' END AS lost_at, coalesce(t3, t2, t1, t0) - t0 AS took_us FROM e""",
    ),
    "rate_limited": (
        lambda s, d: recommend.rate_limited(_messages(s, d), 2, HALF_DAY, "user_id").filter("limited").drop("limited"),
        f"SELECT user_id, event_id, us FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {HALF_DAY} PRECEDING AND CURRENT ROW) AS n FROM (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click')) WHERE n > 2",
    ),
    "feature_flag": (
        lambda s, d: recommend.flagged(table(s, d, "customer").select("c_custkey"), "new-cart", 30, "c_custkey", ("1", "2")),
        "SELECT c_custkey, CAST('0x' || substr(md5('new-cart|' || c_custkey), 1, 8) AS BIGINT) % 100 < 30 OR c_custkey IN (1, 2) AS enabled FROM customer",
    ),
    "lookup_join": (
        lambda s, d: recommend.looked_up(table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("k")), table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), "k", {"segment": "unknown"}).groupBy("segment").agg(F.count("*").alias("n")),
        "SELECT coalesce(c_mktsegment, 'unknown') AS segment, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2 GROUP BY 1",
    ),
    "account_balances": (
        lambda s, d: inventory.balances(table(s, d, "lineitem").select(F.col("l_suppkey").alias("account_id"), "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(-F.col("l_quantity")).alias("amount")), ["l_orderkey", "l_linenumber", "l_partkey", "amount"], F.col("amount")).groupBy("account_id").agg(F.count_if("overdrawn").alias("overdrawn"), F.round(F.min("balance"), 4).alias("least"), F.round(F.max("balance"), 4).alias("most")),
        """WITH b AS (SELECT l_suppkey AS account_id, sum(amount) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, amount ROWS UNBOUNDED PRECEDING) AS balance FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END AS amount FROM lineitem))
        SELECT account_id, count(*) FILTER (balance < 0) AS overdrawn, round(min(balance), 4) AS least, round(max(balance), 4) AS most FROM b GROUP BY 1""",
    ),
}
