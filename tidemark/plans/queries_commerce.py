"""Queries over baskets, rules, recommendations, catalogue and carts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import baskets, catalogue, chat, recommend
from .domain import BASKETS, PRODUCTS, SHOP, micros, parts, products, shop_events, table
from .domain import baskets as basket_items

HALF_DAY = 12 * 3_600_000_000

_SEG = f"""{SHOP}, c AS (SELECT *, CASE WHEN coalesce(lag(event_type) OVER w IN ('ORDER_PLACED'), false) OR coalesce(us - lag(us) OVER w >= {HALF_DAY}, false) THEN 1 ELSE 0 END AS cut FROM shop WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)),
seg AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY session_id ORDER BY us, event_id) AS BIGINT) AS segment FROM c)"""

_RULES = f"""{BASKETS}, t AS (SELECT count(DISTINCT basket_id) AS total FROM bitem), f AS (SELECT item, count(*) AS entries, count(DISTINCT basket_id) AS baskets FROM bitem GROUP BY 1),
d AS (SELECT DISTINCT basket_id, item FROM bitem), pr AS (SELECT x.item AS a, y.item AS c, count(*) AS together FROM d x JOIN d y ON x.basket_id = y.basket_id AND x.item <> y.item GROUP BY 1, 2),
rules AS (SELECT a, c, together, together / total AS support, together / fa.baskets AS confidence, (together / fa.baskets) / (fc.entries / total) AS lift FROM pr JOIN f fa ON fa.item = a JOIN f fc ON fc.item = c, t)"""


def _rules(s, d, support=0.001, confidence=0.1):
    return baskets.pair_rules(basket_items(s, d), min_support=support, min_confidence=confidence)


_RULES_F = f"{_RULES}, r AS (SELECT * FROM rules WHERE confidence > 0.1 AND support > 0.001)"


def _patterns(s, d):
    """Patterns between product ids of events: made from pairs added in one session."""
    e = shop_events(s, d).filter("event_type = 'ADD_TO_CART'").select(F.col("session_id").alias("basket_id"), F.col("product_id").alias("item"))
    r = baskets.pair_rules(e, min_support=0.01, min_confidence=0.1)
    return r.select(F.concat_ws("_", "a", "c").alias("pattern_id"), F.array("a").alias("antecedents"), F.col("c").alias("consequent"), "confidence", "support", "lift")


_PAT = f"""bitem AS (SELECT session_id AS basket_id, product_id AS item FROM shop WHERE event_type = 'ADD_TO_CART'), t AS (SELECT count(DISTINCT basket_id) AS total FROM bitem), f AS (SELECT item, count(DISTINCT basket_id) AS baskets FROM bitem GROUP BY 1),
d AS (SELECT DISTINCT basket_id, item FROM bitem), pr AS (SELECT x.item AS a, y.item AS c, count(*) AS together FROM d x JOIN d y ON x.basket_id = y.basket_id AND x.item <> y.item GROUP BY 1, 2),
pat AS (SELECT a, c, together / baskets AS confidence FROM pr JOIN f ON f.item = a, t WHERE together / baskets > 0.1 AND together / total > 0.01)"""


def _incremental(s, d):
    """Baskets of brands per customer, small histories."""
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("user_id"), micros("o_orderdate").alias("us"))
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_type").alias("item"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).repartition(parts(s, d, "lineitem"), "user_id")
    seq = F.dense_rank().over(W.partitionBy("user_id").orderBy("us", "o_orderkey"))
    return rows.select("user_id", seq.cast("long").alias("seq"), "item")


_INC = """li AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, dense_rank() OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate), o_orderkey) AS seq, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT user_id, seq, list_sort(list(DISTINCT item)) AS s, count(*) AS entries FROM li GROUP BY 1, 2),
w AS (SELECT user_id, seq, c, list_filter(s, lambda x: x <> c) AS a, 'full' AS kind FROM (SELECT *, unnest(s) AS c FROM b WHERE len(s) > 1)
  UNION ALL SELECT user_id, seq, c, [x] AS a, 'single' FROM (SELECT *, unnest(s) AS x FROM (SELECT *, unnest(s) AS c FROM b WHERE entries > 2)) WHERE x <> c),
m AS (SELECT w.user_id, w.seq, w.a, w.c, w.kind, count(*) FILTER (list_has_all(h.s, w.a)) AS occ, count(*) FILTER (list_has_all(h.s, w.a) AND list_contains(h.s, w.c)) AS co FROM w JOIN b h ON h.user_id = w.user_id AND h.seq <= w.seq AND w.seq - h.seq <= 1000 GROUP BY ALL),
q AS (SELECT m.*, (SELECT count(*) FROM li WHERE li.user_id = m.user_id AND li.item = m.c AND li.seq <= m.seq) AS freq FROM m),
o AS (SELECT user_id, seq, array_to_string(a, ',') AS antecedents, c AS consequent, kind, co / occ AS confidence, co / seq AS support, (co / occ) / (freq / seq) AS lift FROM q)"""


def _long(s, d):
    """Baskets of makers of ten customers, whose histories are longer than what is kept."""
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 10).cast("string").alias("user_id"), micros("o_orderdate").alias("us"))
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.concat(F.lit("M"), F.right("p_brand", F.lit(1))).alias("item"))
    seqs = li.select("l_orderkey").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("seq", F.row_number().over(W.partitionBy("user_id").orderBy("us", "o_orderkey")).cast("long"))
    return li.join(seqs.drop("l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("user_id", "seq", "item")


_LONG = """li AS (SELECT CAST(o_custkey % 10 AS VARCHAR) AS user_id, dense_rank() OVER (PARTITION BY o_custkey % 10 ORDER BY epoch_us(o_orderdate), o_orderkey) AS seq, 'M' || right(p_brand, 1) AS item, 1 << CAST(right(p_brand, 1) AS INTEGER) AS bit FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT user_id, seq, bit_or(bit) AS m, count(*) AS entries, list_sort(list(DISTINCT item)) AS s FROM li GROUP BY 1, 2),
c AS (SELECT user_id, seq, m, entries, s, unnest(s) AS c FROM b),
w AS (SELECT user_id, seq, c, m - (1 << CAST(right(c, 1) AS INTEGER)) AS a, array_to_string(list_filter(s, lambda x: x <> c), ',') AS antecedents, 'full' AS kind FROM c WHERE len(s) > 1
  UNION ALL SELECT user_id, seq, c, 1 << CAST(right(x, 1) AS INTEGER), x, 'single' FROM (SELECT *, unnest(s) AS x FROM c WHERE entries > 2) WHERE x <> c),
q AS (SELECT w.*, 1 << CAST(right(c, 1) AS INTEGER) AS cb FROM w),
m AS (SELECT q.user_id, q.seq, q.antecedents, q.c, q.kind, count(*) FILTER ((h.m & q.a) = q.a) AS occ, count(*) FILTER ((h.m & (q.a | q.cb)) = (q.a | q.cb)) AS co FROM q JOIN b h ON h.user_id = q.user_id AND h.seq <= q.seq AND q.seq - h.seq <= 1000 GROUP BY ALL),
z AS (SELECT user_id, seq, item, sum(count(*)) OVER (PARTITION BY user_id, item ORDER BY seq) AS freq FROM li GROUP BY 1, 2, 3),
o AS (SELECT m.user_id, m.seq, antecedents, c AS consequent, kind, co / occ AS confidence, co / m.seq AS support, (co / occ) / (freq / m.seq) AS lift FROM m JOIN z ON z.user_id = m.user_id AND z.seq = m.seq AND z.item = m.c)"""


#: Rules of itemsets of two and three items; the tables have no frequent larger ones.
_ITEMSETS = """WITH e AS (SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), t AS (SELECT count(DISTINCT b) AS total FROM e),
s AS (SELECT [i] AS s, count(*) AS n FROM e GROUP BY i UNION ALL SELECT [x.i, y.i], count(*) FROM e x JOIN e y ON x.b = y.b AND x.i < y.i GROUP BY x.i, y.i
  UNION ALL SELECT [x.i, y.i, z.i], count(*) FROM e x JOIN e y ON x.b = y.b AND x.i < y.i JOIN e z ON z.b = x.b AND y.i < z.i GROUP BY x.i, y.i, z.i),
f AS (SELECT s, n, total FROM s, t WHERE n >= 0.01 * total),
r AS (SELECT s, n, total, unnest(s) AS c FROM f WHERE len(s) > 1), q AS (SELECT list_filter(s, lambda x: x <> c) AS a, c, n, total FROM r)
SELECT array_to_string(a, ',') AS antecedents, c AS consequent, round(q.n / f.n, 6) AS confidence, round(q.n / q.total, 6) AS support FROM q JOIN f ON f.s = a WHERE q.n / f.n >= 0.1"""


def _own(s, d):
    return shop_events(s, d).filter("event_type = 'ADD_TO_CART'").select("session_id", F.col("product_id").alias("item")).distinct()


def _prules(s, d):
    p = _patterns(s, d)
    return p.select(F.col("antecedents")[0].alias("a"), F.col("consequent").alias("c"), "confidence", "support")


_PRULES = _PAT.replace("pat AS (SELECT a, c, together / baskets AS confidence", "pat AS (SELECT a, c, together / total AS support, together / baskets AS confidence")
_OWN = "own AS (SELECT DISTINCT session_id, product_id AS item FROM shop WHERE event_type = 'ADD_TO_CART')"


def _models(s, d):
    """Two versions of product recommendations, three brand mates each, valid from two times."""
    p = products(s, d).select("product_id", "brand")
    w = W.partitionBy("brand").orderBy("product_id")
    near = p.select("product_id", F.array_compact(F.array(*(F.lead("product_id", i).over(w) for i in (1, 2, 3)))).alias("recs")).filter("size(recs) > 0")
    v = s.createDataFrame([(1, 0.85, 1704300000000000), (2, 0.92, 1705500000000000)], "version int, accuracy double, valid_from bigint")
    return near.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).join(F.broadcast(v), "version").filter("version = 2 OR CAST(product_id AS BIGINT) % 2 = 0")


QUERIES = {
    "basket_completed": (
        lambda s, d: baskets.completed(shop_events(s, d), timeout_us=HALF_DAY).withColumn("total_value", F.round("total_value", 4)),
        f"""WITH {_SEG} SELECT a.session_id, a.segment, e.us AS completed_us, n_items, items, total_value FROM (SELECT session_id, segment, count(*) AS n_items, array_to_string(list_sort(list(product_id)), ',') AS items, round(sum(value), 4) AS total_value FROM seg WHERE event_type = 'ADD_TO_CART' GROUP BY 1, 2) a
        JOIN seg e ON e.session_id = a.session_id AND e.segment = a.segment AND e.event_type = 'ORDER_PLACED'""",
    ),
    "rules_global": (
        lambda s, d: _rules(s, d).select("a", "c", "together", *(F.round(x, 6).alias(x) for x in ("support", "confidence", "lift"))),
        f"WITH {_RULES_F} SELECT a, c, together, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM r",
    ),
    "basket_pairs": (
        lambda s, d: _rules(s, d, 0.0, 0.0).filter("a < c").select("a", "c", "together"),
        f"WITH {_RULES} SELECT a, c, together FROM rules WHERE a < c",
    ),
    "rules_incremental": (
        lambda s, d: baskets.incremental_rules(_incremental(s, d), parts=parts(s, d, "lineitem")).select("user_id", "seq", "antecedents", "consequent", "kind", *(F.round(x, 6).alias(x) for x in ("confidence", "support", "lift"))),
        f"WITH {_INC} SELECT user_id, seq, antecedents, consequent, kind, round(confidence, 6) AS confidence, round(support, 6) AS support, round(lift, 6) AS lift FROM o WHERE (kind = 'full' AND confidence > 0.3 AND support > 0.01) OR (kind = 'single' AND confidence > 0.4)",
    ),
    "rules_long_history": (
        lambda s, d: baskets.incremental_rules(_long(s, d), parts=parts(s, d, "lineitem")).groupBy("user_id", "antecedents", "consequent", "kind").agg(F.count("*").alias("n"), *(F.sum(F.round(F.col(x) * 1e6).cast("long")).alias(f"{x}_millionths") for x in ("confidence", "support", "lift"))),
        f"""WITH {_LONG} SELECT user_id, antecedents, consequent, kind, count(*) AS n, {", ".join(f"sum(CAST(round({x} * 1e6::DOUBLE) AS BIGINT))::BIGINT AS {x}_millionths" for x in ("confidence", "support", "lift"))} FROM o
        WHERE (kind = 'full' AND confidence > 0.3 AND support > 0.01) OR (kind = 'single' AND confidence > 0.4) GROUP BY ALL""",
    ),
    "pattern_best": (
        lambda s, d: baskets.best_patterns(baskets.incremental_rules(_incremental(s, d), parts=parts(s, d, "lineitem")).select(F.concat_ws("_", "antecedents", "consequent").alias("pattern_id"), F.col("seq").alias("us"), "confidence")).select("pattern_id", "us", F.round("confidence", 6).alias("confidence")),
        f"WITH {_INC}, e AS (SELECT antecedents || '_' || consequent AS pattern_id, seq, confidence FROM o WHERE (kind = 'full' AND confidence > 0.3 AND support > 0.01) OR (kind = 'single' AND confidence > 0.4)) SELECT pattern_id, min(seq) AS us, round(confidence, 6) AS confidence FROM (SELECT *, max(confidence) OVER (PARTITION BY pattern_id) AS best FROM e) WHERE confidence = best GROUP BY pattern_id, confidence",
    ),
    "pattern_store_newest": (
        lambda s, d: baskets.newest(_rules(s, d).select(F.concat_ws("_", "a", "c").alias("pattern_id"), F.col("together").alias("us"))),
        f"WITH {_RULES_F} SELECT a || '_' || c AS pattern_id, together AS us FROM r ORDER BY us DESC, pattern_id LIMIT 5000",
    ),
    "pattern_interestingness": (
        lambda s, d: _rules(s, d).filter(baskets.significant(0.002, 0.12, 0.5)).select("a", "c", F.round(baskets.interestingness(F.col("confidence"), F.col("support"), F.col("lift")), 6).alias("interestingness")),
        f"WITH {_RULES_F} SELECT a, c, round(0.4 * confidence + CASE WHEN lift > 1 THEN least(lift / 10, 0.3) ELSE 0 END + least(support * 10, 0.3), 6) AS interestingness FROM r WHERE support >= 0.002 AND confidence >= 0.12 AND lift >= 0.5",
    ),
    "itemset_rules": (lambda s, d: baskets.itemset_rules(basket_items(s, d), min_support=0.01, min_confidence=0.1).select(F.array_join(F.array_sort("antecedent"), ",").alias("antecedents"), F.col("consequent")[0].alias("consequent"), F.round("confidence", 6).alias("confidence"), F.round("support", 6).alias("support")), _ITEMSETS),
    "recommend_basket": (
        lambda s, d: recommend.for_baskets(shop_events(s, d), _patterns(s, d), least=0.2),
        f"""WITH {SHOP}, {_PAT}, g AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'ORDER_PLACED' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM shop),
        ad AS (SELECT session_id, event_id, list(product_id) OVER (PARTITION BY session_id, segment ORDER BY us, event_id) AS basket FROM g WHERE event_type = 'ADD_TO_CART'),
        m AS (SELECT session_id, event_id, c, max(confidence) AS confidence FROM ad JOIN pat ON list_contains(basket, a) AND NOT list_contains(basket, c) AND confidence > 0.2 GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY session_id, event_id ORDER BY confidence DESC, c) AS place FROM m)
        SELECT session_id, event_id, string_agg(c, ',' ORDER BY place) AS products, 'BASKET_BASED' AS kind, CAST(0.75 AS DOUBLE) AS confidence FROM k WHERE place <= 5 GROUP BY 1, 2""",
    ),
    "recommend_view": (
        lambda s, d: recommend.for_views(shop_events(s, d), _patterns(s, d)),
        f"""WITH {SHOP}, {_PAT}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY confidence DESC, c) AS place FROM pat), l AS (SELECT a, string_agg(c, ',' ORDER BY place) AS products FROM k WHERE place <= 3 GROUP BY a)
        SELECT session_id, event_id, products, 'VIEW_BASED' AS kind, CAST(0.65 AS DOUBLE) AS confidence FROM shop JOIN l ON a = product_id WHERE event_type = 'PRODUCT_VIEW'""",
    ),
    "popular_topk": (lambda s, d: recommend.popular(shop_events(s, d), 10), f"WITH {SHOP} SELECT product_id, count(*) AS n FROM shop GROUP BY 1 ORDER BY n DESC, product_id LIMIT 10"),
    "rule_topk": (
        lambda s, d: recommend.by_rules(_own(s, d), _prules(s, d)).withColumn("score", F.round("score", 6)),
        f"""WITH {SHOP}, {_PAT}, {_OWN}, fr AS (SELECT c, count(*) AS freq FROM pat GROUP BY 1), sc AS (SELECT session_id, pat.c, sum(confidence) + any_value(freq) / 100 AS score FROM own JOIN pat ON a = item JOIN fr ON fr.c = pat.c WHERE NOT EXISTS (SELECT 1 FROM own h WHERE h.session_id = own.session_id AND h.item = pat.c) GROUP BY 1, 2)
        SELECT session_id, c, round(score, 6) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, c) AS INTEGER) AS place FROM sc) WHERE place <= 5""",
    ),
    "cross_sell_topk": (
        lambda s, d: recommend.cross_sell(_own(s, d), _prules(s, d)).withColumn("score", F.round("score", 6)),
        f"""WITH {SHOP}, {_PRULES}, {_OWN}, sc AS (SELECT session_id, pat.c, sum(1.0::DOUBLE + confidence * support) AS score FROM own JOIN pat ON a = item WHERE NOT EXISTS (SELECT 1 FROM own h WHERE h.session_id = own.session_id AND h.item = pat.c) GROUP BY 1, 2)
        SELECT session_id, c, round(score, 6) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, c) AS INTEGER) AS place FROM sc) WHERE place <= 5""",
    ),
    "item_similarity": (
        lambda s, d: recommend.item_similarity(basket_items(s, d), 0.08).withColumn("similarity", F.round("similarity", 9)),
        """WITH e AS (SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT i, count(*) AS n FROM e GROUP BY 1),
        p AS (SELECT x.i AS item, y.i AS other, count(*) AS t FROM e x JOIN e y ON x.b = y.b AND x.i <> y.i GROUP BY 1, 2)
        SELECT item, other, round(t / sqrt(CAST(a.n AS DOUBLE) * c.n), 9) AS similarity FROM p JOIN n a ON a.i = item JOIN n c ON c.i = other WHERE t / sqrt(CAST(a.n AS DOUBLE) * c.n) >= 0.08""",
    ),
    "contextual_similar": (
        lambda s, d: recommend.contextual(
            recommend.item_similarity(shop_events(s, d).select(F.col("session_id").alias("basket_id"), F.col("product_id").alias("item")), 0.05),
            shop_events(s, d).groupBy("session_id").agg(F.max_by("product_id", F.struct("us", "event_id")).alias("item")),
            shop_events(s, d).filter("event_type = 'PRODUCT_VIEW'").select("session_id", F.col("product_id").alias("item")).distinct(),
            parts=parts(s, d, "events"),
        ).withColumn("score", F.round("score", 6)),
        f"""WITH {SHOP}, e AS (SELECT DISTINCT session_id AS b, product_id AS i FROM shop WHERE product_id IS NOT NULL), n AS (SELECT i, count(*) AS n FROM e GROUP BY 1),
        p AS (SELECT x.i AS a, y.i AS c, count(*) / sqrt(any_value(CAST(nx.n AS DOUBLE)) * any_value(ny.n)) AS sim FROM e x JOIN e y ON x.b = y.b AND x.i <> y.i JOIN n nx ON nx.i = x.i JOIN n ny ON ny.i = y.i GROUP BY 1, 2),
        cur AS (SELECT session_id, arg_max(product_id, (us, event_id)) AS item FROM shop GROUP BY 1), vw AS (SELECT DISTINCT session_id, product_id AS item FROM shop WHERE event_type = 'PRODUCT_VIEW'),
        wt AS (SELECT session_id, item, 1.0::DOUBLE AS w FROM cur UNION ALL SELECT session_id, item, 0.5 FROM vw),
        sc AS (SELECT session_id, c AS other, sum(w * sim) AS score FROM wt JOIN p ON a = item WHERE sim >= 0.05 AND NOT EXISTS (SELECT 1 FROM wt h WHERE h.session_id = wt.session_id AND h.item = c) GROUP BY 1, 2)
        SELECT session_id, other, round(score, 6) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, other) AS INTEGER) AS place FROM sc) WHERE place <= 5""",
    ),
    "contextual_topk": (
        lambda s, d: recommend.contextual(
            _prules(s, d).select(F.col("a").alias("item"), F.col("c").alias("other"), F.col("confidence").alias("similarity")),
            shop_events(s, d).groupBy("session_id").agg(F.max_by("product_id", F.struct("us", "event_id")).alias("item")),
            shop_events(s, d).filter("event_type = 'PRODUCT_VIEW'").select("session_id", F.col("product_id").alias("item")).distinct(),
            parts=parts(s, d, "events"),
        ).withColumn("score", F.round("score", 6)),
        f"""WITH {SHOP}, {_PAT}, cur AS (SELECT session_id, arg_max(product_id, us) AS item FROM shop GROUP BY 1), vw AS (SELECT DISTINCT session_id, product_id AS item FROM shop WHERE event_type = 'PRODUCT_VIEW'),
        wt AS (SELECT session_id, item, 1.0::DOUBLE AS w FROM cur UNION ALL SELECT session_id, item, 0.5 FROM vw), sc AS (SELECT session_id, c AS other, sum(w * confidence) AS score FROM wt JOIN pat ON a = item WHERE NOT EXISTS (SELECT 1 FROM wt h WHERE h.session_id = wt.session_id AND h.item = c) GROUP BY 1, 2)
        SELECT session_id, other, round(score, 6) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, other) AS INTEGER) AS place FROM sc) WHERE place <= 5""",
    ),
    "model_lookup": (
        lambda s, d: recommend.model_lookup(shop_events(s, d), _models(s, d), ["DEFAULT_REC_001", "DEFAULT_REC_002", "DEFAULT_REC_003"]).select("event_id", "version", "accuracy", F.array_join("recs", ",").alias("recs")),
        f"""WITH {SHOP}, {PRODUCTS}, nr AS (SELECT a.product_id, list_sort(list(b.product_id))[1:3] AS recs FROM prod a JOIN prod b ON a.brand = b.brand AND a.product_id < b.product_id GROUP BY 1)
        SELECT event_id, version, accuracy, CASE WHEN recs IS NULL OR (version = 1 AND CAST(shop.product_id AS BIGINT) % 2 = 1) THEN 'DEFAULT_REC_001,DEFAULT_REC_002,DEFAULT_REC_003' ELSE array_to_string(recs, ',') END AS recs
        FROM shop JOIN (VALUES (1, 0.85::DOUBLE, 1704300000000000, 1705500000000000), (2, 0.92::DOUBLE, 1705500000000000, NULL)) AS v(version, accuracy, f, t) ON us >= f AND (t IS NULL OR us < t) LEFT JOIN nr ON nr.product_id = shop.product_id""",
    ),
    "temporal_join": (
        lambda s, d: recommend.as_of(
            shop_events(s, d).select("event_id", "product_id", "us"), table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("product_id"), (micros("l_shipdate") + 86_400_000_000 * 365 * 22).alias("v_us"), "l_extendedprice").groupBy("product_id", "v_us").agg(F.max("l_extendedprice").alias("price")), "product_id", "us", "v_us", ["price"]
        ).select("event_id", "price"),
        f"""WITH {SHOP}, v AS (SELECT CAST(l_partkey AS VARCHAR) AS product_id, epoch_us(l_shipdate) + 86400000000 * 365 * 22 AS v_us, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)
        SELECT event_id, v.price FROM shop ASOF LEFT JOIN v ON v.product_id = shop.product_id AND shop.us >= v.v_us""",
    ),
    "enriched_recommendations": (
        lambda s, d: _patterns(s, d).filter("confidence > 0.2").join(products(s, d), F.col("consequent") == F.col("product_id")).filter("inventory > 0").select("pattern_id", "name", "price", F.round("confidence", 6).alias("confidence")).orderBy(F.desc("confidence"), "pattern_id"),
        f"WITH {SHOP}, {_PAT}, {PRODUCTS} SELECT a || '_' || c AS pattern_id, name, price, round(confidence, 6) AS confidence FROM pat JOIN prod ON c = product_id WHERE confidence > 0.2 AND inventory > 0",
    ),
    "in_stock_recommendations": (
        lambda s, d: _patterns(s, d)
        .filter("confidence > 0.2")
        .join(products(s, d).select("product_id", "name"), F.col("consequent") == F.col("product_id"))
        .join(table(s, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("pid")).agg(F.sum("l_quantity").alias("quantity")), F.col("product_id") == F.col("pid"))
        .filter("quantity > 500")
        .select("pattern_id", "name", "quantity"),
        f"WITH {SHOP}, {_PAT}, {PRODUCTS}, iv AS (SELECT CAST(l_partkey AS VARCHAR) AS pid, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) SELECT a || '_' || c AS pattern_id, name, quantity FROM pat JOIN prod ON c = product_id JOIN iv ON pid = product_id WHERE confidence > 0.2 AND quantity > 500",
    ),
    "inventory_products": (
        lambda s, d: table(s, d, "lineitem").filter("l_quantity < 10").join(products(s, d), F.col("l_partkey").cast("string") == F.col("product_id")).groupBy("product_id", "name").agg(F.count("*").alias("low_lines")),
        f"WITH {PRODUCTS} SELECT product_id, name, count(*) AS low_lines FROM lineitem JOIN prod ON CAST(l_partkey AS VARCHAR) = product_id WHERE l_quantity < 10 GROUP BY 1, 2",
    ),
    "merged_models": (
        lambda s, d: products(s, d).select("product_id", F.array_join(recommend.merge_models(F.array("brand", "category", "name", "product_id"), F.when(F.col("rating") > 3.5, F.array("category", "product_id", "brand"))), "|").alias("merged")).filter("merged is not null"),
        f"WITH {PRODUCTS} SELECT product_id, CASE WHEN category IN (brand, name) OR product_id IN (brand, category, name) THEN NULL ELSE brand || '|' || category || '|' || name || '|' || product_id END AS merged FROM prod WHERE rating > 3.5",
    ),
    "model_update": (
        lambda s, d: recommend.model_update(s.createDataFrame([("item", "Brand#1", "", 5)], "kind string, a string, b string, n bigint"), basket_items(s, d)),
        f"""WITH {BASKETS}, d AS (SELECT DISTINCT basket_id, item FROM bitem), u AS (SELECT 'item' AS kind, 'Brand#1' AS a, '' AS b, 5 AS n UNION ALL SELECT 'item', item, '', count(*) FROM d GROUP BY 2 UNION ALL SELECT 'pair', x.item, y.item, count(*) FROM d x JOIN d y ON x.basket_id = y.basket_id AND x.item <> y.item GROUP BY 2, 3)
        SELECT kind, a, b, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1, 2, 3""",
    ),
    "cart_totals": (
        lambda s, d: catalogue.cart_totals(table(s, d, "lineitem").select(F.col("l_orderkey").alias("cart"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_tax").alias("price")), "cart"),
        "SELECT l_orderkey AS cart, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS items, round(sum(l_tax * CAST(l_quantity AS BIGINT)), 2) AS total FROM lineitem GROUP BY 1",
    ),
    "order_totals": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(catalogue.order_total(F.col("o_totalprice")), 4).alias("total")),
        "SELECT o_orderkey, round(o_totalprice + o_totalprice * 0.08 + 5.99, 4) AS total FROM orders",
    ),
    "catalogue_summary": (lambda s, d: products(s, d).agg(F.count("*").alias("products"), F.count_distinct("category").alias("categories"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("names")), f"WITH {PRODUCTS} SELECT count(*) AS products, count(DISTINCT category) AS categories, array_to_string(list_sort(list(DISTINCT category)), ',') AS names FROM prod"),
    "trending_top8": (lambda s, d: products(s, d).orderBy(F.desc("review_count"), "product_id").limit(8).select("product_id", "review_count"), f"WITH {PRODUCTS} SELECT product_id, review_count FROM prod ORDER BY review_count DESC, product_id LIMIT 8"),
    "featured_top8": (lambda s, d: products(s, d).filter("rating >= 4.0").orderBy("product_id").limit(8).select("product_id", "rating"), f"WITH {PRODUCTS} SELECT product_id, rating FROM prod WHERE rating >= 4.0 ORDER BY product_id LIMIT 8"),
    "featured_by_score": (lambda s, d: products(s, d).withColumn("score", F.round(F.col("rating") * F.col("review_count"), 4)).orderBy(F.desc("score"), "product_id").limit(8).select("product_id", "score"), f"WITH {PRODUCTS} SELECT product_id, round(rating * review_count, 4) AS score FROM prod ORDER BY score DESC, product_id LIMIT 8"),
    "most_expensive": (lambda s, d: products(s, d).orderBy(F.desc("price"), "product_id").limit(10).select("product_id", "price"), f"WITH {PRODUCTS} SELECT product_id, price FROM prod ORDER BY price DESC, product_id LIMIT 10"),
    "search": (lambda s, d: catalogue.search(products(s, d), "BOLT").select("product_id", "name"), f"WITH {PRODUCTS} SELECT product_id, name FROM prod WHERE contains(lower(name), 'bolt') OR len(list_filter(tags, lambda t: contains(lower(t), 'bolt'))) > 0"),
    "category_filter": (lambda s, d: catalogue.in_category(products(s, d), "economy").select("product_id", "category"), f"WITH {PRODUCTS} SELECT product_id, category FROM prod WHERE lower(category) = 'economy'"),
    "product_by_key": (lambda s, d: products(s, d).filter("product_id = '42'").drop("tags"), f"WITH {PRODUCTS} SELECT product_id, name, brand, category, price, inventory, rating, review_count FROM prod WHERE product_id = '42'"),
    "product_listing": (
        lambda s, d: catalogue.listing(products(s, d), "price_desc", 20, "economy", "e", (900.0, 1500.0)).select("product_id", "price"),
        f"WITH {PRODUCTS} SELECT product_id, price FROM prod WHERE lower(category) = 'economy' AND (contains(lower(name), 'e') OR contains(lower(brand), 'e') OR len(list_filter(tags, lambda t: contains(t, 'e'))) > 0) AND price BETWEEN 900 AND 1500 ORDER BY price DESC, product_id LIMIT 20",
    ),
    "product_latest": (
        lambda s, d: catalogue.latest(table(s, d, "lineitem").select(F.col("l_partkey").alias("product_id"), micros("l_shipdate").alias("us"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"), "product_id", ["us", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]),
        "SELECT product_id, us, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity FROM (SELECT l_partkey AS product_id, epoch_us(l_shipdate) AS us, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1",
    ),
    "pattern_stats_by_category": (
        lambda s, d: _rules(s, d).groupBy(F.col("c").alias("category")).agg(F.count("*").alias("n"), *(F.round(F.avg(x), 6).alias(x) for x in ("confidence", "support", "lift"))).orderBy(F.desc("n"), "category"),
        f"WITH {_RULES_F} SELECT c AS category, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(support), 6) AS support, round(avg(lift), 6) AS lift FROM r GROUP BY 1",
    ),
    "top_patterns": (
        lambda s, d: _rules(s, d).filter("confidence > 0.1").select("a", "c", F.round("confidence", 6).alias("confidence")).orderBy(F.desc("confidence"), "a", "c").limit(10),
        f"WITH {_RULES_F} SELECT a, c, round(confidence, 6) AS confidence FROM r ORDER BY confidence DESC, a, c LIMIT 10",
    ),
    "historical_vs_live": (
        lambda s, d: table(s, d, "customer").groupBy(F.col("c_name").like("%00000000_").alias("historical")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("avg_balance")),
        "SELECT c_name LIKE '%00000000_' AS historical, count(*) AS n, round(avg(c_acctbal), 6) AS avg_balance FROM customer GROUP BY 1",
    ),
    "version_comparison": (
        lambda s, d: (lambda o: catalogue.at_version(o, 1_000_000_000_000_000 - 100_000_000_000_000, "us").agg(F.lit("before").alias("at"), F.count("*").alias("n")).unionByName(o.agg(F.lit("now").alias("at"), F.count("*").alias("n"))))(table(s, d, "orders").withColumn("us", micros("o_orderdate"))),
        "WITH o AS (SELECT epoch_us(o_orderdate) AS us FROM orders) SELECT 'before' AS at, count(*) AS n FROM o WHERE us <= 900000000000000 UNION ALL SELECT 'now', count(*) FROM o",
    ),
    "deduplicated_lines": (
        lambda s, d: catalogue.deduplicated(table(s, d, "lineitem").withColumn("pk", F.concat_ws("_", "l_orderkey", "l_linenumber")), "pk", [F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_extendedprice"]).select("pk", "l_partkey", "l_suppkey"),
        "SELECT pk, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) AS n FROM (SELECT *, l_orderkey || '_' || l_linenumber AS pk FROM lineitem)) WHERE n = 1",
    ),
    "event_type_counts": (lambda s, d: table(s, d, "events").groupBy("event_type").count().withColumnRenamed("count", "n"), "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "user_view_counts": (lambda s, d: shop_events(s, d).filter("event_type = 'PRODUCT_VIEW'").groupBy("user_id", "product_id").agg(F.count("*").alias("n")), f"WITH {SHOP} SELECT user_id, product_id, count(*) AS n FROM shop WHERE event_type = 'PRODUCT_VIEW' GROUP BY 1, 2"),
    "user_category_counts": (
        lambda s, d: shop_events(s, d).join(products(s, d), "product_id").groupBy("user_id", "category").agg(F.count("*").alias("n")),
        f"WITH {SHOP}, {PRODUCTS} SELECT user_id, category, count(*) AS n FROM shop JOIN prod USING (product_id) GROUP BY 1, 2",
    ),
    "users_online": (lambda s, d: shop_events(s, d).agg(F.count_distinct("user_id").alias("users"), F.count_distinct("product_id").alias("products")), f"WITH {SHOP} SELECT count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS products FROM shop"),
    "trending_not_viewed": (
        lambda s, d: (lambda e: e.select("user_id").distinct().join(F.broadcast(recommend.popular(e, 30).agg(F.collect_list(F.struct("product_id", "n")).alias("__top")))).select("user_id", F.inline("__top")).join(e.filter("event_type = 'PRODUCT_VIEW'").select("user_id", "product_id").distinct(), ["user_id", "product_id"], "left_anti"))(shop_events(s, d)),
        f"WITH {SHOP}, top AS (SELECT product_id, count(*) AS n FROM shop GROUP BY 1 ORDER BY n DESC, product_id LIMIT 30) SELECT u.user_id, top.product_id, n FROM top, (SELECT DISTINCT user_id FROM shop) u WHERE NOT EXISTS (SELECT 1 FROM shop v WHERE v.user_id = u.user_id AND v.product_id = top.product_id AND v.event_type = 'PRODUCT_VIEW')",
    ),
    "inventory_seed": (lambda s, d: products(s, d).select("product_id", F.col("inventory").alias("quantity"), F.lit(0).alias("reserved"), F.col("inventory").alias("available")), "SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_size AS quantity, 0 AS reserved, p_size AS available FROM part"),
    "chat_basket_asof": (
        lambda s, d: chat.basket_context(
            table(s, d, "conversations").filter("role = 'user'").select((F.pmod("conv_id", F.lit(150))).cast("string").alias("key"), (F.lit(1704067200000000) + F.col("conv_id") * 14_400_000_000 + F.col("turn") * 60_000_000).alias("us"), (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id")),
            shop_events(s, d).select(F.col("session_id").alias("key"), "us", "event_id", F.when((F.col("event_type") == "ADD_TO_CART") & (F.col("event_id") % 4 == 0), "REMOVE_FROM_CART").otherwise(F.col("event_type")).alias("event_type"), F.concat(F.lit("P"), F.pmod("event_id", F.lit(3))).alias("product_id"), "value"),
        ).withColumn("total_value", F.round(F.col("total_value") + 0.0, 4)),
        f"""WITH {SHOP}, ev AS (SELECT session_id, us, event_id, 'P' || (event_id % 3) AS product_id, value, CASE WHEN event_type = 'ADD_TO_CART' AND event_id % 4 = 0 THEN 'REMOVE_FROM_CART' ELSE event_type END AS event_type FROM shop),
        msg AS (SELECT CAST(conv_id % 150 AS VARCHAR) AS key, 1704067200000000 + conv_id * 14400000000 + turn * 60000000 AS us, conv_id * 1000 + turn AS msg_id FROM conversations WHERE role = 'user'),
        x AS (SELECT msg.*, (SELECT max((us, event_id)) FROM ev o WHERE o.session_id = msg.key AND o.event_type = 'ORDER_PLACED' AND o.us <= msg.us) AS lo FROM msg),
        b AS (SELECT x.key, x.msg_id, s.* FROM x JOIN ev s ON s.session_id = x.key AND s.us <= x.us AND (x.lo IS NULL OR (s.us, s.event_id) > x.lo)),
        g AS (SELECT msg_id, product_id, max((us, event_id)) AS at FROM b WHERE event_type = 'REMOVE_FROM_CART' GROUP BY 1, 2),
        a AS (SELECT b.msg_id, b.event_id, b.product_id, first_value(b.value) OVER (PARTITION BY b.msg_id, b.product_id ORDER BY b.us, b.event_id) AS price FROM b LEFT JOIN g USING (msg_id, product_id) WHERE b.event_type = 'ADD_TO_CART' AND (g.at IS NULL OR (b.us, b.event_id) > g.at))
        SELECT x.key, x.msg_id, count(a.event_id) AS item_count, round(coalesce(sum(price), 0.0), 4) AS total_value, count(DISTINCT product_id) AS products FROM x LEFT JOIN a ON a.msg_id = x.msg_id GROUP BY 1, 2""",
    ),
}
