"""The domain streams, built from the driver's tables; and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = {"view": "PRODUCT_VIEW", "click": "ADD_TO_CART", "purchase": "ORDER_PLACED", "signup": "USER_LOGIN"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str, rows: int = 250_000) -> int:
    """How many tasks share a table's rows, so that a task's share stays the same whatever the table's size; its rows are counted from file footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // rows))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz"))


def shop_events(spark, sf_dir) -> DataFrame:
    """Shopping events: event_id, session_id, user_id, event_type, product_id, value, ts, us."""
    kind = F.create_map(*(F.lit(x) for kv in EVENT_TYPES.items() for x in kv))
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin(*EVENT_TYPES)).select(
        "event_id",
        F.col("user_id").cast("string").alias("session_id"),
        F.col("user_id").cast("string").alias("user_id"),
        kind[F.col("event_type")].alias("event_type"),
        F.get_json_object("props", "$.k").alias("product_id"),
        "value",
        "ts",
        micros("ts").alias("us"),
    )


SHOP = """shop AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, CAST(user_id AS VARCHAR) AS user_id,
  CASE event_type WHEN 'view' THEN 'PRODUCT_VIEW' WHEN 'click' THEN 'ADD_TO_CART' WHEN 'purchase' THEN 'ORDER_PLACED' WHEN 'signup' THEN 'USER_LOGIN' END AS event_type,
  json_extract_string(props, '$.k') AS product_id, value, ts, epoch_us(ts) AS us
  FROM events WHERE event_type IN ('view','click','purchase','signup'))"""


def product_updates(spark, sf_dir) -> DataFrame:
    """Product updates: product_id, inventory, price, us and the keys seq1..seq5 of a total order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("product_id"),
        (F.col("l_quantity").cast("int") - 1).alias("inventory"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        micros("l_shipdate").alias("us"),
        F.col("l_orderkey").alias("seq1"),
        F.col("l_linenumber").alias("seq2"),
        F.col("l_suppkey").alias("seq3"),
        F.col("l_extendedprice").alias("seq4"),
        F.col("l_discount").alias("seq5"),
    )


ORDER = ["us", "seq1", "seq2", "seq3", "seq4", "seq5"]
UPDATES = """upd AS (SELECT CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_quantity AS INTEGER) - 1 AS inventory,
  l_extendedprice / l_quantity AS price, epoch_us(l_shipdate) AS us, l_orderkey AS seq1, l_linenumber AS seq2, l_suppkey AS seq3, l_extendedprice AS seq4, l_discount AS seq5 FROM lineitem)"""
W = "(PARTITION BY product_id ORDER BY us, seq1, seq2, seq3, seq4, seq5)"


def products(spark, sf_dir) -> DataFrame:
    """Catalogue: product_id, name, brand, category, price, inventory, rating, review_count, tags."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("inventory"),
        (F.lit(3.0) + F.pmod("p_partkey", F.lit(21)) / F.lit(10.0)).alias("rating"),
        F.pmod(F.col("p_partkey") * 37, F.lit(1009)).alias("review_count"),
        F.array(F.element_at(F.split("p_name", " "), -1), F.lower("p_type")).alias("tags"),
    )


PRODUCTS = """prod AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, p_brand AS brand, p_type AS category, p_retailprice AS price, p_size AS inventory,
  3.0::DOUBLE + (p_partkey % 21) / 10.0::DOUBLE AS rating, (p_partkey * 37) % 1009 AS review_count, [string_split(p_name, ' ')[-1], lower(p_type)] AS tags FROM part)"""


def baskets(spark, sf_dir) -> DataFrame:
    """Baskets for mining: basket_id, user_id, items (distinct, sorted brands), n_entries per item kept apart in `entries`."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return items.select(F.col("l_orderkey").alias("basket_id"), F.col("p_brand").alias("item"))


BASKETS = "bitem AS (SELECT l_orderkey AS basket_id, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def chat(spark, sf_dir) -> DataFrame:
    """Chat messages: conv_id, turn, role, text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
