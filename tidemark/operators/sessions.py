"""Session windows and what is read off them; tumbling and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VIEW, ADD, ORDER = "PRODUCT_VIEW", "ADD_TO_CART", "ORDER_PLACED"


def session_type(purchases: Column, adds: Column, views: Column) -> Column:
    return F.when(purchases > 0, "PURCHASE").when(adds > 0, "ABANDONED_CART").when(views >= 3, "BROWSER").otherwise("QUICK_VISIT")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "session_id", ts: str = "ts", late: str | None = None) -> DataFrame:
    """One row a session: it ends `gap` after its last event, and a pause of exactly `gap` does not end it.

    Counts, products as sorted lists and the type. A null product counts as one product. Works on a stream
    as well; late is then the watermark. A table is cut by one window and counted by session and product first, in one
    shuffle: what nobody reads of it, lists above all, is not made.
    """
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    value = F.sum(F.when(F.col("event_type") == ADD, F.col("value")).otherwise(0.0))
    if events.isStreaming:
        rows = events.withWatermark(ts, late) if late else events
        listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.col("product_id"))))
        got = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(
            of(VIEW).alias("view_count"),
            of(ADD).alias("add_count"),
            of(ORDER).alias("purchases"),
            (F.size(F.collect_set("product_id")) + F.max(F.col("product_id").isNull().cast("int"))).cast("long").alias("unique_products"),
            listed(VIEW).alias("viewed"),
            listed(ADD).alias("added"),
            value.alias("added_value"),
        )
        got = got.withColumn("start", F.col("w.start")).withColumn("end", F.col("w.end"))
    else:
        w, pause = W.partitionBy(key).orderBy(ts), F.expr(f"INTERVAL {gap}")
        rows = events.withColumn("__cut", (F.col(ts) > F.lag(ts).over(w) + pause).cast("int"))
        rows = rows.withColumn("__session", F.coalesce(F.sum("__cut").over(w), F.lit(0)))
        each = rows.filter(F.col(ts).isNotNull()).groupBy(key, "__session", "product_id").agg(of(VIEW).alias("v"), of(ADD).alias("a"), of(ORDER).alias("o"), value.alias("x"), F.min(ts).alias("first"), F.max(ts).alias("last"))
        listed = lambda n: F.array_sort(F.flatten(F.collect_list(F.when(F.col("product_id").isNotNull(), F.array_repeat("product_id", F.col(n).cast("int"))))))
        got = each.groupBy(key, "__session").agg(
            F.sum("v").alias("view_count"),
            F.sum("a").alias("add_count"),
            F.sum("o").alias("purchases"),
            F.count("*").alias("unique_products"),
            listed("v").alias("viewed"),
            listed("a").alias("added"),
            F.sum("x").alias("added_value"),
            F.min("first").alias("start"),
            (F.max("last") + pause).alias("end"),
        )
    return got.select(
        key,
        "start",
        "end",
        F.timestamp_diff("SECOND", "start", "end").alias("duration_s"),
        "view_count",
        "add_count",
        (F.col("view_count") + F.col("add_count") + F.least("purchases", F.lit(1))).alias("total_events"),
        "unique_products",
        (F.col("purchases") > 0).alias("completed_purchase"),
        "viewed",
        "added",
        "added_value",
        session_type(F.col("purchases"), F.col("add_count"), F.col("view_count")).alias("session_type"),
    )


def type_counts(sess: DataFrame) -> DataFrame:
    return sess.groupBy("session_type").agg(F.count("*").alias("n"), F.sum("total_events").alias("events"), F.avg("unique_products").alias("avg_products"), F.avg("add_count").alias("avg_adds"))


def conversion(sess: DataFrame) -> DataFrame:
    return sess.agg(F.count("*").alias("n"), F.count_if("completed_purchase").alias("converted"), (F.count_if("completed_purchase") / F.count("*")).alias("rate"))


def abandoned_of_value(sess: DataFrame, least: float = 100.0) -> DataFrame:
    """Abandoned carts worth at least `least`."""
    return sess.filter((F.col("session_type") == "ABANDONED_CART") & (F.col("added_value") >= least))


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Tumbling or sliding counts and sums by event type."""
    return events.groupBy(F.window(ts, size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")
