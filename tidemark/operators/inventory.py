"""Inventory: change classifiers, alerts, routing, deductions and running figures per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def _lagged(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return updates.select("*", F.lag("inventory").over(w).alias("prev_inventory"), F.lag("price").over(w).alias("prev_price"), F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(0)).alias("since_us"))


def stock_change(old: Column, new: Column, names=("OUT_OF_STOCK", "BACK_IN_STOCK", "INVENTORY_DECREASED", "INVENTORY_INCREASED")) -> Column:
    """Kind of an inventory change; null if there is none."""
    return F.when(old == new, None).when(new == 0, names[0]).when(old == 0, names[1]).when(new < old, names[2]).otherwise(names[3])


def price_moved(old: Column, new: Column, least: float = 0.01) -> Column:
    return F.abs(new - old) > least


def percent(old: Column, new: Column) -> Column:
    """Change in percent of the old price; null if that is 0."""
    return F.when(old != 0, (new - old) / old * 100)


def classify(updates: DataFrame, order: list[str], mode: str = "refactored", key: str = "product_id") -> DataFrame:
    """Change events of each product in order.

    original: one event an update, the first that fits of added, stock change, price change, updated.
    refactored: added, or a stock change and a price change independently; no event if nothing changed.
    """
    rows = _lagged(updates, key, order)
    old, new, p, q = F.col("prev_inventory"), F.col("inventory"), F.col("prev_price"), F.col("price")
    stock, price = stock_change(old, new), F.when(price_moved(p, q), "PRICE_CHANGED")
    if mode == "original":
        kinds = F.array(F.when(old.isNull(), "PRODUCT_ADDED").otherwise(F.coalesce(stock, price, F.lit("PRODUCT_UPDATED"))))
    elif mode == "refactored":
        kinds = F.when(old.isNull(), F.array(F.lit("PRODUCT_ADDED"))).otherwise(F.array_compact(F.array(stock, price)))
    else:
        raise ValueError(mode)
    return rows.withColumn("event_type", F.explode(kinds))


def alerts(events: DataFrame, mode: str = "refactored", low: int = 10, critical: int = 5, drop: float = 10.0) -> DataFrame:
    """Alerts of classify()'s events, with channel and severity.

    original: low stock up to and with `low` at every update, and sales of a price drop of `drop` percent or more.
    refactored: low stock below `low` and out of stock, when added or changed; price drops.
    """
    kind, stock = F.col("event_type"), F.col("inventory")
    fall = percent(F.col("prev_price"), F.col("price")) <= -drop
    severity = F.when(stock <= critical, "CRITICAL").otherwise("WARNING")
    if mode == "original":
        made = F.array(F.when((stock > 0) & (stock <= low), F.struct(F.lit("LOW_STOCK_ALERT").alias("channel"), severity.alias("severity"))), F.when((kind == "PRICE_CHANGED") & fall, F.struct(F.lit("SALE_STARTED").alias("channel"), F.lit("INFO").alias("severity"))))
    else:
        touched = (kind != "PRICE_CHANGED") & (kind != "PRODUCT_UPDATED")
        made = F.array(
            F.when(touched & (stock > 0) & (stock < low), F.struct(F.lit("LOW_STOCK").alias("channel"), severity.alias("severity"))),
            F.when(touched & (stock == 0), F.struct(F.lit("OUT_OF_STOCK").alias("channel"), F.lit("CRITICAL").alias("severity"))),
            F.when((kind == "PRICE_CHANGED") & fall, F.struct(F.lit("PRICE_DROP").alias("channel"), F.lit("INFO").alias("severity"))),
        )
    return events.withColumn("a", F.explode(F.array_compact(made))).select("*", "a.channel", "a.severity").drop("a")


def track(updates: DataFrame, order: list[str], key: str = "product_id") -> DataFrame:
    """New product, sale or restock with its delta, and price changes independently."""
    rows = _lagged(updates, key, order)
    old, new = F.col("prev_inventory"), F.col("inventory")
    stock = F.when(new < old, "SALE").when(new > old, "RESTOCK")
    kinds = F.when(old.isNull(), F.array(F.lit("NEW_PRODUCT"))).otherwise(F.array_compact(F.array(stock, F.when(price_moved(F.col("prev_price"), F.col("price")), "PRICE_CHANGE"))))
    return rows.withColumn("change", F.explode(kinds)).withColumn("delta", F.when(F.col("change").isin("SALE", "RESTOCK"), new - old))


def route(products: DataFrame) -> DataFrame:
    """Every product on MAIN, and on OUT_OF_STOCK or LOW_STOCK, and PRICE_DROP, where it belongs: one scan."""
    stock = F.when(F.col("inventory") == 0, "OUT_OF_STOCK").when(F.col("inventory") < 10, "LOW_STOCK")
    deal = F.when((F.col("rating") > 4.5) & (F.col("price") < 100), "PRICE_DROP")
    was = F.col("price") * 1.15
    return products.withColumn("channel", F.explode(F.array_compact(F.array(F.lit("MAIN"), stock, deal)))).withColumn("discount", F.when(F.col("channel") == "PRICE_DROP", F.round((was - F.col("price")) / was * 100, 3)))


def deduct(log: DataFrame, order: list[str], key: str = "product_id") -> DataFrame:
    """Order rows with the stock before and after, clamped at zero.

    log: product rows (inventory set) reset the stock, order rows (quantity set) take from it. Clamped
    subtraction composes: a run of rows maps stock s to max(s + a, b), so it folds as pairs. Without clamping
    at an order the balance is running sums; with it, the balance is the sum since the last reset less the
    lowest dip below zero, all of them running aggregates of one window.
    """
    w = W.partitionBy(key).orderBy(*order)
    span = F.sum(F.col("inventory").isNotNull().cast("long")).over(w)
    rows = log.filter(F.coalesce("quantity", F.lit(1)) > 0).withColumn("__span", span)
    inside = W.partitionBy(key, "__span").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    free = F.sum(F.coalesce(F.col("inventory"), -F.col("quantity")).cast("long")).over(inside)
    rows = rows.withColumn("__free", free)
    rows = rows.withColumn("current", F.col("__free") - F.least(F.min("__free").over(inside), F.lit(0)))
    rows = rows.withColumn("previous", F.coalesce(F.lag("current").over(W.partitionBy(key, "__span").orderBy(*order)), F.lit(0)))
    known = F.col("__span") > 0
    kind = F.when(known & (F.col("current") == 0), "OUT_OF_STOCK").otherwise("INVENTORY_DECREASED")
    return rows.filter("quantity is not null").withColumn("event_type", kind).withColumn("sufficient", ~known | (F.col("previous") >= F.col("quantity"))).drop("__span", "__free")


def stale(updates: DataFrame, order: list[str], threshold_us: int, horizon_us: int, key: str = "product_id") -> DataFrame:
    """Updates after which nothing came for threshold_us, up to the horizon; severity by the time idle when the timer fires.

    A timer is moved by each update and fires the moment the threshold is reached. HIGH needs twice the threshold, so an alert on
    time is MEDIUM whatever the threshold.
    """
    w = W.partitionBy(key).orderBy(*order)
    idle = F.coalesce(F.lead("us").over(w), F.lit(horizon_us)) - F.col("us")
    rows = updates.withColumn("idle_us", idle).filter(F.col("idle_us") >= threshold_us).withColumn("fires_us", F.col("us") + threshold_us)
    return rows.withColumn("severity", severity_of(F.col("fires_us") - F.col("us"), threshold_us))


def severity_of(idle_us: Column, threshold_us: int) -> Column:
    return F.when(idle_us > 2 * threshold_us, "HIGH").otherwise("MEDIUM")


def stale_uncancelled(updates: DataFrame, order: list[str], threshold_us: int, fires_after_us: int, horizon_us: int, key: str = "product_id") -> DataFrame:
    """The original form: each update sets a timer of its own that no later one cancels, several of a key at a time.

    A timer that fires by the horizon is judged against the last update up to then: an alert needs more than threshold_us between
    them. With fires_after_us equal to the threshold none is ever late enough, which is the original's defect; what it meant needs later timers.
    """
    near = W.partitionBy(key).orderBy("us").rangeBetween(0, fires_after_us)
    rows = updates.withColumn("fires_us", F.col("us") + fires_after_us).withColumn("last_us", F.max("us").over(near))
    rows = rows.withColumn("idle_us", F.col("fires_us") - F.col("last_us"))
    return rows.filter((F.col("fires_us") <= horizon_us) & (F.col("idle_us") > threshold_us)).withColumn("reason", stale_reason(F.col("idle_us")))


def stale_at_horizon(updates: DataFrame, order: list[str], threshold_us: int, horizon_us: int, key: str = "product_id") -> DataFrame:
    """stale() as seen from the horizon: severity by the whole idle time, HIGH beyond twice the threshold."""
    rows = stale(updates, order, threshold_us, horizon_us, key)
    return rows.withColumn("severity", severity_of(F.col("idle_us"), threshold_us))


def reason(kind: str = "event_type") -> Column:
    """The text of a change event of classify()."""
    old, new, p, q = F.col("prev_inventory"), F.col("inventory"), F.col("prev_price"), F.col("price")
    moved = F.format_string("Price %s by $%.2f (%.1f%%)", F.when(q > p, "increased").otherwise("decreased"), F.abs(q - p).cast("double"), F.abs(percent(p, q)).cast("double"))
    return (
        F.when(F.col(kind) == "OUT_OF_STOCK", F.lit("Product is now out of stock"))
        .when(F.col(kind) == "BACK_IN_STOCK", F.format_string("Product restocked with %d units", new))
        .when(F.col(kind) == "INVENTORY_DECREASED", F.format_string("%d units sold/removed", old - new))
        .when(F.col(kind) == "INVENTORY_INCREASED", F.format_string("%d units added to inventory", new - old))
        .when(F.col(kind) == "PRICE_CHANGED", moved)
    )


def alert_message(channel: str = "channel") -> Column:
    """The text of an alert of alerts()."""
    old, new = F.col("prev_price"), F.col("price")
    fall = F.format_string("Price dropped %.1f%% from $%.2f to $%.2f", F.abs(percent(old, new)).cast("double"), old.cast("double"), new.cast("double"))
    return F.when(F.col(channel) == "LOW_STOCK", F.format_string("Low stock: only %d items remaining", F.col("inventory"))).when(F.col(channel) == "OUT_OF_STOCK", F.lit("Product is out of stock")).when(F.col(channel) == "PRICE_DROP", fall)


def stale_reason(idle_us: Column) -> Column:
    return F.format_string("No updates for %.1f hours", idle_us / float(HOUR))


def running(updates: DataFrame, order: list[str], key: str = "product_id", last: int = 10) -> DataFrame:
    """Running sum and average and the last prices of each product."""
    w = W.partitionBy(key).orderBy(*order)
    so_far, few = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1 - last, 0)
    return updates.select("*", F.sum(F.col("inventory").cast("long")).over(so_far).alias("running_total"), F.avg("price").over(so_far).alias("running_avg"), F.collect_list("price").over(few).alias("last_prices"))


def snapshots(updates: DataFrame, size_us: int, order: list[str], key: str = "product_id") -> DataFrame:
    """The last state of each product in each period that has an update."""
    return updates.withColumn("period", F.floor(F.col("us") / size_us)).groupBy(key, "period").agg(F.count("*").alias("updates"), F.max_by(F.struct("inventory", "price"), F.struct(*order)).alias("s")).select(key, "period", "updates", "s.inventory", "s.price")


def snapshot_spans(updates: DataFrame, size_us: int, order: list[str], horizon_us: int, key: str = "product_id") -> DataFrame:
    """What a timer that sets itself anew each period would show, idle periods included: spans of periods with one state.

    A span goes from a period with an update to that before the next such period, or to the last one that ends by the
    horizon: one row however long a product idles.
    """
    each = snapshots(updates, size_us, order, key)
    last = F.floor(F.lit(horizon_us) / size_us) - 1
    w = W.partitionBy(key).orderBy("period")
    spans = each.withColumn("to_period", F.coalesce(F.lead("period").over(w) - 1, last)).filter(F.col("period") <= last)
    return spans.select(key, F.col("period").alias("from_period"), F.least("to_period", last).alias("to_period"), "updates", "inventory", "price")


def periods(spans: DataFrame) -> DataFrame:
    """Rows of snapshot_spans() as one row a period; idle periods have no updates."""
    rows = spans.withColumn("period", F.explode(F.sequence("from_period", "to_period")))
    return rows.withColumn("updates", F.when(F.col("period") == F.col("from_period"), F.col("updates")).otherwise(F.lit(0).cast("long"))).drop("from_period", "to_period")


def balances(log: DataFrame, order: list[str], amount: Column, limit: float | None = None, key: str = "account_id") -> DataFrame:
    """log with `balance`, the running sum of amounts of its key, and `overdrawn`, whether it is under the limit (0 if none)."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn("balance", F.sum(amount).over(w)).withColumn("overdrawn", F.coalesce(F.col("balance") < (limit or 0.0), F.lit(False)))
