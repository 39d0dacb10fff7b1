"""Event sequences over one key, by neighbours in order and by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sessions import ADD, ORDER, VIEW

MINUTE = 60_000_000


def _by(key: str, order: list[str]):
    return W.partitionBy(key).orderBy(*order)


def strict_sequence(events: DataFrame, kinds: list[str], within_us: int, key: str = "session_id", order: tuple = ("us", "event_id")) -> DataFrame:
    """Rows at which neighbouring events have the given kinds; the last less than within_us after the first."""
    w = _by(key, list(order))
    out = events
    for i in range(1, len(kinds)):
        out = out.withColumn(f"__k{i}", F.lead("event_type", i).over(w)).withColumn(f"__u{i}", F.lead("us", i).over(w)).withColumn(f"__p{i}", F.lead("product_id", i).over(w))
    ok = F.col("event_type") == kinds[0]
    for i, kind in enumerate(kinds[1:], 1):
        ok = ok & (F.col(f"__k{i}") == kind)
    n = len(kinds) - 1
    return out.filter(ok & (F.col(f"__u{n}") - F.col("us") < within_us)).select(key, "event_id", F.col("us").alias("first_us"), F.col(f"__u{n}").alias("last_us"), (F.col(f"__u{n}") - F.col("us")).alias("took_us"), F.col(f"__p{n}").alias("product_id"))


def quick_purchase(events: DataFrame, within_us: int = 10 * MINUTE) -> DataFrame:
    """View, add and order, next to each other."""
    return strict_sequence(events, [VIEW, ADD, ORDER], within_us)


def repeated(events: DataFrame, kind: str = VIEW, least: int = 3, most: int = 10, within_us: int = 20 * MINUTE, key: str = "session_id") -> DataFrame:
    """For each start and each length from least to most: the next events of the kind, if all lie within the limit."""
    w = _by(key, ["us", "event_id"])
    only = events.filter(F.col("event_type") == kind).select(key, "event_id", "us", "product_id")
    ahead = w.rowsBetween(0, most - 1)
    runs = only.withColumn("__next", F.collect_list(F.struct("us", "event_id", "product_id")).over(ahead))
    out = runs.select(key, "event_id", "us", F.explode(F.sequence(F.lit(least), F.lit(most))).alias("length"), "__next").filter(F.size("__next") >= F.col("length"))
    return out.select(key, "event_id", "length", F.col("us").alias("first_us"), F.expr("__next[length - 1].us").alias("last_us"), F.expr("concat_ws(',', transform(slice(__next, 1, length), x -> x.product_id))").alias("products")).filter(F.col("last_us") - F.col("first_us") < within_us)


def abandonment_intent(events: DataFrame, within_us: int = 30 * MINUTE, key: str = "session_id") -> DataFrame:
    """Keys with adds and no order from the last add until within_us after it."""
    adds = events.filter(F.col("event_type") == ADD).groupBy(key).agg(F.min("us").alias("first_add"), F.max("us").alias("last_add"), F.count("*").alias("adds"), F.array_join(F.array_sort(F.collect_set("product_id")), ",").alias("products"))
    orders = events.filter(F.col("event_type") == ORDER).select(F.col(key).alias("__k"), F.col("us").alias("__o"))
    return adds.join(orders, (F.col(key) == F.col("__k")) & (F.col("__o") >= F.col("last_add")) & (F.col("__o") <= F.col("last_add") + within_us), "left_anti")


def abandonment_faithful(events: DataFrame, key: str = "session_id") -> DataFrame:
    """The original pattern, whose closing part is optional: every key with an add, purchasers too."""
    return events.filter(F.col("event_type") == ADD).groupBy(key).agg(F.min("us").alias("first_add"), F.max("us").alias("last_add"), F.count("*").alias("adds"))


def burst(events: DataFrame, least: int, within_us: int, key: str = "session_id", where: Column | None = None) -> DataFrame:
    """Events that complete at least `least` events of their key within within_us, both ends counted (spam, brute force)."""
    rows = events.filter(where) if where is not None else events
    w = W.partitionBy(key).orderBy("us").rangeBetween(-within_us, 0)
    return rows.withColumn("in_range", F.count("*").over(w)).filter(F.col("in_range") >= least).select(key, "event_id", "us", "in_range")


def not_followed(events: DataFrame, first: str, then: str, within_us: int, key: str = "session_id") -> DataFrame:
    """Events of kind first with none of kind then after them within the limit."""
    # Seen from the end, what follows is a running minimum, one step a row.
    w = W.partitionBy(key).orderBy(F.desc("us"), F.desc("event_id")).rowsBetween(W.unboundedPreceding, -1)
    nxt = F.min(F.when(F.col("event_type") == then, F.col("us"))).over(w)
    return events.withColumn("__n", nxt).filter((F.col("event_type") == first) & (F.col("__n").isNull() | (F.col("__n") - F.col("us") > within_us))).select(key, "event_id", "us")


def followed_by_any(events: DataFrame, first: str, then: str, within_us: int, key: str = "session_id") -> DataFrame:
    """All pairs of an event of kind first and a later one of kind then within the limit."""
    a = events.filter(F.col("event_type") == first).select(key, F.col("event_id").alias("first_id"), F.col("us").alias("first_us"))
    b = events.filter(F.col("event_type") == then).select(F.col(key).alias("__k"), F.col("event_id").alias("then_id"), F.col("us").alias("then_us"))
    # Time buckets make the range an equality on two neighbouring buckets.
    a = a.withColumn("__b", F.explode(F.array(F.floor(F.col("first_us") / within_us), F.floor(F.col("first_us") / within_us) + 1)))
    b = b.withColumn("__c", F.floor(F.col("then_us") / within_us))
    hit = (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__c")) & (F.col("then_us") > F.col("first_us")) & (F.col("then_us") - F.col("first_us") < within_us)
    return a.join(b, hit).select(key, "first_id", "then_id", (F.col("then_us") - F.col("first_us")).alias("took_us"))


def impossible_travel(events: DataFrame, place: str, within_us: int, key: str = "session_id") -> DataFrame:
    """Events whose place differs from that of the event just before them, less than within_us earlier; unknown places don't count."""
    w = _by(key, ["us", "event_id"])
    rows = events.withColumn("from_place", F.lag(place).over(w)).withColumn("took_us", F.col("us") - F.lag("us").over(w))
    return rows.filter((F.col("from_place") != F.col(place)) & (F.col("took_us") < within_us)).select(key, "event_id", "us", "from_place", F.col(place).alias("to_place"), "took_us")


def preceded(events: DataFrame, many: Column, then: Column, least: int, within_us: int, most: int | None = None, key: str = "session_id") -> DataFrame:
    """Events of `then` with at least `least` (and at most `most`) events of `many` less than within_us before them.

    Failed logins before a success, small payments before a large one. Of events at one time, those with smaller ids are before.
    """
    w = _by(key, ["us", "event_id"])
    # Counted up to here, less what had been counted before the limit: two running aggregates, no list a row.
    rows = events.withColumn("__many", F.coalesce(many, F.lit(False)).cast("int")).withColumn("__then", then)
    so_far = F.coalesce(F.sum("__many").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    old = F.coalesce(F.sum("__many").over(W.partitionBy(key).orderBy("us").rangeBetween(W.unboundedPreceding, -within_us)), F.lit(0))
    hit = rows.withColumn("before", so_far - old).filter(F.col("__then") & (F.col("before") >= least))
    return (hit.filter(F.col("before") <= most) if most is not None else hit).select(key, "event_id", "us", "before")


def funnel(events: DataFrame, kinds: list[str], within_us: int, key: str = "session_id") -> DataFrame:
    """How far each key gets: from its first event of kinds[0], each next kind after the one before, all less than within_us from the start.

    reached: steps done, 1 at least; lost_at: the kind it did not reach, null for keys that finish.
    """
    whole = W.partitionBy(key)
    rows = events.filter(F.col("event_type").isin(*kinds)).withColumn("__t0", F.min(F.when(F.col("event_type") == kinds[0], F.col("us"))).over(whole))
    for i, kind in enumerate(kinds[1:], 1):
        in_time = (F.col("event_type") == kind) & (F.col("us") > F.col(f"__t{i - 1}")) & (F.col("us") - F.col("__t0") < within_us)
        rows = rows.withColumn(f"__t{i}", F.min(F.when(in_time, F.col("us"))).over(whole))
    steps = [F.col(f"__t{i}") for i in range(len(kinds))]
    one = rows.groupBy(key).agg(*(F.first(c).alias(f"__t{i}") for i, c in enumerate(steps))).filter("__t0 is not null")
    reached = sum((c.isNotNull().cast("int") for c in steps), F.lit(0))
    return one.withColumn("reached", reached).select(key, "reached", F.try_element_at(F.array(*map(F.lit, kinds)), F.col("reached") + 1).alias("lost_at"), (F.greatest(*steps) - F.col("__t0")).alias("took_us"))
