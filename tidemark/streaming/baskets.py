"""Baskets and their rules as streams: the forms of operators.baskets that keep state a key."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.baskets import ADD, COMPLETE, REMOVE, RULE_COLUMNS, TIMEOUT, VIEWS, History
from ..operators.sessions import VIEW
from .ordered import Ordered, run_ordered


class BasketProcessor(Ordered):
    """One key's basket: adds and removals, the last VIEWS views, and a deadline that each event moves.

    A completing event gives a row 'completed' if the basket holds an item; an idle timeout gives a row 'timeout' if asked
    for; either empties the basket.
    """

    columns = ["kind", "at_us", "n_items", "items", "total_value", "views"]

    def __init__(self, key: str, mode: str, timeout_us: int, timeouts: bool, adjust: bool):
        super().__init__(key)
        self.mode, self.timeout, self.timeouts, self.adjust = mode, timeout_us, timeouts, adjust

    def load(self, text: str | None) -> dict:
        return json.loads(text) if text else {"items": [], "total": 0.0, "views": [], "last": None}

    def save(self, basket: dict) -> str | None:
        return None if basket["last"] is None else json.dumps(basket)

    def due(self, basket: dict) -> int | None:
        return None if basket["last"] is None else basket["last"] + self.timeout

    def _row(self, basket: dict, kind: str, at_us: int) -> tuple:
        total = sum(v or 0.0 for _, v in basket["items"]) if self.adjust else basket["total"]
        return kind, at_us, len(basket["items"]), ",".join(sorted(p for p, _ in basket["items"] if p is not None)), total, ",".join(basket["views"])

    def _clear(self, basket: dict) -> None:
        basket.update(items=[], total=0.0, views=[], last=None)

    def passed(self, basket: dict, now_us: int) -> list[tuple]:
        if basket["last"] is None or now_us - basket["last"] < self.timeout:
            return []
        out = [self._row(basket, "timeout", basket["last"] + self.timeout)] if self.timeouts and basket["items"] else []
        self._clear(basket)
        return out

    def event(self, basket: dict, us: int, place: int, row: list) -> list[tuple]:
        kind, product, value = row
        out = self.passed(basket, us)
        basket["last"] = us
        if kind == ADD:
            basket["items"].append((product, value))
            basket["total"] += value or 0.0
        elif kind == REMOVE:
            basket["items"] = [x for x in basket["items"] if x[0] != product]
        elif kind == VIEW:
            basket["views"] = [*basket["views"], product][-VIEWS:] if product is not None else basket["views"]
        elif kind in COMPLETE[self.mode]:
            if basket["items"]:
                out.append(self._row(basket, "completed", us))
            self._clear(basket)
        return out


def carts(events: DataFrame, mode: str = "refactored", timeout_us: int = TIMEOUT, timeouts: bool = False, late: str = "5 seconds", key: str = "session_id", ts: str = "ts", adjust_total_on_remove: bool = False) -> DataFrame:
    """operators.baskets.carts as a stream: events with key, us, event_id, event_type, product_id, value and a time for the watermark."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    rows = rows.select(F.col(key).cast("string").alias(key), F.col("us").alias("__us"), F.col("event_id").cast("long").alias("__place"), "event_type", "product_id", F.col("value").cast("double").alias("value"), "__ts")
    schema = f"`{key}` string, kind string, at_us bigint, n_items bigint, items string, total_value double, views string"
    return run_ordered(rows, BasketProcessor(key, mode, timeout_us, timeouts, adjust_total_on_remove), schema)


class RuleProcessor(Ordered):
    """Rules of each basket of a key from the baskets that its history holds then."""

    columns = RULE_COLUMNS

    def __init__(self, key: str, keep: int, full: tuple, single: float):
        super().__init__(key)
        self.keep, self.full, self.single = keep, full, single

    def load(self, text: str | None) -> History:
        return History(self.keep).load(text) if text else History(self.keep)

    def save(self, history: History) -> str | None:
        return history.dump()

    def event(self, history: History, us: int, place: int, row: list) -> list[tuple]:
        history.add(json.loads(row[0]))
        return [(history.count, *r) for r in history.rules(self.full, self.single)]


def rules(baskets: DataFrame, keep: int = 1000, late: str = "5 seconds", key: str = "user_id", ts: str = "ts", full: tuple = (0.3, 0.01), single: float = 0.4) -> DataFrame:
    """operators.baskets.incremental_rules as a stream: baskets with key, us, basket_id, items (array) and a time for the watermark."""
    rows = baskets.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    rows = rows.select(F.col(key).cast("string").alias(key), F.col("us").alias("__us"), F.col("basket_id").cast("long").alias("__place"), F.to_json("items").alias("items"), "__ts")
    schema = f"`{key}` string, seq bigint, antecedents string, consequent string, kind string, confidence double, support double, lift double"
    return run_ordered(rows, RuleProcessor(key, keep, full, single), schema)
