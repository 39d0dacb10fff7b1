"""Stateful streaming forms of the keyed operators; they give the rows of the batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR_MS = 3_600_000


class InventoryProcessor(StatefulProcessor):
    """Change events of a product in order of (us, seq), as inventory.classify(mode='refactored') gives them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "inventory int, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us", "seq"])
        old, out = self.last.get() if self.last.exists() else None, []
        for r in pdf.itertuples():
            now = (int(r.inventory), float(r.price))
            if old is None:
                out.append((key[0], r.us, r.seq, "PRODUCT_ADDED"))
            else:
                if now[0] != old[0]:
                    kind = "OUT_OF_STOCK" if now[0] == 0 else "BACK_IN_STOCK" if old[0] == 0 else "INVENTORY_DECREASED" if now[0] < old[0] else "INVENTORY_INCREASED"
                    out.append((key[0], r.us, r.seq, kind))
                if abs(now[1] - old[1]) > 0.01:
                    out.append((key[0], r.us, r.seq, "PRICE_CHANGED"))
            old = now
        self.last.update(old)
        yield pd.DataFrame(out, columns=["product_id", "us", "seq", "event_type"])

    def close(self) -> None:
        pass


def inventory_events(updates: DataFrame) -> DataFrame:
    """updates: product_id, us, seq, inventory, price."""
    return updates.groupBy("product_id").transformWithStateInPandas(InventoryProcessor(), "product_id string, us bigint, seq bigint, event_type string", "Append", "None")


class StaleProcessor(StatefulProcessor):
    """A row when a product has had no update for the threshold, by event time."""

    def __init__(self, threshold_ms: int = HOUR_MS):
        self.threshold = threshold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = max(int(p["at_ms"].max()) for p in rows)
        if not self.last.exists() or self.last.get()[0] < at:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.last.update((at,))
            self.handle.registerTimer(at + self.threshold)
        yield pd.DataFrame({"product_id": [], "idle_since": []}).astype({"product_id": str, "idle_since": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"product_id": [key[0]], "idle_since": [since]})

    def close(self) -> None:
        pass


def stale(updates: DataFrame, threshold_ms: int = HOUR_MS, late: str = "5 seconds", ts: str = "ts") -> DataFrame:
    rows = updates.withWatermark(ts, late).withColumn("at_ms", F.unix_millis(F.col(ts).cast("timestamp")))
    return rows.groupBy("product_id").transformWithStateInPandas(StaleProcessor(threshold_ms), "product_id string, idle_since bigint", "Append", "EventTime")


class UncancelledProcessor(StatefulProcessor):
    """The original stale detector: a timer an update, several at a time, each judged against the last update when it fires."""

    def __init__(self, threshold_ms: int, fires_after_ms: int):
        self.threshold, self.fires_after = threshold_ms, fires_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for at in pdf["at_ms"].astype("int64").tolist():
                self.times.appendValue((at,))
                self.handle.registerTimer(at + self.fires_after)
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fires = expiredTimerInfo.getExpiryTimeInMs()
        times = sorted(t[0] for t in self.times.get())
        last = max(t for t in times if t <= fires)
        begun = sum(t == fires - self.fires_after for t in times)  # updates of one time share a timer
        keep = [(t,) for t in times if t > fires - self.fires_after]
        self.times.clear()
        if keep:
            self.times.put(keep)
        yield self._rows([(key[0], fires, fires - last)] * begun if fires - last > self.threshold else [])

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["product_id", "fires_ms", "idle_ms"]).astype({"fires_ms": "int64", "idle_ms": "int64"})

    def close(self) -> None:
        pass


def stale_uncancelled(updates: DataFrame, threshold_ms: int = HOUR_MS, fires_after_ms: int = HOUR_MS, late: str = "5 seconds", ts: str = "ts") -> DataFrame:
    """inventory.stale_uncancelled as a stream."""
    rows = updates.withWatermark(ts, late).withColumn("at_ms", F.unix_millis(F.col(ts).cast("timestamp")))
    return rows.groupBy("product_id").transformWithStateInPandas(UncancelledProcessor(threshold_ms, fires_after_ms), "product_id string, fires_ms bigint, idle_ms bigint", "Append", "EventTime")


class SequenceProcessor(StatefulProcessor):
    """A small automaton over one key's events: steps of (name, kind, how), how one of next, followedBy, followedByAny, notNext, notFollowedBy.

    Partial matches are kept until the limit passes. next asks for the very next event; followedBy skips
    others; followedByAny also keeps waiting after a hit; the two nots drop a match when their kind comes
    (next or at all) before the following step. A pattern must not end in notFollowedBy.
    """

    def __init__(self, steps: list[tuple[str, str, str]], within_us: int, ttl_ms: int | None = None):
        self.steps, self.within, self.ttl = steps, within_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "step int, first bigint, ids string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us", "event_id"])
        runs = [tuple(x) for x in self.open.get()]
        out = []
        for r in pdf.itertuples():
            runs, done = advance(self.steps, self.within, runs, r.event_type, int(r.us), str(r.event_id))
            out += [(key[0], first, int(r.us), ids) for first, ids in done]
        self.open.clear()
        if runs:
            self.open.put(runs)
        yield pd.DataFrame(out, columns=["session_id", "first_us", "last_us", "ids"])

    def close(self) -> None:
        pass


def advance(steps, within: int, runs: list[tuple], kind: str, us: int, ident: str):
    """One event on all partial matches (next step, first time, ids): (partial matches, completed ones)."""
    nots = ("notNext", "notFollowedBy")
    after, done = [], []

    def enter(step: int, first: int, ids: str) -> None:
        if step == len(steps):
            done.append((first, ids))
        else:
            after.append((step, first, ids))

    for step, first, ids in [*runs, (0, us, "")]:
        if us - first >= within:
            continue
        want, how = steps[step][1], steps[step][2]
        if how in nots and ids:
            if kind == want:
                continue
            if how == "notNext" or kind == (steps[step + 1][1] if step + 1 < len(steps) else None):
                step += 1
                if step == len(steps):
                    done.append((first, ids))
                    continue
                want, how = steps[step][1], steps[step][2]
            else:
                after.append((step, first, ids))
                continue
        if kind == want:
            enter(step + 1, first, f"{ids},{ident}" if ids else ident)
            if how == "followedByAny" and ids:
                after.append((step, first, ids))
        elif ids and how in ("followedBy", "followedByAny"):
            after.append((step, first, ids))
    return after, done


def sequences(events: DataFrame, steps: list[tuple[str, str, str]], within_us: int, ttl_ms: int | None = None) -> DataFrame:
    """ttl_ms: partial matches of a session that is idle for so long (processing time) are forgotten."""
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return events.groupBy("session_id").transformWithStateInPandas(SequenceProcessor(steps, within_us, ttl_ms), "session_id string, first_us bigint, last_us bigint, ids string", "Append", mode)


class DeductionProcessor(StatefulProcessor):
    """Order rows with the stock before and after, clamped at zero; product rows set the stock (inventory.deduct as a stream)."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stock = handle.getValueState("stock", "known boolean, n bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, out = pd.concat(list(rows)).sort_values(["us", "seq"]), []
        known, n = self.stock.get() if self.stock.exists() else (False, 0)
        for r in pdf.itertuples():
            if not pd.isna(r.inventory):
                known, n = True, int(r.inventory)
            elif not pd.isna(r.quantity) and r.quantity > 0:
                before, n = n, max(n - int(r.quantity), 0)
                out.append((key[0], r.us, r.seq, before, n, "OUT_OF_STOCK" if known and n == 0 else "INVENTORY_DECREASED", not known or before >= r.quantity))
        self.stock.update((known, n))
        yield pd.DataFrame(out, columns=["product_id", "us", "seq", "previous", "current", "event_type", "sufficient"])

    def close(self) -> None:
        pass


def deductions(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """log: product_id, us, seq, inventory (product rows) or quantity (order rows): two streams joined by their union."""
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return log.groupBy("product_id").transformWithStateInPandas(DeductionProcessor(ttl_ms), "product_id string, us bigint, seq bigint, previous bigint, current bigint, event_type string, sufficient boolean", "Append", mode)


class CartProcessor(StatefulProcessor):
    """Chat messages with their key's cart at their time, from events that came before (chat.basket_context as a stream).

    Rows have src 0 (events) or 1 (messages). An add raises the count and the value by the product's first price; a
    removal takes the product's rows out again; a completing event empties the cart.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "product_id string", "n int, price double", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, out = pd.concat(list(rows)).sort_values(["us", "src", "id"]), []
        items = {k[0]: list(v) for k, v in self.items.iterator()}
        for r in pdf.itertuples():
            if r.src == 1:
                out.append((key[0], r.id, sum(n for n, _ in items.values()), float(sum(n * p for n, p in items.values())), len(items)))
            elif r.event_type == "ADD_TO_CART":
                items.setdefault(r.product_id, [0, float(r.value)])[0] += 1
            elif r.event_type == "REMOVE_FROM_CART":
                items.pop(r.product_id, None)
            elif r.event_type == "ORDER_PLACED":
                items.clear()
        self.items.clear()
        for k, (n, price) in items.items():
            self.items.updateValue((k,), (n, price))
        yield pd.DataFrame(out, columns=["key", "msg_id", "item_count", "total_value", "products"])

    def close(self) -> None:
        pass


def cart_context(messages: DataFrame, events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """messages: key, us, msg_id. events: key, us, event_id, event_type, product_id, value. Carts idle for ttl_ms (processing time) are forgotten."""
    tag = messages.select("key", "us", F.lit(1).alias("src"), F.col("msg_id").cast("long").alias("id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("string").alias("product_id"), F.lit(None).cast("double").alias("value"))
    both = tag.unionByName(events.select("key", "us", F.lit(0).alias("src"), F.col("event_id").cast("long").alias("id"), "event_type", "product_id", "value"))
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return both.groupBy("key").transformWithStateInPandas(CartProcessor(ttl_ms), "key string, msg_id bigint, item_count bigint, total_value double, products bigint", "Append", mode)


def late_split(batch: DataFrame, ts: str, seen_max_us: int, allowed_us: int) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a micro-batch against the greatest event time of earlier ones; for use in foreachBatch."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return batch.filter(at >= seen_max_us - allowed_us), batch.filter(at < seen_max_us - allowed_us)
