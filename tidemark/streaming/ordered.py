"""Keyed processors that see events in order of event time, whatever the order of their arrival within the watermark.

Rows wait in state until the watermark has passed them; a timer stands for the next moment at which a key has something to do: a row
that waits, or the processor's own deadline. When that moment moves, the timer is deleted and registered anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Ordered(StatefulProcessor):
    """Subclasses give `columns` (of the result, after the key) and the functions below; a state that saves as None is cleared.

    Rows have key, __us, __place, then what event() gets as a list, then the watermark's column.
    """

    columns: list[str] = []

    def __init__(self, key: str):
        self.key = key

    def load(self, text: str | None):
        raise NotImplementedError

    def save(self, state) -> str | None:
        raise NotImplementedError

    def event(self, state, us: int, place: int, row: list) -> list[tuple]:
        raise NotImplementedError

    def passed(self, state, now_us: int) -> list[tuple]:
        """Event time has reached now_us, and no event before it is still to come."""
        return []

    def due(self, state) -> int | None:
        """The time at which passed() has something to do if nothing comes before."""
        return None

    # -- Spark's side --

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, place bigint, row string")
        self.held = handle.getValueState("held", "text string")

    def _timer(self, now_ms: int, due_us: list[int]) -> None:
        # Rounded up, and a millisecond on for rows at the very watermark.
        wanted = max(min(due_us) // 1000 + 1, now_ms + 1) if due_us else None
        for t in list(self.handle.listTimers()):
            if t != wanted and t > now_ms:
                self.handle.deleteTimer(t)
        if wanted is not None:
            self.handle.registerTimer(wanted)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r[1]), int(r[2]), json.dumps([_plain(x) for x in r[3:-1]])) for pdf in rows for r in pdf.itertuples(index=False)]
        for row in new:
            self.waiting.appendValue(row)
        state = self.load(self.held.get()[0] if self.held.exists() else None)
        due = self.due(state)
        self._timer(timerValues.getCurrentWatermarkInMs(), [min(w[0] for w in self.waiting.get()), *([due] if due is not None else [])])
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        state = self.load(self.held.get()[0] if self.held.exists() else None)
        out, later = [], []
        for us, place, row in sorted(tuple(w) for w in self.waiting.get()):
            if us < now_ms * 1000:
                out += self.event(state, us, place, json.loads(row))
            else:
                later.append((us, place, row))
        out += self.passed(state, now_ms * 1000)
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        text, due = self.save(state), self.due(state)
        if text is None:
            self.held.clear()
        else:
            self.held.update((text,))
        self._timer(now_ms, [*(w[0] for w in later[:1]), *([due] if due is not None else [])])
        yield self._rows(key, out)

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, *self.columns])

    def close(self) -> None:
        pass


def _plain(x):
    return None if x is None or (isinstance(x, float) and x != x) else x.item() if hasattr(x, "item") else x


def run_ordered(rows: DataFrame, processor: Ordered, schema: str) -> DataFrame:
    return rows.groupBy(processor.key).transformWithStateInPandas(processor, schema, "Append", "EventTime")
