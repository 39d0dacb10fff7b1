"""Session windows that late events may still change, with a channel for those that come too late.

The operator keeps a watermark of its own: the greatest event time of earlier batches less `bound`. A session fires when that watermark reaches
its end, and stays in state for `lateness` longer: an event that comes meanwhile is merged, even if it joins two sessions that have
fired, and the session is given out again with a higher revision. An event whose window, merged with what is there, ended more than the
lateness before the watermark goes to the channel 'late' unmerged.

Spark's watermark runs `keep` behind, so that Spark itself drops only what is later than that; the operator's own follows from it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import ADD, ORDER, VIEW

COLUMNS = ["kind", "start_ms", "end_ms", "revision", "events", "views", "adds", "orders", "added_value"]


class Sessions:
    """The sessions of one key: [start, end, revision, changed, events, views, adds, orders, added value] each; changed: since it last fired."""

    def __init__(self, gap: int, lateness: int, held: list[list] | None = None):
        self.gap, self.lateness, self.held = gap, lateness, held or []

    def event(self, ms: int, kind: str, value: float, now: int | None) -> list[tuple]:
        """What the event gives at once: a row 'late', or nothing."""
        one = [ms, ms + self.gap, 0, True, 1, int(kind == VIEW), int(kind == ADD), int(kind == ORDER), value if kind == ADD else 0.0]
        near = [s for s in self.held if s[0] <= one[1] and s[1] >= one[0]]
        end = max([one[1], *(s[1] for s in near)])
        if now is not None and end - 1 + self.lateness <= now:
            return [("late", one[0], one[1], 0, *one[4:])]
        for s in near:
            one = [min(one[0], s[0]), max(one[1], s[1]), max(one[2], s[2]), True, *(a + b for a, b in zip(one[4:], s[4:], strict=True))]
        self.held = sorted([*(s for s in self.held if s not in near), one])
        return []

    def fire(self, now: int | None) -> list[tuple]:
        """Sessions that the watermark has reached and that are new or changed since they fired; those past the lateness go."""
        out = []
        for s in self.held:
            if now is not None and s[1] - 1 <= now and s[3]:
                s[2], s[3] = s[2] + 1, False
                out.append(("session", *s[:3], *s[4:]))
        self.held = [s for s in self.held if now is None or s[1] - 1 + self.lateness > now]
        return out

    def due(self) -> list[int]:
        return [s[1] - 1 if s[3] else s[1] - 1 + self.lateness for s in self.held]


class LateSessionProcessor(StatefulProcessor):
    def __init__(self, gap: int, lateness: int, slack: int):
        self.gap, self.lateness, self.slack = gap, lateness, slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", "text string")

    def _now(self, timerValues) -> int | None:
        spark = timerValues.getCurrentWatermarkInMs()
        return spark + self.slack if spark > 0 else None

    def _load(self) -> Sessions:
        return Sessions(self.gap, self.lateness, json.loads(self.state.get()[0]) if self.state.exists() else None)

    def _keep(self, sessions: Sessions, key, out: list[tuple]) -> pd.DataFrame:
        if sessions.held:
            self.state.update((json.dumps(sessions.held),))
        else:
            self.state.clear()
        wanted = {max(1, min(sessions.due()) - self.slack)} if sessions.held else set()
        for t in list(self.handle.listTimers()):
            if t not in wanted:
                self.handle.deleteTimer(t)
        for t in wanted:
            self.handle.registerTimer(t)
        return pd.DataFrame([(key[0], *r) for r in out], columns=["session_id", *COLUMNS])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sessions, now = self._load(), self._now(timerValues)
        got = sorted(((int(r.ms), int(r.place), r.event_type, float(r.value or 0.0)) for pdf in rows for r in pdf.itertuples(index=False)))
        out = [x for ms, _, kind, value in got for x in sessions.event(ms, kind, value, now)]
        out += sessions.fire(now)
        yield self._keep(sessions, key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions = self._load()
        yield self._keep(sessions, key, sessions.fire(self._now(timerValues)))

    def close(self) -> None:
        pass


def late_sessions(events: DataFrame, gap_ms: int = 1_800_000, bound_ms: int = 5_000, lateness_ms: int = 300_000, keep_ms: int = 7 * 86_400_000, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """Rows (session_id, kind, start_ms, end_ms, revision, ...) of a stream of events with key, event_id, event_type, value and ts.

    kind 'session': a session as it stands, revision 1 when it first fires; 'late': an event that came after its
    session was given up. Within a batch events are taken in order of time, so its result does not depend on how the batch was read.
    """
    if keep_ms < bound_ms + lateness_ms:
        raise ValueError("keep_ms must be at least bound_ms + lateness_ms")
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", f"{keep_ms} milliseconds")
    rows = rows.select(F.col(key).cast("string").alias("session_id"), F.unix_millis("__ts").alias("ms"), F.col("event_id").cast("long").alias("place"), "event_type", F.col("value").cast("double").alias("value"), "__ts")
    schema = "session_id string, kind string, start_ms bigint, end_ms bigint, revision bigint, events bigint, views bigint, adds bigint, orders bigint, added_value double"
    return rows.groupBy("session_id").transformWithStateInPandas(LateSessionProcessor(gap_ms, lateness_ms, keep_ms - bound_ms), schema, "Append", "EventTime")
