"""Event patterns over the events of a key: one automaton, run on sorted tables and, by event time, on streams.

A pattern is a chain of steps; each step has a name, a condition and how it follows the one before:

* next: the very next event must match; followed_by: the first later event that matches is taken; followed_by_any: any later
  event that matches, so that one partial match may give several;
* not_next(c): the event right after the step before must not satisfy c; not_followed_by(c): no event before the following step may.
  At the end of a pattern not_followed_by holds until the limit has passed, so such a pattern needs one;
* times(n, m), one_or_more(), optional(); inside a loop events follow as by followed_by, or strictly (consecutive()), or in any
  combination (combinations()); greedy(): an event that the loop can take is not passed over for the following step;
* a step may itself be a pattern (a group), which repeats as a whole;
* within(us): the last event comes less than so much after the first.

Conditions are SQL over the events' columns, so Catalyst evaluates them before any Python; or_() adds an
alternative. A step may also have an iterative condition, a function of (event, events taken so far by step name).

Skip strategies say what a match forbids: 'none' nothing; 'to_next' other matches from the same first event; 'past_last' matches that
begin at or before its last event; ('to_first', name) and ('to_last', name) matches that begin before that step's first or last event.
Matches that one event completes are taken in order of their first event, then of their events.

Partial matches share what they have in common: a taken event is a cell with a link to the cell before, and a cell goes
when no partial match leads to it. Past the limit a partial match that had not completed leaves as kind 'timeout'. So what is kept of a key is
bounded by what can happen within the limit.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, run_ordered

NEXT, FOLLOWED, ANY = "next", "followed_by", "followed_by_any"
START, END = -1, -2


@dataclass(frozen=True)
class Step:
    name: str
    where: str | None = None  # SQL; None for a group
    how: str = FOLLOWED
    group: Pattern | None = None
    check: Callable | None = None
    least: int = 1
    most: int | None = 1
    inner: str = FOLLOWED
    is_greedy: bool = False
    nots: tuple[tuple[str, str], ...] = ()  # (next or followed_by, SQL) between the step before and this one


@dataclass(frozen=True)
class Pattern:
    steps: tuple[Step, ...]
    limit: int | None = None
    skip: str | tuple[str, str] = "none"
    trailing: tuple[tuple[str, str], ...] = ()

    @classmethod
    def begin(cls, name: str, where: str | Pattern, check: Callable | None = None, skip: str | tuple[str, str] = "none") -> Pattern:
        return cls((), None, skip)._step(name, where, ANY, check)

    def _step(self, name, where, how, check=None) -> Pattern:
        group = where if isinstance(where, Pattern) else None
        step = Step(name, None if group else where, how, group, check, nots=self.trailing)
        return replace(self, steps=(*self.steps, step), trailing=())

    def next(self, name: str, where: str | Pattern, check: Callable | None = None) -> Pattern:
        return self._step(name, where, NEXT, check)

    def followed_by(self, name: str, where: str | Pattern, check: Callable | None = None) -> Pattern:
        return self._step(name, where, FOLLOWED, check)

    def followed_by_any(self, name: str, where: str | Pattern, check: Callable | None = None) -> Pattern:
        return self._step(name, where, ANY, check)

    def not_next(self, where: str) -> Pattern:
        return replace(self, trailing=(*self.trailing, (NEXT, where)))

    def not_followed_by(self, where: str) -> Pattern:
        return replace(self, trailing=(*self.trailing, (FOLLOWED, where)))

    def _last(self, **how) -> Pattern:
        return replace(self, steps=(*self.steps[:-1], replace(self.steps[-1], **how)))

    def or_(self, where: str) -> Pattern:
        return self._last(where=f"({self.steps[-1].where}) OR ({where})")

    def times(self, least: int, most: int | None = 0) -> Pattern:
        """most: None for no end; left out, exactly `least` times."""
        return self._last(least=least, most=least if most == 0 else most)

    def times_or_more(self, least: int) -> Pattern:
        return self._last(least=least, most=None)

    def one_or_more(self) -> Pattern:
        return self.times_or_more(1)

    def optional(self) -> Pattern:
        return self._last(least=0)

    def consecutive(self) -> Pattern:
        return self._last(inner=NEXT)

    def combinations(self) -> Pattern:
        return self._last(inner=ANY)

    def greedy(self) -> Pattern:
        return self._last(is_greedy=True)

    def within(self, us: int) -> Pattern:
        return replace(self, limit=us)


@dataclass
class Edge:
    to: int
    how: str
    nots: tuple[tuple[str, int], ...]
    loop: bool = False


@dataclass
class Graph:
    """The automaton: for each node its step, condition and edges; conditions are numbered."""

    names: list[str] = field(default_factory=list)
    tests: list[int] = field(default_factory=list)
    checks: list[Callable | None] = field(default_factory=list)
    greedy: list[bool] = field(default_factory=list)
    edges: dict[int, list[Edge]] = field(default_factory=lambda: {START: []})
    conditions: list[str] = field(default_factory=list)
    accepting: set[int] = field(default_factory=set)

    def condition(self, sql: str) -> int:
        if sql not in self.conditions:
            self.conditions.append(sql)
        return self.conditions.index(sql)

    def node(self, step: Step) -> int:
        self.names.append(step.name)
        self.tests.append(self.condition(step.where))
        self.checks.append(step.check)
        self.greedy.append(step.is_greedy)
        self.edges[len(self.names) - 1] = []
        return len(self.names) - 1

    def link(self, exits: list[tuple[int, tuple]], entries: list[int], how: str, nots: tuple = (), loop: bool = False) -> None:
        for u, held in exits:
            for v in entries:
                self.edges[u].append(Edge(v, how, (*held, *nots), loop))

    def once(self, step: Step) -> tuple[list[int], list[int]]:
        """(entries, exits) of one pass of a step."""
        if step.group is None:
            v = self.node(step)
            return [v], [v]
        hook = len(self.edges) + 1_000_000  # stands for what comes before the group
        self.edges[hook] = []
        exits = self.chain(step.group, [(hook, ())])
        if any(u == hook for u, _ in exits) or any(e.nots for e in self.edges[hook]):
            raise ValueError("a group must take an event, and cannot begin with a not")
        return [e.to for e in self.edges.pop(hook)], [u for u, _ in exits]

    def chain(self, pattern: Pattern, exits: list[tuple[int, tuple]]) -> list[tuple[int, tuple]]:
        for step in pattern.steps:
            nots = tuple((kind, self.condition(sql)) for kind, sql in step.nots)
            copies, first = max(step.least, step.most or 1, 1), None
            after, before = [], exits
            for i in range(copies):
                entries, ends = self.once(step)
                if i == 0:
                    self.link(exits, entries, step.how, nots)
                else:
                    self.link(before, entries, step.inner, loop=True)
                before = [(u, ()) for u in ends]
                if i + 1 >= step.least:
                    after += before
                first = first or entries
            if step.most is None:
                self.link(before, entries, step.inner, loop=True)
            # A step that may be left out hands on what came before it, with the nots that lie in between.
            exits = after + ([(u, (*held, *nots)) for u, held in exits] if step.least == 0 else [])
        return exits


def compiled(pattern: Pattern) -> Graph:
    g = Graph()
    exits = g.chain(pattern, [(START, ())])
    trailing = tuple((kind, g.condition(sql)) for kind, sql in pattern.trailing)
    if trailing and (pattern.limit is None or any(kind == NEXT for kind, _ in trailing)):
        raise ValueError("a pattern may end in not_followed_by with a limit only")
    for u, held in exits:
        if u == START:
            raise ValueError("a pattern must take an event")
        if held or trailing:
            g.edges[u].append(Edge(END, ANY, (*held, *trailing)))
        else:
            g.accepting.add(u)
    return g


@dataclass
class Run:
    """A partial match: its node, the edges that are still open, whether no event has come since, its first event and last cell."""

    node: int
    open: int
    fresh: bool
    first_us: int
    first_no: int
    cell: int


class Matcher:
    """The partial matches of one key. Events come in order as (us, id, bits of the conditions, values for iterative conditions)."""

    def __init__(self, pattern: Pattern, graph: Graph | None = None):
        self.pattern, self.graph = pattern, graph or compiled(pattern)
        self.runs: list[Run] = []
        self.cells: dict[int, list] = {}  # cell -> [cell before or -1, node, number, us, id, values, links to it]
        self.count = self.made = 0
        self.floor = -1  # matches that begin before this event are skipped
        self.barred: set[int] = set()  # first events that have had their match (to_next)

    # -- cells --

    def _cell(self, before: int, node: int, no: int, us: int, ident: str, values) -> int:
        self.made += 1
        self.cells[self.made] = [before, node, no, us, ident, values, 0]
        if before >= 0:
            self.cells[before][6] += 1
        return self.made

    def _hold(self, cell: int) -> None:
        self.cells[cell][6] += 1

    def _drop(self, cell: int) -> None:
        while cell >= 0:
            self.cells[cell][6] -= 1
            if self.cells[cell][6] > 0:
                return
            cell = self.cells.pop(cell)[0]

    def path(self, cell: int) -> list[list]:
        out = []
        while cell >= 0:
            out.append(self.cells[cell])
            cell = self.cells[cell][0]
        return out[::-1]

    def _bindings(self, cell: int) -> dict[str, list]:
        out: dict[str, list] = {}
        for c in self.path(cell):
            out.setdefault(self.graph.names[c[1]], []).append(c[5])
        return out

    # -- events --

    def _row(self, kind: str, cell: int) -> tuple[str, int, int, str, str]:
        path = self.path(cell)
        return kind, path[0][3], path[-1][3], ",".join(self.graph.names[c[1]] for c in path), ",".join(c[4] for c in path)

    def expire(self, now_us: int) -> list[tuple]:
        """What leaves because the limit has passed at now_us: timeouts, and matches that only waited for nothing to come."""
        if self.pattern.limit is None:
            return []
        out, stay, due = [], [], []
        for run in self.runs:
            if now_us - run.first_us < self.pattern.limit:
                stay.append(run)
            else:
                due.append(run)
        self.runs = stay
        waits = lambda run: any(e.to == END and run.open >> i & 1 for i, e in enumerate(self.graph.edges[run.node]))
        done = [run for run in due if waits(run)]
        out += [self._row("timeout", run.cell) for run in due if not waits(run) and run.node not in self.graph.accepting]
        out += self._settle(done)
        for run in due:
            self._drop(run.cell)
        return out

    def _skipped(self, first_no: int) -> bool:
        return first_no < self.floor or first_no in self.barred

    def _settle(self, done: list[Run]) -> list[tuple]:
        """Completed matches that no other one forbids, and what they forbid."""
        out = []
        for run in sorted(done, key=lambda r: [c[2] for c in self.path(r.cell)]):
            if self._skipped(run.first_no):
                continue
            out.append(self._row("match", run.cell))
            skip, path = self.pattern.skip, self.path(run.cell)
            if skip == "to_next":
                self.barred.add(run.first_no)
            elif skip == "past_last":
                self.floor = max(self.floor, path[-1][2] + 1)
            elif isinstance(skip, tuple):
                named = [c[2] for c in path if self.graph.names[c[1]] == skip[1]]
                if named:
                    self.floor = max(self.floor, named[0 if skip[0] == "to_first" else -1])
        if out and self.pattern.skip != "none":
            stay = [r for r in self.runs if not self._skipped(r.first_no)]
            for run in self.runs:
                if self._skipped(run.first_no):
                    self._drop(run.cell)
            self.runs = stay
        firsts = {r.first_no for r in self.runs}
        self.barred &= firsts
        return out

    def event(self, us: int, ident: str, bits: int, values=None) -> list[tuple]:
        """Rows (kind, first_us, last_us, steps, ids) that the event brings."""
        out = self.expire(us)
        no, self.count = self.count, self.count + 1
        g, after, done = self.graph, [], []
        for run in [*self.runs, Run(START, (1 << len(g.edges[START])) - 1, False, us, no, -1)]:
            edges, open_ = g.edges[run.node], run.open
            bound = None

            def fits(v: int, cell=run.cell) -> bool:
                nonlocal bound
                if not bits >> g.tests[v] & 1:
                    return False
                if g.checks[v] is None:
                    return True
                if bound is None:
                    bound = self._bindings(cell)
                return bool(g.checks[v](values, bound))

            looped = run.node >= 0 and g.greedy[run.node] and any(e.loop and open_ >> i & 1 and fits(e.to) for i, e in enumerate(edges))
            for i, e in enumerate(edges):
                if not open_ >> i & 1:
                    continue
                if run.node != START and (any(bits >> c & 1 and (kind == FOLLOWED or run.fresh) for kind, c in e.nots) or (looped and not e.loop)):
                    open_ &= ~(1 << i)
                    continue
                if e.to == END:
                    continue
                took = fits(e.to)
                if took:
                    cell = self._cell(run.cell, e.to, no, us, ident, values if self._keeps_values else None)
                    new = Run(e.to, (1 << len(g.edges[e.to])) - 1, True, run.first_us, run.first_no, cell)
                    self._hold(cell)
                    after.append(new)
                    if e.to in g.accepting:
                        done.append(new)
                if run.node != START and (e.how == NEXT or (e.how == FOLLOWED and took)):
                    open_ &= ~(1 << i)
            if run.node != START:
                if open_:
                    after.append(replace(run, open=open_, fresh=False))
                else:
                    self._drop(run.cell)
        self.runs = after
        out += self._settle(done)
        stay = []
        for run in self.runs:
            if g.edges[run.node]:
                stay.append(run)
            else:
                self._drop(run.cell)
        self.runs = stay
        if not self.runs:
            self.cells = {}
        return out

    @property
    def _keeps_values(self) -> bool:
        return any(c is not None for c in self.graph.checks)

    # -- state between batches --

    def dump(self) -> str:
        return json.dumps([[[r.node, r.open, r.fresh, r.first_us, r.first_no, r.cell] for r in self.runs], list(self.cells.items()), self.count, self.made, self.floor, sorted(self.barred)])

    def load(self, text: str) -> Matcher:
        runs, cells, self.count, self.made, self.floor, barred = json.loads(text)
        self.runs, self.cells, self.barred = [Run(*r) for r in runs], {int(k): c for k, c in cells}, set(barred)
        return self


# -- Spark --------------------------------------------------------------------------------------

COLUMNS = ["kind", "first_us", "last_us", "steps", "ids"]


def _judged(events: DataFrame, graph: Graph, key: str, order: tuple[str, str], values: list[str], *more: str) -> DataFrame:
    """key, us, place and id of events with the bits of their conditions, evaluated here, and their values as JSON."""
    bits = F.lit(0).cast("long")
    for i, sql in enumerate(graph.conditions):
        bits = bits.bitwiseOR(F.when(F.coalesce(F.expr(sql), F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    text = F.to_json(F.struct(*values)) if values else F.lit(None).cast("string")
    return events.select(F.col(key).cast("string").alias(key), F.col(order[0]).cast("long").alias("__us"), F.col(order[1]).cast("long").alias("__place"), bits.alias("__bits"), text.alias("__values"), *more)


def find(events: DataFrame, pattern: Pattern, key: str = "session_id", order: tuple[str, str] = ("us", "event_id"), values: list[str] | None = None, horizon_us: int | None = None) -> DataFrame:
    """Rows (key, kind, first_us, last_us, steps, ids) of a table of events.

    values: columns that iterative conditions read. Keys are dealt by hash and sorted, and a task holds the partial matches of one
    key at a time. horizon_us: a time up to which nothing more came, for what waits for the limit to pass.
    """
    graph, own = compiled(pattern), values or []
    rows = _judged(events, graph, key, order, own).repartition(key).sortWithinPartitions(key, "__us", "__place")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, now, begun = Matcher(pattern, graph), None, False
        for pdf in parts:
            out = []
            for k, us, ident, bits, text in pdf.itertuples(index=False):
                if not begun or k != now:
                    if begun and horizon_us is not None:
                        out += [(now, *r) for r in matcher.expire(horizon_us)]
                    matcher, now, begun = Matcher(pattern, graph), k, True
                out += [(k, *r) for r in matcher.event(int(us), str(ident), int(bits), json.loads(text) if own else None)]
            yield pd.DataFrame(out, columns=[key, *COLUMNS])
        if begun and horizon_us is not None:
            yield pd.DataFrame([(now, *r) for r in matcher.expire(horizon_us)], columns=[key, *COLUMNS])

    return rows.mapInPandas(run, f"`{key}` string, kind string, first_us bigint, last_us bigint, steps string, ids string")


class PatternProcessor(Ordered):
    """The automaton by event time."""

    columns = COLUMNS

    def __init__(self, pattern: Pattern, graph: Graph, key: str, reads: bool):
        super().__init__(key)
        self.pattern, self.graph, self.reads = pattern, graph, reads

    def load(self, text: str | None) -> Matcher:
        matcher = Matcher(self.pattern, self.graph)
        return matcher.load(text) if text else matcher

    def save(self, matcher: Matcher) -> str | None:
        return matcher.dump() if matcher.runs or matcher.floor >= 0 else None

    def event(self, matcher: Matcher, us: int, place: int, row: list) -> list[tuple]:
        return matcher.event(us, str(place), row[0], json.loads(row[1]) if self.reads else None)

    def passed(self, matcher: Matcher, now_us: int) -> list[tuple]:
        return matcher.expire(now_us)

    def due(self, matcher: Matcher) -> int | None:
        return min(r.first_us for r in matcher.runs) + self.pattern.limit if matcher.runs and self.pattern.limit is not None else None


def stream(events: DataFrame, pattern: Pattern, late: str = "5 seconds", key: str = "session_id", order: tuple[str, str] = ("us", "event_id"), ts: str = "ts", values: list[str] | None = None) -> DataFrame:
    """find() on a stream: an event is taken when the watermark has passed it; timers let limits end without further events."""
    graph, own = compiled(pattern), values or []
    rows = _judged(events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late), graph, key, order, own, "__ts")
    schema = f"`{key}` string, kind string, first_us bigint, last_us bigint, steps string, ids string"
    return run_ordered(rows, PatternProcessor(pattern, graph, key, bool(own)), schema)
