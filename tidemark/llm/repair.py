"""Conversation structure repair: the cheapest edits that make a conversation's roles read `(s?(ua)+)?`.

Rows of a conversation are taken by turn (nulls first; rows of one turn by role and text). Keep costs 0, Rerole to user or
assistant 2, Delete 3 (the only edit for blank rows and duplicates), Insert of an empty user or assistant text 2; each
undeleted truncated row adds 1. Among cheapest edit lists the ASCII-least one is taken (D < I < K < R).

Search. A node is (rows consumed, role state): nothing yet, after s, after u, after a. A depth-first branch-and-bound with an
explicit stack visits letters in ASCII order. Suffix lower bounds come from the relaxation that forgets letters; a prefix
leaves when its cost and the bound exceed the incumbent (cost, audit), or when its node's dominance table has a
prefix that is no worse. (Two prefixes of equal cost at a node never extend one another, as both have consumed the same rows and
each Insert costs, so the lesser one stays the lesser whatever follows.)

Spark. Rows are dealt by range over (conversation, turn, role, text) and sorted, so a conversation of any size is spread over
tasks and no task holds more than a piece of PIECE_ROWS rows or PIECE_BYTES. Conversations that lie within a task are
solved there. Others leave pieces: for each pair of role states (before, after) the cheapest edits, with the texts; a
stream over a conversation's pieces keeps for each state the best (cost, audit) and the running SHA-256 of the repaired
text. Whether role and text were seen in an earlier row is a join with those that occur more than once.

Faults, each row's first: blank (no character beyond white space), duplicate, truncated (last such character not `.`, `!`
or `?`). Defined results: a null role or text counts as one space; a null conversation id is a conversation; a conversation
without rows has zeros, an empty audit and the digest of the empty text, given that its id is in `ids`; a role other than
user, assistant or system goes by its first character, and one without a character can only be reroled or deleted; repeated rows
are duplicates; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import light_batches, scratch

PIECE_ROWS = 2048
PIECE_BYTES = 4 << 20
WHITE = " \t\n\x0b\x0c\r"
NONE, S, U, A = range(4)
#: The state that an inserted or reroled row leads to.
NEXT = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}
FAR = 1 << 60
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Row:
    __slots__ = ("role", "text", "letter", "dead", "cut")

    def __init__(self, role: str, text: str, dead: bool, cut: bool):
        self.role, self.text, self.letter, self.dead, self.cut = role, text, role[:1], dead, cut


def kept(state: int, letter: str) -> int | None:
    """The state after keeping a row of this role initial."""
    if letter == "s":
        return S if state == NONE else None
    if letter == "u":
        return U if state != U else None
    return A if letter == "a" and state == U else None


def moves(row: Row | None, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows consumed, next state, cost) in ASCII order; without a row only Insert is left."""
    out = [("I", 0, NEXT[state], 2)]
    if row is not None:
        out.insert(0, ("D", 1, state, 3))
        if not row.dead:
            if (to := kept(state, row.letter)) is not None:
                out.append(("K", 1, to, int(row.cut)))
            out.append(("R", 1, NEXT[state], 2 + row.cut))
    return out


def bounds(rows: list[Row], goals: tuple[int, ...], tail: bool) -> list[list[int]]:
    """Least cost from each (rows consumed, state) to a goal; tail: rows may be inserted after the last one."""
    end = [0 if s in goals else FAR for s in range(4)]
    if tail:
        for s in (U, S, NONE):  # in this order each looks at one that is settled
            end[s] = min(end[s], 2 + end[NEXT[s]])
    out = [end]
    for row in reversed(rows):
        after = out[-1]
        here = [min(c + after[to] for x, step, to, c in moves(row, s) if step) for s in range(4)]
        for _ in range(2):  # no more than two inserts lead anywhere new
            here = [min(here[s], 2 + here[NEXT[s]]) for s in range(4)]
        out.append(here)
    out.reverse()
    return out


def search(rows: list[Row], entry: int, goals: tuple[int, ...], tail: bool) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from `entry` to one of `goals`, the ASCII-least among equals; None if there are none."""
    low = bounds(rows, goals, tail)
    n = len(rows)
    best: tuple[int, str] | None = None
    table: list[dict[int, int]] = [{} for _ in range(n + 1)]  # rows consumed -> state -> cost of the prefix that dominates
    path: list[str] = []
    stack = [(0, entry, 0, 0, "")]  # rows consumed, state, cost, depth, letter
    while stack:
        i, state, cost, depth, letter = stack.pop()
        if cost + low[i][state] >= FAR or (best is not None and cost + low[i][state] >= best[0]):
            # A later prefix is the ASCII-greater one, so it would have to be cheaper than the incumbent.
            continue
        if table[i].get(state, FAR) <= cost:
            continue
        table[i][state] = cost
        del path[max(depth - 1, 0) :]
        if letter:
            path.append(letter)
        if i == n and state in goals:
            best = (cost, "".join(path))
            continue
        ways = moves(rows[i] if i < n else None, state) if i < n or tail else []
        # Only what the bound leaves open towards the least total of this node is pushed; the least letter is popped first.
        stack += [(i + step, to, cost + c, depth + 1, x) for x, step, to, c in reversed(ways) if c + low[i + step][to] <= low[i][state]]
    return best


def lines(rows: list[Row], entry: int, audit: str):
    """The repaired rows that an audit gives, as (role, text)."""
    at, state = 0, entry
    for x in audit:
        if x == "I":
            state = NEXT[state]
            yield ROLE[state], ""
            continue
        row, at = rows[at], at + 1
        if x == "K":
            state = kept(state, row.letter)
            yield row.role, row.text
        elif x == "R":
            state = NEXT[state]
            yield ROLE[state], row.text


def state_after(rows: list[Row], entry: int, audit: str) -> int:
    at, state = 0, entry
    for x in audit:
        if x != "I":
            at += 1
        state = state if x == "D" else kept(state, rows[at - 1].letter) if x == "K" else NEXT[state]
    return state


def feed(digest, rows: list[Row], entry: int, audit: str) -> None:
    """Update a running digest with the repaired lines; in any state but the first a line went before."""
    before = entry != NONE
    for role, text in lines(rows, entry, audit):
        digest.update(f"{chr(10) if before else ''}{role}:{text}".encode())
        before = True


class Stats:
    """Counts of consecutive rows; two of them add up."""

    def __init__(self):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # turns
        self.head = self.foot = None  # role initials

    def row(self, turn: int | None, letter: str, blank: bool, duplicate: bool, cut: bool) -> None:
        one = Stats()
        one.n, one.blank, one.duplicate, one.truncated = 1, int(blank), int(duplicate), int(cut)
        one.head = one.foot = letter
        if turn is not None:
            one.first = one.last = turn
            one.turns = 1
        self.add(one)

    def add(self, o: Stats) -> None:
        if not o.n:
            return
        if self.n:
            self.illegal += self.foot + o.head not in ("su", "ua", "au")
        else:
            self.head = o.head
        self.foot = o.foot
        if o.first is not None:
            self.turns += o.turns - (self.last == o.first)
            self.first = o.first if self.first is None else self.first
            self.last = o.last
        self.n, self.blank, self.duplicate = self.n + o.n, self.blank + o.blank, self.duplicate + o.duplicate
        self.truncated, self.illegal = self.truncated + o.truncated, self.illegal + o.illegal

    def packed(self) -> list:
        return [self.n, self.blank, self.duplicate, self.truncated, self.illegal, self.turns]

    @classmethod
    def unpacked(cls, n, first, last, head, foot) -> Stats:
        s = cls()
        s.n, s.blank, s.duplicate, s.truncated, s.illegal, s.turns = n
        s.first, s.last, s.head, s.foot = first, last, head, foot
        return s

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


class Piece:
    """Consecutive rows of one conversation."""

    def __init__(self):
        self.rows: list[Row] = []
        self.stats, self.size = Stats(), 0

    def add(self, row: Row, turn, blank: bool, duplicate: bool, cut: bool) -> None:
        self.rows.append(row)
        self.stats.row(turn, row.letter, blank, duplicate, cut)
        self.size += len(row.text)

    @property
    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.size >= PIECE_BYTES


class Fold:
    """The pieces of one conversation in order: for each state the best (cost, audit) so far and its running digest."""

    def __init__(self):
        self.stats = Stats()
        self.at = {NONE: (0, "", hashlib.sha256())}

    def add(self, piece: Piece) -> None:
        self.stats.add(piece.stats)
        after = {}
        for to in range(4):
            best = None
            for entry, (cost, audit, _) in self.at.items():
                if got := search(piece.rows, entry, (to,), False):
                    found = (cost + got[0], audit + got[1], entry, got[1])
                    best = found if best is None or found[:2] < best[:2] else best
            if best:
                digest = self.at[best[2]][2].copy()
                feed(digest, piece.rows, best[2], best[3])
                after[to] = (*best[:2], digest)
        self.at = after

    def result(self) -> list:
        best = None
        for entry, (cost, audit, digest) in self.at.items():
            got = search([], entry, (NONE, A), True)
            if got and (best is None or (cost + got[0], audit + got[1]) < best[:2]):
                digest = digest.copy()
                feed(digest, [], entry, got[1])
                best = (cost + got[0], audit + got[1], digest)
        return _result(self.stats, best[0], best[1], best[2])


def _result(stats: Stats, cost: int, audit: str, digest) -> list:
    return [stats.gaps(), stats.blank, stats.duplicate, stats.truncated, stats.illegal, cost, audit, digest.hexdigest()]


def whole(piece: Piece) -> list:
    """The result of a conversation that is one piece."""
    cost, audit = search(piece.rows, NONE, (NONE, A), True)
    digest = hashlib.sha256()
    feed(digest, piece.rows, NONE, audit)
    return _result(piece.stats, cost, audit, digest)


# -- Spark --------------------------------------------------------------------------------------

_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_PIECE = "counts array<bigint>, first bigint, last bigint, head string, foot string, roles array<string>, texts array<string>, dead array<boolean>, cut array<boolean>"


def flagged(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text, all but conv and turn without nulls) with `blank`, `cut` and `again`: role and text are in an earlier turn."""
    bare = F.rtrim("text", F.lit(WHITE))
    rows = rows.withColumn("blank", bare == "").withColumn("cut", ~F.right(bare, F.lit(1)).isin(".", "!", "?")).withColumn("__digest", F.md5("text"))
    # Only role and text that occur in several rows of a conversation can be duplicates: their first turn, nulls before all others.
    of = ["conv", "role", "__digest"]
    often = rows.groupBy(*of).agg(F.count("*").alias("__n"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("__first")).filter("__n > 1")
    often = often.select(*(F.col(c).alias(f"__{c}") for c in of), F.col("__first.turn").alias("__turn"))
    meet = F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("__digest") == F.col("____digest"))
    # Equal turns are settled where the rows are sorted; a null turn is never after another.
    again = F.col("__role").isNotNull() & F.col("turn").isNotNull() & (F.col("__turn").isNull() | (F.col("__turn") < F.col("turn")))
    return rows.join(often, meet, "left").select("conv", "turn", "role", "text", "blank", "cut", again.alias("again"))


def pieces_of(batches, emit):
    """Runs over sorted rows; emit(conv, piece, number, open) for each piece; open: others of its conversation may be elsewhere."""
    conv, piece, number, first, seen, before = None, None, 0, True, False, None
    for batch in batches:
        cols = batch.to_pydict()
        for c, turn, role, text, blank, cut, again in zip(*(cols[k] for k in ("conv", "turn", "role", "text", "blank", "cut", "again")), strict=True):
            if not seen or c != conv:
                if piece is not None:
                    yield from emit(conv, piece, number, first or number > 0)
                    first = False
                conv, piece, number, seen, before = c, Piece(), 0, True, None
            elif piece.full:
                yield from emit(conv, piece, number, True)
                piece, number = Piece(), number + 1
            duplicate = not blank and (again or before == (turn, role, text))
            before = (turn, role, text)
            cut_ = cut and not blank and not duplicate
            piece.add(Row(role, text, blank or duplicate, cut_), turn, blank, duplicate, cut_)
    if piece is not None:
        yield from emit(conv, piece, number, True)


def repair(rows: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of rows, and of `ids` (one column) too."""
    id_type = rows.schema[conv].dataType.simpleString()
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"))
    order = ["conv", "turn", "role", "text"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = flagged(own).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def first(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def emit(c, piece, number, open_):
            done = None if open_ else whole(piece)
            s = piece.stats
            rest = [s.packed(), s.first, s.last, s.head, s.foot, [r.role for r in piece.rows], [r.text for r in piece.rows], [r.dead for r in piece.rows], [r.cut for r in piece.rows]]
            yield [c, part, number, open_, *(done or [None] * 8), *(rest if open_ else [None] * 9)]

        out, size = [], 0
        for row in pieces_of(batches, emit):
            out.append(row)
            size += sum(map(len, row[-3] or ()))
            if len(out) >= 1024 or size >= PIECE_BYTES:
                yield _batch(out, of_pieces)
                out, size = [], 0
        if out:
            yield _batch(out, of_pieces)

    schema = f"conv {id_type}, part int, number int, open boolean, {_RESULT}, {_PIECE}"
    of_pieces = _arrow(schema)
    made = scratch(dealt.mapInArrow(first, schema), "repair-pieces")
    names = [x.split()[0] for x in _RESULT.split(", ")]
    done = made.filter("NOT open").select("conv", *names)

    def fold(batches):
        conv_, state, began = None, None, False
        for batch in batches:
            for i in range(len(batch)):
                r = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
                if not began or r["conv"] != conv_:
                    if began:
                        yield _batch([[conv_, *state.result()]], of_joined)
                    conv_, state, began = r["conv"], Fold(), True
                piece = Piece()
                piece.rows = [Row(*x) for x in zip(r["roles"], r["texts"], r["dead"], r["cut"], strict=True)]
                piece.stats = Stats.unpacked(r["counts"], r["first"], r["last"], r["head"], r["foot"])
                state.add(piece)
        if began:
            yield _batch([[conv_, *state.result()]], of_joined)

    joined_schema = f"conv {id_type}, {_RESULT}"
    of_joined = _arrow(joined_schema)
    open_rows = made.filter("open").select("conv", "part", "number", *(x.split()[0] for x in _PIECE.split(", ")))
    with light_batches(rows.sparkSession):
        joined = scratch(open_rows.repartition("conv").sortWithinPartitions("conv", "part", "number").mapInArrow(fold, joined_schema), "repair-folded")
    out = done.unionByName(joined)
    if ids is None:
        return out.withColumnRenamed("conv", conv)
    every = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    zero, none = F.lit(0).cast("long"), F.lit(hashlib.sha256().hexdigest())
    filled = [F.coalesce(F.col(c), F.lit("") if c == "audit" else none if c == "repaired_sha256" else zero).alias(c) for c in names]
    return every.join(out, F.col("__id").eqNullSafe(F.col("conv")), "left").select(F.col("__id").alias(conv), *filled)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults by crc32 of `conv:turn` modulo 20: 0 dropped, 1 emptied, 2 without `.!?`, 3 repeated, 4 of role user; nulls are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")), F.lit(20))
    own = rows.select(F.col(conv).alias(conv), F.col(turn).alias(turn), spaced(role).alias(role), spaced(text).alias(text), fault.alias("__fault")).filter("__fault <> 0")
    own = own.withColumn(text, F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text)))
    own = own.withColumn(role, F.when(F.col("__fault") == 4, "user").otherwise(F.col(role)))
    return own.withColumn("__copy", F.explode(F.when(F.col("__fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("__fault", "__copy")


def op13_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows), rows.select("conv_id"))


def _oracle() -> str:
    """The same by dynamic programming in SQL: for each state the least (cost, audit, text), row by row."""
    white = " || ".join(f"chr({ord(c)})" for c in WHITE)
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"

    def step(state: str, cost: str, letter: str, line: str | None) -> str:
        text = f"{state}.t" if line is None else f"{state}.t || {line}" if state == "n" else f"{state}.t || chr(10) || {line}"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def only(test: str, way: str) -> str:
        return f"CASE WHEN {test} THEN {way} END"

    pair = "'user:' || chr(10) || 'assistant:'"
    insert = f"n, s, {least('u', *(step(x, '2', 'I', chr(39) + 'user:' + chr(39)) for x in 'nsa'))} AS u, {least('a', step('u', '2', 'I', chr(39) + 'assistant:' + chr(39)), step('n', '4', 'II', pair), step('s', '4', 'II', pair))} AS a"
    keep = lambda x, letter: only(f"NOT dead AND letter = '{letter}'", step(x, "cut", "K", "role || ':' || text"))
    rerole = lambda x, name: only("NOT dead", step(x, "2 + cut", "R", f"'{name}:' || text"))
    drop = lambda x: step(x, "3", "D", None)
    after = f"""{drop("n")} AS n2, {least(drop("s"), keep("n", "s"))} AS s2,
        {least(drop("u"), *(keep(x, "u") for x in "nsa"), *(rerole(x, "user") for x in "nsa"))} AS u2,
        {least(drop("a"), keep("u", "a"), rerole("u", "assistant"))} AS a2"""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
f AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {bits}), 4294967295) % 20 AS fault FROM c),
h AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0),
g AS (SELECT *, rtrim(text, {white}) AS bare, left(role, 1) AS letter, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM h),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen FROM g),
j AS (SELECT *, bare = '' AS blank, bare <> '' AND seen AS duplicate, (bare <> '' AND NOT seen AND right(bare, 1) NOT IN ('.', '!', '?'))::INT AS cut, bare = '' OR seen AS dead, lag(letter) OVER (PARTITION BY conv_id ORDER BY pos) || letter AS joint FROM i),
m AS (SELECT conv_id, count(*) AS held, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, sum(cut)::BIGINT AS truncated, count(*) FILTER (joint NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 't': ''}}::{kind} AS n, NULL::{kind} AS s, NULL::{kind} AS u, NULL::{kind} AS a FROM m
  UNION ALL
  SELECT conv_id, i + 1, n2::{kind}, s2::{kind}, u2::{kind}, a2::{kind} FROM (SELECT *, {after} FROM (SELECT x.conv_id, i, j.role, j.text, j.letter, j.dead, j.cut, {insert} FROM dp AS x JOIN j ON j.conv_id IS NOT DISTINCT FROM x.conv_id AND j.pos = x.i + 1))),
e AS (SELECT conv_id, least_.c AS cost, least_.a AS audit, sha256(least_.t) AS repaired_sha256 FROM (SELECT conv_id, list_min([n, a]) AS least_ FROM (SELECT dp.conv_id, {insert} FROM dp JOIN m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.held = dp.i))),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM o LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE = _oracle()
