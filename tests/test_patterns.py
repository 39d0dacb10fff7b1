"""Event patterns against plain enumeration on random streams; streams against tables; bounded state."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import patterns
from tidemark.streaming.patterns import ANY, FOLLOWED, NEXT, Pattern


def of(kind):
    return f"kind = '{kind}'"


def fits(sql, kind):
    return any(p.strip(" ()").split("'")[1] == kind for p in sql.split(" OR "))


def units(pattern):
    """Every way to write the pattern without loops, options and groups: lists of (name, where, check, edge, nots, greedy exits)."""
    def step(s, depth):
        """Sequences of units for one step, each with how its units hang together."""
        top = s.most if s.most is not None else depth
        for n in range(s.least, top + 1):
            if n == 0:
                yield []
                continue
            bodies = [[(s.name, s.where, s.check)]] if s.group is None else None
            if bodies is not None:
                yield [(s.name, s.where, s.check, None if i == 0 else s.inner, (), s if n < top or i + 1 < n else None) for i in range(n)]
            else:
                def nest(i):
                    if i == 0:
                        yield []
                        return
                    for head in nest(i - 1):
                        for body in chain(s.group, depth):
                            fixed = [(body[0][0], body[0][1], body[0][2], s.inner if head else None, (), body[0][5]), *body[1:]]
                            yield head + fixed
                yield from nest(n)

    def chain(p, depth):
        out = [([], ())]
        for s in p.steps:
            new = []
            for head, held in out:
                for body in step(s, depth):
                    if not body:
                        new.append((head, (*held, *s.nots)))
                    else:
                        first = (body[0][0], body[0][1], body[0][2], s.how, (*held, *s.nots), body[0][5])
                        new.append(([*head, first, *body[1:]], ()))
            out = new
        return [h for h, _ in out]

    return chain(pattern, 7)


def enumerated(pattern, kinds, times):
    """All matches (indexes, names) of a pattern that does not end in a not, without skips."""
    found = set()
    n = len(kinds)
    for chain in units(pattern):
        def go(u, taken):
            if u == len(chain):
                found.add((tuple(taken), tuple(c[0] for c in chain)))
                return
            name, where, check, how, nots, _ = chain[u]
            before = taken[-1] if taken else None
            loop = chain[u - 1][5] if u else None
            for j in range(0 if before is None else before + 1, n):
                if pattern.limit is not None and taken and times[j] - times[taken[0]] >= pattern.limit:
                    break
                bound = {}
                for i, t in enumerate(taken):
                    bound.setdefault(chain[i][0], []).append({"v": t})
                ok = lambda j: fits(where, kinds[j]) and (check is None or check({"v": j}, bound))  # noqa: B023, E731
                if before is not None:
                    if how == NEXT and j != before + 1:
                        break
                    if any(fits(sql, kinds[x]) for kind, sql in nots for x in (range(before + 1, j + 1) if kind == FOLLOWED else [before + 1])):
                        break
                    # A greedy loop that could take an event in between, or this one, does not pass it over.
                    if loop is not None and loop.is_greedy and chain[u][3:5] != (loop.inner, ()) and any(fits(loop.where, kinds[x]) for x in range(before + 1, j + 1)):
                        break
                    if loop is not None and loop.is_greedy and chain[u][0] != loop.name and any(fits(loop.where, kinds[x]) for x in range(before + 1, j + 1)):
                        break
                    if how == FOLLOWED and any(ok(x) for x in range(before + 1, j)):
                        break
                if ok(j):
                    go(u + 1, [*taken, j])
        go(0, [])
    return found


def skipped(pattern, matches):
    """What is left of all matches under the pattern's skip strategy."""
    out, floor, barred = set(), -1, set()
    for taken, names in sorted(matches, key=lambda m: (m[0][-1], m[0])):
        if taken[0] < floor or taken[0] in barred:
            continue
        out.add((taken, names))
        if pattern.skip == "to_next":
            barred.add(taken[0])
        elif pattern.skip == "past_last":
            floor = max(floor, taken[-1] + 1)
        elif isinstance(pattern.skip, tuple):
            at = [t for t, x in zip(taken, names) if x == pattern.skip[1]]
            if at:
                floor = max(floor, at[0 if pattern.skip[0] == "to_first" else -1])
    return out


def run(pattern, kinds, times, horizon=None):
    g = patterns.compiled(pattern)
    m = patterns.Matcher(pattern, g)
    out = []
    for i, (k, t) in enumerate(zip(kinds, times)):
        bits = sum(1 << c for c, sql in enumerate(g.conditions) if fits(sql, k))
        out += m.event(t, str(i), bits, {"v": i})
        m = patterns.Matcher(pattern, g).load(m.dump())  # as between two batches
        reached = set()
        for r in m.runs:
            reached |= {id(c) for c in m.path(r.cell)}
        assert len(reached) == len(m.cells), "a cell that nothing leads to"
        if pattern.limit is not None:
            assert all(t - r.first_us < pattern.limit for r in m.runs)
    if horizon is not None:
        out += m.expire(horizon)
    return out


def rising(event, bound):
    return all(event["v"] - x["v"] > 1 for x in bound.get("a", []))


A, B, C, D = map(of, "ABCD")
CASES = {
    "strict": Pattern.begin("a", A).next("b", B).next("c", C),
    "relaxed": Pattern.begin("a", A).followed_by("b", B).followed_by("c", C).within(6),
    "any": Pattern.begin("a", A).followed_by_any("b", B).followed_by_any("c", C).within(7),
    "not_next": Pattern.begin("a", A).not_next(B).followed_by("c", C),
    "not_between": Pattern.begin("a", A).not_followed_by(B).followed_by("c", C),
    "not_between_any": Pattern.begin("a", A).followed_by("b", B).not_followed_by(D).followed_by_any("c", C).within(8),
    "or": Pattern.begin("a", A).or_(D).next("b", B).or_(C),
    "times": Pattern.begin("a", A).times(2).followed_by("b", B),
    "times_range": Pattern.begin("a", A).times(1, 3).followed_by("b", B).within(9),
    "times_or_more": Pattern.begin("a", A).times_or_more(2).within(5),
    "consecutive": Pattern.begin("a", A).one_or_more().consecutive().next("b", B),
    "combinations": Pattern.begin("a", A).times(2, 3).combinations().followed_by("b", B).within(8),
    "optional": Pattern.begin("a", A).followed_by("b", B).optional().followed_by("c", C),
    "optional_first": Pattern.begin("a", A).optional().next("b", B),
    "optional_loop": Pattern.begin("a", A).next("b", B).times(0, 2).next("c", C),
    "not_over_option": Pattern.begin("a", A).not_next(D).next("b", B).optional().not_followed_by(A).followed_by("c", C),
    "greedy": Pattern.begin("x", D).next("a", A).one_or_more().greedy().followed_by("b", B).or_(A).within(9),
    "iterative": Pattern.begin("a", A).or_(B).times(2, 3).combinations().followed_by("c", C),
    "group": Pattern.begin("g", Pattern.begin("a", A).next("b", B)).times(2).followed_by("c", C),
    "group_range": Pattern.begin("x", D).followed_by("g", Pattern.begin("a", A).followed_by("b", B)).times(0, 2).followed_by("c", C).within(9),
    "group_more": Pattern.begin("g", Pattern.begin("a", A).followed_by_any("b", B)).one_or_more().within(6),
}
CASES["iterative"] = patterns.replace(CASES["iterative"], steps=(patterns.replace(CASES["iterative"].steps[0], check=rising), CASES["iterative"].steps[1]))
SKIPS = ["none", "to_next", "past_last", ("to_first", "b"), ("to_last", "a")]


@pytest.mark.parametrize("name", sorted(CASES))
def test_against_enumeration(name):
    rng = random.Random(name)
    some = 0
    for turn in range(400):
        n = rng.randint(1, 12)
        kinds = [rng.choice("AABBCCD") for _ in range(n)]
        times, t = [], 0
        for _ in range(n):
            t += rng.choice([0, 1, 1, 2])
            times.append(t)
        every = enumerated(CASES[name], kinds, times)
        pattern = patterns.replace(CASES[name], skip=SKIPS[turn % len(SKIPS)])
        got = [(tuple(map(int, ids.split(","))), tuple(steps.split(","))) for kind, _, _, steps, ids in run(pattern, kinds, times) if kind == "match"]
        assert len(got) == len(set(got)), (kinds, times)
        assert set(got) == skipped(pattern, every), (kinds, times, pattern.skip)
        some += len(got)
    assert some >= 5


def test_end_in_a_not_and_timeouts():
    p = Pattern.begin("a", A).not_followed_by(B).within(10)
    assert run(p, "ACB", [0, 3, 12], 100) == [("match", 0, 0, "a", "0")]
    assert run(p, "ACB", [0, 3, 9], 100) == []
    p = Pattern.begin("a", A).followed_by("b", B).within(10)
    assert run(p, "ACA", [0, 3, 12], 21) == [("timeout", 0, 0, "a", "0")]
    assert run(p, "ACA", [0, 3, 12], 22) == [("timeout", 0, 0, "a", "0"), ("timeout", 12, 12, "a", "2")]
    for bad in (Pattern.begin("a", A).not_followed_by(B), Pattern.begin("a", A).not_next(B).within(5), Pattern.begin("a", A).optional()):
        with pytest.raises(ValueError):
            patterns.compiled(bad)


def test_state_is_bounded_by_the_limit():
    p = Pattern.begin("a", A).times_or_more(1).followed_by("b", B).within(20)
    g = patterns.compiled(p)
    m, most = patterns.Matcher(p, g), 0
    for i in range(3000):
        m.event(i, str(i), 1)
        most = max(most, len(m.cells))
    assert most <= 20 * 21 and len(m.runs) <= 20 * 20


def table(spark, seed=4, n=160):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 20, 40, 90])
        rows.append((f"s{rng.randint(0, 3)}", i, rng.choice("AABBCD"), t * 1_000_000, i))
    df = spark.createDataFrame(rows, "session_id string, event_id bigint, kind string, us bigint, v int")
    return df.withColumn("ts", F.timestamp_micros("us"))


@pytest.mark.parametrize("name", ["any", "times_range", "iterative", "end_in_not"])
def test_stream_equals_table(spark, tmp_path, name):
    """Batches that arrive out of order within the watermark, with state carried between them."""
    if name == "end_in_not":
        p = Pattern.begin("a", A).not_followed_by(B).within(100_000_000)
    else:
        p = CASES[name].within(300_000_000)
    df = table(spark)
    rows = df.orderBy("us", "event_id").collect()
    for k in range(0, len(rows), 40):
        part = rows[k : k + 40]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    flush = spark.createDataFrame([("flush", 10_000, "Z", 10**12, 0)], "session_id string, event_id bigint, kind string, us bigint, v int").withColumn("ts", F.timestamp_micros("us"))
    flush.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = patterns.stream(source, p, "2 hours", values=["v"]).writeStream.format("memory").queryName(f"p_{name}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = sorted(tuple(r) for r in spark.table(f"p_{name}").collect())
    want = sorted(tuple(r) for r in patterns.find(df, p, values=["v"], horizon_us=10**12 - 2 * 3600 * 10**6).collect())
    assert got == want and len({r[1] for r in got}) >= 1 and got
