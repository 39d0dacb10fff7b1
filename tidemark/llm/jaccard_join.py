"""N-gram Jaccard self-join, exact, in size-banded tiles with hashed bitmap signatures.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Two sets link when
100 * |A and B| >= 75 * |A or B|. Steps:

1. Equal sets are one node from here on.
2. Every shingle's number of sets is counted from packed rows. A set links only if three quarters of
   its shingles occur in another set; the rest leave.
3. Shingles are put in an order, frequent ones last, and a set of n keeps its first floor(n / 4) + 1: two
   sets that link share one of them. (The list of frequent shingles only chooses the order, any order is
   right; it is cut to FREQUENT entries by raising the frequency asked for.)
4. Rounds of tiles gather near copies: sets of one size band with the same least shingle, in an order by
   hash that changes with the round, meet in a tile of about TILE sets, very frequent shingles being dealt over several, with the most central set in each. In
   a tile, sets with the largest share of shingles known elsewhere go first (an original before its
   variants); each is held against the leaders so far whose size allows a link: the bits in which two
   bitmaps differ bound the overlap from above, and what passes is intersected exactly. A set joins a
   leader or becomes one; leaders alone enter the next round.
5. What the rounds could not see is settled exactly: where a shingle's sets are in more than one group so
   far, all its sets meet again in tiles, blocks of BLOCK sets of one size band against each other and
   against the next band. Bitmaps bound the pairs of different groups, and what passes is intersected.
6. Components of all links found, by stars.

Words: A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`; with fewer than five words the whole sequence is the one
shingle; a text without words, or null, is empty, linked with nothing and its own component.
Repeated rows and equal ids are separate rows of one node. A null id is larger than any other. Texts of any length
are hashed in stretches; an empty table gives no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, column, mix, part_of, parts_for, scratch, slices, utf8
from .graph import components
from .packed import SCHEMA, bundles, chunks, dealt, gathered, parcels, rows, split, steps, unbundle, unpack

GRAM = 5
NUMER, DENOM = 75, 100
BITS = 1024
TILE = 256
BLOCK = 512
ROUNDS = 3
FREQUENT = 1 << 20
FREQUENT_FROM = 64
WIDTH = 4
LAST = 2**63 - 1


def shingle_sets(texts: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sorted distinct shingle hashes of each text, one text after the other."""
    w = Words(*utf8(texts), lower=True)
    count = np.diff(w.at)
    h, text, _ = w.windows(gram)
    short = np.flatnonzero((count > 0) & (count < gram))
    if len(short):
        whole = np.zeros(len(short), U64)
        for j in range(gram - 1):
            has = count[short] > j
            whole[has] = mix(whole[has] * U64(0x9E3779B97F4A7C15) + w.hash[w.at[:-1][short[has]] + j] + U64(1))
        h, text = np.r_[h, whole], np.r_[text, short]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]
        h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(count) + 1))


def set_ids(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set."""
    size = np.diff(ends)
    total = np.r_[U64(0), np.cumsum(mix(h + U64(0x9E37)), dtype=U64)]
    other = np.r_[U64(0), np.cumsum(mix(h ^ U64(0x5DEECE66D)), dtype=U64)]
    return (mix(mix(total[ends[1:]] - total[ends[:-1]]) + (other[ends[1:]] - other[ends[:-1]]) + size.astype(U64)) >> U64(1)).astype(np.int64)


def may_link(a, b, common):
    return DENOM * common >= NUMER * (a + b - common)


def bitmap(h: np.ndarray) -> np.ndarray:
    bit = mix(h) & U64(BITS - 1)
    out = np.zeros(BITS // 64, U64)
    np.bitwise_or.at(out, (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return out


def overlap_bound(n: np.ndarray, m: int, bits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap: each differing bit needs an element that only one side has."""
    return (n + m - np.bitwise_count(bits ^ own).sum(axis=-1).astype(np.int64)) // 2


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def band(n, shift: float = 0.0):
    """Size band: sets that link are in the same or neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(4 / 3)) + shift).cast("int")


def _signatures(docs: DataFrame, names: list[str]) -> DataFrame:
    """The other columns of docs, __n (set size) and __set (name; null for the empty set)."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "__text", 1 << 20):
                h, ends = shingle_sets(column(piece, "__text"))
                n = np.diff(ends)
                yield pa.RecordBatch.from_arrays([*(column(piece, c) for c in names), pa.array(n), pa.array(set_ids(h, ends), mask=n == 0)], names=[*names, "__n", "__set"])

    kinds = dict(docs.dtypes)
    return docs.select(*names, "__text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "__n long", "__set long"]))


def _shared(docs: DataFrame) -> DataFrame:
    """Rows (__set, __n, __shared) of the sets that may link: size, and how many shingles another set has; and, with a
    null __set, (__n, __shared) = (key, number of sets) of frequent shingles."""
    parts = parts_for(docs)
    _, span = steps(parts)

    def ask(batches):
        for batch in batches:
            for piece in slices(batch, "__text", 1 << 20):
                h, ends = shingle_sets(column(piece, "__text"))
                names, n = set_ids(h, ends), np.diff(ends)
                one = np.zeros(len(n), bool)
                one[np.unique(names, return_index=True)[1]] = True
                text = np.repeat(np.arange(len(n)), n)
                keep = one[text]
                asks = list(chunks(h[keep], text[keep], parts, [names, n], None, 8 if span > 1 else WIDTH, span))
                yield rows([p for p, _ in asks], [b for _, b in asks], False)

    def answer(batches):
        raw, part = [], 0
        for batch in batches:
            raw += parcels(batch)
            if len(batch):
                part = column(batch, "__part")[0].as_py()
        h, text, per_text, _ = unpack(raw, WIDTH)
        del raw
        if not len(h):
            return
        names, first, inverse = np.unique(per_text[0], return_index=True, return_inverse=True)
        size = per_text[1][first]
        key = (h << U64(32)) | inverse[text].astype(U64)
        del h, text
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        shingle, own = key >> U64(32), (key & U64(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        sets = np.diff(np.r_[head, len(key)])
        shared = np.bincount(own[np.repeat(sets, sets) > 1], minlength=len(names))
        at = np.flatnonzero(shared)
        often = np.flatnonzero(sets >= FREQUENT_FROM)
        pairs = np.ascontiguousarray(np.stack([size[at], shared[at]], axis=1).astype("<u4")).view("<u8").reshape(-1)
        yield rows(*bundles(pairs, np.arange(len(at)), names[at], parts), True)
        often = np.stack([(part << 32) + shingle[head[often]].astype(np.int64), sets[often]], axis=1).astype("<i8")
        yield rows([part] if len(often) else [], [often.tobytes()] if len(often) else [], False)

    def total(batches):
        settled, often = split(batches)
        keys, ends, values = unbundle([x for batch in settled for x in parcels(batch)], "<u8")
        pairs = values.view("<u4").reshape(-1, 2).astype(np.int64)
        size = pairs[ends[:-1], 0] if len(keys) else np.zeros(0, np.int64)
        shared = np.add.reduceat(pairs[:, 1], ends[:-1]) if len(keys) else size
        may = DENOM * shared >= NUMER * size
        yield pa.RecordBatch.from_arrays([pa.array(x[may]) for x in (keys, size, shared)], names=["__set", "__n", "__shared"])
        for raw in often:
            key, n = np.frombuffer(raw, "<i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.array(key), pa.array(n)], names=["__set", "__n", "__shared"])

    asked = docs.select("__text").mapInArrow(lambda batches: gathered(ask(batches)), SCHEMA)
    answered = dealt(asked, parts, WIDTH).mapInArrow(answer, SCHEMA)
    return answered.repartitionById(parts, F.col("__part")).mapInArrow(total, "__set long, __n long, __shared long"), parts


def _frequent(counts: DataFrame) -> np.ndarray:
    """Keys of the most frequent shingles, at most FREQUENT of them."""
    rows = counts.filter("__set is null").select("__n", F.floor(F.log2("__shared")).alias("__level"))
    levels = sorted(((r[0], r[1]) for r in rows.groupBy("__level").count().collect()), reverse=True)
    total, least = 0, None
    for level, n in levels:
        if total + n > FREQUENT:
            break
        total, least = total + n, level
    if least is None:
        return np.zeros(0, np.int64)
    return np.sort(rows.filter(F.col("__level") >= least).select("__n").toPandas()["__n"].to_numpy(np.int64))


def _prefixed(docs: DataFrame, frequent: np.ndarray, parts: int) -> DataFrame:
    """(__set, __n, __shared, __all, __prefix, __bits, __keys) of candidate sets; docs: __want (set), __shared, __text."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        often = shared.value
        for batch in batches:
            for piece in slices(batch, "__text", 1 << 20):
                h, ends = shingle_sets(column(piece, "__text"))
                ok = set_ids(h, ends) == np.asarray(column(piece, "__want"))
                key = (part_of(h, parts).astype(np.int64) << 32) + (h & U64(0xFFFFFFFF)).astype(np.int64)
                at = np.minimum(np.searchsorted(often, key), max(len(often) - 1, 0))
                late = often[at] == key if len(often) else np.zeros(len(h), bool)
                every, prefix, bits, keys = [], [], [], []
                for i in np.flatnonzero(ok).tolist():
                    own, last = h[ends[i] : ends[i + 1]], late[ends[i] : ends[i + 1]]
                    every.append(own.tobytes())
                    prefix.append(np.concatenate([own[~last], own[last]])[: len(own) // 4 + 1].view(np.int64).tolist())
                    bits.append(bitmap(own).tobytes())
                    keys.append([int(mix(own + U64(turn)).min().view(np.int64)) for turn in range(1, ROUNDS + 1)])
                yield pa.RecordBatch.from_arrays(
                    [column(piece, "__want").filter(pa.array(ok)), pa.array(np.diff(ends)[ok]), column(piece, "__shared").filter(pa.array(ok)), pa.array(every, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["__set", "__n", "__shared", "__all", "__prefix", "__bits", "__keys"],
                )

    return docs.mapInArrow(run, "__set long, __n long, __shared long, __all binary, __prefix array<long>, __bits binary, __keys array<long>")


def _lead(rows: list[tuple]) -> list[int]:
    """For each (n, all, bits) of a tile, in order: the index of its leader, itself if none."""
    n = np.array([r[0] for r in rows], np.int64)
    bits = np.stack([np.frombuffer(r[2], U64) for r in rows])
    leaders, out = [], []
    for i in range(len(rows)):
        found = i
        if leaders:
            at = np.array(leaders)
            at = at[(DENOM * n[at] >= NUMER * n[i]) & (DENOM * n[i] >= NUMER * n[at])]
            at = at[may_link(n[at], n[i], overlap_bound(n[at], n[i], bits[at], bits[i]))]
            mine = np.frombuffer(rows[i][1], U64)
            for j in at.tolist():
                if may_link(int(n[j]), int(n[i]), common(np.frombuffer(rows[j][1], U64), mine)):
                    found = j
                    break
        if found == i:
            leaders.append(i)
        out.append(found)
    return out


def _round(sets: DataFrame, turn: int) -> DataFrame:
    """sets with __leader, after one round of tiles; bands are shifted by half in every other round."""
    names = ["__set", "__n", "__shared", "__all", "__bits", "__keys"]
    keyed = sets.select(*names).withColumn("__token", F.col("__keys")[turn]).withColumn("__band", band(F.col("__n"), turn % 2 / 2)).withColumn("__rank", -F.col("__shared") / F.col("__n"))
    many = keyed.groupBy("__token", "__band").agg(F.count("*").alias("__rows"), F.min_by("__set", F.struct("__rank", "__set")).alias("__pivot")).filter(F.col("__rows") > TILE)
    many = many.select("__token", "__band", "__pivot", F.ceil(F.col("__rows") / TILE).alias("__deal"))
    own = F.pmod(F.xxhash64("__set", F.lit(turn)), F.coalesce("__deal", F.lit(1)))
    keyed = keyed.join(many, ["__token", "__band"], "left").withColumn("__own", own)
    salts = F.when(F.col("__set") == F.col("__pivot"), F.sequence(F.lit(0).cast("long"), F.col("__deal") - 1)).otherwise(F.array("__own"))
    keyed = keyed.withColumn("__salt", F.explode(salts)).withColumn("__copy", F.col("__salt") != F.col("__own")).drop("__deal", "__pivot", "__own")

    def run(batches):
        held, mark = None, None

        def settle(table):
            if table is None:
                return
            rows = table.to_pydict()
            lead = _lead(list(zip(rows["__n"], rows["__all"], rows["__bits"], strict=True)))
            for c in ("__all", "__bits", "__keys"):  # of leaders alone these are read again
                rows[c] = [x if i == j else None for i, (x, j) in enumerate(zip(rows[c], lead, strict=True))]
            leaders = pa.array([rows["__set"][j] for j in lead], pa.int64())
            out = pa.RecordBatch.from_arrays([*(pa.array(rows[c], column(table, c).type) for c in names), leaders], names=[*names, "__leader"])
            yield out.filter(pa.array([not x for x in rows["__copy"]]))

        for batch in batches:
            key = list(zip(*(np.asarray(column(batch, c)).tolist() for c in ("__token", "__band", "__salt")), strict=True))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)] if key else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                piece = batch.slice(a, b - a)
                if key[a] == mark:
                    held = pa.Table.from_batches([held, piece]).combine_chunks().to_batches()[0]
                else:
                    yield from settle(held)
                    held, mark = piece, key[a]
        yield from settle(held)

    dealt = keyed.repartition("__token", "__band", "__salt").sortWithinPartitions("__token", "__band", "__salt", "__rank", "__n", "__set")
    return dealt.select(*names, "__token", "__band", "__salt", "__copy").mapInArrow(run, "__set long, __n long, __shared long, __all binary, __bits binary, __keys array<long>, __leader long")


def _tile_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (__seta, __setb, __na, __nb, __leadera, __leaderb) of different leaders that share a shingle and may link.

    rows: __token, __set, __n, __leader, __bits. A shingle's sets of band k and, as guests, of band k - 1 make
    blocks; each block meets itself and each other one in a tile. Guests do not meet guests.
    """
    own = rows.withColumn("__b", band(F.col("__n")))
    dealt = own.select("*", F.explode(F.array(F.struct(F.col("__b").alias("k"), F.lit(False).alias("g")), F.struct((F.col("__b") + 1).alias("k"), F.lit(True).alias("g")))).alias("__at")).select("__token", "__set", "__n", "__leader", "__bits", F.col("__at.k").alias("__band"), F.col("__at.g").alias("__guest"))
    # Bands with guests alone, or with one leader alone, have no pairs.
    live = dealt.groupBy("__token", "__band").agg(F.count("*").alias("__rows"), F.count_if(~F.col("__guest")).alias("__hosts"), F.min("__leader").alias("__lo"), F.max("__leader").alias("__hi")).filter("__hosts > 0 AND __lo < __hi")
    live = live.select("__token", "__band", F.ceil(F.col("__rows") / BLOCK).alias("__deal"))
    dealt = dealt.join(live, ["__token", "__band"]).withColumn("__block", F.pmod(F.xxhash64("__set"), F.col("__deal")))
    other = F.sequence(F.lit(0).cast("long"), F.col("__deal") - 1)
    dealt = dealt.select("__token", "__band", "__set", "__n", "__leader", "__bits", "__guest", "__block", F.explode(other).alias("__o"))
    dealt = dealt.withColumn("__lo", F.least("__block", "__o")).withColumn("__hi", F.greatest("__block", "__o"))
    keys = ["__token", "__band", "__lo", "__hi"]

    def run(batches):
        held, mark = None, None

        def settle(table):
            if table is None or len(table) < 2:
                return
            s, n, lead, block = (np.asarray(column(table, c)) for c in ("__set", "__n", "__leader", "__block"))
            guest = np.asarray(column(table, "__guest").to_pylist(), bool)
            bits = np.frombuffer(b"".join(column(table, "__bits").to_pylist()), U64).reshape(len(s), -1)
            _, _, lo, hi = mark
            pairs = []
            for i in range(len(s) - 1):
                j = np.arange(i + 1, len(s))
                j = j[(lead[j] != lead[i]) & ~(guest[j] & guest[i]) & (DENOM * n[j] >= NUMER * n[i]) & (DENOM * n[i] >= NUMER * n[j])]
                if lo != hi:
                    j = j[block[j] != block[i]]
                if len(j):
                    j = j[may_link(n[j], n[i], overlap_bound(n[j], n[i], bits[j], bits[i]))]
                    if len(j):
                        pairs.append((np.full(len(j), i), j))
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                swap = s[a] > s[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s[a], s[b], n[a], n[b], lead[a], lead[b])], names=["__seta", "__setb", "__n", "__m", "__leadera", "__leaderb"])

        for batch in batches:
            key = list(zip(*(np.asarray(column(batch, c)).tolist() for c in keys), strict=True))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)] if key else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                piece = batch.slice(a, b - a)
                if key[a] == mark:
                    held = pa.Table.from_batches([held, piece]).combine_chunks().to_batches()[0]
                else:
                    yield from settle(held)
                    held, mark = piece, key[a]
        yield from settle(held)

    placed = dealt.drop("__o").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, "__seta long, __setb long, __n long, __m long, __leadera long, __leaderb long")


def _exact(pairs: DataFrame) -> DataFrame:
    """The rows of pairs (__n, __m, __a, __b, ...) whose arrays link."""
    names = pairs.columns
    rest = [c for c in names if c not in ("__a", "__b")]
    kinds = dict(pairs.dtypes)

    def run(batches):
        for batch in batches:
            ok = [may_link(n, m, common(np.frombuffer(a, U64), np.frombuffer(b, U64))) for n, m, a, b in zip(*(column(batch, c).to_pylist() for c in ("__n", "__m", "__a", "__b")), strict=True)]
            yield batch.select(rest).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest))


def links(sets: DataFrame) -> DataFrame:
    """(__set, __root) of every candidate set; sets: as _prefixed gives them, without repeated sets."""
    sets = scratch(sets, "op6-sets")
    joined, active = None, sets
    for turn in range(ROUNDS):
        done = scratch(_round(active, turn), "op6-round")
        step = done.filter("__set <> __leader").select(F.col("__set").alias("u"), F.col("__leader").alias("v"))
        joined = step if joined is None else joined.unionByName(step)
        active = done.filter("__set = __leader").drop("__leader")
    groups = components(joined)
    state = scratch(sets.select("__set").join(groups.toDF("__set", "__root"), "__set", "left").select("__set", F.coalesce("__root", "__set").alias("__leader")), "op6-state")
    # Shingles whose sets are in different groups.
    prefix = sets.select("__set", "__n", "__bits", F.explode_outer("__prefix").alias("__token")).join(state, "__set")
    mixed = prefix.groupBy("__token").agg(F.min("__leader").alias("__lo"), F.max("__leader").alias("__hi")).filter("__lo < __hi").select("__token")
    rows = scratch(prefix.join(mixed, "__token"), "op6-mixed")
    pairs = _tile_pairs(rows).distinct()
    every = sets.select("__set", "__all")
    pairs = pairs.join(every.toDF("__seta", "__a"), "__seta").join(every.toDF("__setb", "__b"), "__setb").select("__leadera", "__leaderb", "__n", "__m", "__a", "__b")
    found = _exact(pairs).select(F.col("__leadera").alias("u"), F.col("__leaderb").alias("v"))
    roots = components(found)
    return state.join(roots.toDF("__leader", "__root"), "__leader", "left").select("__set", F.coalesce("__root", "__leader").alias("__root"))


def _placed(own: DataFrame, names: list[str]) -> tuple[DataFrame, bool]:
    """(names, __id, __n, __root) of every row, root null for empty sets; and whether ids are unique.

    own: names, __id (long, never null) and __text.
    """
    named = scratch(_signatures(own, [*names, "__id"]), "op6-named")
    counts, parts = _shared(own)
    counts = scratch(counts, "op6-counts")
    wanted = counts.filter("__set is not null")
    frequent = _frequent(counts)
    # One row with a text for each wanted set.
    one = named.filter("__set is not null").groupBy("__set").agg(F.min("__id").alias("__id")).join(wanted.select("__set", "__shared"), "__set")
    texts = own.select("__id", "__text").join(one.select("__id", "__shared", F.col("__set").alias("__want")), "__id").select("__want", "__shared", "__text")
    sets = _prefixed(texts, frequent, parts)
    ids = named.agg(F.count("*").alias("n"), F.count_distinct("__id").alias("d")).first()
    if ids["n"] != ids["d"]:  # equal ids: a set may have come more than once
        sets = sets.dropDuplicates(["__set"])
    roots = links(sets)
    placed = named.join(roots, "__set", "left").select(*names, "__id", "__n", F.coalesce("__root", "__set").alias("__root"))
    return scratch(placed, "op6-placed"), ids["n"] == ids["d"]


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row of docs."""
    own = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("__id"), F.col(text).alias("__text"))
    placed, _ = _placed(own, ["__key"])
    least = placed.filter("__root is not null").groupBy("__root").agg(F.min(F.col("__key").cast("long")).alias("__least"))
    least = scratch(least, "op6-least")  # apart from the join, which can then split a large component
    out = placed.join(least, "__root", "left")
    alone = F.when(F.col("__root").isNull(), F.col("__key").cast("long"))
    return out.select(F.col("__key").alias(key), F.col("__n").alias("n_shingles"), F.coalesce("__least", alone).alias("component_id"))


def one_a_component(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs of each component, with its own columns: that of the smallest id, among equal ids of the least text hash.

    A row with an empty set is alone; of repeated rows one stays.
    """
    inside = [f"c{i}" for i in range(len(docs.columns))]
    own_key, own_text = inside[docs.columns.index(key)], inside[docs.columns.index(text)]
    own = docs.toDF(*inside).withColumn("__id", F.coalesce(F.col(own_key).cast("long"), F.lit(LAST))).withColumn("__hash", F.xxhash64(F.coalesce(F.col(own_text), F.lit(""))))
    placed, unique = _placed(own.select("__id", "__hash", F.col(own_text).alias("__text")), ["__hash"])
    first = placed.filter("__root is not null").groupBy("__root").agg(F.min(F.struct("__id", "__hash")).alias("m")).select("m.__id", "m.__hash")
    keep = first.unionByName(placed.filter("__root is null").select("__id", "__hash").distinct())
    out = own.join(keep, ["__id", "__hash"], "left_semi")
    if not unique:
        out = out.dropDuplicates(["__id", "__hash"])
    return out.select(*inside).toDF(*docs.columns)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
