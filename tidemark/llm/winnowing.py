"""Benchmark decontamination by winnowing.

A text's fingerprints are the least k-gram hashes of each window of w neighbouring k-grams, so any run
of t = k + w - 1 words that a document shares with a benchmark item has a fingerprint that both keep.
Fingerprints of both sides meet in a join, and each meeting is extended: the document's windows that hold the
gram are joined, as words, with the different windows of the benchmark. Each fingerprint and each window of the
benchmark is one row whatever number of items has it, so no phrase makes documents meet items pair by pair. Documents
without a meeting never leave their own row.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is `size` consecutive words of an item; a
shorter item with any word is one window. Items are grouped by window length; for each length present
the documents get fingerprints that guarantee that length.

The benchmark's fingerprints, and its windows with their items, are broadcast only while their number is under
BROADCAST_ROWS; beyond that the joins are shuffled.

Defined results: a null text has no words and is hit by nothing; an empty benchmark hits nothing;
repeated document rows are judged each on its own; an item id that occurs twice counts once. Documents
without an id are judged like all others; items without an id hit words but are not counted or named. A text of any
length is one row of words; an empty table gives no rows; extra columns are not read by contamination() and pass through
clean(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

SIZE = 13
GRAM = 5
BROADCAST_ROWS = 1 << 20
#: Everything but digits, letters and what lies beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; empty for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def _array(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} ELSE array() END"


def with_fingerprints(rows: DataFrame, plans: list[tuple[int, int]]) -> DataFrame:
    """rows with `__f`, an array of (t, h, i): fingerprint h at place i for windows of t words.

    rows has the words as `__w`. plans: (t, k) pairs; each window holds w = t - k + 1 grams of k words.
    The window's minimum is taken over values that order by hash, then place, and by doubling spans.
    """
    keep = [c for c in rows.columns if c != "__w"]
    out = rows.select(*keep, F.expr("transform(__w, x -> xxhash64(x))").alias("__x"))
    made = []
    for t, k in plans:
        w = t - k + 1
        g, m = f"__g{t}", f"__m{t}"
        grams = ", ".join(f"__x[i + {j}]" for j in range(k))
        out = out.withColumn(g, F.expr(_array(f"size(__x) >= {t}", f"transform(sequence(0, size(__x) - {k}), i -> xxhash64({grams}))")))
        out = out.withColumn(m, F.expr(f"transform({g}, (h, i) -> shiftleft(shiftrightunsigned(h, 28), 28) | cast(i AS bigint))"))
        span = 1
        while span < w:
            step = min(span, w - span)
            out = out.withColumn(m, F.expr(_array(f"size({m}) > {step}", f"transform(sequence(0, size({m}) - {step + 1}), i -> least({m}[i], {m}[i + {step}]))")))
            span += step
        place = "cast(v & 268435455L AS int)"
        out = out.withColumn(f"__f{t}", F.expr(f"transform(filter({m}, (v, s) -> s = 0 OR v <> {m}[greatest(s - 1, 0)]), v -> struct({t} AS t, {g}[{place}] AS h, {place} AS i))")).drop(m, g)
        made.append(f"__f{t}")
    return out.select(*keep, F.concat(*made).alias("__f"))


def contamination(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE, gram: int = GRAM, row: str | None = None) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs; row: also a hash of the text, so named."""
    more = [F.col("__row").alias(row)] if row else []
    # Ids may be null: inside, a row is known by `__id`, a struct that is never null, and so are items.
    rows = docs.select(F.struct(F.col(key).alias("id")).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__row", F.xxhash64("__text"))
    items = bench.select(F.struct(F.col(item).cast("string").alias("id")).alias("__item"), words(F.col(item_text)).alias("__w")).filter("size(__w) > 0").withColumn("__t", F.least(F.size("__w"), F.lit(size)))
    plans = [(t, min(gram, t)) for t in sorted(r[0] for r in items.select("__t").distinct().collect())]
    counted = rows.select("__id", "__row", F.size(words(F.col("__text"))).cast("long").alias("n_words"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    twenty = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    if not plans:
        zero = F.lit(0).cast("long")
        return counted.select(F.col("__id.id").alias(key), *more, "n_words", zero.alias("n_hit"), zero.alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))

    # Items of one length at a time keep their own fingerprints only; each fingerprint is listed once, whatever number of items has it.
    listed = with_fingerprints(items, plans).select("__t", F.explode_outer("__f").alias("f")).filter("f.t = __t").select("__t", F.col("f.h").alias("__h")).distinct()
    listed = scratch(listed, "op5-prints")
    small = listed.count() <= BROADCAST_ROWS
    own = with_fingerprints(rows.select("__id", "__row", words(F.col("__text")).alias("__w")), plans)
    # The outer form: the plain one adds a filter on the array, which would be pushed down and evaluate it again.
    own = own.select("__id", "__row", F.explode_outer("__f").alias("f")).select("__id", "__row", F.col("f.t").alias("__t"), F.col("f.h").alias("__h"), F.col("f.i").alias("__i"))
    meetings = scratch(own.join(F.broadcast(listed) if small else listed, ["__t", "__h"], "left_semi"), "op5-meetings")

    # The words around each meeting, from the rows that have one.
    by_row = meetings.groupBy("__id", "__row").agg(F.collect_set(F.struct("__t", "__i")).alias("__met"))
    few = meetings.select("__id", "__row").distinct().count() <= 1 << 14
    hit_rows = rows.select("__id", "__row", "__text").join(F.broadcast(by_row.select("__id", "__row").distinct()), ["__id", "__row"], "left_semi") if few else rows.select("__id", "__row", "__text")
    hit_rows = hit_rows.dropDuplicates(["__id", "__row"]) if few else hit_rows
    # A meeting is extended to every window of t words that holds its gram; neighbouring meetings share windows.
    # A window is s * 65536 + t here: numbers, unlike structs, are made distinct by a hash set.
    starts = "array_distinct(flatten(transform(__met, m -> transform(sequence(greatest(m.__i - m.__t + 1, 0), m.__i), s -> shiftleft(cast(s AS bigint), 16) | m.__t))))"
    around = (
        hit_rows.join(by_row, ["__id", "__row"])
        .select("__id", "__row", words(F.col("__text")).alias("__w"), F.expr(starts).alias("__at"))
        .select("__id", "__row", F.explode_outer(F.expr("transform(filter(transform(__at, x -> struct(cast(x & 65535 AS int) AS t, cast(shiftright(x, 16) AS int) AS s)), x -> x.s + x.t <= size(__w)), x -> struct(x.t AS t, x.s AS s, slice(__w, x.s + 1, x.t) AS a))")).alias("m"))
        .select("__id", "__row", F.col("m.t").alias("__t"), F.col("m.s").alias("__s"), F.col("m.a").alias("__a"))
    )
    # Each different window of the benchmark once, with its items: what extends is one row for a document's window.
    theirs = items.select("__item", "__t", F.explode(F.expr("transform(sequence(0, size(__w) - __t), s -> slice(__w, s + 1, __t))")).alias("__a"))
    theirs = scratch(theirs.groupBy("__t", "__a").agg(F.collect_set("__item.id").alias("__of")), "op5-windows")
    weight = theirs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("__of")), F.lit(0)).alias("m")).first()
    windows = around.join(F.broadcast(theirs) if weight["n"] + weight["m"] <= BROADCAST_ROWS else theirs, ["__t", "__a"])
    found = (
        windows.groupBy("__id", "__row")
        .agg(F.array_sort(F.collect_set(F.struct("__s", "__t"))).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__of")))).alias("__items"))
        .select(
            "__id",
            "__row",
            F.expr("aggregate(__spans, struct(0L AS n, 0 AS to), (a, x) -> struct(a.n + greatest(x.__s + x.__t - greatest(x.__s, a.to), 0) AS n, greatest(a.to, x.__s + x.__t) AS to)).n").alias("n_hit"),
            F.size("__items").cast("long").alias("n_items"),
            F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        )
    )
    both = counted["__id"].eqNullSafe(found["__id"]) & (counted["__row"] == found["__row"])
    return (
        counted.join(found, both, "left")
        .select(counted["__id"]["id"].alias(key), *([counted["__row"].alias(row)] if row else []), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"))
        .withColumn("contaminated", twenty)
    )


def clean(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns.

    Rows are told apart by key and text, so rows of one id with different texts are judged apart.
    """
    # Inside, columns go by place, so that no name of the table clashes with those used here.
    inside = [f"c{i}" for i in range(len(docs.columns))]
    own_key, own_text = inside[docs.columns.index(key)], inside[docs.columns.index(text)]
    own = docs.toDF(*inside)
    judged = contamination(own, bench, own_key, own_text, row="__hash", **how).filter("contaminated").select(F.col(own_key).alias("__bad"), F.col("__hash").alias("__bad_text")).distinct()
    hash_ = F.xxhash64(F.coalesce(F.col(own_text), F.lit("")))
    return own.join(judged, F.col(own_key).eqNullSafe(F.col("__bad")) & (hash_ == F.col("__bad_text")), "left_anti").toDF(*docs.columns)


def op5_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
