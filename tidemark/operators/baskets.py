"""Baskets cut from shopping events, association rules over baskets, and the store of patterns."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sessions import ADD, VIEW

REMOVE = "REMOVE_FROM_CART"
COMPLETE = {"original": ("ORDER_PLACED", "CHECKOUT_COMPLETE"), "refactored": ("ORDER_PLACED", "CHECKOUT_COMPLETE", "PAYMENT_PROCESSED")}
TIMEOUT = 1_800_000_000
#: How many views a basket remembers.
VIEWS = 50


def segmented(events: DataFrame, mode: str = "refactored", timeout_us: int | None = TIMEOUT, key: str = "session_id", order: tuple = ("us", "event_id")) -> DataFrame:
    """events with `segment`: it grows after each completing event, and where a key idles for the timeout or longer."""
    w = W.partitionBy(key).orderBy(*order)
    done = F.coalesce(F.lag(F.col("event_type").isin(*COMPLETE[mode])).over(w), F.lit(False))
    idle = F.coalesce(F.col("us") - F.lag("us").over(w) >= timeout_us, F.lit(False)) if timeout_us is not None else F.lit(False)
    return events.withColumn("__cut", (done | idle).cast("int")).withColumn("segment", F.sum("__cut").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__cut")


def carts(events: DataFrame, mode: str = "refactored", timeout_us: int | None = TIMEOUT, key: str = "session_id", adjust_total_on_remove: bool = False, horizon_us: int | None = None) -> DataFrame:
    """One row a basket that has ended with any item: (key, segment, kind, at_us, n_items, items, total_value, views).

    kind is 'completed', or 'timeout' for a key that idles for the timeout, by horizon_us (none without it). An add counts unless its product is
    removed later in the segment; views are the last VIEWS products viewed, oldest first.
    """
    rows = segmented(events, mode, timeout_us, key)
    what, of = F.col("event_type"), [key, "segment"]
    ends = rows.groupBy(*of).agg(F.max(F.struct("us", "event_id", F.coalesce(what.isin(*COMPLETE[mode]), F.lit(False)).alias("done"))).alias("__end"))
    by_product = rows.groupBy(*of, "product_id").agg(F.max(F.when(what == REMOVE, F.struct("us", "event_id"))).alias("__gone"))
    adds = rows.filter(what == ADD).select(*of, "product_id", "us", "event_id", "value")
    both = adds.alias("a").join(by_product.alias("g"), (F.col(f"a.{key}") == F.col(f"g.{key}")) & (F.col("a.segment") == F.col("g.segment")) & F.col("a.product_id").eqNullSafe(F.col("g.product_id")))
    in_ = F.col("g.__gone").isNull() | (F.struct("a.us", "a.event_id") > F.col("g.__gone"))
    counted = in_ if adjust_total_on_remove else F.lit(True)
    basket = both.groupBy(F.col(f"a.{key}").alias(key), F.col("a.segment").alias("segment")).agg(
        F.count_if(in_).alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.when(in_, F.col("a.product_id")))), ",").alias("items"), F.sum(F.when(counted, F.col("a.value")).otherwise(0.0)).alias("total_value")
    )
    # No more than VIEWS rows a segment are gathered.
    late = W.partitionBy(*of).orderBy(F.desc("us"), F.desc("event_id"))
    seen = rows.filter((what == VIEW) & F.col("product_id").isNotNull()).withColumn("__n", F.row_number().over(late)).filter(F.col("__n") <= VIEWS)
    seen = seen.groupBy(*of).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "product_id")), asc=False), lambda x: x["product_id"]), ",").alias("views"))
    out = basket.filter("n_items > 0").join(ends, of).join(seen, of, "left")
    out = out.withColumn("kind", F.when(F.col("__end.done"), "completed").otherwise("timeout")).withColumn("at_us", F.col("__end.us") + F.when(F.col("__end.done"), 0).otherwise(timeout_us or 0))
    timed = F.lit(False) if horizon_us is None or timeout_us is None else F.col("at_us") <= horizon_us
    return out.filter((F.col("kind") == "completed") | timed).select(*of, "kind", "at_us", "n_items", "items", "total_value", F.coalesce("views", F.lit("")).alias("views"))


def completed(events: DataFrame, mode: str = "refactored", timeout_us: int | None = TIMEOUT, key: str = "session_id", adjust_total_on_remove: bool = False) -> DataFrame:
    """One row a completed basket with any item: an add counts unless its product is removed later in the segment."""
    return carts(events, mode, timeout_us, key, adjust_total_on_remove).select(key, "segment", F.col("at_us").alias("completed_us"), "n_items", "items", "total_value")


def pair_rules(items: DataFrame, basket: str = "basket_id", item: str = "item", min_support: float = 0.01, min_confidence: float = 0.3) -> DataFrame:
    """Rules a -> c between single items over all baskets, with support, confidence and lift.

    Entries of an item are no fewer than its baskets, so items whose entries are at or under min_support of the baskets leave
    before pairs are made. Baskets are gathered once; singles and pairs are counted in one aggregation, combined before its shuffle.
    """
    rows = items.select(F.col(basket).alias("b"), F.col(item).alias("i"))
    total = rows.select("b").distinct().agg(F.count("b").alias("total"))
    entries = rows.filter("i is not null").groupBy("i").agg(F.count("*").alias("entries"))
    often = entries.join(F.broadcast(total)).filter(F.col("entries") / F.col("total") > min_support)  # one row beside the counts
    sets = rows.join(often.select("i"), "i", "left_semi").groupBy("b").agg(F.collect_set("i").alias("s"))
    made = F.expr("concat(transform(s, x -> struct(x AS a, null AS c)), flatten(transform(s, x -> transform(filter(s, y -> y <> x), y -> struct(x AS a, y AS c)))))")
    counts = sets.select(F.explode(made).alias("p")).groupBy("p.a", "p.c").agg(F.count("*").alias("together"))
    pairs = counts.withColumn("of_a", F.max(F.when(F.col("c").isNull(), F.col("together"))).over(W.partitionBy("a"))).filter("c is not null")
    out = pairs.join(often.select(F.col("i").alias("c"), F.col("entries").alias("entries_c"), "total"), "c")
    confidence, support = F.col("together") / F.col("of_a"), F.col("together") / F.col("total")
    out = out.select("a", "c", "together", support.alias("support"), confidence.alias("confidence"), (confidence / (F.col("entries_c") / F.col("total"))).alias("lift"))
    return out.filter((F.col("confidence") > min_confidence) & (F.col("support") > min_support))


class History:
    """A key's last `keep` + 1 baskets (the newest one included) as a ring of slots; of each item a mask of the slots that hold it.

    What baskets hold a set of items is the intersection of masks, so a basket costs the same whatever the history: its slot's bits
    are cleared for the basket that leaves and set for the one that comes.
    """

    def __init__(self, keep: int = 1000):
        self.slots, self.count = keep + 1, 0
        self.ring: dict[int, list[str]] = {}
        self.masks: dict[str, int] = {}
        self.entries: dict[str, int] = {}
        self.newest: Counter = Counter()

    def add(self, items: list[str]) -> None:
        self.put(Counter(items))
        for x, n in self.newest.items():
            self.entries[x] = self.entries.get(x, 0) + n

    def put(self, newest: dict[str, int]) -> None:
        """The next basket, by its items and how often each is entered; `entries` are left as they are."""
        slot = self.count % self.slots
        for x in self.ring.get(slot, ()):
            self.masks[x] &= ~(1 << slot)
            if not self.masks[x]:
                del self.masks[x]
        self.newest = newest
        self.ring[slot] = sorted(newest)
        for x in newest:
            self.masks[x] = self.masks.get(x, 0) | 1 << slot
        self.count += 1

    def rules(self, full: tuple = (-1.0, -1.0), single: float = -1.0) -> list[tuple]:
        """(antecedents, consequent, kind, confidence, support, lift) of the newest basket: full rules need confidence and support above
        what is given, single ones confidence."""
        out, s, count = [], sorted(self.newest), self.count
        masks, shares = [self.masks[x] for x in s], [self.entries[x] / count for x in s]
        if len(s) > 1:
            before, after = [-1], [-1]
            for m in masks:
                before.append(before[-1] & m)
            for m in reversed(masks):
                after.append(after[-1] & m)
            after.reverse()
            together = before[-1].bit_count()
            support = together / count
            if support > full[1]:
                for i, c in enumerate(s):
                    confidence = together / (before[i] & after[i + 1]).bit_count()
                    if confidence > full[0]:
                        out.append((",".join(s[:i] + s[i + 1 :]), c, "full", confidence, support, confidence / shares[i]))
        if sum(self.newest.values()) > 2:
            held = [m.bit_count() for m in masks]
            for i, x in enumerate(s):
                for j in range(i + 1, len(s)):
                    together = (masks[i] & masks[j]).bit_count()
                    support, of_x, of_y = together / count, together / held[i], together / held[j]
                    if of_y > single:
                        out.append((s[j], x, "single", of_y, support, of_y / shares[i]))
                    if of_x > single:
                        out.append((x, s[j], "single", of_x, support, of_x / shares[j]))
        return out

    def dump(self) -> str:
        return json.dumps([self.count, list(self.ring.items()), {k: hex(m) for k, m in self.masks.items()}, self.entries])

    def load(self, text: str) -> History:
        self.count, ring, masks, self.entries = json.loads(text)
        self.ring, self.masks = {int(k): v for k, v in ring}, {k: int(m, 16) for k, m in masks.items()}
        return self


#: Rules that a task holds before it hands them on.
OUT = 65_536
RULE_COLUMNS = ["seq", "antecedents", "consequent", "kind", "confidence", "support", "lift"]


def incremental_rules(items: DataFrame, keep: int = 1000, key: str = "user_id", full: tuple = (0.3, 0.01), single: float = 0.4, block: int = 4, parts: int | None = None) -> DataFrame:
    """Rules emitted as each basket of a key arrives, from the baskets of that key held then.

    items: key, `seq` (the key's order of baskets: 1, 2, ...) and item, one row an entry. History of basket n is
    n - keep .. n; null items are no items. Full rule: all other items -> item; single rules if the basket has more than two entries. Support
    divides by all baskets so far, lift by item entries so far.

    A key's baskets are cut into blocks of `block` * keep, each with the keep baskets before it to begin with, so that a key of any
    size is spread over tasks; a task streams a block and holds keep + 1 baskets. Blocks are dealt to `parts` tasks (as many as shuffles
    have, if not given), and rules leave in batches of about OUT rows.
    """
    rows = items.select(F.col(key).alias("k"), F.col("seq").cast("long").alias("seq"), F.col("item").alias("i")).filter("i is not null")
    each = rows.groupBy("k", "seq", "i").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(W.partitionBy("k", "i").orderBy("seq"))
    baskets_ = each.withColumn("e", so_far).groupBy("k", "seq").agg(F.sort_array(F.collect_list(F.struct("i", "n", "e"))).alias("s"))
    size, at = block * keep, F.col("seq") - 1
    own = F.floor(at / size)
    dealt = baskets_.select("k", F.explode(F.when(at % size >= size - keep, F.array(own, own + 1)).otherwise(F.array(own))).alias("b"), "seq", own.alias("own"), F.col("s.i").alias("i"), F.col("s.n").alias("n"), F.col("s.e").alias("e"))
    dealt = dealt.repartition(*([parts] if parts else []), "k", "b").sortWithinPartitions("k", "b", "seq")
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history, now = History(keep), None
        for batch in batches:
            of, out = [], []
            ends = batch.column("i").offsets.to_numpy().tolist()
            begin = ends[0]
            i, n, e = (batch.column(c).flatten().to_numpy(zero_copy_only=False).tolist() for c in ("i", "n", "e"))
            for row, (k, b, seq, own_) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "b", "seq", "own")), strict=True)):
                if (k, b) != now:
                    history, now = History(keep), (k, b)
                x, y = ends[row] - begin, ends[row + 1] - begin
                history.count = seq - 1  # also sets the slot, so a block begins as if it had seen all
                history.put(dict(zip(i[x:y], n[x:y], strict=True)))
                if b == own_:
                    history.entries = dict(zip(i[x:y], e[x:y], strict=True))
                    rules = history.rules(full, single)
                    out += rules
                    of += [row] * len(rules)
                    if len(out) >= OUT:
                        yield _rows(batch, of, out, key)
                        of, out = [], []
            if out:
                yield _rows(batch, of, out, key)

    return dealt.mapInArrow(run, f"`{key}` {kind}, seq bigint, antecedents string, consequent string, kind string, confidence double, support double, lift double")


def _rows(batch: pa.RecordBatch, of: list[int], rules: list[tuple], key: str) -> pa.RecordBatch:
    """Rules with the key and number of the basket (a row of the batch) that each is of."""
    at, columns = np.array(of), list(zip(*rules, strict=True))
    return pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(at)), batch.column("seq").take(pa.array(at)), *map(_texts, columns[:3]), *(pa.array(np.array(c)) for c in columns[3:])], [key, *RULE_COLUMNS])


def _texts(values: tuple[str, ...]) -> pa.Array:
    """Texts that recur are made once."""
    places: dict[str, int] = {}
    at = np.array([places.setdefault(x, len(places)) for x in values])
    return pa.array(list(places), pa.string()).take(pa.array(at))


def pattern_id(antecedents: Column, consequent: Column) -> Column:
    return F.concat(F.array_join(antecedents, ","), F.lit("_"), consequent)


def best_patterns(patterns: DataFrame) -> DataFrame:
    """Of each pattern_id the row of highest confidence, the earliest among equals."""
    return patterns.groupBy("pattern_id").agg(F.max_by(F.struct(*[c for c in patterns.columns if c != "pattern_id"]), F.struct("confidence", -F.col("us"))).alias("p")).select("pattern_id", "p.*")


def newest(patterns: DataFrame, cap: int = 5000) -> DataFrame:
    """The store's newest patterns; the cap is the store's own."""
    return patterns.orderBy(F.desc("us"), "pattern_id").limit(cap)


def interestingness(confidence: Column, support: Column, lift: Column) -> Column:
    return confidence * 0.4 + F.when(lift > 1.0, F.least(lift / 10, F.lit(0.3))).otherwise(0.0) + F.least(support * 10, F.lit(0.3))


def significant(min_support: float, min_confidence: float, min_lift: float) -> Column:
    return (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)


#: Itemsets of a size that are few enough to be sent to every task.
FEW = 100_000


def itemset_rules(items: DataFrame, basket: str = "basket_id", item: str = "item", min_support: float = 0.01, min_confidence: float = 0.3) -> DataFrame:
    """(antecedent, consequent, confidence, lift, support) of rules with one consequent, from frequent itemsets of any size, by pattern growth.

    Null items are no items; a basket without any counts as a basket. Baskets are made once, and equal ones become one row with its
    weight. A base has of each itemset s the rows (p, w): w baskets hold s and, of the items before those of s, just p. An item of p whose
    weights reach the support makes s larger; the others leave p before it is dealt to the next base, where equal rows are one again. Each base and
    its itemsets are made by joins and sums, so neither is held by one task; the loop ends with the largest frequent itemset.
    """
    made = items.select(F.col(basket).alias("b"), F.col(item).alias("x")).groupBy("b").agg(F.array_sort(F.collect_set("x")).alias("p"))
    none = F.array().cast(made.schema["p"].dataType)
    held = [_collapsed(made.select(none.alias("s"), "p", "b", F.lit(1).cast("long").alias("w"))).persist()]
    try:
        total = held[0].agg(F.sum("w")).first()[0] or 0
        least, sizes = math.ceil(min_support * total), []
        each = held[0].select("s", F.explode("p").alias("x"), "b", "w")
        while True:
            often = each.groupBy("s", "x").agg(F.sum("w").alias("n")).filter(F.col("n") >= least).localCheckpoint()
            while len(held) > 1:  # the newest base is in store by now
                held.pop(0).unpersist()
            sizes.append(often.select(F.array_sort(F.concat("s", F.array("x"))).alias("items"), "n"))
            n = often.count()
            if n < 2:
                break
            keys = often.select("s", "x")
            kept = each.join(F.broadcast(keys) if n <= FEW else keys, ["s", "x"], "left_semi")
            rows = kept.groupBy("s", "b").agg(F.array_sort(F.collect_list("x")).alias("p"), F.max("w").alias("w")).filter(F.size("p") > 1)
            held.append(_collapsed(rows).persist())
            grown = held[-1].select("s", "p", F.posexplode("p").alias("j", "y"), "b", "w").filter("j > 0")
            each = grown.select(F.concat("s", F.array("y")).alias("s"), F.explode(F.slice("p", F.lit(1), F.col("j"))).alias("x"), "b", "w")
    finally:
        for base in held:
            base.unpersist()
    sets = reduce(DataFrame.union, sizes)
    rules = sets.filter(F.size("items") > 1).select("items", "n", F.explode("items").alias("c"))
    rules = rules.select(F.array_remove("items", F.col("c")).alias("antecedent"), F.array("c").alias("consequent"), "n")
    rules = rules.join(sets.select(F.col("items").alias("antecedent"), F.col("n").alias("of_a")), "antecedent")
    rules = rules.join(sizes[0].select(F.col("items").alias("consequent"), F.col("n").alias("of_c")), "consequent")
    confidence = F.col("n") / F.col("of_a")
    out = rules.select("antecedent", "consequent", confidence.alias("confidence"), (confidence / (F.col("of_c") / total)).alias("lift"), (F.col("n") / total).alias("support"))
    return out.filter(F.col("confidence") >= min_confidence)


def _collapsed(base: DataFrame) -> DataFrame:
    """Rows of a base of one itemset and equal items as one; the least of their baskets stands for them."""
    return base.groupBy("s", "p").agg(F.min("b").alias("b"), F.sum("w").alias("w"))
