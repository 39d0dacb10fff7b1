"""Recommendations from patterns and counts, and the joins that carry context to a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .baskets import segmented
from .sessions import ADD, VIEW

#: Scores are sums of doubles, which depend on their order in the last digits; they rank as equal to so many decimals.
TIE = 9


def top(df: DataFrame, k: int, per: list[str], order: list) -> DataFrame:
    """The first k rows of each group; `place` from 1."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*per).orderBy(*order))).filter(F.col("place") <= k)


def _listed(each: DataFrame, k: int, key: str) -> DataFrame:
    """The k consequents of highest confidence of each add as one text."""
    ranked = top(each, k, [key, "event_id"], [F.desc("confidence"), "consequent"])
    out = ranked.groupBy(key, "event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "consequent"))), lambda x: x["consequent"]), ",").alias("products"))
    return out.withColumn("kind", F.lit("BASKET_BASED")).withColumn("confidence", F.lit(0.75))


def _parts(patterns: DataFrame, least: float) -> DataFrame:
    """One row an antecedent of each pattern above the confidence asked for; need: how many it has."""
    good = patterns.filter(F.col("confidence") > least).select("pattern_id", F.array_distinct("antecedents").alias("ants"), "consequent", "confidence")
    return good.select("pattern_id", F.size("ants").alias("need"), "consequent", "confidence", F.explode("ants").alias("item"))


def for_baskets(events: DataFrame, patterns: DataFrame, k: int = 5, least: float = 0.5, key: str = "session_id") -> DataFrame:
    """For each add: consequents of patterns whose antecedents the basket holds and whose consequent it lacks.

    patterns: pattern_id, antecedents (array), consequent, confidence. A basket is known by the first add of each of its
    products: a pattern holds from the latest of its antecedents' first adds (a subset test that is an equi-join: as many must match as the
    pattern has) until the consequent's own. So baskets are never carried from add to add.
    """
    order = ("us", "event_id")
    adds = segmented(events, "refactored", None, key).filter(F.col("event_type") == ADD).select(key, "segment", "event_id", F.col("product_id").alias("item"), F.struct(*order).alias("at"))
    firsts = adds.groupBy(key, "segment", "item").agg(F.min("at").alias("at"))
    met = firsts.join(_parts(patterns, least), "item").groupBy(key, "segment", "pattern_id", "need", "consequent", "confidence").agg(F.count("*").alias("have"), F.max("at").alias("begins")).filter("have = need")
    own = firsts.select(key, "segment", F.col("item").alias("consequent"), F.col("at").alias("ends"))
    spans = met.join(own, [key, "segment", "consequent"], "left").select(key, "segment", "consequent", "confidence", "begins", "ends")
    hit = adds.join(spans, [key, "segment"]).filter((F.col("begins") <= F.col("at")) & (F.col("ends").isNull() | (F.col("at") < F.col("ends"))))
    return _listed(hit.groupBy(key, "event_id", "consequent").agg(F.max("confidence").alias("confidence")), k, key)


def for_held(adds: DataFrame, patterns: DataFrame, k: int = 5, least: float = 0.5, key: str = "session_id") -> DataFrame:
    """for_baskets() where each add comes with what its basket holds (an array `basket`), as a stream gives it."""
    held = adds.select(key, "event_id", F.explode(F.array_distinct("basket")).alias("item"))
    met = held.join(_parts(patterns, least), "item").groupBy(key, "event_id", "pattern_id", "need", "consequent", "confidence").agg(F.count("*").alias("have")).filter("have = need")
    met = met.join(held.withColumnRenamed("item", "consequent"), [key, "event_id", "consequent"], "left_anti")
    return _listed(met.groupBy(key, "event_id", "consequent").agg(F.max("confidence").alias("confidence")), k, key)


def for_views(events: DataFrame, patterns: DataFrame, k: int = 3, key: str = "session_id") -> DataFrame:
    """For each view: consequents of patterns that have the viewed product among their antecedents."""
    parts = patterns.select(F.explode(F.array_distinct("antecedents")).alias("product_id"), "consequent", "confidence").filter("product_id <> consequent")
    parts = parts.groupBy("product_id", "consequent").agg(F.max("confidence").alias("confidence"))
    parts = top(parts, k, ["product_id"], [F.desc("confidence"), "consequent"])
    lists = parts.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "consequent"))), lambda x: x["consequent"]), ",").alias("products"))
    views = events.filter(F.col("event_type") == VIEW).select(key, "event_id", "product_id")
    return views.join(lists, "product_id").select(key, "event_id", "products", F.lit("VIEW_BASED").alias("kind"), F.lit(0.65).alias("confidence"))


def popular(events: DataFrame, k: int, item: str = "product_id") -> DataFrame:
    return events.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item).limit(k)


def by_rules(owned: DataFrame, rules: DataFrame, k: int = 5, key: str = "session_id") -> DataFrame:
    """Top consequents by summed confidence of the rules that a key's items meet, plus a hundredth of their rule count."""
    met = owned.join(rules, owned["item"] == rules["a"]).select(key, "c", "confidence")
    freq = rules.groupBy("c").agg(F.count("*").alias("freq"))
    have = owned.select(F.col(key), F.col("item").alias("c")).distinct()
    scored = met.groupBy(key, "c").agg(F.sum("confidence").alias("s")).join(freq, "c").join(have, [key, "c"], "left_anti").select(key, "c", (F.col("s") + F.col("freq") / 100).alias("score"))
    return top(scored, k, [key], [F.desc(F.round("score", TIE)), "c"])


def cross_sell(owned: DataFrame, rules: DataFrame, k: int = 5, key: str = "session_id") -> DataFrame:
    """Top partners: one point for each association and confidence times support for each rule met."""
    met = owned.join(rules, owned["item"] == rules["a"]).select(key, "c", (F.lit(1.0) + F.col("confidence") * F.col("support")).alias("p"))
    have = owned.select(F.col(key), F.col("item").alias("c")).distinct()
    scored = met.groupBy(key, "c").agg(F.sum("p").alias("score")).join(have, [key, "c"], "left_anti")
    return top(scored, k, [key], [F.desc(F.round("score", TIE)), "c"])


def item_similarity(items: DataFrame, least: float = 0.1, basket: str = "basket_id", item: str = "item") -> DataFrame:
    """(item, other, similarity): cosine of the baskets of two different items, both ways, where it is `least` or more.

    With n the baskets of an item, two have at most the lesser n in common, so their cosine is at most sqrt(lesser / greater): pairs
    under the bound are never made. Pairs are made within baskets and counted before they are shuffled, so an item of a
    third of all baskets is no hot key. Null items are no items.
    """
    each = items.filter(F.col(item).isNotNull()).select(F.col(basket).alias("b"), F.col(item).alias("i")).distinct()
    norms = each.groupBy("i").agg(F.count("*").alias("n"))
    sets = each.join(norms, "i").groupBy("b").agg(F.sort_array(F.collect_list(F.struct("n", "i"))).alias("s"))
    # In ascending order of n, the partners of an item are those after it up to n / least**2.
    near = F.expr(f"transform(s, (x, k) -> struct(x AS x, filter(slice(s, k + 2, size(s)), y -> y.n * {least * least}D <= x.n * (1D + 1e-9D)) AS ys))")
    pairs = sets.select(F.explode(near).alias("p")).select("p.x", F.explode("p.ys").alias("y"))
    both = pairs.groupBy(F.col("x.i").alias("a"), F.col("y.i").alias("c"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(F.count("*").alias("together"))
    cosine = both.withColumn("similarity", F.col("together") / F.sqrt(F.col("n").cast("double") * F.col("m"))).filter(F.col("similarity") >= least)
    ways = F.array(F.struct(F.col("a").alias("item"), F.col("c").alias("other")), F.struct(F.col("c").alias("item"), F.col("a").alias("other")))
    return cosine.select(F.explode(ways).alias("w"), "similarity").select("w.item", "w.other", "similarity")


def basket_features(baskets: DataFrame, vectors: DataFrame, size: int, dims: int, key: str = "basket_id") -> DataFrame:
    """(key, features): the vectors of a basket's items one after the other, in order, those without a vector left out, zeros up to `size`.

    baskets: key, items (array); vectors: item, vector. No more than size / dims items count.
    """
    most = size // dims
    each = baskets.select(key, F.posexplode_outer("items").alias("place", "item")).join(vectors, "item", "left")
    got = each.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("vector").isNotNull(), F.struct("place", "vector")))).alias("v"))
    flat = F.flatten(F.transform(F.slice("v", 1, most), lambda x: x["vector"].cast("array<double>")))
    return got.select(key, F.concat(flat, F.array_repeat(F.lit(0.0), size - F.size(flat))).alias("features"))


def contextual(similar: DataFrame, current: DataFrame, viewed: DataFrame, k: int = 5, key: str = "session_id", parts: int | None = None) -> DataFrame:
    """Top items by similarity to the current one plus half of that to viewed ones; viewed and current ones left out.

    Keys are cut into `parts` (as many as shuffles have, if not given) by hash. Keys and similar items meet as arrays, one row an item and part, and are paired only where all items of
    a part's keys are, so that a task sums the scores of one part's keys and not of all keys that have its items.
    """
    parts = parts or int(similar.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = current.select(key, "item", F.lit(1.0).alias("w")).unionByName(viewed.select(key, "item", F.lit(0.5).alias("w")))
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("__part")
    keys = w.select("item", part, F.struct(key, "w").alias("__k")).groupBy("item", "__part").agg(F.collect_list("__k").alias("__ks"))
    others = similar.groupBy("item").agg(F.collect_list(F.struct("other", "similarity")).alias("__os"))
    met = keys.join(others, "item").select("__part", "__ks", "__os").repartition(parts, "__part")
    met = met.select("__part", F.explode("__ks").alias("__k"), "__os").select("__part", F.col(f"__k.{key}").alias(key), F.col("__k.w").alias("w"), F.explode("__os").alias("__o"))
    got = met.groupBy("__part", key, F.col("__o.other").alias("other")).agg(F.sum(F.col("w") * F.col("__o.similarity")).alias("score")).drop("__part")
    have = w.select(key, F.col("item").alias("other")).distinct()
    return top(got.join(have, [key, "other"], "left_anti"), k, [key], [F.desc(F.round("score", TIE)), "other"])


def model_lookup(events: DataFrame, models: DataFrame, defaults: list[str]) -> DataFrame:
    """Each event with the recommendations of the model valid at its time: none yet, no row; product unknown, the defaults.

    models: version, accuracy, valid_from, product_id, recs (array). The versions travel as one row, a sorted array.
    """
    versions = models.select("version", "accuracy", "valid_from").distinct().agg(F.array_sort(F.collect_list(F.struct("valid_from", "version", "accuracy"))).alias("__all"))
    at = events.join(F.broadcast(versions)).withColumn("__v", F.expr("try_element_at(filter(__all, v -> v.valid_from <= us), -1)")).filter("__v is not null")
    at = at.select(*events.columns, "__v.version", "__v.accuracy", "__v.valid_from")
    recs = models.select("version", "product_id", "recs")
    return at.join(recs, ["version", "product_id"], "left").withColumn("recs", F.coalesce("recs", F.array(*map(F.lit, defaults))))


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: str, valid_from: str, values: list[str]) -> DataFrame:
    """rows with the version of their key valid at their time (left): one tagged union, one window, no range join.

    At equal times the version counts.
    """
    tag = rows.withColumn("__t", F.lit(1)).withColumn("__at", F.col(at))
    old = versions.select(F.col(key), F.col(valid_from).alias("__at"), F.struct(*values).alias("__v")).withColumn("__t", F.lit(0))
    w = W.partitionBy(key).orderBy("__at", "__t").rowsBetween(W.unboundedPreceding, 0)
    both = tag.unionByName(old, allowMissingColumns=True).withColumn("__got", F.last("__v", ignorenulls=True).over(w))
    return both.filter("__t = 1").select(*rows.columns, *(F.col(f"__got.{v}").alias(v) for v in values))


def merge_models(by_product: Column, by_user: Column, n: int = 3, m: int = 2) -> Column:
    """First n of one list and first m of the other without repeats; null unless both are there."""
    return F.when(by_product.isNotNull() & by_user.isNotNull(), F.array_distinct(F.concat(F.slice(by_product, 1, n), F.slice(by_user, 1, m))))


def first_rule(rows: DataFrame, rules: list[tuple[int, str, list[str], str]], text: str) -> DataFrame:
    """rows with the action of the first rule by priority that has a word in the text; rules: (priority, name, words, action)."""
    action, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for _, rule, words, what in sorted(rules, reverse=True):
        hit = F.lower(text).rlike("|".join(f"\\Q{w.lower()}\\E" for w in words))
        action, name = F.when(hit, what).otherwise(action), F.when(hit, rule).otherwise(name)
    return rows.withColumn("action", F.coalesce(action, F.lit("ALLOW"))).withColumn("rule", name)


def embeddings(spark, products: int = 500, dims: int = 32, seed: int = 42, scale: float = 0.1) -> DataFrame:
    """Initial item vectors of normal draws."""
    return spark.range(products).select(F.col("id").alias("item"), F.array(*((F.randn(seed + i) * scale).cast("float") for i in range(dims))).alias("vector"))


def model_update(old: DataFrame, new_baskets: DataFrame) -> DataFrame:
    """Item and pair counts after more baskets: old (kind, a, b, n) merged with the counts of the new ones."""
    items = new_baskets.groupBy("basket_id").agg(F.collect_set("item").alias("s"))
    single = items.select(F.explode("s").alias("a")).groupBy("a").agg(F.count("*").alias("n")).select(F.lit("item").alias("kind"), "a", F.lit("").alias("b"), "n")
    pair = items.select("s", F.explode("s").alias("a")).select("a", F.explode("s").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")).select(F.lit("pair").alias("kind"), "a", "b", "n")
    return old.unionByName(single).unionByName(pair).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def in_force(rules: DataFrame, at_us: Column, expires: str = "expires_us") -> DataFrame:
    """Rules that have not expired at a time; a rule without an end stays."""
    return rules.filter(F.col(expires).isNull() | (F.col(expires) > at_us))


def flagged(rows: DataFrame, flag: str, percent: int, user: str = "user_id", always: tuple[str, ...] = ()) -> DataFrame:
    """rows with `enabled`: whether a flag is on for their user, a stable share of users and those always in."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{flag}|"), F.col(user).cast("string"))), 1, 8), 16, 10).cast("long") % 100
    on = F.coalesce(draw < percent, F.lit(False))
    return rows.withColumn("enabled", on | F.coalesce(F.col(user).cast("string").isin(*always), F.lit(False)) if always else on)


def permitted(rows: DataFrame, grants: DataFrame, role: str, action: str) -> DataFrame:
    """rows whose role may do their action; grants: (role, action), kept distinct."""
    return rows.join(grants.select(F.col("role").alias(role), F.col("action").alias(action)).distinct(), [role, action], "left_semi")


def rate_limited(rows: DataFrame, most: int, within_us: int, key: str, at: str = "us") -> DataFrame:
    """rows with `limited`: more than `most` rows of the key in the period that ends with them; equal times count together."""
    w = W.partitionBy(key).orderBy(at).rangeBetween(-within_us, 0)
    return rows.withColumn("limited", F.count("*").over(w) > most)


def looked_up(rows: DataFrame, table: DataFrame, key: str, defaults: dict) -> DataFrame:
    """rows with the columns of a table that has one row a key, as it stands when the job runs; keys it lacks take the defaults."""
    return rows.join(table, key, "left").fillna(defaults)
