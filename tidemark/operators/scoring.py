"""Purchase scoring, feature scaling, splits and evaluation measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import PURCHASE

#: Fixed values of the logistic model: weights, bias, means and deviations of history, value and size.
WEIGHTS, BIAS = [1.8, 3.2, 0.9], -2.5
MEANS, DEVIATIONS = [3.0, 150.0, 5.0], [2.0, 100.0, 3.0]
FEATURES = ["history", "value", "size"]


def features(cols: list[Column]) -> list[Column]:
    return [(c - m) / d for c, m, d in zip(cols, MEANS, DEVIATIONS, strict=True)]


def probability(history: Column, value: Column, size: Column) -> Column:
    """Logistic score of a purchase."""
    z = reduce(lambda a, b: a + b, (x * w for x, w in zip(features([history, value, size]), WEIGHTS, strict=True)), F.lit(BIAS))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def classify(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """rows (user_id, total_value, basket_size, history) with p and channel: INVALID_DATA, HIGH_VALUE or STANDARD."""
    valid = F.col("user_id").isNotNull() & (F.col("total_value") > 0) & (F.col("basket_size") > 0)
    p = F.when(valid, probability(F.col("history"), F.col("total_value"), F.col("basket_size")))
    out = rows.withColumn("p", p)
    return out.withColumn("channel", F.when(~F.coalesce(valid, F.lit(False)), "INVALID_DATA").when(F.col("p") >= threshold, "HIGH_VALUE").otherwise("STANDARD"))


def classify_lines(lines: DataFrame, value: str = "value", threshold: float = 0.5) -> DataFrame:
    """classify() of purchases as JSON texts; what is no JSON object keeps its text and goes to PARSE_ERROR."""
    text = F.col(value)
    sound = F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{")
    p = F.when(sound, F.from_json(text, PURCHASE))
    rows = lines.select(text.alias("value"), p["userId"].alias("user_id"), p["totalValue"].alias("total_value"), F.coalesce(p["basketSize"], F.lit(0)).alias("basket_size"), F.coalesce(p["userPurchaseHistory"], F.lit(0)).alias("history"))
    out = classify(rows, threshold)
    return out.withColumn("channel", F.when(F.coalesce(sound, F.lit(False)), F.col("channel")).otherwise("PARSE_ERROR"))


def three_classes(p: Column, high: float = 0.7, medium: float = 0.4) -> Column:
    return F.when(p >= high, "HIGH").when(p >= medium, "MEDIUM").otherwise("LOW")


def explain(history: Column, value: Column, size: Column) -> tuple[Column, Column]:
    """(map of scaled features, map of importances: the weights' absolute values)."""
    named = [F.lit(n) for n in FEATURES]
    scaled = F.map_from_arrays(F.array(*named), F.array(*features([history, value, size])))
    return scaled, F.map_from_arrays(F.array(*named), F.array(*(F.lit(abs(w)) for w in WEIGHTS)))


def scale(rows: DataFrame, columns: list[str], how: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """columns scaled by max (absolute), minmax, range (to low..high), standard (n - 1) or decimal; `<c>_scaled`.

    The statistics are one row and join by a constant key. A column without spread gives 0.
    """
    agg = []
    for c in columns:
        agg += [F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"), F.max(F.abs(c)).alias(f"{c}__abs"), F.avg(c).alias(f"{c}__avg"), F.stddev_samp(c).alias(f"{c}__sd")]
    stats = rows.agg(*agg).withColumn("__one", F.lit(1))
    out = rows.withColumn("__one", F.lit(1)).join(F.broadcast(stats), "__one")
    for c in columns:
        x, lo, hi, most, avg, sd = (F.col(n) for n in (c, f"{c}__lo", f"{c}__hi", f"{c}__abs", f"{c}__avg", f"{c}__sd"))
        value = {
            "max": F.when(most != 0, x / most),
            "minmax": F.when(hi != lo, (x - lo) / (hi - lo)),
            "range": F.when(hi != lo, (x - lo) / (hi - lo) * (high - low) + low),
            "standard": F.when(sd != 0, (x - avg) / sd),
            "decimal": F.when(most != 0, x / F.pow(F.lit(10.0), F.ceil(F.log10(most)))),
        }[how]
        out = out.withColumn(f"{c}_scaled", F.coalesce(value, F.lit(0.0)))
    return out.select(*rows.columns, *(f"{c}_scaled" for c in columns))


def one_hot(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    return rows.select("*", *((F.col(column).eqNullSafe(F.lit(v))).cast("int").alias(f"{column}_{v}") for v in values))


def folds(rows: DataFrame, key: str, k: int) -> DataFrame:
    """A fold in 0..k-1 by the key's MD5, the same in every run, on every cluster and in other engines."""
    return rows.withColumn("fold", F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % k)


def split(rows: DataFrame, fractions: list[float], seed: int) -> list[DataFrame]:
    return rows.randomSplit(fractions, seed)


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with `draw`, a number from the key and a seed; ordering by (draw, key) is a shuffle that repeats on any cluster."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return rows.withColumn("draw", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"))


#: Buckets of draws that are counted; only those that hold a boundary are ranked.
BUCKETS = 1 << 12


def exact_split(rows: DataFrame, fractions: list[float], key: str, seed: int = 42) -> DataFrame:
    """rows with `part`: of n rows the first int(n * fractions[0]) of the shuffle are part 0, and so on; what is over is null.

    Sizes are exact and do not depend on partitioning: draws are counted by bucket, and rows are ranked only in the few buckets in which a
    part ends. Rows of equal keys are in any order among each other.
    """
    if not fractions or any(f <= 0 for f in fractions) or sum(fractions) > 1 + 1e-9:
        raise ValueError("fractions must be above zero and add up to no more than one")
    drawn = shuffled(rows, key, seed).withColumn("__b", F.shiftright("draw", 60 - 12).cast("int"))
    counts = {r["__b"]: r["n"] for r in drawn.groupBy("__b").agg(F.count("*").alias("n")).collect()}  # BUCKETS rows at most
    total, ends, at = sum(counts.values()), [], 0
    for f in fractions:
        at += int(total * f + 1e-9)
        ends.append(at)
    # For each bucket the number of rows before it; a part that ends inside needs the rank there.
    before, whole, cut = 0, [], []
    for b in range(BUCKETS):
        n = counts.get(b, 0)
        if n and any(before < e < before + n for e in ends):
            cut.append((b, before))
        elif n:
            whole.append((b, next((i for i, e in enumerate(ends) if before < e), None)))
        before += n
    place = F.row_number().over(W.partitionBy("__b").orderBy("draw", key)) + F.element_at(F.create_map(*[F.lit(x) for pair in cut or [(-1, 0)] for x in pair]), F.col("__b")) - 1
    part = F.lit(None).cast("int")
    for i in reversed(range(len(ends))):
        part = F.when(F.col("__place") < ends[i], i).otherwise(part)
    known = drawn.sparkSession.createDataFrame(whole, "__b int, part int")
    settled = drawn.join(F.broadcast(known), "__b").drop("__b", "draw")  # BUCKETS rows at most
    ranked = drawn.filter(F.col("__b").isin([b for b, _ in cut])).withColumn("__place", place).withColumn("part", part).drop("__b", "draw", "__place")
    return settled.unionByName(ranked)


def fit_one_vs_rest(rows: DataFrame, features_: list[str], label: str, classes: list, iterations: int = 50, rate: float = 1.0, penalty: float = 0.0) -> dict:
    """{class: [bias, weights ...]} of logistic models by full gradient steps, all classes in one aggregation a step."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features_)]
    w = {c: [0.0] * len(x) for c in classes}
    for _ in range(iterations):
        sums = []
        for k, c in enumerate(classes):
            z = reduce(lambda a, b: a + b, (v * f for v, f in zip(w[c], x, strict=True)))
            rest = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col(label).eqNullSafe(F.lit(c)).cast("double")
            sums += [F.avg(rest * f).alias(f"g{k}_{j}") for j, f in enumerate(x)]
        g = rows.agg(*sums).first()
        if g[0] is None:
            break
        w = {c: [v - rate * (g[f"g{k}_{j}"] + (penalty * v if j else 0.0)) for j, v in enumerate(w[c])] for k, c in enumerate(classes)}
    return w


def one_vs_rest(rows: DataFrame, features_: list[str], weights: dict) -> DataFrame:
    """rows with `predicted`, the class of the greatest score; the first of equals in the order of weights."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features_)]
    scores = [reduce(lambda a, b: a + b, (F.lit(v) * f for v, f in zip(w, x, strict=True))) for w in weights.values()]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(None)
    for c, s in reversed(list(zip(weights, scores, strict=True))):
        out = F.when(s == best, F.lit(c)).otherwise(out)
    return rows.withColumn("predicted", out)


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def binary_metrics(rows: DataFrame, actual: str, predicted: str, beta: float = 1.0) -> DataFrame:
    """One row of measures of 0/1 columns; a measure without cases is null."""
    a, p = F.col(actual), F.col(predicted)
    c = rows.agg(*(F.count_if((a == x) & (p == y)).cast("double").alias(n) for n, x, y in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))))
    tp, tn, fp, fn = (F.col(n) for n in ("tp", "tn", "fp", "fn"))
    per = lambda x, y: F.when(y != 0, x / y)
    precision, recall = per(tp, tp + fp), per(tp, tp + fn)
    b = beta * beta
    out = {
        "accuracy": per(tp + tn, tp + tn + fp + fn),
        "error": per(fp + fn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "f_beta": per((1 + b) * precision * recall, b * precision + recall),
        "mcc": per(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "balanced": (recall + per(tn, tn + fp)) / 2,
        "fpr": per(fp, fp + tn),
        "fnr": per(fn, fn + tp),
        "fdr": per(fp, fp + tp),
    }
    return c.select(*(F.col(n).cast("long").alias(n) for n in ("tp", "tn", "fp", "fn")), *(v.alias(k) for k, v in out.items()))


def regression_metrics(rows: DataFrame, actual: str, predicted: str, parameters: int = 1) -> DataFrame:
    """n, mse, rmse, rse, r2 and f of a prediction."""
    y, f = F.col(actual), F.col(predicted)
    s = rows.agg(F.count("*").alias("n"), F.sum((y - f) ** 2).alias("rss"), (F.var_samp(y) * (F.count("*") - 1)).alias("tss"))
    n, rss, tss = F.col("n"), F.col("rss"), F.col("tss")
    free = n - parameters - 1
    return s.select("n", (rss / n).alias("mse"), F.sqrt(rss / n).alias("rmse"), F.sqrt(rss / free).alias("rse"), (1 - rss / tss).alias("r2"), (((tss - rss) / parameters) / (rss / free)).alias("f"))
