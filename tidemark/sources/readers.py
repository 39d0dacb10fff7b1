"""Sources: files, hybrids of history and live data, generators, and adapters to outside systems.

Adapters build option maps or Python data sources and import nothing that may be missing; they are used
only when asked for.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# -- files --------------------------------------------------------------------------------------


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a file, the whole file as `value`."""
    return spark.read.text(paths, wholetext=True)


def json_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).text(path)


def csv(spark: SparkSession, path: str, header: bool = True, delimiter: str | None = None) -> DataFrame:
    """A CSV file with column types inferred; the delimiter is the commonest of four in the first line if none is given."""
    if delimiter is None:
        first = spark.read.text(path).first()
        line = first[0] if first else ""
        delimiter = max(",;\t|", key=line.count)
    return spark.read.csv(path, header=header, sep=delimiter, inferSchema=True)


# -- hybrids ------------------------------------------------------------------------------------


def hybrid(history: DataFrame, live: DataFrame) -> DataFrame:
    """History and live rows as one: a static frame and a stream become a stream of both sources' files or topics.

    Both must be batch frames or both streams; a bounded history enters a stream as a file stream, which the
    first micro-batches read to its end.
    """
    if history.isStreaming != live.isStreaming:
        raise ValueError("read the history with readStream to put it before a stream")
    return history.unionByName(live, allowMissingColumns=True)


def backfill_then_stream(history: DataFrame, live: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Run history once through write(batch, -1), then the stream through the same function."""
    write(history, -1)
    return live.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def table_or(spark: SparkSession, name: str, fallback: Callable[[], DataFrame]) -> DataFrame:
    """A catalogue table, or the fallback if there is none."""
    return spark.table(name) if spark.catalog.tableExists(name) else fallback()


#: The patterns that stand in for a missing table (antecedents, consequent, support, confidence, lift, category).
SAMPLES = [
    (["laptop"], "mouse", 0.15, 0.75, 2.1, "electronics"),
    (["laptop"], "keyboard", 0.12, 0.68, 1.9, "electronics"),
    (["phone"], "charger", 0.20, 0.85, 2.8, "electronics"),
    (["shirt"], "pants", 0.25, 0.72, 2.0, "fashion"),
    (["dress"], "shoes", 0.18, 0.76, 2.3, "fashion"),
    (["coffee_maker"], "coffee_beans", 0.22, 0.89, 2.7, "home_kitchen"),
    (["coffee_maker"], "filters", 0.19, 0.81, 2.5, "home_kitchen"),
    (["yoga_mat"], "yoga_blocks", 0.14, 0.67, 2.0, "sports"),
    (["bicycle"], "helmet", 0.23, 0.87, 2.8, "sports"),
]


def stored_patterns(spark: SparkSession, name: str, now_ms: int) -> DataFrame:
    """Patterns of a catalogue table, or the samples if there is none or it lacks a column; a time that is missing is now_ms."""

    def samples() -> DataFrame:
        rows = spark.createDataFrame(SAMPLES, "antecedents array<string>, consequent string, support double, confidence double, lift double, category string")
        return rows.select("*", F.lit(None).cast("string").alias("userId"), F.lit(None).cast("string").alias("sessionId"), F.lit(now_ms).alias("timestamp"))

    wanted = {"antecedents", "consequent", "support", "confidence", "lift", "category", "user_id", "session_id", "created_at"}
    rows = table_or(spark, name, lambda: None)
    if rows is None or not wanted <= set(rows.columns):
        return samples()
    at = F.coalesce(F.unix_millis(F.col("created_at").cast("timestamp")), F.lit(now_ms))
    return rows.select("antecedents", "consequent", "support", "confidence", "lift", "category", F.col("user_id").alias("userId"), F.col("session_id").alias("sessionId"), at.alias("timestamp"))


def since(rows: DataFrame, version: int, column: str = "version") -> DataFrame:
    """Incremental read: rows of versions after one already read; prunes partitions by version."""
    return rows.filter(F.col(column) > version)


#: Fixed value: what stands for a row that cannot be written.
UNKNOWN = '{"antecedents":["unknown"],"consequent":"unknown","support":0.01,"confidence":0.5,"lift":1.0}'


def as_json(rows: DataFrame, fallback: str = "{}") -> DataFrame:
    """Rows as JSON texts; fallback (UNKNOWN for patterns) for a row without any value."""
    empty = F.to_json(F.struct("*"))
    return rows.select(F.when(empty.isNull() | (empty == "{}"), F.lit(fallback)).otherwise(empty).alias("value"))


# -- generators ---------------------------------------------------------------------------------


def points(spark: SparkSession, per_second: int = 5, below: int = 100, seed: int = 42) -> DataFrame:
    """A stream of (value, timestamp); the value follows from the row number, so runs repeat."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.select(F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(below)).cast("int").alias("value"), F.unix_millis("timestamp").alias("timestamp"))


#: Fixed values of the generator: weights of the categories.
CATEGORIES = [("electronics", 0.40), ("fashion", 0.25), ("home_kitchen", 0.20), ("sports", 0.15)]


def _draw(name: str, seed: int):
    """A uniform number in [0, 1) that follows from the row and a name."""
    return (F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).alias(name)


def historical_patterns(spark: SparkSession, templates: DataFrame, n: int = 5000, days: int = 90, seed: int = 42, now_ms: int = 1_700_000_000_000) -> DataFrame:
    """n patterns: a category by weight, a template of it, jittered measures, and a time that favours the recent.

    templates: category, antecedents, consequent, support, confidence, lift. Every draw follows from the row number.
    """
    rows = spark.range(n).select("id", *(_draw(x, seed) for x in ("c", "t", "s", "k", "l", "w")))
    edge, pick = 0.0, F.lit(CATEGORIES[-1][0])
    bounds = []
    for name, weight in CATEGORIES:
        edge += weight
        bounds.append((edge, name))
    for edge, name in reversed(bounds[:-1]):
        pick = F.when(F.col("c") < edge, name).otherwise(pick)
    rows = rows.withColumn("category", pick)
    listed = templates.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("consequent", "antecedents", "support", "confidence", "lift"))).alias("__all"))
    missing = F.raise_error(F.concat(F.lit("no template of category "), F.col("category")))
    rows = rows.join(F.broadcast(listed), "category", "left").withColumn("__all", F.when(F.col("__all").isNull(), missing.cast(listed.schema["__all"].dataType)).otherwise(F.col("__all")))
    rows = rows.withColumn("p", F.expr("__all[cast(floor(t * size(__all)) as int)]"))
    jitter = lambda c, x, by: F.greatest(F.lit(0.0), F.col(f"p.{c}") + (F.col(x) * 2 - 1) * by).alias(c)
    age = F.least(F.lit(1.0), -F.log(1.0 - F.col("w")) / 2)
    return rows.select("category", "p.antecedents", "p.consequent", jitter("support", "s", 0.025), F.least(F.lit(1.0), jitter("confidence", "k", 0.05)).alias("confidence"), jitter("lift", "l", 0.1), (F.lit(now_ms) - (age * days * 86_400_000).cast("long")).alias("timestamp"), F.concat(F.lit("hist_user_"), F.col("id") % 1000).alias("userId"))


#: Fixed values of the generator: price limit (none: all above), least and greatest stock.
STOCK_BANDS = [(50, 50, 200), (200, 20, 100), (500, 10, 50), (None, 5, 25)]


def variants(products: DataFrame) -> DataFrame:
    """Two or three variants a product at 1, 1.2 and 1.5 times the price; stock drawn from the price's band.

    Draws follow from the product and the variant, so runs repeat.
    """
    n = F.when(F.pmod(F.xxhash64("product_id"), F.lit(2)) == 0, 3).otherwise(2)
    rows = products.withColumn("variant", F.explode(F.sequence(F.lit(1), n)))
    rows = rows.withColumn("__price", F.col("price") * F.when(F.col("variant") == 1, 1.0).when(F.col("variant") == 2, 1.2).otherwise(1.5))
    stock = F.lit(None).cast("int")
    for below, lo, hi in reversed(STOCK_BANDS):
        drawn = (lo + F.pmod(F.xxhash64("product_id", "variant", F.lit("stock")), F.lit(hi - lo + 1))).cast("int")
        stock = drawn if below is None else F.when(F.col("__price") < below, drawn).otherwise(stock)
    return rows.withColumn("inventory", stock).withColumn("product_id", F.concat_ws("-", "product_id", "variant")).withColumn("price", F.round("__price", 2)).drop("__price")


# -- adapters -----------------------------------------------------------------------------------


def kafka_options(brokers: str, topics: list[str], group: str | None = None, start: str = "latest") -> dict[str, str]:
    out = {"kafka.bootstrap.servers": brokers, "subscribe": ",".join(topics), "startingOffsets": start}
    return out | ({"kafka.group.id": group} if group else {})


def kafka(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Values as text; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))


def kafka_json(spark: SparkSession, options: dict[str, str], schema: str) -> DataFrame:
    return kafka(spark, options).select(F.from_json("value", schema).alias("v")).select("v.*")


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def debezium(spark: SparkSession, path: str, schema_of_rows: str, stream: bool = False) -> DataFrame:
    """Change rows in Debezium's JSON as files: op, before, after, source; decimals as double in schema_of_rows."""
    kind = f"op string, before struct<{schema_of_rows}>, after struct<{schema_of_rows}>, source struct<table string>, ts_ms bigint"
    return json_lines(spark, path, stream).select(F.from_json("value", kind).alias("c")).select("c.*").filter("op is not null")


def ticker_subscription(products: list[str], channels: tuple[str, ...] = ("ticker",)) -> str:
    """The message that subscribes to a ticker."""
    return json.dumps({"type": "subscribe", "product_ids": products, "channels": list(channels)})


def queue_source(name: str, schema: str, connect: Callable[[], Iterator[tuple]]) -> type[DataSource]:
    """A streaming data source over a push feed (WebSocket, MQTT): connect() gives an endless iterator of rows.

    The driver side takes what has come since the last offset and keeps it until it is committed.
    """

    class Part(InputPartition):
        def __init__(self, rows):
            self.rows = rows

    class Reader(DataSourceStreamReader):
        def __init__(self):
            self.feed, self.kept, self.base, self.at = connect(), [], 0, 0

        def initialOffset(self):
            return {"n": 0}

        def latestOffset(self):
            for row in self.feed:
                if row is None:
                    break
                self.kept.append(row)
                self.at += 1
            return {"n": self.at}

        def partitions(self, start, end):
            return [Part(self.kept[start["n"] - self.base : end["n"] - self.base])]

        def read(self, partition):
            yield from partition.rows

        def commit(self, end):
            del self.kept[: end["n"] - self.base]
            self.base = end["n"]

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def streamReader(self, schema):
            return Reader()

    return Source
