"""Sinks: JSON and envelopes to Kafka, upserts into versioned Parquet, and fan-out of one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def to_json(rows: DataFrame, key: str | None = None) -> DataFrame:
    """key and value columns for a Kafka sink; a row that cannot be written becomes {}."""
    value = F.coalesce(F.to_json(F.struct("*")), F.lit("{}")).alias("value")
    return rows.select(F.col(key).cast("string").alias("key"), value) if key else rows.select(value)


def enveloped(rows: DataFrame, kind: str, timestamp: str = "timestamp") -> DataFrame:
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("eventType"), F.struct(*rows.columns).alias("payload"), F.col(timestamp).alias("timestamp"))).alias("value"))


def assistant_message(rows: DataFrame) -> DataFrame:
    """{type, sessionId, text, recommendedProducts, timestamp}."""
    return rows.select(F.coalesce(F.to_json(F.struct(F.lit("ASSISTANT").alias("type"), "sessionId", "text", "recommendedProducts", "timestamp")), F.lit("{}")).alias("value"))


def kafka(rows: DataFrame, brokers: str, topic: str, checkpoint: str):
    """At least once: offsets are committed after the write."""
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def append(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """A stream's rows appended as Parquet, exactly once by the sink's own log."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def console(rows: DataFrame, lines: int = 20):
    """A stream's rows printed batch by batch; lines: how many of each batch."""
    return rows.writeStream.format("console").option("truncate", "false").option("numRows", lines).start()


def pattern_rows(patterns: DataFrame) -> DataFrame:
    """Patterns as stored: id, and times of second precision from milliseconds."""
    at = F.timestamp_seconds(F.floor(F.col("timestamp") / 1000))
    return patterns.select(F.concat(F.array_join("antecedents", ","), F.lit("_"), "consequent").alias("pattern_id"), "antecedents", "consequent", "support", "confidence", "lift", "category", F.col("userId").alias("user_id"), F.col("sessionId").alias("session_id"), at.alias("created_at"), at.alias("event_time"))


class VersionedTable:
    """A keyed table as Parquet folders `version=n`: an upsert rewrites only the buckets it touches.

    A null key is a key like others. A reader takes of each bucket the newest version up to the one asked for, so old snapshots stay readable
    until they expire. Rows within a version are unique by key.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 4):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path)) if s.isDirectory()]
        # A version without its marker is an attempt that did not finish.
        return sorted(int(n[8:]) for n in names if n.startswith("version=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        own = [v for v in self.versions() if version is None or v <= version]
        if not own:
            return None
        rows = None
        for v in own:
            one = self.spark.read.parquet(f"{self.path}/version={v}").withColumn("__version", F.lit(v))
            rows = one if rows is None else rows.unionByName(one)
        newest = rows.groupBy("__bucket").agg(F.max("__version").alias("__version"))
        return rows.join(F.broadcast(newest), ["__bucket", "__version"]).drop("__bucket", "__version")

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, order: list, keep: Callable | None = None) -> int:
        """Write rows over those of equal key; of several new ones the first by order. Returns the version.

        keep(old, new): a condition on columns o_... and n_... by which the new row wins; always, if None.
        """
        w = W.partitionBy(self.key).orderBy(*order)
        new = rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
        version = (self.versions() or [0])[-1] + 1
        old = self.read()
        if old is not None:
            touched = new.select(self._bucket().alias("__bucket")).distinct()
            held = old.withColumn("__bucket", self._bucket()).join(F.broadcast(touched), "__bucket", "left_semi").drop("__bucket")
            if keep is not None:
                # Column by column pairs, so the condition can see both sides.
                a = held.select(*(F.col(c).alias(f"o_{c}") for c in held.columns))
                b = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns))
                a, b = a.withColumn("__o", F.lit(True)), b.withColumn("__n", F.lit(True))
                j = a.join(b, F.col(f"o_{self.key}").eqNullSafe(F.col(f"n_{self.key}")), "full")
                wins = F.col("__o").isNull() | (F.col("__n").isNotNull() & keep())
                new = j.select(*(F.when(wins, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in new.columns))
            else:
                new = held.join(new.select(F.col(self.key).alias("__k")), F.col(self.key).eqNullSafe(F.col("__k")), "left_anti").select(*new.columns).unionByName(new)
        new.withColumn("__bucket", self._bucket()).repartition(self.buckets, "__bucket").write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return version

    def expire(self, least: int = 10) -> list[int]:
        """Compact, then drop all but the newest `least` versions. Returns what is left."""
        rows = self.read()
        if rows is None:
            return []
        version = self.versions()[-1] + 1
        rows.withColumn("__bucket", self._bucket()).repartition(self.buckets, "__bucket").write.mode("overwrite").parquet(f"{self.path}/version={version}")
        fs, path = self._fs()
        for v in self.versions()[:-least]:
            fs.delete(path(f"{self.path}/version={v}"), True)
        return self.versions()


def fan_out(writes: dict[str, Callable[[DataFrame], None]], column: str = "channel") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the batch is computed once and each channel's rows go to their own writer."""

    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for channel, write in writes.items():
                write(batch.filter(F.col(column) == channel))
        finally:
            batch.unpersist()

    return run
