"""The store of patterns as epochs: one stream writes them, others read each of their batches as of one epoch.

A batch of new patterns makes one epoch, numbered by the batch: a snapshot of the best row of each pattern, the newest of them up to the store's cap. A
reader's batch takes the newest complete epoch at its first attempt and pins it, by batch, in the shared folder; a batch that runs
again after a failure reads the same epoch, so its rows do not change. An update takes effect for all keys at once, with the first batch that
begins after its epoch is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recommend
from ..operators.baskets import ADD, COMPLETE, best_patterns, newest
from ..operators.sessions import VIEW
from .ordered import Ordered, run_ordered

SCHEMA = "pattern_id string, antecedents array<string>, consequent string, confidence double, us bigint"


class PatternStore:
    def __init__(self, spark: SparkSession, path: str, cap: int = 5000):
        self.spark, self.path, self.cap = spark, path.rstrip("/"), cap

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        return hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop.Path

    def epochs(self) -> list[int]:
        """Complete epochs; one without its marker is an attempt that did not finish."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/epochs")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/epochs"))]
        return sorted(int(n) for n in names if fs.exists(path(f"{self.path}/epochs/{n}/_SUCCESS")))

    def read(self, epoch: int | None) -> DataFrame:
        if epoch is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/epochs/{epoch}")

    def apply(self, patterns: DataFrame, epoch: int) -> None:
        """Write the snapshot of an epoch: that of the epoch before with these patterns. Applying an epoch again gives the same."""
        before = [e for e in self.epochs() if e < epoch]
        both = self.read(before[-1] if before else None).unionByName(patterns.select("pattern_id", "antecedents", "consequent", "confidence", "us"))
        rows = newest(best_patterns(both), self.cap).select("pattern_id", "antecedents", "consequent", "confidence", "us")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/epochs/{epoch}")  # no more rows than the cap

    def pinned(self, reader: str, batch: int) -> int | None:
        """The epoch of a reader's batch: that of its first attempt."""
        fs, path = self._fs()
        at = f"{self.path}/pins/{reader}/{batch}"
        if not fs.exists(path(f"{at}/_SUCCESS")):
            known = self.epochs()
            self.spark.createDataFrame([(known[-1] if known else None,)], "epoch bigint").coalesce(1).write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at).first()[0]

    def expire(self, least: int = 10) -> list[int]:
        """Drop all but the newest `least` epochs; what a reader's unfinished batch has pinned must be among them."""
        fs, path = self._fs()
        for e in self.epochs()[:-least]:
            fs.delete(path(f"{self.path}/epochs/{e}"), True)
        return self.epochs()


def learn(patterns: DataFrame, store: PatternStore, checkpoint: str, **trigger):
    """A stream of patterns into the store, an epoch a batch."""
    return patterns.writeStream.foreachBatch(lambda batch, n: store.apply(batch, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class HeldProcessor(Ordered):
    """Adds and views of a key, an add with the different products that the basket holds after it."""

    columns = ["event_id", "event_type", "product_id", "basket"]

    def load(self, text: str | None) -> list[str]:
        return text.split("\x1f") if text else []

    def save(self, held: list[str]) -> str | None:
        return "\x1f".join(held) if held else None

    def event(self, held: list[str], us: int, place: int, row: list) -> list[tuple]:
        kind, product = row
        if kind in COMPLETE["refactored"]:
            held.clear()
        elif kind == ADD and product is not None:
            if product not in held:
                held.append(product)
            return [(place, kind, product, list(held))]
        elif kind == VIEW and product is not None:
            return [(place, kind, product, [])]
        return []


def held(events: DataFrame, late: str = "5 seconds", key: str = "session_id", ts: str = "ts") -> DataFrame:
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    rows = rows.select(F.col(key).cast("string").alias(key), F.col("us").alias("__us"), F.col("event_id").cast("long").alias("__place"), "event_type", "product_id", "__ts")
    return run_ordered(rows, HeldProcessor(key), f"`{key}` string, event_id bigint, event_type string, product_id string, basket array<string>")


def recommendations(rows: DataFrame, patterns: DataFrame, least: float = 0.5, key: str = "session_id") -> DataFrame:
    """Of rows of held(): recommendations for adds and for views."""
    columns = [key, "event_id", "products", "kind", "confidence"]
    adds = recommend.for_held(rows.filter(F.col("event_type") == ADD), patterns, least=least, key=key)
    return adds.select(*columns).unionByName(recommend.for_views(rows, patterns, key=key).select(*columns))


def recommend_stream(events: DataFrame, store: PatternStore, out: str, checkpoint: str, reader: str = "recommend", least: float = 0.5, late: str = "5 seconds", key: str = "session_id", **trigger):
    """Recommendations for a stream of events, batch n as of its pinned epoch, to the folder `out`/batch=n; a batch that runs again replaces its rows."""

    def run(batch: DataFrame, n: int) -> None:
        epoch = store.pinned(reader, n)
        rows = batch.persist()
        try:
            made = recommendations(rows, store.read(epoch), least, key).withColumn("epoch", F.lit(epoch).cast("long"))
            made.write.mode("overwrite").parquet(f"{out}/batch={n}")
        finally:
            rows.unpersist()

    return held(events, late, key).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
