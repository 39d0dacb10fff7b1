"""History first, then the live stream, with a switch point: no row is lost between the two, and none comes twice.

The live source's position is captured and written down before the history is read; the live stream is read from there. What
both hold, because it was written while the history was read, is taken from the history: live rows whose id the history has in
its overlap are left out. The position, the history and each live batch are written once under their own names, so a job that is
killed anywhere, between the phases too, goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_position(spark: SparkSession, options: dict[str, str]) -> str:
    """The ends of a topic's partitions as Kafka's startingOffsets; partitions without rows are not in it."""
    ends = spark.read.format("kafka").options(**options).load().groupBy("topic", "partition").agg(F.max("offset") + 1).collect()  # a row a partition
    out: dict[str, dict[str, int]] = {}
    for topic, partition, end in ends:
        out.setdefault(topic, {})[str(partition)] = end
    return json.dumps(out)


class Handover:
    """history() gives the rows of the past; position() where the live source stands (anything JSON can hold); live(position) its stream from there.

    overlap(position) is a condition on the history's rows: those that the live stream may bring again (all, if left out).
    """

    def __init__(self, spark: SparkSession, path: str, key: str, history: Callable[[], DataFrame], position: Callable[[], object], live: Callable[[object], DataFrame], overlap: Callable | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.history, self.position, self.live, self.overlap = history, position, live, overlap

    def _complete(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def switch_point(self) -> object:
        """The position, captured at the first call of all."""
        if not self._complete("position"):
            self.spark.createDataFrame([(json.dumps(self.position()),)], "position string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/position")
        return json.loads(self.spark.read.parquet(f"{self.path}/position").first()[0])

    def backfill(self) -> None:
        """Write the history, unless it is there; the switch point comes before it."""
        self.switch_point()
        if not self._complete("rows/part=history"):
            self.history().write.mode("overwrite").parquet(f"{self.path}/rows/part=history")

    def follow(self, **trigger):
        """Start the live stream from the switch point; a batch that runs again replaces its rows."""
        at = self.switch_point()
        if not self._complete("rows/part=history"):
            raise ValueError("the history is not complete")
        held = self.spark.read.parquet(f"{self.path}/rows/part=history")
        ids = (held.filter(self.overlap(at)) if self.overlap else held).select(self.key)

        def run(batch: DataFrame, n: int) -> None:
            batch.join(ids, self.key, "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{self.path}/rows/part=live-{n}")

        return self.live(at).writeStream.foreachBatch(run).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def rows(self) -> DataFrame:
        """Everything so far, with `part`: history, or the batch."""
        return self.spark.read.parquet(f"{self.path}/rows")
