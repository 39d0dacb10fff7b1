"""History and live stream with a switch point, ended at each phase."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources.handover import Handover

SCHEMA = "id bigint, at bigint, v string"


class Source:
    """A live topic as a folder of files whose rows have rising offsets (`at`)."""

    def __init__(self, spark, path):
        self.spark, self.path, self.end = spark, path, 0

    def push(self, ids):
        self.spark.createDataFrame([(i, self.end + k, f"v{i}") for k, i in enumerate(ids)], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.end += len(ids)
        time.sleep(0.05)

    def live(self, position):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path).filter(F.col("at") >= position)


@pytest.mark.parametrize("ends", ["nowhere", "before the history", "within the history", "between the phases", "within the live phase"])
def test_no_row_lost_or_doubled(spark, tmp_path, ends):
    source = Source(spark, str(tmp_path / "live"))
    source.push(range(10))
    broken = {"on": ends == "within the history"}

    def history():
        """The store as it is when it is read: it also holds what came after the position was taken."""
        rows = spark.read.schema(SCHEMA).parquet(source.path)
        return rows.withColumn("v", F.when(F.col("id") == 5, F.raise_error(F.lit("killed"))).otherwise(F.col("v"))) if broken["on"] else rows

    def job():
        return Handover(spark, str(tmp_path / "job"), "id", history, lambda: source.end, source.live, lambda at: F.col("at") >= at)

    def finish(j):
        j.backfill()
        assert j.follow().awaitTermination(120)

    first = job()
    assert first.switch_point() == 10
    source.push(range(10, 14))  # between the position and the read of the history: in both
    if ends == "before the history":
        with pytest.raises(ValueError):
            first.follow()
    elif ends == "within the history":
        with pytest.raises(Exception, match="killed"):
            first.backfill()
        broken["on"] = False
        source.push(range(14, 16))
    elif ends == "between the phases":
        first.backfill()
        source.push(range(14, 17))
    elif ends == "within the live phase":
        first.backfill()
        source.push(range(14, 16))
        assert first.follow().awaitTermination(120)
    source.push(range(20, 23))
    finish(job())  # a new process: all it knows is in the folder
    source.push(range(30, 32))
    finish(job())
    got = sorted(r.id for r in job().rows().collect())
    want = sorted(r.id for r in spark.read.schema(SCHEMA).parquet(source.path).collect())
    assert got == want and len(set(got)) == len(got)
    assert job().switch_point() == 10
    history_ids = {r.id for r in job().rows().filter("part = 'history'").collect()}
    assert set(range(14)) <= history_ids
