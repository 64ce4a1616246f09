"""The usage trend as a stream (an addition: the batch report is in operators.usage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import store


def trend(runs: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Runs and tokens saved by tumbling windows of event time; rows later than the watermark are dropped."""
    timed = runs.withColumn("ts", F.timestamp_seconds("recorded_at")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length)).agg(F.count("*").alias("invocations"), F.sum("token_saved").alias("token_saved"), F.avg("reduction_pct").alias("reduction_pct_avg"))


def into_log(path: str, stream: str):
    """A function for foreachBatch that adds each batch of runs to the usage log in one step, with its number: a batch that
    is replayed after a crash adds nothing."""

    def add(rows: DataFrame, number: int) -> None:
        store.append_runs(rows, path, (stream, number))

    return add
