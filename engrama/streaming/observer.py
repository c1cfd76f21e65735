"""Streaming observer: windowed rates, per-user online statistics, and op-log folding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rates(events: DataFrame, width: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per sliding window and kind; rows later than the watermark are dropped, which bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "kind").agg(F.count("*").alias("n"))


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def online_statistics(events: DataFrame, alpha: float = 0.2, late: str = "10 minutes", idle: str = "7 days") -> DataFrame:
    """Per user: events so far, EWMA of `value`, its variance, and the last z-score taken before each update.

    State is four numbers a user and is dropped after `idle` of event time without events.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, mean, var, last = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        for x in rows["value"].astype(float):
            diff = x - mean
            last = 0.0 if n < 3 or var**0.5 < 1e-10 else diff / var**0.5
            mean, var = (x, 0.0) if n == 0 else (mean + alpha * diff, (1 - alpha) * (var + alpha * diff * diff))
            n += 1
        state.update((n, mean, var, last))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(mark, int(rows["ts"].max().timestamp() * 1000)) + int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [mean], "var": [var], "z": [last]})

    return (
        events.withWatermark("ts", late)
        .groupBy("user_id")
        .applyInPandasWithState(update, "user_id long, n long, mean double, var double, z double", "n long, mean double, var double, z double", "update", GroupStateTimeout.EventTimeTimeout)
    )


def fold_oplog(ops: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch's new operations to the log at `path`, idempotently by op_id."""

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["op_id"])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            fresh = fresh.join(spark.read.parquet(path).select("op_id"), "op_id", "left_anti")
        fresh.write.mode("append").parquet(path)

    return ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
