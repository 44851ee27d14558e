"""The queue operators over streams; their batch twins are in entivore.operators.queues."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from entivore.operators.queues import MAX_ATTEMPTS


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files in path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def rate_windows(events: DataFrame, seconds: int, limit: int, lateness: str = "1 day") -> DataFrame:
    """job_id, window_start, n, limited of each window that the watermark closes."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    g = timed.groupBy("job_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return g.select("job_id", F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("limited"))


def sessions(events: DataFrame, gap_seconds: int, lateness: str = "1 day") -> DataFrame:
    """job_id, session_start, n of each session that the watermark closes."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    g = timed.groupBy("job_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return g.select("job_id", F.col("w.start").alias("session_start"), "n")


def _advance(status: str | None, attempts: int, action: str, max_attempts: int) -> tuple[str | None, int]:
    if action == "enqueue" and status is None:
        return "pending", attempts
    if action == "claim" and status == "pending":
        return "claimed", attempts
    if action == "finish" and status == "claimed":
        return "done", attempts
    if action == "fail" and status == "claimed":
        return ("dead" if attempts + 1 >= max_attempts else "pending"), attempts + 1
    return status, attempts


def states(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """job_id, status, attempts of each job that a micro-batch touches; events of a job arrive in order of batches."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("", 0)
        status = status or None
        rows = pd.concat(list(parts)).sort_values("seq")
        for action in rows["action"]:
            status, attempts = _advance(status, attempts, action, max_attempts)
        state.update((status or "", attempts))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status or "unknown"], "attempts": [attempts]})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, status string, attempts int", "status string, attempts int", "update", GroupStateTimeout.NoTimeout)
