"""Jobs in a stream with timers: time-outs, dead letters and closings happen without an event.

The batch twins are timed_states and closings in entivore.operators.queues. State lies in
Spark's RocksDB store (set spark.sql.streaming.stateStore.providerClass), keyed by job or root."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from entivore.operators.queues import MAX_ATTEMPTS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.datetime(1970, 1, 1)


def _ms(ts: dt.datetime) -> int:
    return (ts - _EPOCH) // dt.timedelta(milliseconds=1)


class _Job(StatefulProcessor):
    """status, attempts and when the job was last seen; one timer, for when a claim that isn't renewed times out."""

    def __init__(self, seconds: int, max_attempts: int):
        self.wait, self.max_attempts = dt.timedelta(seconds=seconds), max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, attempts int, seen timestamp_ntz")

    def _failed(self, attempts: int) -> tuple[str, int, None]:
        return ("dead" if attempts + 1 >= self.max_attempts else "pending"), attempts + 1, None

    def _act(self, now: tuple, action: str, ts: dt.datetime) -> tuple:
        status, attempts, seen = now
        if status == "claimed" and ts > seen + self.wait:
            status, attempts, seen = self._failed(attempts)
        if action == "enqueue" and status is None:
            return "pending", attempts, None
        if status == "claimed" and action in ("claim", "heartbeat"):
            return status, attempts, max(seen, ts)
        if status == "pending" and action == "claim":
            return "claimed", attempts, ts
        if status == "claimed" and action == "finish":
            return "done", attempts, None
        if status == "claimed" and action == "fail":
            return self._failed(attempts)
        return status, attempts, seen

    def _keep(self, key, now: tuple, fired: bool) -> Iterator[Row]:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.state.update(now)
        if now[2] is not None:
            self.handle.registerTimer(_ms(now[2] + self.wait))
        yield Row(job_id=key[0], status=now[0] or "unknown", attempts=now[1], last_seen=now[2], by_timer=fired)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = tuple(self.state.get()) if self.state.exists() else (None, 0, None)
        for r in sorted(rows, key=lambda r: r.seq):
            now = self._act(now, r.action, r.at)
        yield from self._keep(key, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, attempts, seen = self.state.get()
        if status == "claimed" and timerValues.getCurrentWatermarkInMs() > _ms(seen + self.wait):
            yield from self._keep(key, self._failed(attempts), True)
        elif status == "claimed":  # exactly on time: not yet over
            self.handle.registerTimer(_ms(seen + self.wait) + 1)

    def close(self) -> None:
        pass


def timed_states(events: DataFrame, seconds: int, lateness: str = "0 seconds", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """job_id, status, attempts, last_seen, by_timer: a row whenever a batch or a timer changes a job (job_id, seq, ts, action);
    the newest row of each job is its state when the watermark is the reference time. Events of a job come in order of
    batches, and within one in order of seq."""
    timed = events.withColumn("at", F.col("ts")).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    kind = events.schema["job_id"].dataType.simpleString()
    out = f"job_id {kind}, status string, attempts int, last_seen timestamp_ntz, by_timer boolean"
    return timed.groupBy("job_id").transformWithState(_Job(seconds, max_attempts), out, "Update", "EventTime")


class _Root(StatefulProcessor):
    """How many children a root has and which of them have ended; the close is emitted once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "total int, ended int, dead int, closed boolean, ts timestamp_ntz, seq long, child long")
        self.children = handle.getMapState("children", "child long", "ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, ended, dead, closed, *last = self.counts.get() if self.counts.exists() else (0, 0, 0, False, None, None, None)
        for r in sorted(rows, key=lambda r: (r.status != "open", r.at, r.seq)):
            known = self.children.containsKey((r.child,))
            if not known:
                total += 1
                self.children.updateValue((r.child,), (False,))
            if r.status != "open" and not (known and self.children.getValue((r.child,))[0]):
                self.children.updateValue((r.child,), (True,))
                ended, dead = ended + 1, dead + (r.status == "dead")
                last = max(last, [r.at, r.seq, r.child]) if last[0] is not None else [r.at, r.seq, r.child]
        if ended == total and not closed:
            closed = True
            message = f"{dead} of {total} pair(s) failed" if 0 < dead < total else None
            yield Row(root=key[0], closed_at=last[0], closed_by=last[2], total=total, dead=dead, final_status="failed" if dead == total else "done", message=message)
        self.counts.update((total, ended, dead, closed, *last))

    def close(self) -> None:
        pass


def closings(events: DataFrame) -> DataFrame:
    """The one closing of each root, when its last open child has ended: events (root, child, ts, seq, status: open, done, dead),
    all children of a root being opened in the batch of the first or before any of them ends."""
    kind = events.schema["root"].dataType.simpleString()
    out = f"root {kind}, closed_at timestamp_ntz, closed_by long, total int, dead int, final_status string, message string"
    return events.withColumn("at", F.col("ts")).groupBy("root").transformWithState(_Root(), out, "Update", "None")


def publish(stream: DataFrame, path: str, checkpoint: str):
    """Writes each batch of a stream to a folder of its own, named by the batch's number: a batch that runs again replaces what
    it wrote before, so every row is there once. Returns the query, which ends when all that is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of what publish() has written; batch tells which."""
    return spark.readStream.schema(f"{schema}, batch long").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", False).parquet(path)
