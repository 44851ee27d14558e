"""Streams with timers against their batch twins."""

import datetime as dt
import random

import pytest

from entivore.operators import queues as U
from entivore.streaming import jobs as S
from entivore.streaming.queues import read_events

SCHEMA = "job_id long, seq long, ts timestamp_ntz, action string"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def saved(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def drained(spark, df, name, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    return spark.table(name).collect()


def test_timers_fire_without_events(spark, tmp_path, store):
    rng = random.Random(4)
    rows = []
    for job in range(30):
        at = START
        for k, action in enumerate(["enqueue", *rng.choices(["claim", "heartbeat", "fail", "finish"], [5, 4, 2, 1], k=9)]):
            at += dt.timedelta(seconds=rng.choice([5, 20, 61, 300]))
            rows.append((job, 100 * job + k, at, action))
    steps = [START + dt.timedelta(seconds=s) for s in (200, 500, 900, 2000, 4000)]
    for n, ref in enumerate(steps):
        due = [r for r in rows if r[2] < ref and (n == 0 or r[2] >= steps[n - 1])]
        # a beat of another job moves the watermark to the reference time
        saved(spark, [*due, (-1, n, ref, "heartbeat")], SCHEMA, tmp_path / "in")
        out = drained(spark, S.timed_states(read_events(spark, str(tmp_path / "in"), SCHEMA), 60), f"jobs{n}", tmp_path / f"run{n}")
        got = {r.job_id: (r.status, r.attempts, r.last_seen) for r in out if r.job_id >= 0}
        batch = U.timed_states(spark.createDataFrame(rows, SCHEMA), str(ref), 60)
        assert got == {r.job_id: (r.status, r.attempts, r.last_seen) for r in batch.collect()}
    assert any(r.by_timer and r.status == "dead" for r in out) and any(r.by_timer and r.status == "pending" for r in out)


def test_roots_close_once(spark, tmp_path, store):
    rng = random.Random(9)
    schema = "root long, child long, ts timestamp_ntz, seq long, status string"
    batches = [[] for _ in range(4)]
    for root in range(12):
        n = rng.randint(1, 6)
        batches[0] += [(root, c, START, c, "open") for c in range(n)]
        for c in range(n):
            for _ in range(rng.randint(0, 2) if root % 4 == 0 else rng.randint(1, 2)):
                k = rng.randint(1, 3)
                batches[k].append((root, c, START + dt.timedelta(seconds=100 * k + rng.randint(0, 99)), rng.randint(0, 10**6), rng.choice(["done", "dead"])))
    for b in batches:
        saved(spark, b, schema, tmp_path / "in")
    out = drained(spark, S.closings(read_events(spark, str(tmp_path / "in"), schema)), "closings", tmp_path)
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = U.closings(every.where("status = 'open'"), every.where("status != 'open'")).collect()
    assert 0 < len(want) < 12 and sorted(map(tuple, out)) == sorted(map(tuple, want))


def test_published_batches_are_there_once(spark, tmp_path):
    for k in range(3):
        saved(spark, [(k, k, START, "enqueue")], SCHEMA, tmp_path / "in")
    stream = lambda: read_events(spark, str(tmp_path / "in"), SCHEMA)
    for checkpoint in ("a", "b"):  # all batches run again, as after a lost checkpoint
        assert S.publish(stream(), str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.job_id for r in rows) == [0, 1, 2] and {r.batch for r in rows} == {0, 1, 2}
    got = drained(spark, S.published(spark, str(tmp_path / "out"), SCHEMA), "published", tmp_path)
    assert sorted((r.job_id, r.batch) for r in got) == sorted((r.job_id, r.batch) for r in rows)
