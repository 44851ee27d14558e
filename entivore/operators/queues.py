"""Work-queue semantics over ordered events (job_id, seq, ts, action)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3


def states(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """job_id, status, attempts after all events: enqueue makes a job pending; only pending jobs are claimed; only
    claimed ones finish (done) or fail (attempts + 1: pending again, dead at max_attempts). The rest changes nothing."""
    ordered = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("all"))

    def step(acc, e):
        s, a, n = acc["status"], e["action"], acc["attempts"]
        new = (
            F.when((a == "enqueue") & s.isNull(), "pending")
            .when((a == "claim") & (s == "pending"), "claimed")
            .when((a == "finish") & (s == "claimed"), "done")
            .when((a == "fail") & (s == "claimed"), F.when(n + 1 >= max_attempts, "dead").otherwise("pending"))
            .otherwise(s)
        )
        return F.struct(new.alias("status"), (n + F.when((a == "fail") & F.coalesce(s == "claimed", F.lit(False)), 1).otherwise(0)).cast("int").alias("attempts"))

    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("attempts"))
    return ordered.select("job_id", F.aggregate("all", start, step).alias("x")).select("job_id", F.coalesce("x.status", F.lit("unknown")).alias("status"), F.col("x.attempts").alias("attempts"))


def stale_claims(events: DataFrame, ref_ts: str, seconds: int) -> DataFrame:
    """job_id, last_seen of the jobs that are claimed at ref_ts and whose newest claim or heartbeat is older than seconds."""
    ref = F.lit(ref_ts).cast("timestamp_ntz")
    claimed = states(events.where(F.col("ts") < ref)).where("status = 'claimed'").select("job_id")
    seen = events.where(F.col("action").isin("claim", "heartbeat") & (F.col("ts") < ref)).groupBy("job_id").agg(F.max("ts").alias("last_seen"))
    return seen.where(F.col("last_seen") < ref - F.make_dt_interval(secs=F.lit(seconds))).join(claimed, "job_id", "left_semi")


def claimable(events: DataFrame, now: str, kinds: DataFrame, n: int) -> DataFrame:
    """The n jobs to claim next: pending, of a known kind (kinds: job_id, kind, priority, run_at), due at now; the highest
    priority first, then the longest waiting."""
    pending = states(events).where("status = 'pending'").select("job_id")
    since = events.where("action = 'enqueue'").groupBy("job_id").agg(F.min("ts").alias("waiting_since"))
    ready = since.join(pending, "job_id").join(kinds, "job_id").where(F.col("kind").isNotNull() & (F.col("run_at") <= F.lit(now).cast("timestamp_ntz")))
    return ready.orderBy(F.desc("priority"), "waiting_since", "job_id").limit(n)


def chunk_progress(done: DataFrame, totals: DataFrame) -> DataFrame:
    """job_id, done, total, merges: parts done (job_id, chunk; repeats count once) against the totals; merges: whether the
    last part is in, which happens once."""
    n = done.select("job_id", "chunk").distinct().groupBy("job_id").agg(F.count("*").alias("done"))
    return totals.join(n, "job_id", "left").select("job_id", F.coalesce("done", F.lit(0)).alias("done"), "total", (F.coalesce("done", F.lit(0)) == F.col("total")).alias("merges"))


def still_cached(entries: DataFrame, changes: DataFrame, now: str, seconds: int) -> DataFrame:
    """Cache entries (key, set_key, ts) that are not over their time at now and whose set has not changed since (set_key, ts)."""
    last = changes.groupBy("set_key").agg(F.max("ts").alias("_changed"))
    ref = F.lit(now).cast("timestamp_ntz")
    return entries.join(last, "set_key", "left").where((F.col("ts") > ref - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("_changed").isNull() | (F.col("_changed") < F.col("ts")))).drop("_changed")


def idle_claims(events: DataFrame, now: str, seconds: int, n: int) -> DataFrame:
    """The n claimed jobs that were seen longest ago, over seconds before now."""
    return stale_claims(events, now, seconds).orderBy("last_seen", "job_id").limit(n)


def fan_in(children: DataFrame) -> DataFrame:
    """root, dead, done, total, final_status: failed if all children are dead, running if some are open, else done;
    message says how many failed where some did."""
    g = children.groupBy("root").agg(F.count_if(F.col("status") == "dead").alias("dead"), F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("total"))
    status = F.when(F.col("dead") == F.col("total"), "failed").when(F.col("dead") + F.col("done") < F.col("total"), "running").otherwise("done")
    some = (F.col("final_status") == "done") & (F.col("dead") > 0)
    return g.withColumn("final_status", status).withColumn("message", F.when(some, F.format_string("%d of %d pair(s) failed", "dead", "total")))


def rate_windows(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """job_id, window_start, n, limited for fixed windows of seconds."""
    start = F.window(F.col("ts"), f"{seconds} seconds")["start"]
    return events.groupBy("job_id", start.alias("window_start")).agg(F.count("*").alias("n")).withColumn("limited", F.col("n") > limit)


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """job_id, session_start, session_end (last event), n: runs of events less than a gap apart."""
    before = F.lag("ts").over(Window.partitionBy("job_id").orderBy("ts", "seq"))
    opened = F.when(before.isNull() | (F.col("ts") >= before + F.make_dt_interval(secs=F.lit(gap_seconds))), 1).otherwise(0)
    run = F.sum("opened").over(Window.partitionBy("job_id").orderBy("ts", "seq"))
    return events.withColumn("opened", opened).withColumn("run", run).groupBy("job_id", "run").agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("n")).drop("run")


def timed_states(events: DataFrame, ref_ts: str, seconds: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """job_id, status, attempts, last_seen at ref_ts, of the events before it, where a claim that isn't renewed times out: after
    seconds without a heartbeat the job fails as of that time, and is pending again or dead. Events are in order by seq."""
    before = events.where(F.col("ts") < F.lit(ref_ts).cast("timestamp_ntz"))
    ordered = before.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "ts"))).alias("all"))
    wait = F.make_dt_interval(secs=F.lit(seconds))

    def failed(acc):
        n = (acc["attempts"] + 1).cast("int")
        return F.struct(F.when(n >= max_attempts, "dead").otherwise("pending").alias("status"), n.alias("attempts"), F.lit(None).cast("timestamp_ntz").alias("last_seen"))

    def timed_out(acc, ts):
        return F.when(F.coalesce((acc["status"] == "claimed") & (ts > acc["last_seen"] + wait), F.lit(False)), failed(acc)).otherwise(acc)

    def act(acc, e):
        s, a = acc["status"], e["action"]
        as_is = lambda status, seen: F.struct(status.alias("status"), acc["attempts"].alias("attempts"), seen.alias("last_seen"))
        gone = F.lit(None).cast("timestamp_ntz")
        return (
            F.when((a == "enqueue") & s.isNull(), as_is(F.lit("pending"), gone))
            .when(a.isin("claim", "heartbeat") & F.coalesce(s == "claimed", F.lit(False)), as_is(F.lit("claimed"), F.greatest(acc["last_seen"], e["ts"])))
            .when((a == "claim") & (s == "pending"), as_is(F.lit("claimed"), e["ts"]))
            .when((a == "finish") & (s == "claimed"), as_is(F.lit("done"), gone))
            .when((a == "fail") & (s == "claimed"), failed(acc))
            .otherwise(acc)
        )

    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp_ntz").alias("last_seen"))
    step = lambda acc, e: F.transform(F.array(timed_out(acc, e["ts"])), lambda x: act(x, e))[0]
    folded = ordered.select("job_id", F.aggregate("all", start, step).alias("x")).select("job_id", timed_out(F.col("x"), F.lit(ref_ts).cast("timestamp_ntz")).alias("x"))
    return folded.select("job_id", F.coalesce("x.status", F.lit("unknown")).alias("status"), "x.attempts", "x.last_seen")


def closings(children: DataFrame, ended: DataFrame) -> DataFrame:
    """root, closed_at, closed_by, total, dead, final_status, message of the roots all of whose children (root, child) have
    ended (root, child, ts, seq, status: done or dead): the one event that closes a root is the last first end of a child.

    Ends of a child beyond its first count for nothing. Sums and maxima only: a root may have any number of children."""
    first = ended.groupBy("root", "child").agg(F.min(F.struct("ts", "seq", "status")).alias("e"))
    ends = first.groupBy("root").agg(F.count("*").alias("ended"), F.count_if(F.col("e.status") == "dead").alias("dead"), F.max(F.struct("e.ts", "e.seq", "child")).alias("last"))
    total = children.select("root", "child").distinct().groupBy("root").agg(F.count("*").alias("total"))
    out = total.join(ends, "root").where("ended = total").withColumn("final_status", F.when(F.col("dead") == F.col("total"), "failed").otherwise("done"))
    message = F.when((F.col("final_status") == "done") & (F.col("dead") > 0), F.format_string("%d of %d pair(s) failed", "dead", "total"))
    return out.select("root", F.col("last.ts").alias("closed_at"), F.col("last.child").alias("closed_by"), "total", "dead", "final_status", message.alias("message"))
