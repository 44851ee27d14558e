"""Work-queue queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from entivore.operators import queues as U
from entivore.sources.tables import queue_events, table

REF = "2024-01-20 00:00:00"
#: A time at which many jobs wait or are claimed.
EARLY = "2024-01-10 00:00:00"


def q_queue_state(spark, sf_dir):
    return U.states(queue_events(spark, sf_dir))


def q_queue_claim(spark, sf_dir):
    """The next ten jobs to claim: pending after all events, longest waiting first."""
    e = queue_events(spark, sf_dir)
    pending = U.states(e).where("status = 'pending'").select("job_id")
    since = e.where("action = 'enqueue'").groupBy("job_id").agg(F.min("ts").alias("waiting_since"))
    return since.join(pending, "job_id").orderBy("waiting_since", "job_id").limit(10)


def q_queue_dequeue(spark, sf_dir):
    """The next ten jobs: kinds and priorities by number, due on the half hour after they are enqueued."""
    e = queue_events(spark, sf_dir).where(F.expr(f"ts < timestamp '{EARLY}'"))
    at = e.where("action = 'enqueue'").groupBy("job_id").agg((F.min("ts") + F.expr("interval 30 minutes")).alias("run_at"))
    kinds = at.select("job_id", "run_at", F.when(F.col("job_id") % 4 != 0, F.lit("known")).alias("kind"), F.pmod("job_id", F.lit(3)).alias("priority"))
    return U.claimable(e, EARLY, kinds, 10).select("job_id", "priority", "waiting_since")


def q_chunk_progress(spark, sf_dir):
    """Orders as jobs: their lines that are finished are chunks done, of as many as they have lines."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("chunk"), "l_linestatus")
    totals = l.groupBy("job_id").agg(F.countDistinct("chunk").alias("total"))
    return U.chunk_progress(l.where("l_linestatus = 'F'"), totals)


def q_cache_live(spark, sf_dir):
    """Views as cached results of a user: live for ten days unless the user bought something since."""
    e = table(spark, sf_dir, "events").where(F.expr(f"ts < timestamp '{REF}'"))
    entries = e.where("event_type = 'view'").select(F.col("event_id").alias("key"), F.col("user_id").alias("set_key"), "ts")
    return U.still_cached(entries, e.where("event_type = 'purchase'").select(F.col("user_id").alias("set_key"), "ts"), REF, 864_000)


def q_idle_claims(spark, sf_dir):
    return U.idle_claims(queue_events(spark, sf_dir), REF, 300, 100)


def q_viewers_now(spark, sf_dir):
    """Who was seen within an hour before the reference time."""
    e = queue_events(spark, sf_dir).where(F.expr(f"ts > timestamp '{REF}' - interval 1 hour AND ts <= timestamp '{REF}'"))
    return e.groupBy("job_id").agg(F.max("ts").alias("last_seen"))


def q_death_hooks(spark, sf_dir):
    """Parents whose last open child died: they end now, failed if all are dead."""
    status = F.when(F.col("o_orderstatus") == "F", "done").otherwise("dead")
    return U.fan_in(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), status.alias("status"))).where("dead > 0").select("root", "final_status", "message")


def q_stale_reclaim(spark, sf_dir):
    return U.stale_claims(queue_events(spark, sf_dir), EARLY, 600)


def q_fanin_finalize(spark, sf_dir):
    """Children are orders, their root the customer."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "dead").otherwise("running")
    return U.fan_in(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), status.alias("status")))


def q_timed_states(spark, sf_dir):
    """Jobs at the reference time, where a claim without a heartbeat for twelve hours fails."""
    return U.timed_states(queue_events(spark, sf_dir), REF, 43_200)


def q_closing_events(spark, sf_dir):
    """Orders as roots, their lines as children that end when they are shipped: which line closed the order, and when."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("root"), F.col("l_linenumber").alias("child"), F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("seq"), F.when(F.col("l_returnflag") == "R", "dead").otherwise("done").alias("status"), "l_linestatus")
    return U.closings(l, l.where("l_linestatus = 'F'"))


def q_rate_limit(spark, sf_dir):
    return U.rate_windows(queue_events(spark, sf_dir), 3600, 2)


def q_presence(spark, sf_dir):
    return U.sessions(queue_events(spark, sf_dir), 3600)


def q_ring_buffer(spark, sf_dir):
    """Mean of the last thousand values."""
    last = table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(1000)
    return last.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ACTIONS = "ev AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'heartbeat' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' END AS action FROM events)"


def _states(condition: str = "true") -> str:
    return f"""{ACTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY job_id) AS n FROM ev WHERE {condition}),
r(job_id, i, status, attempts) AS (SELECT DISTINCT job_id, 0::BIGINT, NULL::VARCHAR, 0 FROM o UNION ALL
  SELECT r.job_id, o.i, CASE WHEN action = 'enqueue' AND status IS NULL THEN 'pending' WHEN action = 'claim' AND status = 'pending' THEN 'claimed' WHEN action = 'finish' AND status = 'claimed' THEN 'done'
    WHEN action = 'fail' AND status = 'claimed' THEN CASE WHEN attempts + 1 >= 3 THEN 'dead' ELSE 'pending' END ELSE status END, attempts + CASE WHEN action = 'fail' AND coalesce(status = 'claimed', false) THEN 1 ELSE 0 END
  FROM r JOIN o ON o.job_id = r.job_id AND o.i = r.i + 1),
st AS (SELECT r.job_id, status FROM r JOIN (SELECT job_id, max(n) AS n FROM o GROUP BY 1) m ON m.job_id = r.job_id AND m.n = r.i)"""


_BEFORE = _states(f"ts < TIMESTAMP '{EARLY}'")


def _stale(ref: str) -> str:
    return f"{_states(f"ts < TIMESTAMP '{ref}'")} SELECT job_id, max(ts) AS last_seen FROM ev WHERE action IN ('claim', 'heartbeat') AND ts < TIMESTAMP '{ref}' AND job_id IN (SELECT job_id FROM st WHERE status = 'claimed') GROUP BY 1 HAVING max(ts) < TIMESTAMP '{ref}' - INTERVAL"


ORACLES = {
    "q_queue_dequeue": f"WITH RECURSIVE {_BEFORE}, w AS (SELECT job_id, min(ts) AS waiting_since FROM o WHERE action = 'enqueue' GROUP BY 1) SELECT job_id, job_id % 3 AS priority, waiting_since FROM w JOIN st USING (job_id) WHERE status = 'pending' AND job_id % 4 != 0 AND waiting_since + INTERVAL 30 MINUTES <= TIMESTAMP '{EARLY}' ORDER BY priority DESC, waiting_since, job_id LIMIT 10",
    "q_chunk_progress": "WITH l AS (SELECT l_orderkey AS job_id, count(DISTINCT l_linenumber) FILTER (WHERE l_linestatus = 'F') AS done, count(DISTINCT l_linenumber) AS total FROM lineitem GROUP BY 1) SELECT *, done = total AS merges FROM l",
    "q_cache_live": f"WITH c AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '{REF}' GROUP BY 1) SELECT event_id AS key, e.user_id AS set_key, ts FROM events e LEFT JOIN c ON c.user_id = e.user_id WHERE event_type = 'view' AND ts < TIMESTAMP '{REF}' AND ts > TIMESTAMP '{REF}' - INTERVAL 864000 SECONDS AND (t IS NULL OR t < ts)",
    "q_timed_states": f"""WITH RECURSIVE {ACTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY job_id) AS n FROM ev WHERE ts < TIMESTAMP '{REF}'),
r(job_id, i, s, a, t) AS (SELECT DISTINCT job_id, 0::BIGINT, NULL::VARCHAR, 0, NULL::TIMESTAMP FROM o UNION ALL
  SELECT job_id, i, CASE WHEN action = 'enqueue' AND s IS NULL THEN 'pending' WHEN action = 'claim' AND s = 'pending' THEN 'claimed' WHEN action = 'finish' AND s = 'claimed' THEN 'done' WHEN action = 'fail' AND s = 'claimed' THEN CASE WHEN a >= 2 THEN 'dead' ELSE 'pending' END ELSE s END,
    a + CASE WHEN action = 'fail' AND coalesce(s = 'claimed', false) THEN 1 ELSE 0 END,
    CASE WHEN action IN ('claim', 'heartbeat') AND s = 'claimed' THEN greatest(t, ts) WHEN action = 'claim' AND s = 'pending' THEN ts WHEN action IN ('finish', 'fail') AND s = 'claimed' THEN NULL ELSE t END
  FROM (SELECT r.job_id, o.i, action, ts, late, CASE WHEN late THEN CASE WHEN a + 1 >= 3 THEN 'dead' ELSE 'pending' END ELSE s END AS s, CASE WHEN late THEN a + 1 ELSE a END AS a, CASE WHEN late THEN NULL ELSE t END AS t
    FROM (SELECT r.*, o.i AS oi, coalesce(s = 'claimed' AND o.ts > t + INTERVAL 43200 SECONDS, false) AS late FROM r JOIN o ON o.job_id = r.job_id AND o.i = r.i + 1) r JOIN o ON o.job_id = r.job_id AND o.i = r.oi)),
z AS (SELECT r.*, coalesce(s = 'claimed' AND TIMESTAMP '{REF}' > t + INTERVAL 43200 SECONDS, false) AS late FROM r JOIN (SELECT job_id, max(n) AS n FROM o GROUP BY 1) m ON m.job_id = r.job_id AND m.n = r.i)
SELECT job_id, CASE WHEN late THEN CASE WHEN a + 1 >= 3 THEN 'dead' ELSE 'pending' END ELSE coalesce(s, 'unknown') END AS status, (CASE WHEN late THEN a + 1 ELSE a END)::INT AS attempts, CASE WHEN NOT late THEN t END AS last_seen FROM z""",
    "q_closing_events": """WITH f AS (SELECT l_orderkey AS root, l_linenumber AS child, min((l_shipdate, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'dead' ELSE 'done' END)) AS e FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
g AS (SELECT root, count(*) AS ended, count(*) FILTER (WHERE e[3] = 'dead') AS dead, max((e[1], e[2], child)) AS z FROM f GROUP BY 1), t AS (SELECT l_orderkey AS root, count(DISTINCT l_linenumber) AS total FROM lineitem GROUP BY 1)
SELECT root, z[1] AS closed_at, z[3] AS closed_by, total, dead, CASE WHEN dead = total THEN 'failed' ELSE 'done' END AS final_status, CASE WHEN dead > 0 AND dead < total THEN dead || ' of ' || total || ' pair(s) failed' END AS message FROM g JOIN t USING (root) WHERE ended = total""",
    "q_idle_claims": f"WITH RECURSIVE {_stale(REF)} 300 SECONDS ORDER BY last_seen, job_id LIMIT 100",
    "q_viewers_now": f"WITH {ACTIONS} SELECT job_id, max(ts) AS last_seen FROM ev WHERE ts > TIMESTAMP '{REF}' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '{REF}' GROUP BY 1",
    "q_death_hooks": "WITH g AS (SELECT o_custkey AS root, count(*) FILTER (WHERE o_orderstatus != 'F') AS dead, count(*) AS total FROM orders GROUP BY 1) SELECT root, CASE WHEN dead = total THEN 'failed' ELSE 'done' END AS final_status, CASE WHEN dead < total THEN dead || ' of ' || total || ' pair(s) failed' END AS message FROM g WHERE dead > 0",
    "q_queue_state": f"""WITH RECURSIVE {ACTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY job_id) AS n FROM ev),
r(job_id, i, status, attempts) AS (SELECT DISTINCT job_id, 0::BIGINT, NULL::VARCHAR, 0 FROM o UNION ALL
  SELECT r.job_id, o.i, CASE WHEN action = 'enqueue' AND status IS NULL THEN 'pending' WHEN action = 'claim' AND status = 'pending' THEN 'claimed' WHEN action = 'finish' AND status = 'claimed' THEN 'done'
    WHEN action = 'fail' AND status = 'claimed' THEN CASE WHEN attempts + 1 >= 3 THEN 'dead' ELSE 'pending' END ELSE status END, attempts + CASE WHEN action = 'fail' AND coalesce(status = 'claimed', false) THEN 1 ELSE 0 END
  FROM r JOIN o ON o.job_id = r.job_id AND o.i = r.i + 1)
SELECT r.job_id, coalesce(status, 'unknown') AS status, attempts FROM r JOIN (SELECT job_id, max(n) AS n FROM o GROUP BY 1) m ON m.job_id = r.job_id AND m.n = r.i""",
    "q_queue_claim": f"WITH RECURSIVE {_states()} SELECT job_id, min(ts) AS waiting_since FROM ev WHERE action = 'enqueue' AND job_id IN (SELECT job_id FROM st WHERE status = 'pending') GROUP BY 1 ORDER BY 2, 1 LIMIT 10",
    "q_stale_reclaim": f"WITH RECURSIVE {_stale(EARLY)} 600 SECONDS",
    "q_fanin_finalize": "WITH g AS (SELECT o_custkey AS root, count(*) FILTER (WHERE o_orderstatus = 'P') AS dead, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS total FROM orders GROUP BY 1) SELECT *, CASE WHEN dead = total THEN 'failed' WHEN dead + done < total THEN 'running' ELSE 'done' END AS final_status, CASE WHEN final_status = 'done' AND dead > 0 THEN dead || ' of ' || total || ' pair(s) failed' END AS message FROM g",
    "q_rate_limit": f"WITH {ACTIONS} SELECT job_id, date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) > 2 AS limited FROM ev GROUP BY 1, 2",
    "q_presence": f"WITH {ACTIONS}, o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 3600 SECONDS THEN 1 ELSE 0 END AS op FROM ev WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)), s AS (SELECT *, sum(op) OVER (PARTITION BY job_id ORDER BY ts, seq) AS run FROM o) SELECT job_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY job_id, run",
    "q_ring_buffer": "WITH l AS (SELECT value FROM events ORDER BY event_id DESC LIMIT 1000) SELECT count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM l",
}
