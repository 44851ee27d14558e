"""Changes to tables, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entivore.operators import mutations as X
from entivore.sources.tables import table


def q_insert_rows(spark, sf_dir):
    """Part names as requests, every third with blanks about it, against the names of small parts."""
    p = table(spark, sf_dir, "part")
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).when(F.col("p_partkey") % 50 == 1, " ").otherwise(F.col("p_name"))
    return X.inserted(p.select(F.col("p_partkey").alias("request_id"), label.alias("label")), p.where("p_size <= 5").select(F.col("p_name").alias("label")))


def q_request_dedup(spark, sf_dir):
    """Customers as requests: once by market segment and nation, then once by the last digits of the phone."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("|", "c_mktsegment", "c_nationkey").alias("label"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 97).alias("external_id"))
    return X.once_by_keys(c, ["label", "external_id"], "c_custkey")


def q_patch(spark, sf_dir):
    """New balances and segments for every fifth customer; only the segment may change."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    patches = c.where("c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "PATCHED").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return X.patched(c, patches, "c_custkey", ["c_mktsegment"])


def q_reorder(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("display_order"))
    ordering = s.where("s_suppkey % 2 = 0").select("s_suppkey", (1000 - F.col("s_suppkey")).alias("place"))
    return X.reordered(s, ordering, "s_suppkey")


def q_assign_once(spark, sf_dir):
    """Orders ask to put their customer into a program; every third customer is in one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("long")).alias("target"))
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("item"), F.pmod("o_orderkey", F.lit(3)).alias("target"))
    return X.assigned_once(c, requests)


#: Queue rows that a task takes, about.
TASK_ROWS = 1_000_000


def _jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.lit(None).cast("string").alias("message"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_orderkey").alias("job_id"), F.when(F.col("l_linestatus") == "F", "done").otherwise("pending").alias("status"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return X.cancelled(jobs, rows, o.where("o_custkey % 10 = 1").select(F.col("o_orderkey").alias("job_id")), tasks)


def q_cancel_jobs(spark, sf_dir):
    return _jobs(spark, sf_dir)[0]


def q_cancel_rows(spark, sf_dir):
    return _jobs(spark, sf_dir)[1].groupBy("job_id", "status").agg(F.count("*").alias("n"))


def q_mark_read(spark, sf_dir):
    """All purchases of user 1 are marked as read."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lit(False).alias("is_read"))
    return X.updated_where(e, (F.col("user_id") == 1) & (F.col("event_type") == "purchase"), {"is_read": F.lit(True)}).groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"))


def q_links(spark, sf_dir):
    """Which customer follows which nation: orders add links, returned ones take them away."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.pmod("o_orderkey", F.lit(25)).alias("topic"), "o_orderstatus")
    return X.linked_rows(o.where("o_orderstatus = 'O'").select("user", "topic"), o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"))


def _copies(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("campaign_id"), F.col("n_name").alias("name")).where("campaign_id % 2 = 0")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("entity_id"), F.col("s_nationkey").cast("long").alias("campaign_id"), F.col("s_name").alias("label"))
    return X.cloned(n, s, "campaign_id", "entity_id", "name", F.col("campaign_id") + 1000, F.col("entity_id") + 1_000_000_000)


def q_clone_campaigns(spark, sf_dir):
    return _copies(spark, sf_dir)[0]


def q_clone_entities(spark, sf_dir):
    return _copies(spark, sf_dir)[1]


def q_typed_write(spark, sf_dir):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("boolean", "numeric", "select", "text")]), F.pmod(F.col("p_partkey"), F.lit(4)).cast("int") + 1)
    values = F.element_at(F.array(F.lit("false"), F.lit("12.5"), F.lit("x"), F.lit("yes"), F.lit("")), F.pmod(F.col("p_partkey"), F.lit(5)).cast("int") + 1)
    return X.coerced(table(spark, sf_dir, "part").select("p_partkey", kinds.alias("kind"), values.alias("value"))).drop("value")


def _audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("old"), F.element_at(F.array(F.lit("O"), F.lit("P"), F.lit("F")), F.pmod("o_orderkey", F.lit(3)).cast("int") + 1).alias("new"), F.col("o_custkey").alias("by"))
    return X.audited(o, (("O", "P"), ("P", "F"), ("O", "F")), "o_orderkey")


def q_status_audit(spark, sf_dir):
    return _audit(spark, sf_dir)[0]


def q_status_refused(spark, sf_dir):
    return _audit(spark, sf_dir)[1]


MOVES = "m AS (SELECT o_orderkey, o_orderstatus AS old, ['O', 'P', 'F'][(o_orderkey % 3 + 1)::INT] AS new, o_custkey AS who, (o_orderstatus, ['O', 'P', 'F'][(o_orderkey % 3 + 1)::INT]) IN (('O', 'P'), ('P', 'F'), ('O', 'F')) AS ok FROM orders)"
CANCEL = "j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_custkey % 10 = 1 AND o_orderstatus IN ('O', 'P') AS hit FROM orders)"
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_insert_rows": """WITH r AS (SELECT p_partkey AS request_id, nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '  ' || upper(p_name) || ' ' WHEN p_partkey % 50 = 1 THEN ' ' ELSE p_name END), '') AS label FROM part)
SELECT request_id, label, CASE WHEN label IS NULL THEN 'invalid' WHEN lower(label) IN (SELECT lower(p_name) FROM part WHERE p_size <= 5) OR min(request_id) OVER (PARTITION BY lower(label)) != request_id THEN 'duplicate' ELSE 'created' END AS outcome FROM r""",
    "q_request_dedup": """WITH c AS (SELECT c_custkey, c_mktsegment || '|' || c_nationkey AS label, CASE WHEN c_custkey % 4 != 0 THEN c_custkey % 97 END AS external_id FROM customer),
a AS (SELECT * FROM c QUALIFY min(c_custkey) OVER (PARTITION BY lower(label)) = c_custkey) SELECT * FROM a QUALIFY external_id IS NULL OR min(c_custkey) OVER (PARTITION BY external_id) = c_custkey""",
    "q_patch": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal::DOUBLE AS c_acctbal FROM customer",
    "q_reorder": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 1000 - s_suppkey ELSE s_suppkey END AS display_order FROM supplier",
    "q_assign_once": """WITH r AS (SELECT o_orderkey AS request_id, o_custkey AS item, o_orderkey % 3 AS target, first_value(o_orderkey % 3) OVER w AS f, first_value(o_orderkey) OVER w AS i FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
h AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::BIGINT END AS held FROM customer)
SELECT request_id, item, target, CASE WHEN held IS NULL AND request_id = i THEN 'assigned' WHEN target = coalesce(held, f) THEN 'same' ELSE 'conflict' END AS outcome FROM r LEFT JOIN h ON c_custkey = item""",
    "q_cancel_jobs": f"WITH {CANCEL} SELECT job_id, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN 'cancelled by user' END AS message FROM j",
    "q_cancel_rows": f"WITH {CANCEL} SELECT l_orderkey AS job_id, CASE WHEN l_linestatus = 'F' THEN 'done' WHEN hit THEN 'dead' ELSE 'pending' END AS status, count(*) AS n FROM lineitem JOIN j ON job_id = l_orderkey GROUP BY 1, 2",
    "q_mark_read": "SELECT user_id, count(*) FILTER (WHERE NOT (user_id IS NOT DISTINCT FROM 1 AND event_type = 'purchase')) AS unread FROM events GROUP BY 1",
    "q_links": "WITH o AS (SELECT o_custkey AS \"user\", o_orderkey % 25 AS topic, o_orderstatus AS st FROM orders) SELECT \"user\", topic FROM o WHERE st IN ('O', 'P') EXCEPT SELECT \"user\", topic FROM o WHERE st = 'F'",
    "q_clone_campaigns": "SELECT n_nationkey::BIGINT + 1000 AS campaign_id, n_name || ' (Copy)' AS name, n_nationkey::BIGINT AS copied_from FROM nation WHERE n_nationkey % 2 = 0",
    "q_clone_entities": "SELECT s_suppkey::BIGINT + 1000000000 AS entity_id, s_nationkey::BIGINT + 1000 AS campaign_id, s_name AS label, s_suppkey::BIGINT AS copied_from FROM supplier WHERE s_nationkey % 2 = 0",
    "q_typed_write": """WITH v AS (SELECT p_partkey, ['boolean', 'numeric', 'select', 'text'][(p_partkey % 4 + 1)::INT] AS kind, ['false', '12.5', 'x', 'yes', ''][(p_partkey % 5 + 1)::INT] AS v FROM part)
SELECT p_partkey, kind, CASE WHEN kind = 'boolean' THEN v NOT IN ('false', '') END AS value_boolean, CASE WHEN kind = 'numeric' THEN try_cast(v AS DOUBLE) END AS value_numeric, CASE WHEN kind = 'select' THEN v END AS value_select, CASE WHEN kind = 'text' THEN v END AS value_text FROM v""",
    "q_status_audit": f"WITH {MOVES} SELECT o_orderkey, old AS from_status, new AS to_status, who AS changed_by FROM m WHERE ok",
    "q_status_refused": f"WITH {MOVES} SELECT o_orderkey, 'cannot go from ' || old || ' to ' || new AS error FROM m WHERE NOT ok",
}
