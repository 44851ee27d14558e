"""Scores, diffs, caches and merges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entivore.functions.text import csv_safe, ilike, normal_key, staleness
from entivore.operators import relational as R
from entivore.sources.tables import NEWEST, results, table, weights

KEYS = ["entity_id", "attribute_id"]
REF = "1998-12-01 00:00:00"
RES = """res AS (SELECT l_suppkey AS entity_id, l_partkey AS attribute_id, l_returnflag = 'N' AS present, round(1 - l_discount, 2) AS confidence,
  l_shipdate AS created_at, strftime(l_shipdate, '%Y-%m') AS job, l_linestatus = 'F' AS done, l_orderkey AS tie1, l_linenumber AS tie2 FROM lineitem)"""
LATEST = f"""{RES}, latest AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY entity_id, attribute_id ORDER BY created_at DESC, tie1, tie2) = 1)"""
W = "w AS (SELECT p_partkey AS attribute_id, p_name AS attribute_label, p_retailprice::DECIMAL(12,2) AS weight FROM part)"
SCORE = "sum(CASE WHEN present THEN weight ELSE 0 END)::DOUBLE AS total_score, count(*) FILTER (WHERE present) AS attributes_present, count(*) AS attributes_checked"


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_key(results(spark, sf_dir), KEYS, NEWEST)


def q_score_latest(spark, sf_dir):
    return R.weighted_scores(latest(spark, sf_dir), weights(spark, sf_dir))


def q_score_job(spark, sf_dir):
    job = results(spark, sf_dir).where("job = '1996-03'")
    return R.weighted_scores(R.first_per_key(job, KEYS, NEWEST), weights(spark, sf_dir))


def q_live_scores(spark, sf_dir):
    live = R.first_per_key(results(spark, sf_dir).where("NOT done"), KEYS, NEWEST)
    newest = live.groupBy("entity_id").agg(F.max("created_at").alias("last_updated"))
    label = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("entity_label"))
    return R.weighted_scores(live, weights(spark, sf_dir)).join(newest, "entity_id").join(label, "entity_id")


def matrix_cells(spark, sf_dir):
    spend = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("spend"))
    c = table(spark, sf_dir, "customer").join(spend, "c_custkey", "left")
    cell = lambda name, b=None, n=None, s=None: F.struct(F.lit(name).alias("attribute"), F.lit(b).cast("boolean").alias("value_boolean"), F.lit(n).cast("double").alias("value_numeric"), F.lit(s).cast("string").alias("value_select"))
    cells = F.array(cell("balance", n=F.col("c_acctbal")), cell("spend", n=F.col("spend")), cell("in_credit", b=F.col("c_acctbal") > 0), cell("segment", s=F.col("c_mktsegment")))
    return c.select(F.col("c_custkey").alias("entity_id"), F.explode(cells).alias("x")).select("entity_id", "x.*").where("value_boolean IS NOT NULL OR value_numeric IS NOT NULL OR value_select IS NOT NULL")


SEGMENTS = ["HOUSEHOLD", "MACHINERY", "FURNITURE", "AUTOMOBILE", "BUILDING"]
CELLS = """spent AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(14,2))::DOUBLE AS spend FROM orders GROUP BY 1),
c AS (SELECT * FROM customer LEFT JOIN spent ON o_custkey = c_custkey),
cells AS (
  SELECT c_custkey AS entity_id, 'balance' AS attribute, NULL::BOOLEAN AS value_boolean, c_acctbal AS value_numeric, NULL::VARCHAR AS value_select FROM c WHERE c_acctbal IS NOT NULL
  UNION ALL SELECT c_custkey, 'spend', NULL, spend, NULL FROM c WHERE spend IS NOT NULL
  UNION ALL SELECT c_custkey, 'in_credit', c_acctbal > 0, NULL, NULL FROM c WHERE c_acctbal IS NOT NULL
  UNION ALL SELECT c_custkey, 'segment', NULL, NULL, c_mktsegment FROM c WHERE c_mktsegment IS NOT NULL)"""


def q_matrix_score(spark, sf_dir):
    rows = [("balance", "numeric", 2.0, -1000.0, 10000.0, None), ("spend", "numeric", 1.0, None, None, None), ("in_credit", "boolean", 1.0, None, None, None), ("segment", "select", 2.0, None, None, SEGMENTS)]
    attributes = spark.createDataFrame(rows, "attribute string, kind string, weight double, low double, high double, options array<string>")
    return R.matrix_scores(matrix_cells(spark, sf_dir), attributes)


def q_matrix_export_long(spark, sf_dir):
    cells = matrix_cells(spark, sf_dir)
    names = spark.createDataFrame([(x,) for x in ("balance", "spend", "in_credit", "segment", "unused")], "attribute string")
    grid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id")).join(F.broadcast(names))
    value = F.coalesce(F.col("value_boolean").cast("string"), F.col("value_numeric").cast("decimal(18,2)").cast("string"), "value_select")
    return grid.join(cells.withColumn("value", value).select("entity_id", "attribute", "value"), ["entity_id", "attribute"], "left")


def q_score_rank(spark, sf_dir):
    label = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("label"))
    return q_score_latest(spark, sf_dir).join(label, "entity_id").orderBy(F.desc("total_score"), "entity_id").limit(20).select("entity_id", "label", "total_score")


def q_compare_entities(spark, sf_dir):
    return R.highlights(latest(spark, sf_dir).where("entity_id BETWEEN 1 AND 5"))


def q_job_diff(spark, sf_dir):
    one = lambda job: R.first_per_key(results(spark, sf_dir).where(F.col("job") == job), KEYS, NEWEST)
    return R.diff(one("1996-03"), one("1996-04"))


def q_score_trends(spark, sf_dir):
    r = results(spark, sf_dir).join(weights(spark, sf_dir), "attribute_id")
    # half-up in whole cents: a quotient of doubles may fall on either side of a midpoint
    cents = (F.col("weight") * 100).cast("long")
    per = r.groupBy("job", "entity_id").agg(F.sum(F.when(F.col("present"), cents).otherwise(0)).alias("part"), F.sum(cents).alias("whole"))
    per = per.select("job", "entity_id", F.expr("CASE WHEN whole != 0 THEN ((part * 20000 + whole) div (2 * whole)) / 10000.0D END").alias("score"))
    # summed and joined back, so that no task holds a whole job
    per = per.withColumn("k", F.round(F.col("score") * 10000).cast("long"))
    per = per.join(per.groupBy("job").agg(F.sum("k").alias("all"), F.count("k").alias("n")), "job")
    return per.select("job", "entity_id", "score", F.expr("((2 * all + n) div (2 * n)) / 10000.0D").alias("campaign_avg"))


def q_stale_scores(spark, sf_dir):
    since = results(spark, sf_dir).where("created_at >= TIMESTAMP_NTZ '2001-06-01 00:00:00'").select("entity_id").distinct().withColumn("hit", F.lit(True))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"))
    return s.join(since, "entity_id", "left").select("entity_id", F.col("hit").isNotNull().alias("score_stale"))


def q_knowledge_lookup(spark, sf_dir):
    """For every part, the finding of a supplier of region 1 if there is one, else of any; the newest, with its age tier."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("entity_id"), (F.col("n_regionkey") == 1).alias("own"))
    known = results(spark, sf_dir).where(F.col("created_at") <= F.lit(REF).cast("timestamp_ntz")).join(s, "entity_id")
    best = R.first_per_key(known, ["attribute_id"], ["own desc", *NEWEST, "entity_id"])
    out = weights(spark, sf_dir).select("attribute_id", "attribute_label").join(best, "attribute_id", "left").withColumn("tier", staleness(F.col("created_at"), REF))
    return out.select("attribute_id", "attribute_label", "tier", F.col("tier").isin("fresh", "warm").alias("is_hit"), F.col("own").alias("own_team"), "confidence")


def q_knowledge_upsert(spark, sf_dir):
    count = results(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("session_count"))
    return latest(spark, sf_dir).join(count, KEYS).select(*KEYS, "present", "session_count", F.col("created_at").alias("last_updated"))


def q_upsert_overwrite(spark, sf_dir):
    r = results(spark, sf_dir)
    old, new = (R.first_per_key(r.where(F.col("job") == j), KEYS, NEWEST).select(*KEYS, "present", "job") for j in ("1996-03", "1996-04"))
    return R.upsert(old, new, KEYS)


def q_fanout_cache(spark, sf_dir):
    """Clusters of ten parts by key: cached for a supplier if all known findings of the cluster are fresh or warm."""
    tier = staleness(F.col("created_at"), "2001-06-01 00:00:00")
    r = latest(spark, sf_dir).withColumn("ok", tier.isin("fresh", "warm")).withColumn("cluster_id", F.floor(F.col("attribute_id") / 10))
    return r.groupBy("entity_id", "cluster_id").agg(F.bool_and("ok").alias("cached"), F.count_if(~F.col("ok")).alias("n_missing"))


def q_value_history(spark, sf_dir):
    return R.history(results(spark, sf_dir), KEYS, "present", ["created_at", "tie1", "tie2"])


def q_campaign_stats(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("campaign_id"))
    size = s.groupBy("campaign_id").agg(F.count("*").alias("entities"))
    r = results(spark, sf_dir).join(s, "entity_id").groupBy("campaign_id").agg(F.count("*").alias("results"), F.max(F.when(F.col("done"), F.col("created_at"))).alias("last_completed"))
    score = q_score_latest(spark, sf_dir).join(s, "entity_id").groupBy("campaign_id").agg(F.round((F.sum(F.col("total_score").cast("decimal(18,2)")) / F.count("*")).cast("double"), 2).alias("avg_score"))
    return size.join(r, "campaign_id", "left").join(score, "campaign_id", "left")


def q_cross_campaign(spark, sf_dir):
    """Parts found present in several nations: the latest finding of each nation."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("campaign_id"))
    per = R.first_per_key(results(spark, sf_dir).join(s, "entity_id"), ["campaign_id", "attribute_id"], [*NEWEST, "entity_id"])
    many = per.where("present").groupBy("attribute_id").agg(F.count("*").alias("n_present")).where("n_present >= 2")
    return per.join(many, "attribute_id").select("attribute_id", "campaign_id", "present", "n_present")


def q_import_skip(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    existing = part.where("p_size <= 10").select(normal_key(F.col("p_name")).alias("key"))
    incoming = part.select(normal_key(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))).alias("key"), "p_partkey")
    return R.insert_ignore(existing, incoming, "key", "p_partkey")[1]


def q_clone_copy(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    size = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_entities"))
    return n.join(size, "n_nationkey", "left").select(F.concat("n_name", F.lit(" (Copy)")).alias("new_name"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


STATES = (("O", "P"), ("P", "F"), ("O", "F"))


def q_status_transition(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    moves = table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderstatus").over(w).alias("old"), F.col("o_orderstatus").alias("new")).where("old IS NOT NULL AND old != new")
    return R.transitions(moves, STATES)


def q_cascade_delete(spark, sf_dir):
    """Orders that remain when the customers of one segment go."""
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(gone, "o_custkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def q_usage_daily(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"))
    return e.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


def q_usage_top(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return e.orderBy(F.desc("total"), "user_id").limit(10)


def q_percentiles(spark, sf_dir):
    return R.ranked_percentiles(table(spark, sf_dir, "events").select(F.col("value").cast("decimal(18,4)").alias("value")), "value", (50, 95, 99)).select(*[F.col(f"p{p}").cast("double").alias(f"p{p}") for p in (50, 95, 99)], "count", F.col("mean").cast("double").alias("mean"))


def q_reactions(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type")
    return e.agg(F.array_sort(F.collect_set("user_id")).alias("users")).withColumn("n_users", F.size("users").cast("long"))


def q_toggle_reactions(spark, sf_dir):
    return R.toggles(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])


def q_fill_rate(spark, sf_dir):
    total = table(spark, sf_dir, "part").agg(F.count("*").alias("all"))
    g = latest(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("checked"), F.count_if("present").alias("present"), F.sum(F.col("confidence").cast("decimal(6,2)")).alias("c"))
    out = g.join(F.broadcast(total))
    return out.select("entity_id", F.round(F.col("checked") / F.col("all"), 6).alias("coverage"), F.round(F.col("present") / F.col("checked"), 6).alias("presence"), F.round((F.col("c") / F.col("checked")).cast("double"), 6).alias("avg_confidence"))


def q_price_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("at"))
    g = o.groupBy("o_custkey").agg(F.min_by("o_totalprice", "at").alias("first"), F.max_by("o_totalprice", "at").alias("last"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    return g.withColumn("change_pct", F.round((F.col("last") - F.col("first")) / F.nullif(F.col("first"), F.lit(0.0)) * 100, 4))


def q_search_ilike(spark, sf_dir):
    return table(spark, sf_dir, "part").where(ilike(F.col("p_name"), "SMALL")).select("p_partkey", "p_name")


def q_search_page(spark, sf_dir):
    hits = table(spark, sf_dir, "part").where(ilike(F.col("p_name"), "ring")).select("p_partkey", "p_name")
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy("p_name", "p_partkey").offset(20).limit(10).join(F.broadcast(total))


def q_search_all(spark, sf_dir):
    """The first five hits of each kind."""
    kinds = (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"))
    each = [table(spark, sf_dir, t).select(F.lit(t).alias("category"), F.col(k).cast("long").alias("id"), F.col(v).alias("label")).where(ilike(F.col("label"), "n")).orderBy("id").limit(5) for t, k, v in kinds]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


def q_csv_sanitise(spark, sf_dir):
    raw = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "|", "\t", "\r", "")]), F.pmod(F.col("p_partkey"), F.lit(8)).cast("int") + 1), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), csv_safe(raw).alias("safe"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_score_latest": f"WITH {LATEST}, {W} SELECT entity_id, {SCORE} FROM latest JOIN w USING (attribute_id) GROUP BY entity_id",
    "q_score_job": f"WITH {RES}, {W}, one AS (SELECT * FROM res WHERE job = '1996-03' QUALIFY row_number() OVER (PARTITION BY entity_id, attribute_id ORDER BY created_at DESC, tie1, tie2) = 1) SELECT entity_id, {SCORE} FROM one JOIN w USING (attribute_id) GROUP BY entity_id",
    "q_live_scores": f"WITH {RES}, {W}, one AS (SELECT * FROM res WHERE NOT done QUALIFY row_number() OVER (PARTITION BY entity_id, attribute_id ORDER BY created_at DESC, tie1, tie2) = 1) SELECT entity_id, any_value(s_name) AS entity_label, {SCORE}, max(created_at) AS last_updated FROM one JOIN w USING (attribute_id) JOIN supplier ON s_suppkey = entity_id GROUP BY entity_id",
    "q_matrix_score": f"""WITH {CELLS}, a AS (SELECT * FROM (VALUES ('balance', 'numeric', 2.0::DOUBLE, -1000.0::DOUBLE, 10000.0::DOUBLE), ('spend', 'numeric', 1.0, NULL, NULL), ('in_credit', 'boolean', 1.0, NULL, NULL), ('segment', 'select', 2.0, NULL, NULL)) t(attribute, kind, weight, low, high)),
n AS (SELECT entity_id, weight, CASE WHEN kind = 'boolean' THEN value_boolean::INT::DOUBLE WHEN low IS NOT NULL THEN greatest(0.0, least(1.0, (value_numeric - low) / (high - low)))
  WHEN kind = 'numeric' THEN greatest(0.0, least(1.0, value_numeric / nullif(max(abs(value_numeric)) OVER (PARTITION BY attribute), 0.0)))
  ELSE (nullif(list_position({SEGMENTS}, value_select), 0) - 1) / 4.0 END::DOUBLE AS norm FROM cells JOIN a USING (attribute))
SELECT entity_id, round(sum(norm * weight) / nullif(sum(weight), 0) * 100, 2) AS total_score, count(*) FILTER (WHERE norm > 0) AS present, count(*) AS checked FROM n WHERE norm IS NOT NULL GROUP BY entity_id""",
    "q_matrix_export_long": f"""WITH {CELLS} SELECT c_custkey AS entity_id, n.attribute, coalesce(value_boolean::VARCHAR, value_numeric::DECIMAL(18,2)::VARCHAR, value_select) AS value
FROM customer CROSS JOIN (VALUES ('balance'), ('spend'), ('in_credit'), ('segment'), ('unused')) n(attribute) LEFT JOIN cells ON cells.entity_id = c_custkey AND cells.attribute = n.attribute""",
    "q_score_rank": f"WITH {LATEST}, {W} SELECT entity_id, any_value(s_name) AS label, sum(CASE WHEN present THEN weight ELSE 0 END)::DOUBLE AS total_score FROM latest JOIN w USING (attribute_id) JOIN supplier ON s_suppkey = entity_id GROUP BY entity_id ORDER BY total_score DESC, entity_id LIMIT 20",
    "q_compare_entities": f"""WITH {LATEST}, v AS (SELECT attribute_id, entity_id, present, confidence, present::INT * 10 + confidence AS k FROM latest WHERE entity_id BETWEEN 1 AND 5)
SELECT attribute_id, entity_id, present, confidence, k = max(k) OVER w AND max(k) OVER w != min(k) OVER w AS is_best, k = min(k) OVER w AND max(k) OVER w != min(k) OVER w AS is_worst FROM v WINDOW w AS (PARTITION BY attribute_id)""",
    "q_job_diff": f"""WITH {RES}, one AS (SELECT * FROM res WHERE job IN ('1996-03', '1996-04') QUALIFY row_number() OVER (PARTITION BY job, entity_id, attribute_id ORDER BY created_at DESC, tie1, tie2) = 1),
a AS (SELECT entity_id, attribute_id, present AS present_a FROM one WHERE job = '1996-03'), b AS (SELECT entity_id, attribute_id, present AS present_b FROM one WHERE job = '1996-04')
SELECT entity_id, attribute_id, present_a, present_b, CASE WHEN present_a IS NULL THEN 'added' WHEN present_b IS NULL THEN 'removed' WHEN present_a != present_b THEN 'changed' ELSE 'unchanged' END AS diff_status FROM a FULL JOIN b USING (entity_id, attribute_id)""",
    "q_score_trends": f"""WITH {RES}, {W}, per AS (SELECT job, entity_id, ((sum(CASE WHEN present THEN (weight * 100)::BIGINT ELSE 0 END) * 20000 + sum((weight * 100)::BIGINT)) // nullif(2 * sum((weight * 100)::BIGINT), 0))::DOUBLE / 10000.0::DOUBLE AS score FROM res JOIN w USING (attribute_id) GROUP BY ALL)
SELECT job, entity_id, score, ((2 * sum(round(score * 10000)::BIGINT) OVER w + count(*) OVER w) // (2 * count(*) OVER w))::DOUBLE / 10000.0::DOUBLE AS campaign_avg FROM per WINDOW w AS (PARTITION BY job)""",
    "q_stale_scores": "SELECT s_suppkey AS entity_id, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_shipdate >= TIMESTAMP '2001-06-01') AS score_stale FROM supplier",
    "q_knowledge_lookup": f"""WITH {RES}, k AS (SELECT res.*, n_regionkey = 1 AS own FROM res JOIN supplier ON s_suppkey = entity_id JOIN nation ON n_nationkey = s_nationkey WHERE created_at <= TIMESTAMP '{REF}'),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY attribute_id ORDER BY own DESC, created_at DESC, tie1, tie2, entity_id) = 1),
t AS (SELECT p_partkey AS attribute_id, p_name AS attribute_label, CASE WHEN created_at > TIMESTAMP '{REF}' - INTERVAL 3 DAYS THEN 'fresh' WHEN created_at > TIMESTAMP '{REF}' - INTERVAL 14 DAYS THEN 'warm' WHEN created_at > TIMESTAMP '{REF}' - INTERVAL 30 DAYS THEN 'stale' ELSE 'expired' END AS tier, own AS own_team, confidence FROM part LEFT JOIN b ON attribute_id = p_partkey)
SELECT attribute_id, attribute_label, tier, tier IN ('fresh', 'warm') AS is_hit, own_team, confidence FROM t""",
    "q_knowledge_upsert": f"WITH {LATEST} SELECT l.entity_id, l.attribute_id, l.present, n AS session_count, l.created_at AS last_updated FROM latest l JOIN (SELECT entity_id, attribute_id, count(*) AS n FROM res GROUP BY ALL) USING (entity_id, attribute_id)",
    "q_upsert_overwrite": f"WITH {RES} SELECT entity_id, attribute_id, present, job FROM res WHERE job IN ('1996-03', '1996-04') QUALIFY row_number() OVER (PARTITION BY entity_id, attribute_id ORDER BY created_at DESC, tie1, tie2) = 1",
    "q_fanout_cache": f"WITH {LATEST}, t AS (SELECT *, created_at > TIMESTAMP '2001-06-01' - INTERVAL 14 DAYS AS ok FROM latest) SELECT entity_id, floor(attribute_id / 10)::BIGINT AS cluster_id, bool_and(ok) AS cached, count(*) FILTER (WHERE NOT ok) AS n_missing FROM t GROUP BY ALL",
    "q_value_history": f"WITH {RES}, h AS (SELECT *, lag(present) OVER (PARTITION BY entity_id, attribute_id ORDER BY created_at, tie1, tie2) AS old FROM res) SELECT entity_id, attribute_id, old, present AS new, created_at AS changed_at FROM h WHERE old IS DISTINCT FROM present",
    "q_campaign_stats": f"""WITH {LATEST}, {W}, sc AS (SELECT entity_id, sum(CASE WHEN present THEN weight ELSE 0 END) AS t FROM latest JOIN w USING (attribute_id) GROUP BY 1),
r AS (SELECT s_nationkey, count(*) AS results, max(created_at) FILTER (WHERE done) AS last_completed FROM res JOIN supplier ON s_suppkey = entity_id GROUP BY 1),
a AS (SELECT s_nationkey, round((sum(t)::DOUBLE / count(*)), 2) AS avg_score FROM sc JOIN supplier ON s_suppkey = entity_id GROUP BY 1)
SELECT s.s_nationkey AS campaign_id, count(*) AS entities, any_value(results) AS results, any_value(last_completed) AS last_completed, any_value(avg_score) AS avg_score FROM supplier s LEFT JOIN r USING (s_nationkey) LEFT JOIN a USING (s_nationkey) GROUP BY 1""",
    "q_cross_campaign": f"""WITH {RES}, per AS (SELECT attribute_id, s_nationkey AS campaign_id, present FROM res JOIN supplier ON s_suppkey = entity_id QUALIFY row_number() OVER (PARTITION BY s_nationkey, attribute_id ORDER BY created_at DESC, tie1, tie2, entity_id) = 1)
SELECT attribute_id, campaign_id, present, n AS n_present FROM per JOIN (SELECT attribute_id, count(*) AS n FROM per WHERE present GROUP BY 1 HAVING count(*) >= 2) USING (attribute_id)""",
    "q_import_skip": "WITH k AS (SELECT count(DISTINCT lower(p_name)) FILTER (WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size <= 10)) AS inserted, count(*) AS n FROM part) SELECT inserted, n - inserted AS skipped, n AS total_requested FROM k",
    "q_clone_copy": "SELECT n_name || ' (Copy)' AS new_name, count(s_suppkey) AS n_entities FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name",
    "q_status_transition": "WITH m AS (SELECT o_orderkey, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old, o_orderstatus AS new FROM orders) SELECT *, (old, new) IN (('O', 'P'), ('P', 'F'), ('O', 'F')) AS is_valid FROM m WHERE old IS NOT NULL AND old != new",
    "q_cascade_delete": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "q_usage_daily": "SELECT ts::DATE AS day, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1",
    "q_usage_top": "SELECT user_id, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1 ORDER BY total DESC, user_id LIMIT 10",
    "q_percentiles": "WITH v AS (SELECT list(value::DECIMAL(18,4) ORDER BY value) AS l, count(value) AS n, sum(value::DECIMAL(18,4)) AS s FROM events WHERE value IS NOT NULL) SELECT l[least(n * 50 // 100, n - 1) + 1]::DOUBLE AS p50, l[least(n * 95 // 100, n - 1) + 1]::DOUBLE AS p95, l[least(n * 99 // 100, n - 1) + 1]::DOUBLE AS p99, n AS count, round(s::DOUBLE / n, 2) AS mean FROM v",
    "q_reactions": "SELECT ts::DATE AS day, event_type, list(DISTINCT user_id ORDER BY user_id) AS users, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2",
    "q_toggle_reactions": "SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) % 2 = 1",
    "q_fill_rate": f"WITH {LATEST} SELECT entity_id, round(count(*) / (SELECT count(*) FROM part), 6) AS coverage, round(count(*) FILTER (WHERE present) / count(*), 6) AS presence, round(sum(confidence::DECIMAL(6,2))::DOUBLE / count(*), 6) AS avg_confidence FROM latest GROUP BY 1",
    "q_price_history": "SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last, min(o_totalprice) AS low, max(o_totalprice) AS high, round((arg_max(o_totalprice, (o_orderdate, o_orderkey)) - arg_min(o_totalprice, (o_orderdate, o_orderkey))) / nullif(arg_min(o_totalprice, (o_orderdate, o_orderkey)), 0) * 100, 4) AS change_pct FROM orders GROUP BY 1",
    "q_search_ilike": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%small%'",
    "q_search_page": "SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_name ILIKE '%ring%') AS total FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_name, p_partkey LIMIT 10 OFFSET 20",
    "q_search_all": " UNION ALL ".join(f"(SELECT '{t}' AS category, {k}::BIGINT AS id, {v} AS label FROM {t} WHERE {v} ILIKE '%n%' ORDER BY id LIMIT 5)" for t, k, v in (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"))),
    "q_csv_sanitise": "WITH r AS (SELECT p_partkey, ['=', '+', '-', '@', '|', chr(9), chr(13), ''][p_partkey % 8 + 1] || p_name AS raw FROM part) SELECT p_partkey, raw, CASE WHEN raw[1] IN ('=', '+', '-', '@', '|', chr(9)) THEN '''' || raw ELSE raw END AS safe FROM r",
}
