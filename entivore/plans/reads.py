"""Reads that put several tables together: knowledge, comparisons, campaigns, batches and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from entivore.operators import batches as B
from entivore.operators import graph as G
from entivore.operators import knowledge as K
from entivore.operators import listing as L
from entivore.operators import passages as P
from entivore.operators import sheets as H
from entivore.plans.graphs import EDGES, WINNERS, _winners
from entivore.plans.scores import CELLS, LATEST, REF, W, latest, matrix_cells, q_score_latest
from entivore.plans.texts import SIM, _grams
from entivore.sources import delimited
from entivore.sources.shared import scratch
from entivore.sources.tables import edges, results, table, weights

#: What counts among rows of one pair and time.
TIES = ["tie", "confidence", "present"]
TEAM = "team 1"


def _known(spark, sf_dir):
    """Findings up to the reference time: a third is known to all, the others to one of two teams."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit(REF).cast("timestamp_ntz"))
    team = F.when(F.col("l_orderkey") % 3 > 0, F.concat(F.lit("team "), F.col("l_orderkey") % 3))
    return l.select(
        F.concat(F.lit("s"), "l_suppkey").alias("gwm_id"), F.concat(F.lit("p"), "l_partkey").alias("attribute_label"), team.alias("team"), F.col("l_shipdate").alias("last_updated"),
        F.col("l_orderkey").alias("tie"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), (F.col("l_returnflag") == "N").alias("present"),
    )


def _pairs(spark, sf_dir):
    """The pairs of all lines and their neighbours; the entity of some is blank."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.when(F.col("l_orderkey") % 50 != 0, F.concat(F.lit("s"), "l_suppkey")).otherwise(" ").alias("gwm_id"), F.concat(F.lit("p"), F.col("l_partkey") + F.col("l_linenumber") % 2).alias("attribute_label"))


def q_staleness_map(spark, sf_dir):
    return K.staleness_map(_pairs(spark, sf_dir), _known(spark, sf_dir), TEAM, REF, TIES).select(*K.PAIR, "tier", "cached.team", "cached.present", "cached.confidence")


def q_staleness_shared(spark, sf_dir):
    """Without a team only what all may know counts."""
    return K.staleness_map(_pairs(spark, sf_dir), _known(spark, sf_dir), None, REF, TIES).groupBy("tier").agg(F.count("*").alias("n"), F.count("cached").alias("cached"))


def q_knowledge_batch(spark, sf_dir):
    return K.lookup(_pairs(spark, sf_dir), _known(spark, sf_dir), TEAM, REF, TIES)


def q_knowledge_young(spark, sf_dir):
    return K.lookup_young(_pairs(spark, sf_dir), _known(spark, sf_dir), REF)


def q_knowledge_campaigns(spark, sf_dir):
    """What is known of the suppliers of each nation, by nation, age and team."""
    e = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("campaign_id"), F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("s"), "s_suppkey")).alias("gwm_id"))
    return K.known_of(e, _known(spark, sf_dir), REF).groupBy("campaign_id", "tier", "team").agg(F.count("*").alias("n"), F.max("last_updated").alias("newest"))


def q_compare_ordered(spark, sf_dir):
    """Three suppliers side by side, in the order asked, over all parts."""
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("label"))
    return K.compared(entities, weights(spark, sf_dir), latest(spark, sf_dir), [7, 2, 7, 5])


def _campaigns(spark, sf_dir):
    """Nations as campaigns: regions own them, three teams share them."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("campaign_id"), "n_name", F.col("n_regionkey").alias("owner"), F.pmod("n_nationkey", F.lit(3)).cast("int").alias("team"))


def q_campaign_counts(spark, sf_dir):
    """Every nation with its suppliers, parts in use, results, last finished job, mean score and region."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("campaign_id"))
    r = results(spark, sf_dir).join(s, "entity_id")
    last = r.where("done").groupBy("campaign_id").agg(F.max("created_at").alias("last_completed_at"))
    score = q_score_latest(spark, sf_dir).join(s, "entity_id").groupBy("campaign_id").agg(F.round((F.sum(F.col("total_score").cast("decimal(18,2)")) / F.count("*")).cast("double"), 2).alias("avg_score"))
    program = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("owner"), F.col("r_name").alias("program_name"))
    out = K.with_counts(_campaigns(spark, sf_dir), "campaign_id", entity_count=s, attribute_count=r.select("campaign_id", "attribute_id").distinct(), result_count=r)
    return out.join(last, "campaign_id", "left").join(score, "campaign_id", "left").join(program, "owner", "left").drop("owner", "team")


def q_campaign_totals(spark, sf_dir):
    """All that the user of region 1 sees with team 2, in one row."""
    mine = L.own_or_teams(_campaigns(spark, sf_dir), 1, [2])
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("campaign_id")).join(mine, "campaign_id", "left_semi")
    r = results(spark, sf_dir).join(s, "entity_id")
    jobs = r.where(F.expr(f"created_at > timestamp_ntz '{REF}' - interval 7 days AND created_at <= timestamp_ntz '{REF}'"))
    return K.totals({"campaigns": mine, "entities": s, "results": r, "jobs_last_7_days": jobs}, {"knowledge_entries": (r, [F.col("entity_id"), F.col("attribute_id")])})


def q_effective_weights(spark, sf_dir):
    """Parts in use in each nation: their price counts, unless a large line of that nation says otherwise."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("campaign_id")), "l_suppkey")
    links = l.groupBy("campaign_id", F.col("l_partkey").alias("attribute_id")).agg(F.max(F.when(F.col("l_quantity") > 45, F.col("l_quantity"))).alias("weight_override"))
    known = table(spark, sf_dir, "part").where("p_size != 13").select(F.col("p_partkey").alias("attribute_id"), F.col("p_retailprice").alias("weight"))
    return K.effective_weights(known, links)


def q_mentionable_users(spark, sf_dir):
    """Regions as sessions shared with their nations and some of the next region's; customers are members of two nations each."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    shares = n.select(F.col("n_regionkey").alias("session"), F.col("n_nationkey").alias("team")).unionByName(n.where("n_nationkey % 2 = 0").select(F.pmod(F.col("n_regionkey") + 1, F.lit(5)).alias("session"), F.col("n_nationkey").alias("team")))
    members = c.select(F.col("c_nationkey").alias("team"), F.col("c_custkey").alias("sid")).unionByName(c.select(F.pmod(F.col("c_nationkey") + 5, F.lit(25)).alias("team"), F.col("c_custkey").alias("sid")))
    return K.once_across(shares, members, c.select(F.col("c_custkey").alias("sid"), F.col("c_name").alias("display_name")))


def q_notifications(spark, sf_dir):
    """The fifty newest events of each user, with what their properties say."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return L.newest_each(e, "user_id", "ts", "event_id").drop("ts")


def q_set_operations(spark, sf_dir):
    """Pairs found in two months: in either, in both, in the first only."""
    a, b = (results(spark, sf_dir).where(F.col("job") == j).select("entity_id", "attribute_id").distinct() for j in ("1996-03", "1996-04"))
    both = {"union": a.union(b).distinct(), "intersection": a.intersect(b), "difference": a.subtract(b)}
    out = [df.select(F.lit(op).alias("op"), "*") for op, df in both.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _lookups(spark, sf_dir):
    """Parts as names that were looked up, twenty in a batch."""
    at = F.col("p_partkey") % 5
    status = F.when(at == 0, "error").when(at == 1, "no_match").otherwise("matched")
    error = F.when(at == 0, F.when(F.col("p_size") > 25, F.repeat(F.lit("time|out "), 12)).when(F.col("p_size") > 10, "refused"))
    return table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 20).alias("batch"), F.col("p_partkey").alias("position"), F.concat("p_name", F.when(at == 2, "|x").otherwise("")).alias("name"),
        F.when(at > 1, F.concat(F.lit("g"), "p_partkey")).alias("gwm_id"), F.when(at > 2, F.round(F.col("p_size") / 50, 2)).alias("confidence"), status.alias("status"), error.alias("error"),
    )


def q_batch_report(spark, sf_dir):
    return B.results_markdown(_lookups(spark, sf_dir))


def q_batch_json(spark, sf_dir):
    return B.results_json(_lookups(spark, sf_dir))


def q_batch_statuses(spark, sf_dir):
    return B.summaries(_lookups(spark, sf_dir))


def _jobs(spark, sf_dir):
    """Orders of a customer as a batch of jobs; kinds by priority, some of them missing."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 40 == 0, "").when(F.col("o_orderkey") % 2 == 0, "validation_pair").otherwise("report")
    return o.select(
        F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("place"), kind.alias("job_type"), F.create_map(F.lit("status"), "o_orderstatus").alias("payload"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(9)).alias("max_attempts"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(5)).alias("priority"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).alias("run_at"), F.when(F.col("o_orderkey") % 30 != 2, F.col("o_orderkey") + 1).alias("validation_job_id"),
    )


def q_enqueue_many(spark, sf_dir):
    return B.enqueued(_jobs(spark, sf_dir), REF)[0].select("batch", "place", "job_type", "payload", "max_attempts", "priority", "run_at", "status")


def q_enqueue_refused(spark, sf_dir):
    return B.enqueued(_jobs(spark, sf_dir), REF)[1]


def q_merged_extractions(spark, sf_dir):
    """Lines as relations found by chunks (orders), written in several ways: the first of each."""
    l = table(spark, sf_dir, "lineitem")
    name = lambda c, kind: F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.upper(F.lit(f" {kind} ")), c, F.lit(" "))).otherwise(F.concat(F.lit(f"{kind} "), c))
    return B.merged_relations(l.select(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("place"), name("l_suppkey", "Supplier").alias("subject"), F.col("l_returnflag").alias("predicate"), name("l_partkey", "Part").alias("object")))


def q_merged_names(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("chunk"), F.col("p_partkey").alias("place"), F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")).alias("name"), "p_type")
    return B.merged_entities(c)


def _things(spark, sf_dir):
    """Parts as entities of the graph, with their brand as an alias."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.col("p_type").alias("description"), F.col("p_size").alias("updated_at"))


def q_merged_aliases(spark, sf_dir):
    """Parts of one name merged: the one that stays has the brands of all."""
    out = G.merged_entities(_things(spark, sf_dir), _winners(spark, sf_dir))
    return out.select("id", "name", F.array_join("aliases", ";").alias("aliases"))


def q_kg_search(spark, sf_dir):
    """Entities by name, by alias and by description, with their degree."""
    asked = [G.searched(_things(spark, sf_dir), edges(spark, sf_dir), q).select(F.lit(q).alias("asked"), "id", "name", "degree") for q in ("ring", "brand#13", "promo")]
    return asked[0].unionByName(asked[1]).unionByName(asked[2])


def q_suggest_degree(spark, sf_dir):
    return G.suggested(_things(spark, sf_dir), edges(spark, sf_dir), "smal rng", 25).withColumn("sim", F.round("sim", 6))


def q_matrix_csv(spark, sf_dir):
    """The matrix of customers written as files and read again."""
    cells = matrix_cells(spark, sf_dir).withColumnRenamed("attribute", "attribute_id").withColumn("value_numeric", F.col("value_numeric").cast("decimal(18,2)")).withColumn("value_text", F.lit(None).cast("string"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat(F.when(F.col("c_custkey") % 3 == 0, "=").otherwise(""), "c_name").alias("label"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("g"), "c_custkey")).alias("gwm_id"))
    path = scratch(spark, "matrix")
    H.exported(c, [("balance", "Balance, net"), ("spend", "Spend"), ("in_credit", "In credit"), ("segment", "spend"), ("unused", "Unused")], cells, path)
    return delimited.read_delimited(spark, path)


def q_session_files(spark, sf_dir):
    """Conversations as sessions of files, whose kinds go by their roles and names: how many chunks each page gives."""
    c = table(spark, sf_dir, "conversations")
    meta = F.struct(F.concat(F.col("role"), F.element_at(F.array(F.lit(".txt"), F.lit(".PDF"), F.lit("")), F.pmod(F.col("turn"), F.lit(3)).cast("int") + 1)).alias("filename"), F.lit(None).cast("string").alias("type"))
    s = c.groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text", meta.alias("meta")))).alias("r"))
    sessions = s.select("session_id", F.transform("r", lambda x: x["text"]).alias("texts"), F.slice(F.transform("r", lambda x: x["meta"]), 1, 4).alias("metadata"))
    chunks = P.session_chunks(sessions, size=120)
    return chunks.groupBy("session_id", "file", "filename", "page").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


def q_search_scoped(spark, sf_dir):
    """What the user of region 1 with team 2 finds for 'rings'."""
    c = _campaigns(spark, sf_dir).select("campaign_id", F.concat(F.lit("Rings of "), "n_name").alias("label"), F.lit(None).cast("string").alias("description"), "owner", "team", F.col("campaign_id").alias("created_at"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.pmod("p_partkey", F.lit(25)).alias("campaign_id"), F.concat("p_name", F.when(F.col("p_partkey") % 9 == 0, "strings").otherwise("")).alias("label"), F.col("p_type").alias("description"), F.col("p_size").alias("created_at"))
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("campaign_id"), F.col("c_name").alias("label"), F.when(F.col("c_custkey") % 2 == 0, "a ring").otherwise("none").alias("description"), F.lit(0).alias("created_at"))
    g = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("all RINGS").alias("description"), F.pmod("r_regionkey", F.lit(3)).cast("int").alias("team"), F.lit(0).alias("created_at"))
    return L.searched_in_scope(c, p, a, g, "rings", 1, [2])


_KNOWN = f"""k AS (SELECT 's' || l_suppkey AS gwm_id, 'p' || l_partkey AS attribute_label, CASE WHEN l_orderkey % 3 > 0 THEN 'team ' || l_orderkey % 3 END AS team, l_shipdate AS last_updated, l_orderkey AS tie, round(1 - l_discount, 2) AS confidence, l_returnflag = 'N' AS present FROM lineitem WHERE l_shipdate <= TIMESTAMP '{REF}'),
q AS (SELECT DISTINCT 's' || l_suppkey AS gwm_id, 'p' || (l_partkey + l_linenumber % 2) AS attribute_label FROM lineitem WHERE l_orderkey % 50 != 0)"""
_TIER = f"CASE WHEN last_updated > TIMESTAMP '{REF}' - INTERVAL 3 DAYS THEN 'fresh' WHEN last_updated > TIMESTAMP '{REF}' - INTERVAL 14 DAYS THEN 'warm' WHEN last_updated > TIMESTAMP '{REF}' - INTERVAL 30 DAYS THEN 'stale' ELSE 'expired' END"


def _best(scope: str) -> str:
    return f"b AS (SELECT q.*, k.team, last_updated, tie, confidence, present, {_TIER} AS tier FROM q LEFT JOIN k ON k.gwm_id = q.gwm_id AND k.attribute_label = q.attribute_label AND ({scope}) QUALIFY row_number() OVER (PARTITION BY q.gwm_id, q.attribute_label ORDER BY coalesce(k.team = '{TEAM}', false) DESC, last_updated DESC NULLS LAST, tie DESC, confidence DESC, present DESC) = 1)"


_OWN = _best(f"k.team IS NULL OR k.team = '{TEAM}'")
_SUM = "count(*) AS total, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'no_match') AS no_match, count(*) FILTER (WHERE status = 'error') AS errors"
_LOOKED = """r AS (SELECT p_partkey // 20 AS batch, p_partkey AS position, p_name || CASE WHEN p_partkey % 5 = 2 THEN '|x' ELSE '' END AS name, CASE WHEN p_partkey % 5 > 1 THEN 'g' || p_partkey END AS gwm_id, CASE WHEN p_partkey % 5 > 2 THEN round(p_size / 50, 2) END AS confidence,
  CASE p_partkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'no_match' ELSE 'matched' END AS status, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_size > 25 THEN repeat('time|out ', 12) WHEN p_size > 10 THEN 'refused' END END AS error, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS i FROM part)"""
_JOBS = """j AS (SELECT o_custkey AS batch, o_orderkey AS place, CASE WHEN o_orderkey % 40 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'validation_pair' ELSE 'report' END AS job_type, o_orderkey % 30 != 2 AS has_job, * FROM orders),
bad AS (SELECT batch, place, CASE WHEN job_type = '' THEN 'job ' || place || ' has no job_type' ELSE 'job ' || place || ' has no validation_job_id' END AS reason FROM j WHERE job_type = '' OR (job_type = 'validation_pair' AND NOT has_job))"""
_THINGS = "t AS (SELECT 'part:' || p_partkey AS id, * FROM part)"
_DEGREE = "deg AS (SELECT n, count(*) AS d FROM (SELECT s AS n FROM e UNION ALL SELECT o FROM e) GROUP BY 1)"
_MINE = "mine AS (SELECT n_nationkey AS campaign_id, * FROM nation WHERE n_regionkey = 1 OR n_nationkey % 3 = 2)"
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_") and k != "q_score_latest"}
ORACLES = {
    "q_staleness_map": f"WITH {_KNOWN}, {_OWN} SELECT gwm_id, attribute_label, tier, CASE WHEN tier IN ('fresh', 'warm') THEN team END AS team, CASE WHEN tier IN ('fresh', 'warm') THEN present END AS present, CASE WHEN tier IN ('fresh', 'warm') THEN confidence END AS confidence FROM b",
    "q_staleness_shared": f"WITH {_KNOWN}, {_best('k.team IS NULL')} SELECT tier, count(*) AS n, count(*) FILTER (WHERE tier IN ('fresh', 'warm')) AS cached FROM b GROUP BY 1",
    "q_knowledge_batch": f"WITH {_KNOWN}, {_OWN} SELECT * FROM b WHERE tier IN ('fresh', 'warm')",
    "q_knowledge_young": f"WITH {_KNOWN} SELECT * FROM k WHERE last_updated > TIMESTAMP '{REF}' - INTERVAL 168 HOURS AND (gwm_id, attribute_label) IN (SELECT (gwm_id, attribute_label) FROM q)",
    "q_knowledge_campaigns": f"WITH {_KNOWN} SELECT s_nationkey AS campaign_id, {_TIER} AS tier, team, count(*) AS n, max(last_updated) AS newest FROM k JOIN supplier ON gwm_id = 's' || s_suppkey WHERE s_suppkey % 7 != 0 GROUP BY ALL",
    "q_compare_ordered": f"""WITH {LATEST}, {W}, a AS (SELECT * FROM (VALUES (0::INT, 7::BIGINT), (1, 2), (2, 5)) t(position, entity_id)), v AS (SELECT *, present::INT * 10 + confidence AS k FROM latest WHERE entity_id IN (2, 5, 7)),
h AS (SELECT *, k = max(k) OVER w AND max(k) OVER w != min(k) OVER w AS is_best, k = min(k) OVER w AND max(k) OVER w != min(k) OVER w AS is_worst FROM v WINDOW w AS (PARTITION BY attribute_id))
SELECT w.attribute_id, attribute_label, weight, position, a.entity_id, s_name AS entity_label, present, confidence, coalesce(is_best, false) AS is_best, coalesce(is_worst, false) AS is_worst FROM w CROSS JOIN a JOIN supplier ON s_suppkey = a.entity_id LEFT JOIN h ON h.attribute_id = w.attribute_id AND h.entity_id = a.entity_id""",
    "q_campaign_counts": f"""WITH {LATEST}, {W}, sc AS (SELECT entity_id, sum(CASE WHEN present THEN weight ELSE 0 END) AS t FROM latest JOIN w USING (attribute_id) GROUP BY 1)
SELECT n_nationkey AS campaign_id, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS entity_count, (SELECT count(DISTINCT attribute_id) FROM res JOIN supplier ON s_suppkey = entity_id WHERE s_nationkey = n_nationkey) AS attribute_count,
  (SELECT count(*) FROM res JOIN supplier ON s_suppkey = entity_id WHERE s_nationkey = n_nationkey) AS result_count, (SELECT max(created_at) FROM res JOIN supplier ON s_suppkey = entity_id WHERE done AND s_nationkey = n_nationkey) AS last_completed_at,
  (SELECT round(sum(t)::DOUBLE / count(*), 2) FROM sc JOIN supplier ON s_suppkey = entity_id WHERE s_nationkey = n_nationkey) AS avg_score, r_name AS program_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey""",
    "q_campaign_totals": f"""WITH {_MINE}, s AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT campaign_id FROM mine)), r AS (SELECT * FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM s))
SELECT (SELECT count(*) FROM mine) AS campaigns, (SELECT count(*) FROM s) AS entities, (SELECT count(*) FROM r) AS results, (SELECT count(*) FROM r WHERE l_shipdate > TIMESTAMP '{REF}' - INTERVAL 7 DAYS AND l_shipdate <= TIMESTAMP '{REF}') AS jobs_last_7_days, (SELECT count(DISTINCT (l_suppkey, l_partkey)) FROM r) AS knowledge_entries""",
    "q_effective_weights": "SELECT campaign_id, attribute_id, coalesce(o, p_retailprice, 1.0)::DOUBLE AS weight, o IS NOT NULL AS overridden FROM (SELECT s_nationkey AS campaign_id, l_partkey AS attribute_id, max(l_quantity) FILTER (WHERE l_quantity > 45) AS o FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) LEFT JOIN part ON p_partkey = attribute_id AND p_size != 13",
    "q_mentionable_users": "WITH sh AS (SELECT n_regionkey AS session, n_nationkey AS team FROM nation UNION SELECT (n_regionkey + 1) % 5, n_nationkey FROM nation WHERE n_nationkey % 2 = 0), m AS (SELECT c_nationkey AS team, c_custkey AS sid, c_name FROM customer UNION SELECT (c_nationkey + 5) % 25, c_custkey, c_name FROM customer) SELECT DISTINCT session, sid, c_name AS display_name FROM sh JOIN m USING (team)",
    "q_notifications": "SELECT event_id, user_id, event_type, props::JSON ->> '$.k' AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 50",
    "q_set_operations": "WITH a AS (SELECT DISTINCT l_suppkey AS entity_id, l_partkey AS attribute_id FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1996-03'), b AS (SELECT DISTINCT l_suppkey AS entity_id, l_partkey AS attribute_id FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1996-04') SELECT 'union' AS op, * FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersection', * FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'difference', * FROM (FROM a EXCEPT FROM b)",
    "q_batch_statuses": f"WITH {_LOOKED} SELECT batch, {_SUM} FROM r GROUP BY 1",
    "q_batch_report": rf"""WITH {_LOOKED}, c AS (SELECT batch, {_SUM}, string_agg('| ' || i || ' | ' || replace(name, '|', '\|') || ' | ' || CASE WHEN status = 'matched' THEN coalesce(gwm_id, '—') ELSE '—' END || ' | ' || CASE WHEN status = 'matched' AND confidence IS NOT NULL THEN round_even(confidence * 100, 0)::BIGINT || '%' ELSE '—' END || ' | ' ||
  CASE status WHEN 'matched' THEN 'Matched' WHEN 'no_match' THEN 'No match' ELSE 'Error: ' || replace(CASE WHEN length(error) > 80 THEN left(error, 77) || '...' ELSE coalesce(error, 'Unknown error') END, '|', '\|') END || ' |', chr(10) ORDER BY i) AS lines FROM r GROUP BY 1)
SELECT batch, 'Processed ' || total || ' name' || CASE WHEN total = 1 THEN '' ELSE 's' END || ': ' || matched || ' matched, ' || no_match || ' no match, ' || errors || ' error' || CASE WHEN errors = 1 THEN '' ELSE 's' END || chr(10) || chr(10) || '| # | Entity Name | Client ID | Confidence | Status |' || chr(10) || '|---|-------------|-----------|------------|--------|' || chr(10) || lines AS report FROM c""",
    "q_batch_json": f"WITH {_LOOKED}, c AS (SELECT batch, {_SUM}, list({{'name': name, 'gwm_id': gwm_id, 'confidence': confidence, 'status': status}} ORDER BY i) AS results FROM r GROUP BY 1) SELECT batch, to_json({{'summary': {{'total': total, 'matched': matched, 'no_match': no_match, 'errors': errors}}, 'results': results}})::VARCHAR AS body FROM c",
    "q_enqueue_many": f"WITH {_JOBS} SELECT batch, place, job_type, '{{\"status\":\"' || o_orderstatus || '\"}}' AS payload, CASE WHEN place % 7 = 0 THEN 9 ELSE 3 END::INT AS max_attempts, CASE WHEN place % 4 = 0 THEN 5 ELSE 0 END::INT AS priority, CASE WHEN place % 5 = 0 THEN o_orderdate ELSE TIMESTAMP '{REF}' END AS run_at, 'pending' AS status FROM j WHERE batch NOT IN (SELECT batch FROM bad)",
    "q_enqueue_refused": f"WITH {_JOBS} SELECT batch, arg_min(reason, place) AS reason FROM bad GROUP BY 1",
    "q_merged_extractions": "WITH r AS (SELECT l_orderkey AS chunk, l_linenumber AS place, CASE WHEN l_linenumber % 2 = 0 THEN ' SUPPLIER ' || l_suppkey || ' ' ELSE 'Supplier ' || l_suppkey END AS subject, l_returnflag AS predicate, CASE WHEN l_linenumber % 2 = 0 THEN ' PART ' || l_partkey || ' ' ELSE 'Part ' || l_partkey END AS object, l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT chunk, place, subject, predicate, object FROM r QUALIFY row_number() OVER (PARTITION BY a, predicate, b ORDER BY chunk, place, subject) = 1",
    "q_merged_names": "WITH r AS (SELECT p_partkey // 100 AS chunk, p_partkey AS place, CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS name, p_type, lower(p_name) AS key FROM part) SELECT chunk, place, name, p_type FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY place) = 1",
    "q_merged_aliases": f"WITH {WINNERS}, {_THINGS}, g AS (SELECT winner, list(name) || list(brand) AS more FROM (SELECT winner, p_name AS name, p_brand AS brand FROM win JOIN t ON t.id = loser) GROUP BY 1) SELECT id, p_name AS name, CASE WHEN more IS NULL THEN p_brand ELSE array_to_string(list_sort(list_distinct(list_append(more, p_brand))), ';') END AS aliases FROM t LEFT JOIN g ON winner = id WHERE id NOT IN (SELECT loser FROM win)",
    "q_kg_search": f"WITH {EDGES}, {_DEGREE}, {_THINGS}, a AS (SELECT * FROM (VALUES ('ring'), ('brand#13'), ('promo')) v(asked)), h AS (SELECT asked, id, p_name AS name FROM a, t WHERE contains(lower(p_name), asked) OR lower(p_brand) = asked OR contains(lower(p_type), asked) QUALIFY row_number() OVER (PARTITION BY asked ORDER BY p_size DESC, id) <= 50) SELECT asked, id, name, coalesce(d, 0) AS degree FROM h LEFT JOIN deg ON n = id",
    "q_suggest_degree": f"WITH {EDGES}, {_DEGREE}, {_THINGS}, n AS (SELECT id, p_name AS name, {_grams('p_name')} AS ga, {_grams("'smal rng'")} AS gb FROM t), h AS (SELECT id, name, {SIM} AS s FROM n WHERE {SIM} > 0.1 OR contains(lower(name), 'smal rng') ORDER BY s DESC, name, id LIMIT 25) SELECT id, name, round(s, 6) AS sim, coalesce(d, 0) AS degree FROM h LEFT JOIN deg ON n = id",
    "q_matrix_csv": rf"""WITH {CELLS}, x AS (SELECT entity_id, attribute, coalesce(value_select, value_numeric::DECIMAL(18,2)::VARCHAR, CASE WHEN value_boolean THEN 'True' WHEN NOT value_boolean THEN 'False' END) AS v FROM cells), p AS (SELECT entity_id, max(v) FILTER (WHERE attribute = 'balance') AS b, max(v) FILTER (WHERE attribute = 'spend') AS s, max(v) FILTER (WHERE attribute = 'in_credit') AS i, max(v) FILTER (WHERE attribute = 'segment') AS g FROM x GROUP BY 1)
SELECT CASE WHEN c_custkey % 3 = 0 THEN '''=' ELSE '' END || c_name AS "Entity", CASE WHEN c_custkey % 4 != 0 THEN 'g' || c_custkey ELSE '' END AS "GWM ID", coalesce(CASE WHEN b LIKE '-%' THEN '''' ELSE '' END || b, '') AS "Balance, net", coalesce(s, '') AS "Spend", coalesce(i, '') AS "In credit", coalesce(g, '') AS "spend (segment)", '' AS "Unused" FROM customer LEFT JOIN p ON entity_id = c_custkey""",
    "q_search_scoped": f"""WITH {_MINE},
c AS (SELECT 'campaigns' AS category, campaign_id::VARCHAR AS id, 'Rings of ' || n_name AS label, false AS hit, (row_number() OVER (ORDER BY campaign_id DESC))::INT AS rank FROM mine),
p AS (SELECT p_partkey, p_size, p_name || CASE WHEN p_partkey % 9 = 0 THEN 'strings' ELSE '' END AS label, p_partkey % 25 AS n FROM part), e AS (SELECT 'entities' AS category, p_partkey::VARCHAR AS id, label, regexp_matches(label, '\\brings?\\b') AS hit, (row_number() OVER (ORDER BY regexp_matches(label, '\\brings?\\b') DESC, p_size DESC, p_partkey))::INT AS rank FROM p WHERE n IN (SELECT campaign_id FROM mine) AND (regexp_matches(label, '\\brings?\\b') OR contains(label, 'rings'))),
a AS (SELECT 'attributes' AS category, c_custkey::VARCHAR AS id, c_name AS label, true AS hit, (row_number() OVER (ORDER BY c_name, c_custkey))::INT AS rank FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey IN (SELECT campaign_id FROM mine)),
g AS (SELECT 'programs' AS category, r_regionkey::VARCHAR AS id, r_name AS label, false AS hit, (row_number() OVER (ORDER BY r_regionkey))::INT AS rank FROM region WHERE r_regionkey % 3 = 2)
SELECT * FROM (FROM c UNION ALL FROM e UNION ALL FROM a UNION ALL FROM g) WHERE rank <= 20""",
}
