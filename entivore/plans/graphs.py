"""Knowledge-graph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entivore.functions.text import normal_key
from entivore.operators import graph as G
from entivore.operators.relational import first_per_key
from entivore.sources.tables import edges, located, table

EDGES = """e AS (SELECT 'supplier:' || l_suppkey AS s, CASE l_returnflag WHEN 'N' THEN 'supplies' WHEN 'R' THEN 'recalled' WHEN 'A' THEN 'offers' END AS predicate, 'part:' || l_partkey AS o,
  round(1 - l_discount, 2) AS confidence, strftime(l_shipdate, '%Y-%m') AS session, l_shipdate AS created_at, l_orderkey AS tie1, l_linenumber AS tie2 FROM lineitem)"""
LOCATED = """loc AS (SELECT 'supplier:' || s_suppkey AS s, 'nation:' || s_nationkey AS o FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""


def q_kg_vertices(spark, sf_dir):
    kinds = (("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"))
    each = [table(spark, sf_dir, t).select(F.concat(F.lit(f"{t}:"), F.col(k)).alias("id"), F.col(v).alias("name"), F.lit(t).alias("type")) for t, k, v in kinds]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def q_kg_edges(spark, sf_dir):
    """The newest edge of each pair."""
    return first_per_key(edges(spark, sf_dir), ["s", "o"], ["created_at desc", "tie1", "tie2"]).select("s", "predicate", "o", "confidence")


def q_kg_stats(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.agg(F.count("*").alias("n_edges"), F.countDistinct("s", "o").alias("n_pairs"), F.countDistinct("predicate").alias("n_predicates"), F.countDistinct("s").alias("n_subjects"), F.count_if(F.col("confidence") >= 0.95).alias("n_sure"))


def q_kg_aggregates(spark, sf_dir):
    e = edges(spark, sf_dir)
    a = e.groupBy(F.concat(F.lit("predicate:"), "predicate").alias("name")).agg(F.count("*").alias("n"))
    b = q_kg_vertices(spark, sf_dir).groupBy(F.concat(F.lit("type:"), "type").alias("name")).agg(F.count("*").alias("n"))
    return a.unionByName(b)


def q_kg_degree_rank(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir)).orderBy(F.desc("degree"), "name").limit(500)


def q_kg_neighbors(spark, sf_dir):
    return G.neighbourhood(located(spark, sf_dir), ["supplier:1"], 3)


def q_kg_paths(spark, sf_dir):
    """From a supplier along its parts to other suppliers, their nation and its region."""
    supplies = edges(spark, sf_dir).select("s", "o")
    back = supplies.select(F.col("o").alias("s"), F.col("s").alias("o"))
    return G.paths(supplies.unionByName(back).unionByName(located(spark, sf_dir)), "supplier:1", "region:0", 4, 5)


def q_deal_partners(spark, sf_dir):
    return G.partners(edges(spark, sf_dir))


def _families(df):
    """Supplies and offers are trade, recalls are of another family."""
    return df.withColumn("family", F.when(F.col("predicate") == "recalled", "quality").otherwise("trade"))


def q_kg_conflicts(spark, sf_dir):
    return G.conflicts(_families(edges(spark, sf_dir)), ["created_at", "tie1", "tie2"]).where("status = 'conflict'").select("s", "o", "old_predicate", "predicate", "status")


def _winners(spark, sf_dir):
    """Parts of one name are one thing: the one with most edges stays, of those the oldest (smallest key)."""
    p = table(spark, sf_dir, "part").select(normal_key(F.col("p_name")).alias("key"), "p_partkey")
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    p = p.join(n, "p_partkey", "left")
    best = p.groupBy("key").agg(F.max_by("p_partkey", F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.col("p_partkey")).alias("k"))).alias("best"))
    return p.join(best, "key").where("p_partkey != best").select(F.concat(F.lit("part:"), "p_partkey").alias("loser"), F.concat(F.lit("part:"), "best").alias("winner"))


def q_kg_merge(spark, sf_dir):
    return G.merged(_families(edges(spark, sf_dir)), _winners(spark, sf_dir))


def q_kg_dedup(spark, sf_dir):
    return _winners(spark, sf_dir)


def q_kg_promotable(spark, sf_dir):
    return G.promotable(edges(spark, sf_dir), 0.95, 2)


def q_kg_promote_edges(spark, sf_dir):
    """Sure edges between promoted subjects and parts that master (size up to 25) has."""
    e = edges(spark, sf_dir).where("confidence >= 0.97")
    up = G.promotable(edges(spark, sf_dir), 0.95, 2).select(F.col("name").alias("s"))
    parts = table(spark, sf_dir, "part").where("p_size <= 25").select(F.concat(F.lit("part:"), "p_partkey").alias("o"))
    return e.join(up, "s", "left_semi").join(parts, "o", "left_semi").select("s", "predicate", "o").distinct()


def q_find_or_create(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return G.find_or_create(part.select(F.upper("p_name").alias("name")), part.where("p_size <= 2").select(F.col("p_name").alias("name")), part.where("p_size BETWEEN 3 AND 4").select(F.col("p_name").alias("name")))


def q_kg_top_edges(spark, sf_dir):
    """Twenty named entities, then the fifty surest edges at them."""
    names = table(spark, sf_dir, "supplier").orderBy("s_name", "s_suppkey").limit(20).select(F.concat(F.lit("supplier:"), "s_suppkey").alias("s"))
    return edges(spark, sf_dir).join(F.broadcast(names), "s", "left_semi").orderBy(F.desc("confidence"), "s", "o", "tie1", "tie2", "created_at").limit(50).select("s", "predicate", "o", "confidence")


WINNERS = """d AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY lower(trim(p_name)) ORDER BY coalesce(n, 0) DESC, p_partkey) AS best FROM part LEFT JOIN d ON l_partkey = p_partkey),
win AS (SELECT 'part:' || p_partkey AS loser, 'part:' || best AS winner FROM p WHERE p_partkey != best)"""
FAMILY = "CASE WHEN predicate = 'recalled' THEN 'quality' ELSE 'trade' END"
VERTICES = " UNION ALL ".join(f"SELECT '{t}:' || {k} AS id, {v} AS name, '{t}' AS type FROM {t}" for t, k, v in (("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name")))
PROMOTED = "up AS (SELECT s AS name, sum(confidence::DECIMAL(4,2))::DOUBLE / count(*) AS a, count(DISTINCT session) AS sessions FROM e GROUP BY 1 HAVING sum(confidence::DECIMAL(4,2))::DOUBLE / count(*) >= 0.95 AND count(DISTINCT session) >= 2)"
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_kg_vertices": VERTICES,
    "q_kg_edges": f"WITH {EDGES} SELECT s, predicate, o, confidence FROM e QUALIFY row_number() OVER (PARTITION BY s, o ORDER BY created_at DESC, tie1, tie2) = 1",
    "q_kg_stats": f"WITH {EDGES} SELECT count(*) AS n_edges, count(DISTINCT (s, o)) AS n_pairs, count(DISTINCT predicate) AS n_predicates, count(DISTINCT s) AS n_subjects, count(*) FILTER (WHERE confidence >= 0.95) AS n_sure FROM e",
    "q_kg_aggregates": f"WITH {EDGES}, v AS ({VERTICES}) SELECT 'predicate:' || predicate AS name, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT 'type:' || type, count(*) FROM v GROUP BY 1",
    "q_kg_degree_rank": f"WITH {EDGES} SELECT name, count(*) AS degree FROM (SELECT s AS name FROM e UNION ALL SELECT o FROM e) GROUP BY 1 ORDER BY degree DESC, name LIMIT 500",
    "q_kg_neighbors": f"""WITH RECURSIVE {LOCATED}, b AS (SELECT s AS node, o AS nxt FROM loc UNION SELECT o, s FROM loc),
r(node, hop) AS (SELECT 'supplier:1', 0 UNION SELECT nxt, hop + 1 FROM r JOIN b USING (node) WHERE hop < 2), m AS (SELECT node, min(hop) AS hop FROM r GROUP BY 1)
SELECT s, o, (least(a.hop, z.hop) + 1)::INT AS hop FROM (SELECT DISTINCT * FROM loc) LEFT JOIN m a ON a.node = s LEFT JOIN m z ON z.node = o WHERE a.hop IS NOT NULL OR z.hop IS NOT NULL""",
    "q_kg_paths": f"""WITH RECURSIVE {EDGES}, {LOCATED}, x AS (SELECT DISTINCT s, o FROM e), g AS (SELECT s, o FROM x UNION SELECT o, s FROM x UNION SELECT s, o FROM loc),
r(node, hops, nodes) AS (SELECT o, 1, [s, o] FROM g WHERE s = 'supplier:1' UNION ALL SELECT g.o, hops + 1, list_append(nodes, g.o) FROM r JOIN g ON g.s = r.node WHERE hops < 4 AND r.node != 'region:0' AND (hops < 2 OR starts_with(g.o, 'nation:') OR starts_with(g.o, 'region:')) AND NOT list_contains(nodes, g.o))
SELECT hops, array_to_string(nodes, '>') AS path FROM r WHERE node = 'region:0' ORDER BY hops, path LIMIT 5""",
    "q_deal_partners": f"WITH {EDGES}, d AS (SELECT DISTINCT s, o FROM e) SELECT a.s AS person1, b.s AS person2, count(*) AS n_shared FROM d a JOIN d b ON a.o = b.o AND a.s < b.s GROUP BY 1, 2",
    "q_kg_conflicts": f"WITH {EDGES}, h AS (SELECT *, lag(predicate) OVER (PARTITION BY s, o, {FAMILY} ORDER BY created_at, tie1, tie2) AS old_predicate FROM e) SELECT s, o, old_predicate, predicate, 'conflict' AS status FROM h WHERE old_predicate != predicate",
    "q_kg_merge": f"""WITH {EDGES}, {WINNERS}, x AS (SELECT DISTINCT coalesce(a.winner, s) AS s, predicate, {FAMILY} AS family, coalesce(b.winner, o) AS o, a.winner IS NULL AND b.winner IS NULL AS own FROM e LEFT JOIN win a ON a.loser = s LEFT JOIN win b ON b.loser = o)
SELECT DISTINCT s, predicate, o FROM x WHERE s != o AND (own OR (s, o, family) NOT IN (SELECT (s, o, family) FROM x WHERE own))""",
    "q_kg_dedup": f"WITH {WINNERS} SELECT * FROM win",
    "q_kg_promotable": f"WITH {EDGES}, {PROMOTED} SELECT name, round(a, 6) AS avg_conf, sessions FROM up",
    "q_kg_promote_edges": f"WITH {EDGES}, {PROMOTED} SELECT DISTINCT s, predicate, o FROM e WHERE confidence >= 0.97 AND s IN (SELECT name FROM up) AND o IN (SELECT 'part:' || p_partkey FROM part WHERE p_size <= 25)",
    "q_find_or_create": "WITH n AS (SELECT lower(trim(p_name)) AS key, min(upper(p_name)) AS name FROM part GROUP BY 1) SELECT name, CASE WHEN key IN (SELECT lower(trim(p_name)) FROM part WHERE p_size <= 2) THEN 'team' WHEN key IN (SELECT lower(trim(p_name)) FROM part WHERE p_size BETWEEN 3 AND 4) THEN 'copied' ELSE 'created' END AS resolution_mode FROM n",
    "q_kg_top_edges": f"WITH {EDGES}, t AS (SELECT 'supplier:' || s_suppkey AS s FROM supplier ORDER BY s_name, s_suppkey LIMIT 20) SELECT s, predicate, o, confidence FROM e WHERE s IN (SELECT s FROM t) ORDER BY confidence DESC, s, o, tie1, tie2, created_at LIMIT 50",
}
