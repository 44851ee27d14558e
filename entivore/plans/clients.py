"""Resolving names, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entivore.functions import text as X
from entivore.operators import clients as C
from entivore.plans.texts import SIM, _grams
from entivore.sources.tables import table


def _names(spark, sf_dir):
    """Every part name as a person's, some with a letter too few; every third asks for a company."""
    n = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return n.select(F.concat(F.lit("Mr. "), F.when(F.col("k") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.expr("left(p_name, length(p_name) - 2)")))).alias("name"), F.when(F.col("k") % 3 == 0, "acme").alias("company"))


def _directory(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size <= 40").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("id"))


def _queue(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("label")).agg(F.min("p_partkey").alias("id"))


def _candidates(spark, sf_dir):
    n = _names(spark, sf_dir)
    both = C.fuzzy_candidates(n, _directory(spark, sf_dir)).unionByName(C.queue_candidates(n, _queue(spark, sf_dir), 0.6))
    return C.best_per_id(both)


def q_word_similarity(spark, sf_dir):
    return _queue(spark, sf_dir).select("id", F.round(X.word_similarity(F.lit("small bolt"), F.col("label")), 6).alias("sim"))


def q_fuzzy_candidates(spark, sf_dir):
    return C.fuzzy_candidates(_names(spark, sf_dir), _directory(spark, sf_dir)).select("name", "id", F.round("score", 6).alias("score"))


def q_client_candidates(spark, sf_dir):
    """The ten best candidates of each name in either source, the best one of each id."""
    return _candidates(spark, sf_dir).select("name", "source", "id", "label", F.round("score", 6).alias("score"))


def q_client_fast_path(spark, sf_dir):
    return C.fast_path(_names(spark, sf_dir), C.fuzzy_candidates(_names(spark, sf_dir), _directory(spark, sf_dir), 0.8)).select("name", "id", "source", F.round("confidence", 6).alias("confidence"))


def q_client_fallback(spark, sf_dir):
    fuzzy = C.fuzzy_candidates(_names(spark, sf_dir), _directory(spark, sf_dir))
    return C.fallback(_names(spark, sf_dir), fuzzy).select("name", "found", "id", F.round("confidence", 6).alias("confidence"))


def q_client_decision(spark, sf_dir):
    """Decisions made of the names' own keys, held against the fuzzy candidates."""
    n = _names(spark, sf_dir)
    fuzzy = C.fuzzy_candidates(n, _directory(spark, sf_dir))
    best = fuzzy.groupBy("name").agg(F.max_by("id", F.struct("score", (-F.col("id")).alias("i"))).alias("id"))
    d = best.select("name", "id", F.round(0.6 + F.pmod("id", F.lit(35)) / 100, 2).alias("confidence"), (F.col("id") % 11 == 0).alias("conflict"), (F.col("id") % 7 == 0).alias("ambiguous"))
    return C.decided(d, fuzzy)


def q_client_batch(spark, sf_dir):
    """Parts as people: titles and case apart, one of each name is looked up."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Dr. "), F.initcap("p_name"))).otherwise(F.col("p_name")).alias("name"), F.col("p_brand").alias("company"))
    return C.once_each(p)


def q_attribute_verdicts(spark, sf_dir):
    """Verdicts of each supplier on sizes of parts, by number, aligned with all sizes: those that are missing are absent, with a note."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("int").alias("number"))
    v = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' AND l_quantity > 45").join(p, "l_partkey").groupBy(F.col("l_suppkey").alias("entity_id"), "number")
    v = v.agg(F.max(F.col("l_returnflag") == "N").alias("present"), F.max("l_tax").alias("confidence"))
    return C.aligned(v, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id")), p.select("number", F.format_string("size %d", "number").alias("label")).distinct())


def q_attribute_clusters(spark, sf_dir):
    """Clusters by type of at most ten attributes, by key; attributes without a brand of one digit go to the rest."""
    p = table(spark, sf_dir, "part").withColumn("cluster", F.when(F.length("p_brand") <= 7, F.col("p_type")))
    return C.clustered(p, "cluster", "p_partkey", 10).select("p_partkey", "cluster", "part")


def q_batch_summary(spark, sf_dir):
    """How many names were found, not found, or failed (blank)."""
    n = _names(spark, sf_dir)
    r = C.fallback(n, C.fuzzy_candidates(n, _directory(spark, sf_dir), 0.5))
    return r.agg(F.count_if("found").alias("matched"), F.count_if(~F.col("found")).alias("no_match"), F.count("*").alias("total"))


N = "n AS (SELECT 'Mr. ' || CASE WHEN k % 2 = 0 THEN p_name ELSE left(p_name, len(p_name) - 2) END AS name, CASE WHEN k % 2 = 0 THEN p_name ELSE left(p_name, len(p_name) - 2) END AS a, k, CASE WHEN k % 3 = 0 THEN 'acme' END AS company FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1)), dir AS (SELECT p_name AS b, min(p_partkey) AS id FROM part WHERE p_size <= 40 GROUP BY 1)"


def _fuzzy(least: float) -> str:
    return f"{N}, x AS (SELECT name, a, company, {_grams('a')} AS ga, id, b, {_grams('b')} AS gb FROM n, dir), c AS (SELECT name, company, id, {SIM} AS score FROM x WHERE {SIM} >= {least} QUALIFY row_number() OVER (PARTITION BY name ORDER BY {SIM} DESC, id) <= 10)"


_ORDERED = r"flatten(list_transform(list_filter(regexp_split_to_array(lower(label), '[^\p{L}\p{N}]+'), lambda w: w != ''), lambda w: list_transform(range(len(w) + 1), lambda i: substr('  ' || w || ' ', (i + 1)::INT, 3))))"
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_word_similarity": f"""WITH l AS (SELECT p_name || ' ' || lower(p_type) AS label, min(p_partkey) AS id FROM part GROUP BY 1), t AS (SELECT id, {_ORDERED} AS t, {_grams("'small bolt'")} AS ga FROM l),
e AS (SELECT id, ga, list_distinct(t[i:j]) AS gb FROM (SELECT id, ga, t, unnest(range(1, len(t) + 1)) AS i FROM t) q1, LATERAL (SELECT unnest(range(q1.i, len(q1.t) + 1)) AS j) q2) SELECT id, round(max({SIM}), 6) AS sim FROM e GROUP BY 1""",
    # a part that is similar enough holds 60 % of the name's trigrams; labels that don't are left out before parts are made
    "q_client_candidates": rf"""WITH {_fuzzy(0.3)}, l AS (SELECT p_name || ' ' || lower(p_type) AS label, min(p_partkey) AS id FROM part GROUP BY 1), lt AS (SELECT label, id, {_ORDERED} AS t FROM l),
y AS (SELECT name, a, id, label, ga, list_filter(range(len(t)), lambda i: list_contains(ga, t[i + 1])) AS h, t FROM (SELECT name, a, {_grams('a')} AS ga FROM n), lt WHERE len(list_intersect(ga, list_distinct(t))) >= 0.6 * len(ga) - 1e-9),
e AS (SELECT name, id, label, ga, list_distinct(t[i + 1 : j + 1]) AS gb FROM (SELECT name, id, label, ga, t, h, unnest(h) AS i FROM y) q1, LATERAL (SELECT unnest(q1.h) AS j) q2 WHERE j >= i),
w AS (SELECT name, id, label, max({SIM}) AS score FROM e GROUP BY 1, 2, 3 HAVING score >= 0.6 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, id) <= 10)
SELECT name, 'directory' AS source, id, b AS label, round(score, 6) AS score FROM c JOIN dir USING (id) UNION ALL SELECT name, 'queue', id, label, round(score, 6) FROM w""",
    "q_fuzzy_candidates": f"WITH {_fuzzy(0.3)} SELECT name, id, round(score, 6) AS score FROM c",
    "q_client_fast_path": f"WITH {_fuzzy(0.8)} SELECT name, min(id) AS id, 'directory' AS source, round(least(max(score), 0.95), 6) AS confidence FROM c WHERE company IS NULL GROUP BY name HAVING count(DISTINCT id) = 1 AND max(score) >= 0.85",
    "q_client_fallback": f"WITH {_fuzzy(0.3)}, b AS (SELECT name, arg_max(id, (score, -id)) AS id, least(max(score), 0.6) AS confidence FROM c GROUP BY 1) SELECT n.name, coalesce(confidence, 0.0) >= 0.4 AS found, CASE WHEN confidence >= 0.4 THEN id END AS id, round(coalesce(confidence, 0.0), 6) AS confidence FROM (SELECT DISTINCT name FROM n) n LEFT JOIN b USING (name)",
    "q_client_decision": f"""WITH {_fuzzy(0.3)}, d AS (SELECT name, arg_max(id, (score, -id)) AS id, max(score) AS own FROM c GROUP BY 1), r AS (SELECT name, d.id, own, max(c.score) FILTER (WHERE c.id != d.id) AS rival FROM d JOIN c USING (name) GROUP BY ALL),
k AS (SELECT *, round(0.6 + (id % 35) / 100, 2) AS confidence, id % 11 = 0 AS conflict, id % 7 = 0 AS ambiguous FROM r),
s AS (SELECT *, CASE WHEN conflict THEN 'conflict' WHEN ambiguous THEN 'ambiguous' WHEN confidence < 0.7 THEN 'no_match' WHEN coalesce(own - rival < 0.15 AND confidence < 0.85, false) THEN 'ambiguous' ELSE 'matched' END AS status FROM k)
SELECT name, status, CASE WHEN status IN ('matched', 'no_match') THEN id END AS id, CASE WHEN conflict THEN least(confidence, 0.5) ELSE confidence END AS confidence FROM s""",
    "q_client_batch": "WITH p AS (SELECT p_partkey AS position, p_name AS key, p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'Dr. ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE p_name END AS name FROM part) SELECT position, name, key, min(position) OVER w AS first, first_value(p_brand) OVER w AS company FROM p WINDOW w AS (PARTITION BY key ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "q_attribute_verdicts": "WITH v AS (SELECT l_suppkey AS entity_id, p_size::INT AS number, bool_or(l_returnflag = 'N') AS present, max(l_tax) AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'F' AND l_quantity > 45 GROUP BY 1, 2) SELECT s_suppkey AS entity_id, a.number, 'size ' || a.number AS label, coalesce(present, false) AS present, coalesce(confidence, 0.0) AS confidence, CASE WHEN present IS NULL THEN 'not in the answer' END AS note FROM supplier CROSS JOIN (SELECT DISTINCT p_size::INT AS number FROM part) a LEFT JOIN v ON v.entity_id = s_suppkey AND v.number = a.number",
    "q_attribute_clusters": "WITH p AS (SELECT p_partkey, CASE WHEN len(p_brand) <= 7 THEN p_type ELSE 'General Research' END AS cluster FROM part) SELECT p_partkey, cluster, ((row_number() OVER (PARTITION BY cluster ORDER BY p_partkey) - 1) // 10)::INT AS part FROM p",
    "q_batch_summary": f"WITH {_fuzzy(0.5)}, b AS (SELECT name, max(score) AS s FROM c GROUP BY 1) SELECT count(*) FILTER (WHERE coalesce(s, 0) >= 0.4) AS matched, count(*) FILTER (WHERE coalesce(s, 0) < 0.4) AS no_match, count(*) AS total FROM (SELECT DISTINCT name FROM n) LEFT JOIN b USING (name)",
}
