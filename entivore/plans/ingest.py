"""Taking entities and edges into graphs, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entivore.functions import ontology as O
from entivore.operators import graph as G
from entivore.operators import ingest as N
from entivore.sources.tables import edges, table

#: What raw predicates of orders say, by the rest of their key.
RAW = ("Buys", "purchased", "fan-of", "sponsors", "operates in", "joint venture with", "leads", "ceo of", "coached by", "lives in", "married to", "is near", "rival of", "limited partner in", "founded by")
KINDS = ("person", "company", "location", "pe_fund", "sports_team", "unknown")
BY = ("o_orderdate", "o_orderkey")


def _raw(spark, sf_dir):
    """Orders as raw edges between customers: who, what, whom, how sure."""
    raw = F.element_at(F.array(*[F.lit(x) for x in RAW]), F.pmod("o_orderkey", F.lit(len(RAW))).cast("int") + 1)
    hint = F.when(F.col("o_orderkey") % 7 == 0, "investment").when(F.col("o_orderkey") % 7 == 1, "ownership")
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("s"), F.pmod(F.col("o_orderkey") * 7, F.lit(12)).cast("long").alias("o"), raw.alias("raw"), hint.alias("hint"), F.round(0.4 + F.pmod("o_orderkey", F.lit(60)) / 100, 2).alias("confidence"))


def _gated(spark, sf_dir):
    return O.gated(O.normalised(_raw(spark, sf_dir), "raw", "hint"))


def q_ontology_normalise(spark, sf_dir):
    return O.normalised(_raw(spark, sf_dir), "raw", "hint").select("o_orderkey", "raw", "family", "canonical")


def q_ontology_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("o_orderkey", "canonical", "signal", "keep")


def q_ingest_edges(spark, sf_dir):
    return N.edge_outcomes(_gated(spark, sf_dir), BY).select("o_orderkey", "s", "o", "canonical", "replaces", "outcome")


def q_ingest_counters(spark, sf_dir):
    return N.counters(N.edge_outcomes(_gated(spark, sf_dir), BY))


def q_ingest_active(spark, sf_dir):
    return N.active_edges(N.edge_outcomes(_gated(spark, sf_dir), BY), BY).select("s", "o", "family", "canonical", "confidence")


def q_entity_relevance(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.pmod("c_custkey", F.lit(len(KINDS))).cast("int") + 1)
    kinds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), kind.alias("kind"))
    return N.relevance(_gated(spark, sf_dir).where("canonical IS NOT NULL"), kinds)


def _entities(spark, sf_dir, condition):
    p = table(spark, sf_dir, "part").where(condition)
    return p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_brand", F.split("p_name", " ")[0]), F.lower("p_type")).alias("aliases"), F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise("").alias("context"))


def q_find_or_create_full(spark, sf_dir):
    """Names and aliases of all parts are asked for; small parts are the team's, the next the master's."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).when(F.col("p_partkey") % 5 == 1, F.concat_ws(" ", "p_brand", F.split("p_name", " ")[0])).otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    asked = p.select(F.col("p_partkey").alias("request_id"), name.alias("name"), F.array("p_brand").alias("aliases"), F.when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("about "), F.lower("p_type"))).alias("context"))
    return N.resolved(asked, _entities(spark, sf_dir, "p_size <= 3"), _entities(spark, sf_dir, "p_size BETWEEN 4 AND 12")).select("key", "mode", "entity_id", F.array_join("aliases", "|").alias("aliases"), "context")


def q_contexts(spark, sf_dir):
    """Whether neighbours (by key) in the part table have conflicting types as contexts."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("a"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(b, "p_partkey", "left").select("p_partkey", N.contexts_conflict(F.col("a"), F.col("b")).alias("conflict"))


def _person(spark, sf_dir, condition, tag):
    p = table(spark, sf_dir, "part").where(condition).groupBy(F.col("p_name").alias("name")).agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"), F.min(F.concat(F.lit(tag), "p_type")).alias("d"), F.min("p_size").cast("string").alias("size"))
    return p.select("name", "aliases", F.when(F.length("d") % 2 == 0, F.col("d")).otherwise("").alias("description"), F.create_map(F.lit("size"), "size", F.lit(tag), F.lit("yes")).alias("metadata"))


def q_promote_entities(spark, sf_dir):
    out = N.promoted(_person(spark, sf_dir, "p_size <= 2", "team"), _person(spark, sf_dir, "p_size BETWEEN 2 AND 3", "master"))
    return out.select("name", F.array_join("aliases", "|").alias("aliases"), "description", F.col("metadata")["size"].alias("size"), F.size("metadata").alias("n_metadata"), "outcome")


def _families(df):
    return df.withColumn("family", F.when(F.col("predicate") == "recalled", "quality").otherwise("trade"))


def q_promote_edges_full(spark, sf_dir):
    """Sure edges of parts with even keys go to the master, whose edges are those of 1992 to 1994."""
    e = _families(edges(spark, sf_dir))
    ids = e.select(F.col("s").alias("id")).unionByName(e.where(F.substring_index("o", ":", -1).cast("long") % 2 == 0).select(F.col("o").alias("id"))).distinct()
    mapping = ids.select("id", F.concat(F.lit("m/"), "id").alias("master_id"))
    master = e.where("session < '1995'").select(F.concat(F.lit("m/"), "s").alias("s"), F.concat(F.lit("m/"), "o").alias("o"), "family", "predicate").distinct()
    return N.promoted_edges(e, mapping, master).groupBy("predicate", "outcome").agg(F.count("*").alias("n"), F.min("s").alias("first"))


def q_sync_master(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("master_id"), F.col("s_name").alias("name"), F.lit("own").alias("description"))
    n = table(spark, sf_dir, "nation").where("n_regionkey != 2").select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 1, "shared").alias("description"))
    return N.synced(s, n)


def q_intra_team(spark, sf_dir):
    """Edges of the last month's line items whose supplier and part fall into one of three teams."""
    e = edges(spark, sf_dir).select("s", "o").distinct()
    ends = e.select(F.col("s").alias("entity")).unionByName(e.select(F.col("o").alias("entity"))).distinct()
    teams = ends.select("entity", F.pmod(F.substring_index("entity", ":", -1).cast("long"), F.lit(3)).alias("team")).where("entity NOT LIKE '%9'")
    return N.within_team(e, teams).groupBy("s").agg(F.count_if("ok").alias("inside"), F.count_if(~F.col("ok")).alias("across"))


def q_neighbors_limited(spark, sf_dir):
    """Edges within two steps of a supplier but for one part, first hops first: two hundred."""
    e = edges(spark, sf_dir).where("s != 'part:5' AND o != 'part:5'")
    return G.neighbourhood(e, ["supplier:1"], 2).orderBy("hop", "s", "o").limit(200)


def q_explore(spark, sf_dir):
    return N.explored(edges(spark, sf_dir), "supplier:1", 2, 200)


def q_entity_details(spark, sf_dir):
    """Suppliers by list of ids, with their degrees."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey < 100").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("name"), "s_name")
    return s.join(G.degrees(edges(spark, sf_dir)), "name", "left").select("name", "s_name", F.coalesce("degree", F.lit(0)).alias("degree"))


def q_most_connected(spark, sf_dir):
    """The twenty entities with most edges; a loop counts once."""
    e = edges(spark, sf_dir)
    ends = e.select(F.col("s").alias("name")).unionAll(e.where("s != o").select(F.col("o").alias("name")))
    return ends.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(20)


def q_graph_page(spark, sf_dir):
    """Trade edges at parts whose key ends in 7: the hundred whose better connected end has most edges, and which hop of names they show."""
    e = _families(edges(spark, sf_dir)).where("family = 'trade'").select("s", "predicate", "o").distinct()
    d = G.degrees(e)
    page = e.where(F.col("o").endswith("7"))
    page = page.join(d.select(F.col("name").alias("s"), F.col("degree").alias("ds")), "s").join(d.select(F.col("name").alias("o"), F.col("degree").alias("do")), "o")
    return page.withColumn("rank", F.greatest("ds", "do")).orderBy(F.desc("rank"), "s", "o", "predicate").limit(100).select("s", "predicate", "o", "rank")


def q_graph_nodes(spark, sf_dir):
    """The nodes of the page's edges, once each, with how many of its edges they have."""
    page = q_graph_page(spark, sf_dir)
    return G.degrees(page).withColumnRenamed("degree", "n")


def q_review_flags(spark, sf_dir):
    """Entities flagged once for review: suppliers with a conflicting edge, and their first reason."""
    c = G.conflicts(_families(edges(spark, sf_dir)), ["created_at", "tie1", "tie2"]).where("status = 'conflict'")
    return c.groupBy("s").agg(F.count("*").alias("n_conflicts"), F.min(F.concat_ws(" > ", "old_predicate", "predicate")).alias("reason"))


def q_partner_deals(spark, sf_dir):
    """The parts that each two suppliers share, listed."""
    return G.shared_deals(edges(spark, sf_dir)).select("person1", "person2", "n_shared", F.array_join("deals", "|").alias("deals"))


def q_tool_ids(spark, sf_dir):
    """Ids in the JSON of a tool's answer, each once, in order."""
    s = table(spark, sf_dir, "supplier")
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("supplier:"), "s_suppkey").alias("id")), F.struct(F.concat(F.lit("nation:"), "s_nationkey").alias("id")), F.struct(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))).alias("entities")))
    ids = F.array_distinct(F.transform(F.from_json(body, "entities array<struct<id:string>>")["entities"], lambda x: x["id"]))
    return s.select("s_suppkey", F.array_join(ids, ",").alias("ids"))


def _values() -> str:
    words, rules = [], []
    for place, family in enumerate(O.FAMILIES):
        own = O.PREDICATES[family]
        words += [(p, family, p, place) for p in own] + [(k, family, p, place) for p, keys in O.SPELLINGS[family].items() for k in keys if k not in own]
        for p, signal in own.items():
            least = "NULL" if (family, signal) in O.DROPPED else O.LEAST.get((family, signal), O.DEFAULT_LEAST)
            rules.append(f"('{family}', '{p}', '{signal}', {str(p in O.SYMMETRIC).lower()}, {least})")
    rows = ", ".join(f"('{k}', '{f}', '{c}', {p})" for k, f, c, p in words)
    return f"words AS (SELECT * FROM (VALUES {rows}) t(key, family, canonical, place)), rules AS (SELECT * FROM (VALUES {', '.join(rules)}) t(family, canonical, signal, sym, least))"


_LIST = "[" + ", ".join(f"'{x}'" for x in RAW) + "]"
_BARE = "CASE " + " ".join(f"WHEN ends_with(key, '{s}') AND left(key, -{len(s)}) IN (SELECT key FROM words) THEN left(key, -{len(s)})" for s in O.SUFFIXES) + " END"
NORMAL = f"""{_values()}, raw AS (SELECT o_orderkey, o_orderdate, o_custkey AS s, (o_orderkey * 7 % 12)::BIGINT AS o, {_LIST}[(o_orderkey % {len(RAW)} + 1)::INT] AS raw, CASE o_orderkey % 7 WHEN 0 THEN 'investment' WHEN 1 THEN 'ownership' END AS hint, round(0.4 + (o_orderkey % 60) / 100, 2) AS confidence FROM orders),
keyed AS (SELECT *, regexp_replace(trim(lower(raw)), '[ -]', '_', 'g') AS key FROM raw), bare AS (SELECT *, {_BARE} AS bare FROM keyed),
best AS (SELECT key, arg_min(family, place) AS family, arg_min(canonical, place) AS canonical FROM words GROUP BY 1),
norm AS (SELECT b.*, coalesce(h.family, f.family, g.family) AS family, coalesce(h.canonical, f.canonical, g.canonical) AS canonical FROM bare b LEFT JOIN words h ON h.key = b.key AND h.family = hint LEFT JOIN best f ON f.key = b.key LEFT JOIN best g ON g.key = b.bare),
gate AS (SELECT n.*, signal, sym, coalesce(confidence >= 0.5 AND confidence >= least, false) AS keep FROM norm n LEFT JOIN rules USING (family, canonical)),
pre AS (SELECT *, CASE WHEN canonical IS NULL THEN 'unknown' WHEN NOT keep THEN 'irrelevant' WHEN s = o THEN 'loop' END AS bad, CASE WHEN sym AND s > o THEN o ELSE s END AS s1, CASE WHEN sym AND s > o THEN s ELSE o END AS o1 FROM gate),
good AS (SELECT *, lag(canonical) OVER (PARTITION BY s1, o1, family ORDER BY o_orderdate, o_orderkey) AS replaces FROM pre WHERE bad IS NULL),
done AS (SELECT o_orderkey, o_orderdate, s, o, s1, o1, family, canonical, confidence, replaces, CASE WHEN replaces IS NULL THEN 'new' WHEN replaces = canonical THEN 'duplicate' ELSE 'conflict' END AS outcome FROM good
  UNION ALL SELECT o_orderkey, o_orderdate, s, o, s1, o1, family, canonical, confidence, NULL, bad FROM pre WHERE bad IS NOT NULL)"""
EDGES = """e AS (SELECT 'supplier:' || l_suppkey AS s, CASE l_returnflag WHEN 'N' THEN 'supplies' WHEN 'R' THEN 'recalled' WHEN 'A' THEN 'offers' END AS predicate, CASE WHEN l_returnflag = 'R' THEN 'quality' ELSE 'trade' END AS family, 'part:' || l_partkey AS o, l_partkey,
  round(1 - l_discount, 2) AS confidence, strftime(l_shipdate, '%Y-%m') AS session, l_shipdate AS created_at, l_orderkey AS tie1, l_linenumber AS tie2 FROM lineitem)"""
_PAGE = "t AS (SELECT DISTINCT s, predicate, o FROM e WHERE family = 'trade'), d AS (SELECT n, count(*) AS d FROM (SELECT s AS n FROM t UNION ALL SELECT o FROM t) GROUP BY 1), pg AS (SELECT s, predicate, o, greatest(a.d, b.d) AS rank FROM t JOIN d a ON a.n = s JOIN d b ON b.n = o WHERE ends_with(o, '7') ORDER BY rank DESC, s, o, predicate LIMIT 100)"
_KINDS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_FLOORS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.TYPE_FLOORS.items())
_ALIASES = "[p_brand || ' ' || string_split(p_name, ' ')[1], lower(p_type)]"
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_ontology_normalise": f"WITH {NORMAL} SELECT o_orderkey, raw, family, canonical FROM norm",
    "q_ontology_gate": f"WITH {NORMAL} SELECT o_orderkey, canonical, signal, keep FROM gate",
    "q_ingest_edges": f"WITH {NORMAL} SELECT o_orderkey, s, o, canonical, replaces, outcome FROM done",
    "q_ingest_counters": f"WITH {NORMAL} SELECT " + ", ".join(f"count(*) FILTER (WHERE outcome = '{n}') AS \"{n}\"" for n in ("new", "duplicate", "conflict", "unknown", "irrelevant", "loop")) + " FROM done",
    "q_ingest_active": f"WITH {NORMAL} SELECT s, o, family, canonical, confidence FROM done WHERE outcome IN ('new', 'conflict') QUALIFY row_number() OVER (PARTITION BY s1, o1, family ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "q_entity_relevance": f"""WITH {NORMAL}, ends AS (SELECT s AS entity, signal FROM gate WHERE canonical IS NOT NULL UNION ALL SELECT o, signal FROM gate WHERE canonical IS NOT NULL AND s != o),
n AS (SELECT entity, count(*) FILTER (WHERE signal = 'high') AS high, count(*) FILTER (WHERE signal = 'medium') AS medium, count(*) FILTER (WHERE signal = 'low') AS low FROM ends GROUP BY 1),
k AS (SELECT c_custkey AS entity, {_KINDS}[(c_custkey % {len(KINDS)} + 1)::INT] AS kind, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low FROM customer LEFT JOIN n ON entity = c_custkey),
s AS (SELECT entity, kind, high, medium, round(coalesce(least((CASE kind {_FLOORS} END)::DOUBLE + least(high * 0.2::DOUBLE, 0.4) + least(medium * 0.1::DOUBLE, 0.2) - CASE WHEN low > 0 AND high + medium = 0 THEN 0.1::DOUBLE ELSE 0.0 END, 1.0), 0.0), 6)::DOUBLE AS score FROM k)
SELECT *, kind != 'unknown' AND score >= 0.4 AS keep FROM s""",
    "q_find_or_create_full": f"""WITH r AS (SELECT p_partkey, lower(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 1 THEN p_brand || ' ' || string_split(p_name, ' ')[1] ELSE p_name || ' ' || p_brand END) AS key, p_brand, CASE WHEN p_partkey % 5 = 1 THEN 'about ' || lower(p_type) END AS ctx FROM part),
q AS (SELECT key, list(p_brand) AS more, arg_min(ctx, p_partkey) FILTER (WHERE ctx IS NOT NULL) AS ctx FROM r GROUP BY 1),
en AS (SELECT p_partkey AS id, lower(p_name) AS key, {_ALIASES} AS aliases, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE '' END AS ctx, p_size FROM part),
t AS (SELECT key, min(id) AS id FROM en WHERE p_size <= 3 GROUP BY 1), m AS (SELECT key, min(id) AS id FROM en WHERE p_size BETWEEN 4 AND 12 GROUP BY 1),
a AS (SELECT lower(x) AS key, min(id) AS id FROM (SELECT unnest(aliases) AS x, id FROM en WHERE p_size <= 3) GROUP BY 1),
j AS (SELECT q.key, q.more, q.ctx, t.id AS tid, a.id AS aid, m.id AS mid, ea.ctx AS actx, CASE WHEN q.ctx IS NOT NULL AND ea.ctx != '' AND len(list_filter(string_split(ea.ctx, ' '), lambda w: len(w) > 3)) > 0
  AND NOT list_has_any(list_filter(string_split(q.ctx, ' '), lambda w: len(w) > 3), list_filter(string_split(ea.ctx, ' '), lambda w: len(w) > 3)) THEN true ELSE false END AS clash
  FROM q LEFT JOIN t USING (key) LEFT JOIN a ON a.key = q.key LEFT JOIN m ON m.key = q.key LEFT JOIN en ea ON ea.id = a.id),
md AS (SELECT *, CASE WHEN tid IS NOT NULL THEN 'team_hit' WHEN aid IS NOT NULL AND NOT clash THEN 'team_alias_hit' WHEN mid IS NOT NULL THEN 'master_copy' ELSE 'created' END AS mode FROM j),
h AS (SELECT md.*, e.aliases AS held, e.ctx AS hctx, e.id AS hid FROM md LEFT JOIN en e ON e.id = CASE mode WHEN 'team_hit' THEN tid WHEN 'team_alias_hit' THEN aid WHEN 'master_copy' THEN mid END)
SELECT key, mode, CASE WHEN mode != 'master_copy' THEN hid END AS entity_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(held, []), more))), '|') AS aliases, coalesce(nullif(hctx, ''), ctx, '') AS context FROM h""",
    "q_contexts": "WITH p AS (SELECT p_partkey, list_filter(string_split(lower(p_type || ' ' || p_brand), ' '), lambda w: len(w) > 3) AS w FROM part) SELECT a.p_partkey, b.w IS NOT NULL AND len(a.w) > 0 AND len(b.w) > 0 AND NOT list_has_any(a.w, b.w) AS conflict FROM p a LEFT JOIN p b ON b.p_partkey = a.p_partkey + 1",
    "q_promote_entities": """WITH x AS (SELECT p_name AS name, p_size, p_brand, p_type FROM part), t AS (SELECT name, list(DISTINCT p_brand) AS al, min('team' || p_type) AS d, min(p_size) AS sz FROM x WHERE p_size <= 2 GROUP BY 1), m AS (SELECT name, list(DISTINCT p_brand) AS al, min('master' || p_type) AS d, min(p_size) AS sz FROM x WHERE p_size BETWEEN 2 AND 3 GROUP BY 1)
SELECT name, array_to_string(list_sort(list_distinct(list_concat(coalesce(m.al, []), coalesce(t.al, [])))), '|') AS aliases, coalesce(nullif(CASE WHEN len(m.d) % 2 = 0 THEN m.d ELSE '' END, ''), CASE WHEN t.d IS NOT NULL THEN CASE WHEN len(t.d) % 2 = 0 THEN t.d ELSE '' END END, '') AS description,
  coalesce(t.sz, m.sz)::VARCHAR AS size, CASE WHEN t.d IS NULL OR m.d IS NULL THEN 2 ELSE 3 END::INT AS n_metadata, CASE WHEN m.d IS NULL THEN 'added' WHEN t.d IS NULL THEN 'kept' ELSE 'merged' END AS outcome FROM t FULL JOIN m USING (name)""",
    "q_promote_edges_full": f"""WITH {EDGES}, c AS (SELECT DISTINCT s, o, family, predicate FROM e WHERE confidence >= 0.85 AND l_partkey % 2 = 0), k AS (SELECT DISTINCT s, o, family, predicate FROM e WHERE session < '1995'),
r AS (SELECT c.*, CASE WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.s = c.s AND k.o = c.o AND k.family = c.family) THEN 'added' WHEN EXISTS (SELECT 1 FROM k WHERE k.s = c.s AND k.o = c.o AND k.predicate = c.predicate) THEN 'skipped' ELSE 'superseding' END AS outcome FROM c)
SELECT predicate, outcome, count(*) AS n, min('m/' || s) AS first FROM r GROUP BY 1, 2""",
    "q_sync_master": "SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 3 != 0 THEN s_nationkey END AS master_id, coalesce(n_name, s_name) AS name, CASE WHEN n_regionkey = 1 THEN 'shared' ELSE 'own' END AS description, n_name IS NOT NULL AS synced FROM supplier LEFT JOIN nation ON n_nationkey = CASE WHEN s_suppkey % 3 != 0 THEN s_nationkey END AND n_regionkey != 2",
    "q_intra_team": "WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS o FROM lineitem) SELECT 'supplier:' || s AS s, count(*) FILTER (WHERE s % 10 != 9 AND o % 10 != 9 AND s % 3 = o % 3) AS inside, count(*) FILTER (WHERE NOT (s % 10 != 9 AND o % 10 != 9 AND s % 3 = o % 3)) AS across FROM e GROUP BY 1",
    "q_neighbors_limited": f"WITH {EDGES}, x AS (SELECT DISTINCT s, o FROM e WHERE o != 'part:5'), f AS (SELECT s, o, CASE WHEN s = 'supplier:1' THEN 1 ELSE 2 END::INT AS hop FROM x WHERE o IN (SELECT o FROM x WHERE s = 'supplier:1')) SELECT * FROM f ORDER BY hop, s, o LIMIT 200",
    "q_explore": f"""WITH {EDGES}, x AS (SELECT DISTINCT s, o FROM e), a AS (SELECT s, o FROM x WHERE s = 'supplier:1' ORDER BY s, o LIMIT 200), b AS (SELECT s, o FROM x WHERE o IN (SELECT o FROM a) AND s != 'supplier:1' ORDER BY s, o LIMIT 200)
SELECT s, o, 1::INT AS hop FROM a UNION ALL SELECT s, o, 2 FROM b""",
    "q_entity_details": f"WITH {EDGES}, d AS (SELECT s AS name, count(*) AS degree FROM e GROUP BY 1) SELECT name, s_name, coalesce(degree, 0) AS degree FROM (SELECT 'supplier:' || s_suppkey AS name, s_name FROM supplier WHERE s_suppkey < 100) LEFT JOIN d USING (name)",
    "q_most_connected": f"WITH {EDGES} SELECT name, count(*) AS n FROM (SELECT s AS name FROM e UNION ALL SELECT o FROM e) GROUP BY 1 ORDER BY n DESC, name LIMIT 20",
    "q_graph_page": f"WITH {EDGES}, {_PAGE} SELECT * FROM pg",
    "q_graph_nodes": f"WITH {EDGES}, {_PAGE} SELECT name, count(*) AS n FROM (SELECT s AS name FROM pg UNION ALL SELECT o FROM pg) GROUP BY 1",
    "q_review_flags": f"WITH {EDGES}, h AS (SELECT *, lag(predicate) OVER (PARTITION BY s, o, family ORDER BY created_at, tie1, tie2) AS old FROM e) SELECT s, count(*) AS n_conflicts, min(old || ' > ' || predicate) AS reason FROM h WHERE old != predicate GROUP BY 1",
    "q_partner_deals": f"WITH {EDGES}, d AS (SELECT DISTINCT s, o FROM e) SELECT a.s AS person1, b.s AS person2, count(*) AS n_shared, string_agg(a.o, '|' ORDER BY a.o) AS deals FROM d a JOIN d b ON a.o = b.o AND a.s < b.s GROUP BY 1, 2",
    "q_tool_ids": "SELECT s_suppkey, 'supplier:' || s_suppkey || ',nation:' || s_nationkey AS ids FROM supplier",
}
