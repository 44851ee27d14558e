"""Text, document and matching queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from entivore.functions import text as X
from entivore.operators import documents as D
from entivore.operators import matching as M
from entivore.operators import trigrams as T
from entivore.sources.tables import table

#: Predicate families with the least confidence that keeps an edge (fixed values), and spellings of the predicates.
FAMILIES = (("ownership", 0.50), ("affinity", 0.75), ("deal_network", 0.70))
SPELLINGS = (("buys", "owns", "ownership"), ("purchased", "owns", "ownership"), ("owns", "owns", "ownership"), ("fan_of", "fan_of", "affinity"), ("sponsors", "sponsors", "deal_network"))
RAW = ("Buys", "purchased ", "fan-of", "sponsors", "operates in")


def _part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name").distinct()


def q_trigram_pairs(spark, sf_dir):
    n = _part_names(spark, sf_dir)
    found = T.similar(n.select(F.col("p_name").alias("a")), n.select(F.col("p_name").alias("b")), 0.3)
    return found.where("a < b").select("a", "b", F.round("sim", 6).alias("sim"))


def q_suggest(spark, sf_dir):
    asked = "smal rng"
    sim = X.similarity(F.col("p_name"), F.lit(asked))
    return _part_names(spark, sf_dir).select("p_name", F.round(sim, 6).alias("sim")).where((F.col("sim") > 0.1) | X.ilike(F.col("p_name"), asked)).orderBy(F.desc("sim"), "p_name").limit(10)


def q_name_normalise(spark, sf_dir):
    title = F.element_at(F.array(*[F.lit(x) for x in ("Mr. ", "Dr ", "  ", "Prof. ", "")]), F.pmod(F.col("s_suppkey"), F.lit(5)).cast("int") + 1)
    raw = F.concat(title, "s_name", F.lit("  Jr."))
    return table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw"), X.plain_name(raw).alias("normalised"))


def q_resolve_client(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("Mr. "), "p_name").alias("name")).distinct()
    directory = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("id"))
    return M.resolve(names, directory)


def q_pages_split(spark, sf_dir):
    paged = F.regexp_replace("text", r"\n", "\n[Page 7]\n")
    return D.pages(table(spark, sf_dir, "documents").select("doc_id", paged.alias("text"))).select("doc_id", "page", F.length("text").alias("n")).groupBy("doc_id", "page").agg(F.count("*").alias("pages"), F.sum("n").alias("chars"))


def q_batch_greedy(spark, sf_dir):
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x).cast("long"))
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("sizes"))
    return docs.select("doc_id", F.array_max(D.greedy_batches(F.col("sizes"), 1000)).alias("last_batch"))


def q_fixed_chunks(spark, sf_dir):
    return D.fixed_chunks(table(spark, sf_dir, "documents"), 4000).select("doc_id", F.col("ix"), F.length("chunk").alias("n"))


def q_md_table_roundtrip(spark, sf_dir):
    """All parts by tables of a hundred keys; rows are numbered through."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("|x")).alias("p_name"), "p_brand", F.floor(F.col("p_partkey") / 100).alias("page"))
    cells = D.table_cells(D.markdown_table(part, ["p_partkey", "p_name", "p_brand"], "p_partkey", "page"))
    return cells.join(D.page_starts(part, "page"), "page").select((F.col("row") + F.col("before")).cast("int").alias("row"), "column", "value")


def q_text_dedup(spark, sf_dir):
    """Which document of each text stays: the first."""
    key = F.sha2(F.lower(F.trim(F.coalesce("text", F.lit("")))), 256)
    return table(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def q_claims_conflict(spark, sf_dir):
    """The least and the greatest claim of each page; null where a page makes none."""
    c = table(spark, sf_dir, "pages").select("page_id", X.claims(F.col("html")).alias("claims"))
    return c.select("page_id", F.array_min("claims").alias("low"), F.array_max("claims").alias("high")).withColumn("conflict", (F.col("high") - F.col("low")) / F.nullif(F.col("low"), F.lit(0.0)) > 0.25)


def q_history_trim(spark, sf_dir):
    """Conversations trimmed to 300 tokens; every third answer counts as a tool's."""
    c = table(spark, sf_dir, "conversations").withColumn("role", F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), "tool").otherwise(F.col("role")))
    return D.trimmed_turns(c, 300).select("conv_id", "turn", "role")


def q_session_cap(spark, sf_dir):
    """Turns cut to 1000 characters of each conversation."""
    return D.capped(table(spark, sf_dir, "conversations"), 1000).select("conv_id", "turn", "text")


def q_claims_by_host(spark, sf_dir):
    """Claims of each host's pages: they conflict if two pages or more make some, the least is above 0, and the greatest
    is over a quarter more."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), "page_id", F.explode(F.filter(X.claims(F.col("html")), lambda c: c.isNotNull())).alias("claim"))
    g = p.groupBy("host").agg(F.countDistinct("page_id").alias("sources"), F.count("*").alias("n"), F.min("claim").alias("low"), F.max("claim").alias("high"))
    apart = (F.col("low") > 0) & ((F.col("high") - F.col("low")) / F.nullif(F.col("low"), F.lit(0.0)) > 0.25)
    return g.withColumn("conflict", (F.col("sources") > 1) & (F.col("n") > 1) & F.coalesce(apart, F.lit(False)))


def q_result_type(spark, sf_dir):
    """Messages as answers: their lines are matches, an assistant's have places, a system's are errors."""
    value = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("$"), F.col("conv_id").cast("string"), F.lit("K")))
    lines = F.transform(F.filter(F.split(F.coalesce(value, "text", F.lit("")), "\n"), lambda x: x != ""), lambda x: F.struct(x.alias("value"), F.when(F.col("turn") % 5 == 1, 2).otherwise(1).alias("columns"), F.when(F.col("role") == "assistant", 1).otherwise(0).alias("places")))
    error = F.when(F.col("role") == "system", "failed")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.result_type(error, lines).alias("kind"))


def q_predicate_normalise(spark, sf_dir):
    """What raw predicates, one for each kind of event, stand for, and which events' confidence keeps them."""
    raw = F.element_at(F.array(*[F.lit(x) for x in RAW]), F.pmod(F.col("event_id"), F.lit(len(RAW))).cast("int") + 1)
    e = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), F.round(F.pmod(F.col("event_id"), F.lit(100)) / 100, 2).alias("confidence"))
    known = spark.createDataFrame(list(SPELLINGS), "key string, canonical string, family string")
    gate = spark.createDataFrame(list(FAMILIES), "family string, least double")
    out = e.withColumn("key", F.regexp_replace(F.trim(F.lower("raw")), "[ -]", "_")).join(F.broadcast(known), "key", "left").join(F.broadcast(gate), "family", "left")
    keep = F.coalesce((F.col("confidence") >= F.col("least")) & (F.col("confidence") >= 0.5), F.lit(False))
    return out.select("event_id", "raw", "canonical", "family", keep.alias("keep"))


def q_markdown_strip(spark, sf_dir):
    raw = F.concat(F.lit("**"), "p_name", F.lit("** of *"), "p_brand", F.lit("* `"), F.col("p_size").cast("string"), F.lit("` [link](http://x/"), F.col("p_partkey").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", X.plain_markdown(raw).alias("text"))




def _grams(column: str) -> str:
    return rf"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{N}}]+'), lambda w: w != ''), lambda w: list_transform(range(len(w) + 1), lambda i: substr('  ' || w || ' ', (i + 1)::INT, 3)))))"


SIM = "len(list_intersect(ga, gb))::DOUBLE / (len(ga) + len(gb) - len(list_intersect(ga, gb)))"
_CLAIMS = r"""WITH f AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract_all(html, '\$[0-9][0-9,]*\.?[0-9]*[BMTKbmtk]?|[0-9]+\.?[0-9]*%') AS f FROM pages),
v AS (SELECT page_id, host, list_transform(f, lambda c: try_cast(regexp_replace(c, '[^0-9.]', '', 'g') AS DOUBLE) * CASE upper(right(c, 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 WHEN 'T' THEN 1e12 ELSE 1.0 END) AS c FROM f)"""
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_trigram_pairs": f"WITH n AS (SELECT p_name, {_grams('p_name')} AS g FROM (SELECT DISTINCT p_name FROM part)), x AS (SELECT a.p_name AS a, b.p_name AS b, a.g AS ga, b.g AS gb FROM n a JOIN n b ON a.p_name < b.p_name) SELECT a, b, round({SIM}, 6) AS sim FROM x WHERE {SIM} >= 0.3",
    "q_suggest": f"WITH n AS (SELECT p_name, {_grams('p_name')} AS ga, {_grams(chr(39) + 'smal rng' + chr(39))} AS gb FROM (SELECT DISTINCT p_name FROM part)) SELECT p_name, round({SIM}, 6) AS sim FROM n WHERE {SIM} > 0.1 OR contains(lower(p_name), 'smal rng') ORDER BY sim DESC, p_name LIMIT 10",
    "q_name_normalise": "SELECT s_suppkey, ['Mr. ', 'Dr ', '  ', 'Prof. ', ''][s_suppkey % 5 + 1] || s_name || '  Jr.' AS raw, trim(s_name) AS normalised FROM supplier",
    "q_pages_split": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, CASE WHEN i > 1 THEN 7 WHEN n > 1 THEN 0 ELSE 1 END::INT AS page, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM l)
SELECT doc_id, page, count(*) AS pages, sum(length(t))::BIGINT AS chars FROM p WHERE t != '' GROUP BY 1, 2""",
    "q_fixed_chunks": "WITH c AS (SELECT doc_id, text, unnest(range(((length(text) + 3999) // 4000)::BIGINT))::INT AS ix FROM documents WHERE text IS NOT NULL AND text != '') SELECT doc_id, ix, length(substr(text, ix * 4000 + 1, 4000))::INT AS n FROM c",
    "q_md_table_roundtrip": """WITH r AS (SELECT row_number() OVER (ORDER BY p_partkey)::INT AS row, * FROM part)
SELECT row, 'p_partkey' AS "column", p_partkey::VARCHAR AS value FROM r UNION ALL SELECT row, 'p_name', p_name || '|x' FROM r UNION ALL SELECT row, 'p_brand', p_brand FROM r""",
    "q_text_dedup": "SELECT sha256(lower(trim(coalesce(text, '')))) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "q_claims_conflict": f"{_CLAIMS} SELECT page_id, list_min(c) AS low, list_max(c) AS high, (list_max(c) - list_min(c)) / nullif(list_min(c), 0) > 0.25 AS conflict FROM v",
    "q_claims_by_host": f"{_CLAIMS}, x AS (SELECT host, page_id, unnest(list_filter(c, lambda y: y IS NOT NULL)) AS claim FROM v), g AS (SELECT host, count(DISTINCT page_id) AS sources, count(*) AS n, min(claim) AS low, max(claim) AS high FROM x GROUP BY 1) SELECT *, sources > 1 AND n > 1 AND low > 0 AND coalesce((high - low) / nullif(low, 0) > 0.25, false) AS conflict FROM g",
    "q_result_type": r"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'error' WHEN turn % 3 != 0 AND replace(coalesce(text, ''), chr(10), '') = '' THEN 'empty' WHEN turn % 5 = 1 THEN 'table' WHEN role = 'assistant' THEN 'prose' WHEN turn % 3 = 0 THEN 'count'
  WHEN regexp_matches(trim(text, chr(10)), '^[^\n]*$') AND regexp_matches(trim(trim(text, chr(10))), '^\$?[0-9,]+\.?[0-9]*\s*[KMBkmb%]?$') THEN 'count' ELSE 'list' END AS kind FROM conversations""",
    "q_batch_greedy": r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
r(doc_id, i, s, b) AS (SELECT doc_id, i, length(t), 0 FROM l WHERE i = 1 UNION ALL SELECT l.doc_id, l.i, CASE WHEN s > 0 AND s + length(t) > 1000 THEN length(t) ELSE s + length(t) END, CASE WHEN s > 0 AND s + length(t) > 1000 THEN b + 1 ELSE b END FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
SELECT doc_id, max(b)::INT AS last_batch FROM r GROUP BY 1""",
    "q_history_trim": """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'tool' ELSE role END AS role, length(coalesce(text, '')) // 4 + 4 AS cost FROM conversations),
k AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id) - 300 AS over_, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY role != 'tool', turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
s AS (SELECT *, min(turn) FILTER (WHERE role IN ('user', 'system')) OVER (PARTITION BY conv_id) AS start FROM k WHERE before >= over_) SELECT conv_id, turn, role FROM s WHERE turn >= coalesce(start, turn)""",
    "q_session_cap": "WITH t AS (SELECT *, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) SELECT conv_id, turn, left(text, greatest(0, 1000 - before)::BIGINT) AS text FROM t",
    "q_predicate_normalise": """WITH e AS (SELECT event_id, ['Buys', 'purchased ', 'fan-of', 'sponsors', 'operates in'][event_id % 5 + 1] AS raw, round(event_id % 100 / 100, 2) AS confidence FROM events),
k AS (SELECT * FROM (VALUES ('buys', 'owns', 'ownership', 0.5), ('purchased', 'owns', 'ownership', 0.5), ('owns', 'owns', 'ownership', 0.5), ('fan_of', 'fan_of', 'affinity', 0.75), ('sponsors', 'sponsors', 'deal_network', 0.7)) t(key, canonical, family, least))
SELECT event_id, raw, canonical, family, coalesce(confidence >= least, false) AS keep FROM e LEFT JOIN k ON key = regexp_replace(trim(lower(raw)), '[ -]', '_', 'g')""",
    "q_markdown_strip": "SELECT p_partkey, p_name || ' of ' || p_brand || ' ' || p_size || ' link' AS text FROM part",
}
