"""Passages, tables in documents and merged results, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entivore.functions import text as X
from entivore.operators import documents as D
from entivore.operators import passages as P
from entivore.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def q_sheets_split(spark, sf_dir):
    """Every second line of a document opens a sheet."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("## Sheet: s"), i.cast("string"), F.lit(" \n"), x)).otherwise(x)), "\n")
    return P.sheets(_docs(spark, sf_dir).select("doc_id", marked.alias("text"))).groupBy("doc_id").agg(F.count("*").alias("sheets"), F.min("sheet").alias("first"), F.sum(F.length("text")).alias("chars"))


def q_recursive_chunks(spark, sf_dir):
    return P.recursive_chunks(_docs(spark, sf_dir), 2000).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.max(F.length("chunk")).alias("longest"))


def q_overlapping_chunks(spark, sf_dir):
    """Pieces of 2000 characters with 200 of the one before; every seventh document is without blanks."""
    docs = _docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.replace("text", F.lit(" "), F.lit("_"))).otherwise(F.col("text")))
    return P.overlapping_chunks(docs, 2000, 200).select("doc_id", "ix", F.md5("chunk").alias("digest"), F.length("chunk").alias("chars"))


def q_page_batches(spark, sf_dir):
    """Lines as pages, put together to batches of 1000 characters."""
    pages = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return P.batched(pages, 1000).select("doc_id", "batch", "first_page", "n_pages", F.length("text").alias("chars"))


def _tables(spark, sf_dir):
    """The lines of each order as a markdown table; every fifth has no value."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("l_linenumber").cast("string"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey").cast("string")).otherwise(""), "l_returnflag"), F.lit(" |")).alias("line"))
    body = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("see\n| Line | Part | Flag |\n| --- | --- | --- |\n"), "body", F.lit("\nend")).alias("text"))


def q_table_chunks(spark, sf_dir):
    """Tables by three rows, of two columns."""
    return P.table_chunks(_tables(spark, sf_dir), 3, ["part", "LINE"])


def q_table_extract_one(spark, sf_dir):
    return P.extracted(_tables(spark, sf_dir), ["part"])


def q_table_extract_several(spark, sf_dir):
    return P.extracted(_tables(spark, sf_dir), ["part", "flag"])


def q_first_table(spark, sf_dir):
    """The first table of two, by its number of lines."""
    t = _tables(spark, sf_dir).select("doc_id", F.concat("text", F.lit("\n| x |\n")).alias("text"))
    return t.select("doc_id", F.size(P.table_lines(P.first_table(F.col("text")))).alias("lines"))


def q_person_names(spark, sf_dir):
    """Names of all orders' parts across chunks: one row per name (titles and case apart), the first form, and how many."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Dr. "), F.upper("p_name"))).otherwise(F.col("p_name"))
    r = j.select(raw.alias("name"), F.lower(X.plain_name(raw)).alias("key"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    return r.groupBy("key").agg(F.min_by("name", "at").alias("name"), F.count("*").alias("n"))


def q_memory_search(spark, sf_dir):
    """The five newest memories of subjects that a word asked for is in, one for each subject."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("entity"), F.col("p_size").alias("created"), "p_brand")
    return D.remembered(p, "a small or brass thing")


def q_chunk_results(spark, sf_dir):
    """Values found by chunks (orders), once each: the first chunk and place wins."""
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(F.struct(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))).alias("value"))
    return P.merged_first(r, ["value"], ["l_orderkey", "l_linenumber"])


def q_chunk_json(spark, sf_dir):
    """Answers of chunks as JSON, read with a declared schema; confidence is 0.5 where it is missing."""
    p = table(spark, sf_dir, "part")
    body = F.when(F.col("p_partkey") % 4 == 0, "no json").otherwise(F.to_json(F.struct(F.col("p_name").alias("value"), F.col("p_size").alias("row"), F.when(F.col("p_size") > 25, F.lit(0.9)).alias("confidence"))))
    got = F.from_json(body, "value string, row int, confidence double")
    return p.select("p_partkey", got.alias("g")).select("p_partkey", "g.value", "g.row", F.when(F.col("g.value").isNotNull(), F.coalesce("g.confidence", F.lit(0.5))).alias("confidence"))


def q_union_teams(spark, sf_dir):
    """Parts of three teams by name; a later team's row counts."""
    p = table(spark, sf_dir, "part").groupBy("p_name", F.pmod("p_size", F.lit(3)).alias("team")).agg(F.min("p_partkey").alias("id"))
    return P.overriding(*[p.where(F.col("team") == t) for t in range(3)], key="p_name").select("p_name", F.col("team").cast("int").alias("team"), "id")


def q_live_over_final(spark, sf_dir):
    """Final scores of suppliers, with live ones in their place."""
    s = table(spark, sf_dir, "supplier")
    return P.overriding(s.select("s_suppkey", F.lit("final").alias("kind"), "s_acctbal"), s.where("s_suppkey % 4 = 0").select("s_suppkey", F.lit("live").alias("kind"), (F.col("s_acctbal") + 1).alias("s_acctbal")), key="s_suppkey")


def q_set_difference(spark, sf_dir):
    """Brands that large parts have and small ones lack."""
    p = table(spark, sf_dir, "part")
    return p.where("p_size > 48").select("p_brand", "p_type").subtract(p.where("p_size < 20").select("p_brand", "p_type"))


def q_cited_urls(spark, sf_dir):
    """Pages as answers that cite their own address and another: which are unknown, and whether to warn."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("[a]("), "url", F.lit(") [b](http://other.example/"), F.col("page_id").cast("string"), F.lit(")")).alias("text"), "url")
    urls = X.cited_urls(F.col("text"))
    unknown = F.array_except(urls, F.array("url"))
    return p.select("page_id", F.size(urls).alias("cited"), F.array_join(F.slice(unknown, 1, 5), " ").alias("unknown"), (F.size(unknown) > 0.3 * F.size(urls)).alias("warn"))


def q_bands(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem")
    c = F.round(1 - F.col("l_discount") * 5, 2)
    return r.select(X.band(c, X.CONFIDENCE_BANDS, "low").alias("confidence"), X.band(c, X.FILL_BANDS, "empty").alias("fill")).groupBy("confidence", "fill").agg(F.count("*").alias("n"))


def q_cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(F.lower(F.trim("p_name"))).alias("key"))


def q_file_labels(spark, sf_dir):
    """Types of files by their endings, and labels of passages."""
    ends = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".XLSX", ".csv", ".txt", "")]), F.pmod("doc_id", F.lit(5)).cast("int") + 1)
    ext = F.lower(F.regexp_extract(F.col("file"), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.create_map(*[F.lit(x) for x in ("pdf", "pdf", "xlsx", "excel", "xls", "excel", "csv", "csv", "tsv", "csv", "docx", "word")])[ext]
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), ends).alias("file"))
    return d.select("doc_id", F.coalesce(kind, F.lit("text")).alias("kind"), F.concat(F.lit("["), "file", F.lit(", Page "), F.pmod("doc_id", F.lit(9)).cast("string"), F.lit("]")).alias("label"))


def q_session_costs(spark, sf_dir):
    """Cost of each conversation so far by an estimate of tokens and prices by role, and whether it is over the budget."""
    from pyspark.sql import Window

    price = F.when(F.col("role") == "assistant", 15).otherwise(3)
    micro = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long") * price
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(micro).over(w).alias("spent"))
    return c.select("conv_id", "turn", "spent", F.greatest(5000 - F.col("spent"), F.lit(0)).alias("remaining"), (F.col("spent") > 5000).alias("exceeded"))


TAB = "t AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE WHEN l_partkey % 5 != 0 THEN l_partkey::VARCHAR ELSE '' END AS part, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, '| ' || l_linenumber || ' | ' || CASE WHEN l_partkey % 5 != 0 THEN l_partkey::VARCHAR ELSE '' END || ' | ' || l_returnflag || ' |')::INT AS row FROM lineitem)"
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_sheets_split": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, n, (i + 1) // 2 AS k, string_agg(t, chr(10) ORDER BY i) AS t FROM l GROUP BY ALL), s AS (SELECT doc_id, n, CASE WHEN n = 1 THEN 'Sheet1' WHEN k = 0 THEN '_preamble' ELSE 's' || (2 * k - 1) END AS sheet, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM g)
SELECT doc_id, count(*) AS sheets, min(sheet) AS first, sum(length(t))::BIGINT AS chars FROM s WHERE n = 1 OR t != '' GROUP BY 1""",
    "q_overlapping_chunks": """WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(text, ' ', '_') ELSE text END AS text FROM documents WHERE text != ''),
c(doc_id, ix, start, stop) AS (SELECT doc_id, 0, 0, CASE WHEN length(text) <= 2000 THEN length(text) ELSE 2000 - CASE WHEN contains(substr(text, 202, 1799), ' ') THEN strpos(reverse(substr(text, 202, 1799)), ' ') ELSE 0 END END FROM d
  UNION ALL SELECT doc_id, ix + 1, start, CASE WHEN length(text) - start <= 2000 THEN length(text) ELSE start + 2000 - CASE WHEN contains(substr(text, start + 202, 1799), ' ') THEN strpos(reverse(substr(text, start + 202, 1799)), ' ') ELSE 0 END END
  FROM (SELECT c.doc_id, ix, stop - 200 AS start, text FROM c JOIN d ON d.doc_id = c.doc_id WHERE stop < length(text)))
SELECT c.doc_id, ix, md5(substr(text, start + 1, stop - start)) AS digest, (stop - start)::INT AS chars FROM c JOIN d ON d.doc_id = c.doc_id""",
    "q_page_batches": r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS page FROM documents WHERE text IS NOT NULL),
r(doc_id, page, batch, size) AS (SELECT doc_id, page, 0, length(t) FROM l WHERE page = 0 UNION ALL SELECT l.doc_id, l.page, CASE WHEN size + length(t) <= 1000 THEN batch ELSE batch + 1 END, CASE WHEN size + length(t) <= 1000 THEN size + length(t) ELSE length(t) END FROM r JOIN l ON l.doc_id = r.doc_id AND l.page = r.page + 1)
SELECT doc_id, batch::INT AS batch, min(page)::INT AS first_page, count(*)::INT AS n_pages, (sum(length(t)) + 2 * (count(*) - 1))::INT AS chars FROM r JOIN l USING (doc_id, page) GROUP BY 1, 2""",
    "q_table_chunks": f"WITH {TAB} SELECT doc_id, ((row - 1) // 3)::INT AS ix, '| Line | Part |' || chr(10) || string_agg('| ' || n || ' | ' || part || ' |', chr(10) ORDER BY row) AS chunk FROM t GROUP BY 1, 2",
    "q_table_extract_one": f"WITH {TAB} SELECT doc_id, row, 'Part' AS \"column\", part AS value FROM t WHERE part != ''",
    "q_table_extract_several": f"WITH {TAB} SELECT doc_id, row, 'Part' AS \"column\", part AS value FROM t WHERE part != '' UNION ALL SELECT doc_id, row, 'Flag', flag FROM t WHERE part != ''",
    "q_first_table": "SELECT l_orderkey AS doc_id, (count(*) + 1)::INT AS lines FROM lineitem GROUP BY 1",
    "q_person_names": "SELECT lower(p_name) AS key, arg_min(CASE WHEN l_linenumber % 2 = 0 THEN 'Dr. ' || upper(p_name) ELSE p_name END, (l_orderkey, l_linenumber)) AS name, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "q_memory_search": "WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS entity, p_size AS created, p_brand FROM part) SELECT * FROM p WHERE contains(lower(entity), 'small') OR contains(lower(entity), 'brass') OR contains(lower(entity), 'thing') QUALIFY row_number() OVER (PARTITION BY lower(entity) ORDER BY created DESC, id DESC) = 1 ORDER BY created DESC, id DESC LIMIT 5",
    "q_chunk_results": "SELECT l_orderkey, l_linenumber, '{\"part\":' || l_partkey || ',\"flag\":\"' || l_returnflag || '\"}' AS value, count(*) OVER (PARTITION BY l_partkey, l_returnflag) AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber) = 1",
    "q_chunk_json": "SELECT p_partkey, CASE WHEN p_partkey % 4 != 0 THEN p_name END AS value, CASE WHEN p_partkey % 4 != 0 THEN p_size END AS row, CASE WHEN p_partkey % 4 != 0 THEN CASE WHEN p_size > 25 THEN 0.9 ELSE 0.5 END::DOUBLE END AS confidence FROM part",
    "q_union_teams": "WITH p AS (SELECT p_name, (p_size % 3)::INT AS team, min(p_partkey) AS id FROM part GROUP BY 1, 2) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY team DESC) = 1",
    "q_live_over_final": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'live' ELSE 'final' END AS kind, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "q_set_difference": "SELECT p_brand, p_type FROM part WHERE p_size > 48 EXCEPT SELECT p_brand, p_type FROM part WHERE p_size < 20",
    "q_cited_urls": "SELECT page_id, CASE WHEN url = 'http://other.example/' || page_id THEN 1 ELSE 2 END::INT AS cited, CASE WHEN url = 'http://other.example/' || page_id THEN '' ELSE 'http://other.example/' || page_id END AS unknown, url != 'http://other.example/' || page_id AS warn FROM pages",
    "q_bands": "WITH c AS (SELECT round(1 - l_discount * 5, 2) AS c FROM lineitem) SELECT CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN c >= 0.8 THEN 'full' WHEN c >= 0.5 THEN 'half' WHEN c >= 0.3 THEN 'thin' ELSE 'empty' END AS fill, count(*) AS n FROM c GROUP BY 1, 2",
    "q_cache_keys": "SELECT p_partkey, md5(lower(trim(p_name))) AS key FROM part",
    "q_file_labels": "SELECT doc_id, ['pdf', 'excel', 'csv', 'text', 'text'][(doc_id % 5 + 1)::INT] AS kind, '[f' || doc_id || ['.pdf', '.XLSX', '.csv', '.txt', ''][(doc_id % 5 + 1)::INT] || ', Page ' || doc_id % 9 || ']' AS label FROM documents",
    "q_session_costs": "WITH c AS (SELECT conv_id, turn, sum((length(coalesce(text, '')) // 4) * CASE WHEN role = 'assistant' THEN 15 ELSE 3 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM conversations) SELECT conv_id, turn, spent, greatest(5000 - spent, 0) AS remaining, spent > 5000 AS exceeded FROM c",
}
