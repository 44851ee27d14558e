"""Sheets in and out, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entivore.functions.text import csv_safe
from entivore.operators import sheets as H
from entivore.plans.scores import LATEST, W, latest
from entivore.sources import files
from entivore.sources.tables import table, weights

ATTRIBUTES = ("p_brand", "p_type", "p_name")


def q_csv_lines(spark, sf_dir):
    """Suppliers of each nation as a file with its own delimiter, a mark and a header, read back by the header's delimiter."""
    s = table(spark, sf_dir, "supplier")
    sep = F.element_at(F.array(*[F.lit(d) for d in files.DELIMITERS]), F.pmod("s_nationkey", F.lit(4)).cast("int") + 1)
    header = F.concat(F.lit("﻿key"), sep, F.lit("name"))
    d = files.delimiter(files.without_mark(header))
    parts = F.split(F.concat(F.col("s_suppkey").cast("string"), sep, F.col("s_name")), F.concat(F.lit("\\Q"), d, F.lit("\\E")))
    return s.select("s_suppkey", d.alias("delimiter"), parts[1].alias("name"))


def q_magic_bytes(spark, sf_dir):
    """Pages as files, some behind the first bytes of other formats: whether their first bytes are those of the ending they name."""
    p = table(spark, sf_dir, "pages")
    ends = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "PNG", "csv", "gif", "docx", "odd")]), F.pmod("page_id", F.lit(6)).cast("int") + 1)
    head = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in ("255044462D31", "89504E470D0A1A0A00", "00", "474946383961", "504B0303", "00")]), F.pmod("page_id", F.lit(6)).cast("int") + 1)
    return p.select("page_id", ends.alias("ending"), files.looks_like(ends, F.concat(head, F.encode(F.coalesce("html", F.lit("")), "UTF-8"))).alias("ok"))


def q_format_counts(spark, sf_dir):
    """Rows that aren't blank, pages and sheets named in each document."""
    d = table(spark, sf_dir, "documents")
    t = F.coalesce("text", F.lit(""))
    return d.select("doc_id", F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")).alias("rows"), F.regexp_count(t, F.lit(r"(?m)^\[Page [0-9]+\]")).alias("pages"), F.regexp_count(t, F.lit("(?m)^## Sheet:")).alias("sheets"))


def q_session_blob(spark, sf_dir):
    """Conversations as JSON blobs of texts and file names, and back as rows; texts without a name get none."""
    c = table(spark, sf_dir, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    blob = c.groupBy("conv_id").agg(rows.alias("r")).select("conv_id", F.to_json(F.struct(F.transform("r", lambda x: x["text"]).alias("texts"), F.slice(F.transform("r", lambda x: x["role"]), 1, 2).alias("filenames"))).alias("body"))
    got = blob.select("conv_id", F.from_json("body", "texts array<string>, filenames array<string>").alias("b"))
    return got.select("conv_id", "b.filenames", F.posexplode("b.texts").alias("ix", "text")).select("conv_id", "ix", F.length("text").alias("chars"), F.get("filenames", F.col("ix")).alias("filename"))


def q_matrix_wide(spark, sf_dir):
    """Each supplier's cells as one map, shown as a sheet shows them."""
    kind = F.col("attribute_id") % 4
    shown = H.typed_text(F.when(kind == 0, F.col("present")), F.when(kind == 1, F.round(F.col("confidence") * 100, 0)), F.when(kind == 2, F.concat(F.lit("o"), F.col("attribute_id") % 3)), F.when(kind == 3, F.lit("")))
    wide = H.wide_map(latest(spark, sf_dir).withColumn("shown", shown), "entity_id", "attribute_id", "shown")
    return wide.select("entity_id", F.size("cells").alias("n"), F.to_json("cells").alias("cells"))


def q_matrix_columns(spark, sf_dir):
    """A column for each of three parts."""
    shown = F.when(F.col("present"), "Yes").otherwise("No")
    few = latest(spark, sf_dir).where("attribute_id IN (1, 2, 3)").select("entity_id", F.col("attribute_id").cast("string").alias("attribute"), shown.alias("shown"))
    return H.wide_columns(few, "entity_id", "attribute", "shown", ["1", "2", "3"])


def q_results_csv(spark, sf_dir):
    """Latest results as lines of a CSV file."""
    r = latest(spark, sf_dir).join(weights(spark, sf_dir), "attribute_id")
    cells = [F.concat(F.lit("s"), F.col("entity_id")), csv_safe(F.concat(F.lit("="), F.col("attribute_label"))), F.when(F.col("present"), "Yes").otherwise("No"), F.format_string("%.2f", "confidence"), F.format_string("%.2f", F.col("weight").cast("double")), F.date_format("created_at", "yyyy-MM-dd")]
    return r.select("entity_id", "attribute_id", F.concat_ws(",", *cells).alias("line"))


def _import(spark, sf_dir):
    """Parts as rows of a file: every seventh has no label."""
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") + 1).alias("row"), F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit(" "), F.col("p_name"))).alias("label"), F.when(F.col("p_size") > 10, F.concat(F.lit("x"), F.col("p_size"))).otherwise(" ").alias("external_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand"), "p_type")


def _preview(spark, sf_dir):
    return H.previewed(_import(spark, sf_dir), "label", "external_id", ["brand", "p_type"])


def q_import_entities(spark, sf_dir):
    return _preview(spark, sf_dir)[0]


def q_import_cells(spark, sf_dir):
    return _preview(spark, sf_dir)[1].groupBy("label", "attribute").agg(F.count("*").alias("n"), F.max("value").alias("last"))


def q_import_errors(spark, sf_dir):
    rows = _import(spark, sf_dir).select((F.col("row") + 1).alias("row"), "p_type")
    errors = _preview(spark, sf_dir)[2]
    small = rows.where("p_type = 'PROMO'").select("row", F.lit("No promotions").alias("message"))
    return H.error_report(rows, errors.unionByName(small))


def q_job_report(spark, sf_dir):
    """A report of each order: its lines by number under their parts."""
    l = table(spark, sf_dir, "lineitem")
    parts = l.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("supplier "), F.col("l_suppkey"), F.lit(" — part "), F.col("l_partkey")).alias("title"), F.concat(F.lit("flag "), F.col("l_returnflag")).alias("body"))
    return H.combined_report(parts, "l_orderkey", ["l_linenumber", "l_partkey"]).select("l_orderkey", F.md5("report").alias("digest"), F.length("report").alias("chars"))


def q_results_json(spark, sf_dir):
    """Results of each supplier as compact JSON, with a summary."""
    r = latest(spark, sf_dir).groupBy("entity_id").agg(F.count_if("present").alias("found"), F.count_if(~F.col("present")).alias("missing"))
    return r.select("entity_id", F.to_json(F.struct("entity_id", "found", "missing")).alias("body"))


def q_trend_series(spark, sf_dir):
    """Shares of present findings of all suppliers by month, with gaps, and the campaign's average."""
    from entivore.sources.tables import results

    r = results(spark, sf_dir)
    s = r.groupBy(F.col("job").alias("date"), "entity_id").agg((F.count_if("present") / F.count("*")).alias("score"))
    return H.trend_series(s)


def q_token_costs(spark, sf_dir):
    """Estimated tokens of each conversation and their price by role, in units of a millionth."""
    price = spark.createDataFrame([("user", 250), ("assistant", 1000), ("system", 250)], "role string, price long")
    c = table(spark, sf_dir, "conversations").join(F.broadcast(price), "role", "left")
    tokens = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long")
    return c.groupBy("conv_id").agg(F.sum(tokens).alias("tokens"), F.sum(tokens * F.coalesce("price", F.lit(250))).alias("cost"))


_SEP = "[',', ';', chr(9), '|'][(s_nationkey % 4 + 1)::INT]"
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_csv_lines": f"SELECT s_suppkey, {_SEP} AS delimiter, s_name AS name FROM supplier",
    "q_magic_bytes": "SELECT page_id, ['pdf', 'PNG', 'csv', 'gif', 'docx', 'odd'][(page_id % 6 + 1)::INT] AS ending, [true, true, true, true, false, NULL][(page_id % 6 + 1)::INT] AS ok FROM pages",
    "q_format_counts": "SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') != ''))::INT AS rows, len(regexp_extract_all(coalesce(text, ''), '(?m)^\\[Page [0-9]+\\]'))::INT AS pages, len(regexp_extract_all(coalesce(text, ''), '(?m)^## Sheet:'))::INT AS sheets FROM documents",
    "q_session_blob": "SELECT conv_id, (row_number() OVER w - 1)::INT AS ix, length(text)::INT AS chars, CASE WHEN row_number() OVER w <= 2 THEN role END AS filename FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "q_matrix_wide": f"""WITH {LATEST}, c AS (SELECT entity_id, attribute_id::VARCHAR AS k, CASE attribute_id % 4 WHEN 0 THEN CASE WHEN present THEN 'Yes' ELSE 'No' END WHEN 1 THEN round(confidence * 100, 0)::BIGINT::VARCHAR WHEN 2 THEN 'o' || attribute_id % 3 ELSE '' END AS v FROM latest)
SELECT entity_id, count(*)::INT AS n, '{{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}}' AS cells FROM c GROUP BY 1""",
    "q_matrix_columns": f"WITH {LATEST}, c AS (SELECT entity_id, attribute_id, CASE WHEN present THEN 'Yes' ELSE 'No' END AS v FROM latest WHERE attribute_id IN (1, 2, 3)) SELECT entity_id, coalesce(max(v) FILTER (WHERE attribute_id = 1), '') AS \"1\", coalesce(max(v) FILTER (WHERE attribute_id = 2), '') AS \"2\", coalesce(max(v) FILTER (WHERE attribute_id = 3), '') AS \"3\" FROM c GROUP BY 1",
    "q_results_csv": f"WITH {LATEST}, {W} SELECT entity_id, attribute_id, 's' || entity_id || ',''=' || attribute_label || ',' || CASE WHEN present THEN 'Yes' ELSE 'No' END || ',' || printf('%.2f', confidence) || ',' || printf('%.2f', weight::DOUBLE) || ',' || strftime(created_at, '%Y-%m-%d') AS line FROM latest JOIN w USING (attribute_id)",
    "q_import_entities": "SELECT label, nullif(e, '') AS external_id FROM (SELECT p_name AS label, arg_min(CASE WHEN p_size > 10 THEN 'x' || p_size ELSE '' END, p_partkey) AS e FROM part WHERE p_partkey % 7 != 0 GROUP BY 1)",
    "q_import_cells": "WITH r AS (SELECT * FROM part WHERE p_partkey % 7 != 0) SELECT p_name AS label, 'brand' AS attribute, count(*) AS n, max(p_brand) AS last FROM r WHERE p_size % 2 = 0 GROUP BY 1 UNION ALL SELECT p_name, 'p_type', count(*), max(p_type) FROM r GROUP BY 1",
    "q_import_errors": "SELECT p_partkey + 2 AS row, p_type, CASE WHEN p_partkey % 7 = 0 AND p_type = 'PROMO' THEN 'Missing entity label; No promotions' WHEN p_partkey % 7 = 0 THEN 'Missing entity label' ELSE 'No promotions' END AS _error FROM part WHERE p_partkey % 7 = 0 OR p_type = 'PROMO'",
    "q_job_report": "WITH r AS (SELECT l_orderkey, string_agg('## supplier ' || l_suppkey || ' — part ' || l_partkey || chr(10) || chr(10) || 'flag ' || l_returnflag, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, '## supplier ' || l_suppkey || ' — part ' || l_partkey || chr(10) || chr(10) || 'flag ' || l_returnflag) AS t FROM lineitem GROUP BY 1) SELECT l_orderkey, md5(t) AS digest, length(t)::INT AS chars FROM r",
    "q_results_json": f"WITH {LATEST} SELECT entity_id, '{{\"entity_id\":' || entity_id || ',\"found\":' || count(*) FILTER (WHERE present) || ',\"missing\":' || count(*) FILTER (WHERE NOT present) || '}}' AS body FROM latest GROUP BY 1",
    "q_trend_series": f"""WITH {LATEST}, s AS (SELECT job AS date, entity_id, count(*) FILTER (WHERE present) / count(*) AS score FROM res GROUP BY 1, 2), w AS (SELECT date, sum(round(score * 10000)::BIGINT) / count(*) AS a FROM s GROUP BY 1)
SELECT w.date, e.entity_id, round(score * 100, 2) AS percent, round(a / 100, 1) AS campaign FROM w CROSS JOIN (SELECT DISTINCT entity_id FROM s) e LEFT JOIN s ON s.date = w.date AND s.entity_id = e.entity_id""",
    "q_token_costs": "SELECT conv_id, sum(length(coalesce(text, '')) // 4)::BIGINT AS tokens, sum(length(coalesce(text, '')) // 4 * CASE WHEN role = 'assistant' THEN 1000 ELSE 250 END)::BIGINT AS cost FROM conversations GROUP BY 1",
}
