"""Profiles of tables in documents, and deletes that follow references, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entivore.operators import answers as A
from entivore.operators import cascades
from entivore.operators import profiles as P
from entivore.operators.passages import sheet_parts, sheets
from entivore.sources.shared import stored
from entivore.sources.tables import table


def _orders(spark, sf_dir):
    """Every order's lines as a table with amounts, dates, shares, flags and a short last row; orders of one line are notes."""
    l = table(spark, sf_dir, "lineitem")
    cell = [F.col("l_linenumber").cast("string"), F.concat(F.lit("$"), F.floor("l_extendedprice").cast("long").cast("string")), F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")), F.date_format("l_shipdate", "yyyy-MM-dd"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("Supplier "), F.col("l_suppkey"))), F.when(F.col("l_returnflag") == "R", "yes").otherwise("no")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |"))
    rows = l.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag", line.alias("line")).alias("x"))
    body = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("lines"))
    head = "## Sheet: lines\n| Line | Price | Discount | Shipped | Supplier name |  |\n| --- | --- | --- | --- | --- | --- |\n"
    text = F.when(F.size("lines") > 1, F.concat(F.lit(head), F.array_join("lines", "\n"), F.lit("\n| 99 | $5 |\n"))).otherwise("one line, no table")
    return body.select(F.col("l_orderkey").alias("doc_id"), text.alias("text"))


def _profiles(spark, sf_dir):
    return P.profiles(P.table_cells(sheets(_orders(spark, sf_dir))))


def q_column_profiles(spark, sf_dir):
    """Every column of every order's table: filled, different, type, role, samples."""
    return P.roles(_profiles(spark, sf_dir)).select("doc_id", "sheet", "position", "column", "n", "filled", "n_distinct", "type", "role", F.array_join("samples", "|").alias("samples"))


def q_schema_profile(spark, sf_dir):
    """Orders and documents by what they are, by session: tabular, prose, or mixed."""
    docs = _orders(spark, sf_dir)
    tabular = P.text_kinds(docs, sheet_parts(F.col("text"))).withColumn("session", F.pmod("doc_id", F.lit(700)))
    prose = P.text_kinds(table(spark, sf_dir, "documents").select("doc_id", "text"), F.array("text")).withColumn("session", F.pmod("doc_id", F.lit(500)) + 600)
    return P.together(tabular.unionByName(prose), "session")


def q_query_suggestions(spark, sf_dir):
    return P.suggestions(P.roles(_profiles(spark, sf_dir))).select("doc_id", F.array_join("asks", " / ").alias("asks"))


def q_schema_summary(spark, sf_dir):
    return P.summaries(P.roles(_profiles(spark, sf_dir)))


def _asked(spark, sf_dir):
    """Every second order gets a simple plan, the others a complex one."""
    docs = sheets(_orders(spark, sf_dir))
    return docs, docs.select(F.col("doc_id").alias("plan_id"), "doc_id", F.when(F.col("doc_id") % 2 == 0, "simple").otherwise("complex").alias("kind"), F.array(F.lit("PRICE"), F.lit("supplier name")).alias("columns"))


def _plans(spark, sf_dir):
    """The complex plans' requests, of three rows each; one answer in five fails."""
    docs, plans = _asked(spark, sf_dir)
    requests = stored(A.requests(docs, plans, 3), "requests")
    value = F.transform(F.slice(F.split("chunk", "\n"), 2, 3), lambda x: F.trim(F.element_at(F.split(x, r"\|"), 3)))
    answers = requests.select("plan_id", "sheet", "ix", F.when((F.col("plan_id") + F.col("ix")) % 5 == 0, "failed").alias("error"), value.alias("matches"))
    return docs, plans, requests, answers


def q_plan_simple(spark, sf_dir):
    docs, plans = _asked(spark, sf_dir)
    return A.simple(docs, plans).select("plan_id", "sheet", "row", "column", "value")


def q_plan_requests(spark, sf_dir):
    return _plans(spark, sf_dir)[2].select("plan_id", "sheet", "ix", "chunk")


def q_plan_merged(spark, sf_dir):
    return A.merged(*_plans(spark, sf_dir)[2:])


def q_plan_outcomes(spark, sf_dir):
    return A.outcomes(*_plans(spark, sf_dir)[2:])


def _cascaded(spark, sf_dir):
    """What goes with region 2: nations, their suppliers and customers, orders, and lines."""
    lines = table(spark, sf_dir, "lineitem").withColumn("line", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    tables = {"region": (table(spark, sf_dir, "region"), "r_regionkey"), "nation": (table(spark, sf_dir, "nation"), "n_nationkey"), "supplier": (table(spark, sf_dir, "supplier"), "s_suppkey"), "customer": (table(spark, sf_dir, "customer"), "c_custkey"), "orders": (table(spark, sf_dir, "orders"), "o_orderkey"), "lineitem": (lines, "line")}
    references = [("nation", "n_regionkey", "region"), ("supplier", "s_nationkey", "nation"), ("customer", "c_nationkey", "nation"), ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_suppkey", "supplier")]
    return tables, cascades.cascade(tables, references, {"region": spark.createDataFrame([(2,)], "key long")})


def q_cascade_levels(spark, sf_dir):
    """Every row that goes, and how far from the region."""
    _, gone = _cascaded(spark, sf_dir)
    out = None
    for name, df in gone.items():
        one = df.select(F.lit(name).alias("table"), F.col("key").cast("string").alias("key"), "level")
        out = one if out is None else out.unionByName(one)
    return out


def q_cascade_scores(spark, sf_dir):
    """Sums of suppliers after the cascade: made anew for those that lost lines only; suppliers that went are gone."""
    tables, gone = _cascaded(spark, sf_dir)
    compute = lambda df: df.groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
    lines = tables["lineitem"][0]
    lost = stored(lines.join(gone["lineitem"].select(F.col("key").alias("line")), "line", "left_semi").select("l_suppkey").distinct(), "stale")
    left = cascades.remaining(lines, "line", gone["lineitem"])
    return cascades.recomputed(compute(lines), lost, "l_suppkey", left, compute)


_CELLS = r"""t AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_shipdate, l_returnflag) AS row, count(*) OVER (PARTITION BY l_orderkey) AS m, l_linenumber::VARCHAR AS c0, '$' || floor(l_extendedprice)::BIGINT AS c1, round(l_discount * 100)::INT || '%' AS c2, strftime(l_shipdate, '%Y-%m-%d') AS c3,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'Supplier ' || l_suppkey END AS c4, CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS c5 FROM lineitem),
x AS (SELECT doc_id, row, m, unnest([0, 1, 2, 3, 4, 5]) AS position, unnest([c0, c1, c2, c3, c4, c5]) AS value FROM t WHERE m > 1
  UNION ALL SELECT doc_id, m + 1, m, unnest([0, 1, 2, 3, 4, 5]), unnest(['99', '$5', '', '', '', '']) FROM (SELECT DISTINCT doc_id, m FROM t WHERE m > 1)),
v AS (SELECT doc_id, position, value, count(*) AS n, min(row) AS row FROM x GROUP BY ALL),
p AS (SELECT doc_id, position, sum(n) AS n, coalesce(sum(n) FILTER (WHERE value != ''), 0) AS filled, count(*) FILTER (WHERE value != '') AS n_distinct,
  coalesce(array_to_string(list_slice(list(value ORDER BY row) FILTER (WHERE value != ''), 1, 3), '|'), '') AS samples FROM v GROUP BY ALL),
r AS (SELECT *, ['Line', 'Price', 'Discount', 'Shipped', 'Supplier name', 'column 6'][position + 1] AS "column", CASE WHEN filled = 0 THEN 'empty' ELSE ['number', 'money', 'percent', 'date', 'text', 'flag'][position + 1] END AS type,
  CASE WHEN filled = 0 THEN 'empty' WHEN position = 0 THEN CASE WHEN n_distinct = n THEN 'key' ELSE 'measure' END ELSE ['', 'amount', 'share', 'date', 'organisation', 'flag'][position + 1] END AS role FROM p)"""
_ASKED = f"""{_CELLS}, w AS (SELECT doc_id, row, max(value) FILTER (WHERE position = 1) AS price, max(value) FILTER (WHERE position = 4) AS supplier FROM x GROUP BY ALL),
q AS (SELECT doc_id AS plan_id, 'lines' AS sheet, ((row - 1) // 3)::INT AS ix, row, price, supplier FROM w WHERE doc_id % 2 = 1)"""
_GONE = """n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2), s AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT k FROM n)), c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT k FROM n)), o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM c)),
l AS (SELECT l_suppkey, l_quantity, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS k, CASE WHEN l_suppkey IN (SELECT k FROM s) THEN 3 WHEN l_orderkey IN (SELECT k FROM o) THEN 4 END AS level FROM lineitem)"""
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_column_profiles": f'WITH {_CELLS} SELECT doc_id, \'lines\' AS sheet, position::INT AS position, "column", n::BIGINT AS n, filled::BIGINT AS filled, n_distinct, type, role, samples FROM r',
    "q_schema_profile": "WITH k AS (SELECT l_orderkey % 700 AS session, CASE WHEN count(*) > 1 THEN 'tabular' ELSE 'prose' END AS kind FROM lineitem GROUP BY l_orderkey UNION ALL SELECT doc_id % 500 + 600, 'prose' FROM documents) SELECT session, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS kind, count(*) AS n FROM k GROUP BY 1",
    "q_query_suggestions": f"""WITH {_CELLS} SELECT doc_id, array_to_string(list_slice(['How much is Price in all?'] || CASE WHEN max(filled) FILTER (WHERE position = 4) > 0 THEN ['Which organisations stand under Supplier name?'] ELSE [] END || ['What time does Shipped span?', 'Where is Discount highest?'], 1, 3), ' / ') AS asks FROM r GROUP BY 1""",
    "q_schema_summary": f"""WITH {_CELLS} SELECT doc_id, 1::BIGINT AS sheets, 6::BIGINT AS columns, 'lines: ' || string_agg("column" || ' (' || role || ')', ', ' ORDER BY position) FILTER (WHERE position < 5) AS summary FROM r GROUP BY 1""",
    "q_plan_simple": f'WITH {_ASKED}, s AS (SELECT * FROM w WHERE doc_id % 2 = 0 AND supplier != \'\' AND price != \'\') SELECT doc_id AS plan_id, \'lines\' AS sheet, row::INT AS row, \'Price\' AS "column", price AS value FROM s UNION ALL SELECT doc_id, \'lines\', row::INT, \'Supplier name\', supplier FROM s',
    "q_plan_requests": f"WITH {_ASKED} SELECT plan_id, sheet, ix, '| Price | Supplier name |' || chr(10) || string_agg('| ' || price || ' | ' || supplier || ' |', chr(10) ORDER BY row) AS chunk FROM q GROUP BY 1, 2, 3",
    "q_plan_merged": f"WITH {_ASKED} SELECT plan_id, supplier AS value, sheet || ':' || min(ix) AS first, count(*) AS n FROM q WHERE supplier != '' AND (plan_id + ix) % 5 != 0 GROUP BY plan_id, sheet, supplier",
    "q_plan_outcomes": f"WITH {_ASKED}, c AS (SELECT DISTINCT plan_id, ix FROM q), o AS (SELECT plan_id, count(*) AS chunks, count(*) FILTER (WHERE (plan_id + ix) % 5 = 0) AS failed FROM c GROUP BY 1) SELECT *, failed > 0 AND failed < chunks AS partial, failed = 0 AS cached FROM o",
    "q_cascade_levels": f"WITH {_GONE} SELECT 'region' AS \"table\", '2' AS key, 0 AS level UNION ALL SELECT 'nation', k::VARCHAR, 1 FROM n UNION ALL SELECT 'supplier', k::VARCHAR, 2 FROM s UNION ALL SELECT 'customer', k::VARCHAR, 2 FROM c UNION ALL SELECT 'orders', k::VARCHAR, 3 FROM o UNION ALL SELECT 'lineitem', k, min(level) FROM l WHERE level IS NOT NULL GROUP BY k",
    "q_cascade_scores": f"WITH {_GONE}, lost AS (SELECT DISTINCT l_suppkey FROM l WHERE level IS NOT NULL), g AS (SELECT k FROM l WHERE level IS NOT NULL) SELECT l_suppkey, count(*) AS lines, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, l_suppkey IN (SELECT l_suppkey FROM lost) AS recomputed FROM l WHERE k NOT IN (SELECT k FROM g) GROUP BY 1",
}
