"""Delimited files that are written of the driver's tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from entivore.operators import documents as D
from entivore.sources import delimited
from entivore.sources.shared import scratch
from entivore.sources.tables import table


def _written(df, sep=","):
    path = scratch(df.sparkSession, "csv")
    delimited.write_delimited(df, path, sep)
    return delimited.read_delimited(df.sparkSession, path)


def q_csv_files(spark, sf_dir):
    """All documents through files with quoted line breaks, quotes and delimiters; cells are safe for spreadsheets."""
    return _written(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def q_csv_markdown(spark, sf_dir):
    """Files of parts, with empty cells and pipes, to markdown tables of fifty keys each."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit('; "'), "p_brand", F.lit('"|')).alias("label"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size"))
    rows = _written(part, ";").withColumn("key", F.col("p_partkey").cast("long"))
    return D.markdown_table(rows.withColumn("page", F.floor(F.col("key") / 50)), ["p_partkey", "label", "size"], "key", "page")


def _safe(column: str) -> str:
    return rf"CASE WHEN regexp_matches({column}, '^[=+\-@|\t]') THEN '''' || {column} ELSE {column} END AS {column}"


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_csv_files": f"SELECT doc_id::VARCHAR AS doc_id, {_safe('text')}, {_safe('lang')}, {_safe('source')} FROM documents",
    "q_csv_markdown": r"""SELECT p_partkey // 50 AS page, '| p_partkey | label | size |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
  string_agg('| ' || p_partkey || ' | ' || replace(p_name || '; "' || p_brand || '"|', '|', '\|') || ' | ' || CASE WHEN p_size % 7 != 0 THEN p_size::VARCHAR ELSE '' END || ' |', chr(10) ORDER BY p_partkey) AS "table" FROM part GROUP BY 1""",
}
