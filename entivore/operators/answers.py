"""Carrying out the plan that a question about documents' tables was given.

A simple plan takes cells as they stand. A complex one asks about the table in chunks of rows, with
the columns of the plan only; what comes back is merged, and tells whether it is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entivore.operators.passages import cells, table_lines
from entivore.operators.profiles import names

#: Rows of a chunk.
ROWS = 100


def simple(docs: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id, doc_id, sheet, row, column, value: the filled cells of the columns (any case) that each simple plan (plan_id,
    doc_id, kind, columns) names; of several, in rows where none of them is empty; of none, all."""
    asked = plans.where("kind = 'simple'").select("plan_id", "doc_id", F.transform(F.coalesce("columns", F.array().cast("array<string>")), F.lower).alias("low"))
    lines = docs.select("doc_id", "sheet", "text").join(asked, "doc_id").select("plan_id", "doc_id", "sheet", "low", table_lines(F.col("text")).alias("lines"))
    rows = lines.select("plan_id", "doc_id", "sheet", "low", names(cells(F.get("lines", F.lit(0)))).alias("head"), F.posexplode_outer("lines").alias("row", "line")).where("row > 0")
    # the cells of a row stay together: only rows that have some are put together
    each = F.zip_with(F.transform("head", lambda c, i: F.struct(i.alias("position"), c.alias("column"))), F.slice(cells(F.col("line")), F.lit(1), F.size("head")), lambda h, v: F.struct(h["position"].alias("position"), h["column"].alias("column"), F.coalesce(v, F.lit("")).alias("value")))
    held = rows.select("plan_id", "doc_id", "sheet", "low", "row", F.filter(each, lambda x: (x["value"] != "") & ((F.size("low") == 0) | F.array_contains("low", F.lower(x["column"])))).alias("all"))
    keys = ["plan_id", "doc_id", "sheet", "row"]
    full = held.groupBy(*keys, "low").agg(F.flatten(F.collect_list("all")).alias("all"))
    n = F.size(F.array_distinct(F.transform("all", lambda x: F.lower(x["column"]))))
    whole = (F.size("low") < 2) | (n == F.size(F.array_distinct("low")))
    return full.select(*keys, F.inline_outer(F.when(whole, F.array_sort("all")))).where("position IS NOT NULL").drop("position")


def requests(docs: DataFrame, plans: DataFrame, rows: int = ROWS) -> DataFrame:
    """plan_id, doc_id, sheet, ix, chunk: the tables that complex plans ask about, by so many rows, the header before each, with
    the plan's columns only if the table has some of them."""
    asked = plans.where("kind = 'complex'").select("plan_id", "doc_id", F.transform(F.coalesce("columns", F.array().cast("array<string>")), F.lower).alias("low"))
    lines = docs.select("doc_id", "sheet", table_lines(F.col("text")).alias("lines")).where("size(lines) > 1").join(asked, "doc_id")
    held = lines.withColumn("head", cells(F.get("lines", F.lit(0))))
    all_ = F.sequence(F.lit(0), F.size("head") - 1)
    wanted = F.filter(all_, lambda i: F.array_contains("low", F.lower(F.get("head", i))))
    held = held.withColumn("at", F.when(F.size(wanted) > 0, wanted).otherwise(all_))
    parts = held.select("plan_id", "doc_id", "sheet", "lines", "at", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 2) / rows).cast("int"))).alias("ix"))
    line = lambda x: F.concat(F.lit("| "), F.array_join(F.transform("at", lambda i: F.coalesce(F.get(cells(x), i), F.lit(""))), " | "), F.lit(" |"))
    text = F.array_join(F.concat(F.array(line(F.get("lines", F.lit(0)))), F.transform(F.slice("lines", F.col("ix") * rows + 2, F.lit(rows)), line)), "\n")
    return parts.select("plan_id", "doc_id", "sheet", "ix", text.alias("chunk"))


def merged(requests_: DataFrame, answers: DataFrame) -> DataFrame:
    """plan_id, value, first, n: what the answers (plan_id, sheet, ix, error, matches) to the requests found, each value once
    (blanks and case apart), as it was first written, with the chunk it came from first and how often it came."""
    keys = ["plan_id", "sheet", "ix"]
    found = requests_.select(*keys).join(answers.where("error IS NULL"), keys).select("plan_id", "sheet", "ix", F.posexplode("matches").alias("at", "value"))
    found = found.withColumn("value", F.trim("value")).where("value != ''")
    first = F.min(F.struct("sheet", "ix", "at", "value")).alias("x")
    return found.groupBy("plan_id", F.lower("value").alias("key")).agg(first, F.count("*").alias("n")).select("plan_id", "x.value", F.concat_ws(":", "x.sheet", F.col("x.ix").cast("string")).alias("first"), "n")


def outcomes(requests_: DataFrame, answers: DataFrame) -> DataFrame:
    """plan_id, chunks, failed, partial, cached: a chunk without an answer or with an error has failed; a result of which some
    chunks failed is partial, and only a whole one is kept in the cache."""
    keys = ["plan_id", "sheet", "ix"]
    good = answers.where("error IS NULL AND matches IS NOT NULL").select(*keys).distinct().withColumn("ok", F.lit(True))
    each = requests_.select(*keys).join(good, keys, "left").groupBy("plan_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("ok").isNull()).alias("failed"))
    return each.select("plan_id", "chunks", "failed", ((F.col("failed") > 0) & (F.col("failed") < F.col("chunks"))).alias("partial"), (F.col("failed") == 0).alias("cached"))
