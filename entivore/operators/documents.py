"""Documents: pages, batches, chunks, tables, passages, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, page, text: split at lines that begin with [Page N]; text before the first is page 0, without any
    it is page 1; blank pages go."""
    mark = r"(?m)^\[Page ([0-9]+)\]"
    numbers = F.regexp_extract_all("text", F.lit(mark), F.lit(1))
    parts = F.split("text", mark, -1)
    numbered = F.arrays_zip(F.concat(F.array(F.when(F.size(numbers) > 0, "0").otherwise("1")), numbers).alias("page"), parts.alias("part"))
    out = docs.where("text IS NOT NULL").select("doc_id", F.explode(numbered).alias("p")).select("doc_id", F.col("p.page").cast("int").alias("page"), F.trim(F.regexp_replace("p.part", r"^\s+|\s+$", "")).alias("text"))
    return out.where("text != ''")


def greedy_batches(sizes: Column, target: int) -> Column:
    """The batch number, from 0, of each size: a batch is closed when the next size would go beyond target."""

    def step(acc, x):
        full = (acc["sum"] > 0) & (acc["sum"] + x > target)
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(F.when(full, x).otherwise(acc["sum"] + x).cast("long").alias("sum"), batch.cast("int").alias("batch"), F.concat(acc["out"], F.array(batch.cast("int"))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def fixed_chunks(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, ix, chunk: pieces of size characters."""
    n = F.length("text")
    at = F.explode(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1))
    return docs.where("text IS NOT NULL AND text != ''").select("doc_id", "text", at.alias("ix")).select("doc_id", "ix", F.substr("text", F.col("ix") * size + 1, F.lit(size)).alias("chunk"))


def markdown_table(rows: DataFrame, columns: list[str], key: str, page: str) -> DataFrame:
    """page, table: the rows of each page, in key's order, as a markdown table with pipes in cells escaped.

    All rows of a page meet in one value, so pages should be of bounded size."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    lines = rows.select(F.struct(F.col(key).alias("k"), line.alias("line")).alias("x"), page).groupBy(page).agg(F.array_sort(F.collect_list("x")).alias("all"))
    return lines.select(page, F.concat(F.lit(head), F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("table"))


def page_starts(rows: DataFrame, page: str) -> DataFrame:
    """page (a whole number), before: how many rows come on the pages before it.

    Pages are summed by blocks of a thousand first, so that only blocks are counted in one task."""
    n = rows.groupBy(page).agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col(page) / 1000))
    blocks = n.groupBy("block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("start"))
    within = F.sum("n").over(Window.partitionBy("block").orderBy(page)) - F.col("n")
    return n.withColumn("within", within).join(blocks, "block").select(page, (F.col("start") + F.col("within")).alias("before"))


def table_cells(tables: DataFrame) -> DataFrame:
    """row (from 1), column, value: the non-empty cells of markdown tables, with the other columns of tables; the first
    pipe line is the header."""
    keep = [c for c in tables.columns if c != "table"]
    lines = F.filter(F.split("table", "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^[\s|:-]+$"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\s*\||\|\s*$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    rows = tables.select(*keep, lines.alias("lines")).select(*keep, cells(F.get("lines", F.lit(0))).alias("head"), F.posexplode("lines").alias("row", "line")).where("row > 0")
    out = rows.select(*keep, "row", "head", F.posexplode(cells(F.col("line"))).alias("at", "value")).select(*keep, "row", F.get("head", F.col("at")).alias("column"), "value")
    return out.where("value != ''")


def trimmed_turns(turns: DataFrame, budget: int) -> DataFrame:
    """The turns of each conversation (conv_id, turn, role, text) that stay when its cost, of characters / 4 + 4 a turn, is to fit
    the budget: the oldest tool results go first, then the oldest messages, until it fits; what then comes before the first
    message of the user or the system goes as well, if there is one."""
    cost = (F.floor(F.length(F.coalesce("text", F.lit(""))) / 4) + 4).cast("long")
    own = Window.partitionBy("conv_id")
    order = own.orderBy(F.col("role") != "tool", "turn").rowsBetween(Window.unboundedPreceding, -1)
    df = turns.withColumn("_cost", cost).withColumn("_over", F.sum("_cost").over(own) - budget).withColumn("_before", F.coalesce(F.sum("_cost").over(order), F.lit(0)))
    kept = df.where(F.col("_before") >= F.col("_over"))
    kept = kept.withColumn("_start", F.min(F.when(F.col("role").isin("user", "system"), F.col("turn"))).over(own))
    return kept.where(F.col("turn") >= F.coalesce("_start", "turn")).drop("_cost", "_over", "_before", "_start")


def capped(turns: DataFrame, cap: int) -> DataFrame:
    """turns with text cut so that a conversation's texts, in the order of turns, have cap characters together."""
    before = F.coalesce(F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.withColumn("text", F.substring("text", F.lit(1), F.greatest(F.lit(cap) - before, F.lit(0)).cast("int")))


def remembered(memories: DataFrame, query: str, n: int = 5) -> DataFrame:
    """The n newest memories (entity, created, id, ...) of subjects that hold a word of more than three letters of the query, one
    for each subject whatever its case."""
    words = sorted({w for w in query.lower().split() if len(w) > 3})
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("entity"), F.lit(w))
    newest = F.row_number().over(Window.partitionBy(F.lower("entity")).orderBy(F.desc("created"), F.desc("id")))
    return memories.where(hit).withColumn("_k", newest).where("_k = 1").drop("_k").orderBy(F.desc("created"), F.desc("id")).limit(n)
