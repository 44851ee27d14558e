"""What the columns of tables in documents hold, and what can be asked about them.

One aggregation over all cells gives every column's profile: how many cells, how many filled, how
many different, which types its values vote for, and its first samples. Roles, suggestions and
capped summaries follow from profiles alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entivore.operators.passages import cells, table_lines

# At most so many sheets, columns of a sheet and samples; columns named in a summary, of a sheet and in all.
SHEETS, COLUMNS, SAMPLES, NAMED, NAMED_IN_ALL = 10, 20, 3, 5, 10
#: A type wins if so many of ten filled cells have it.
VOTES = 8
#: Types by pattern; the first that fits a cell is its vote.
TYPES = (
    ("money", r"^[$€£]\s?-?[0-9][0-9,]*(?:\.[0-9]+)?\s?[KMBTkmbt]?$"),
    ("percent", r"^-?[0-9]+(?:\.[0-9]+)?\s?%$"),
    ("date", r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})(?:[ T].*)?$"),
    ("number", r"^-?[0-9][0-9,]*(?:\.[0-9]+)?$"),
    ("flag", r"(?i)^(?:yes|no|true|false|y|n)$"),
)
#: Names of columns that tell who or what is meant.
PEOPLE, ORGANISATIONS, AMOUNTS = r"(?i)name|owner|person|contact|author|user", r"(?i)company|organi[sz]ation|team|vendor|supplier|client", r"(?i)price|cost|revenue|amount|total|salary|value|balance"


def names(head: Column) -> Column:
    """The names of columns; those without one are called by their position."""
    return F.transform(head, lambda c, i: F.when(c == "", F.concat(F.lit("column "), (i + 1).cast("string"))).otherwise(c))


def table_cells(docs: DataFrame) -> DataFrame:
    """doc_id, sheet, position, column, row, value of all cells of the documents' markdown tables (doc_id, sheet, text): missing
    cells of short rows and empty ones are empty; columns without a name are called by their position."""
    lines = docs.select("doc_id", "sheet", table_lines(F.col("text")).alias("lines"))
    rows = lines.select("doc_id", "sheet", names(cells(F.get("lines", F.lit(0)))).alias("head"), F.posexplode_outer("lines").alias("row", "line")).where("row > 0")
    rows = rows.select("doc_id", "sheet", "row", "head", cells(F.col("line")).alias("values"))
    each = rows.select("doc_id", "sheet", "row", "values", F.posexplode_outer("head").alias("position", "name"))
    return each.select("doc_id", "sheet", "position", F.col("name").alias("column"), "row", F.coalesce(F.get("values", F.col("position")), F.lit("")).alias("value"))


def _vote(value: Column) -> Column:
    out = F.when(value == "", F.lit(None).cast("string"))
    for name, pattern in TYPES:
        out = out.when(value.rlike(pattern), name)
    return out.otherwise("text")


def profiles(cells_: DataFrame) -> DataFrame:
    """doc_id, sheet, position, column, n, filled, n_distinct, type, samples of each column of table_cells.

    Cells are counted by value first, so that a column of any length is a sum; samples are the values that come first. A cell's
    vote is found once, before its value is counted, and all sums are taken in one pass over the values in order."""
    keys = ["doc_id", "sheet", "position", "column"]
    values = cells_.withColumn("vote", _vote(F.col("value"))).groupBy(*keys, "value", "vote").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    votes = [F.sum(F.when(F.col("vote") == t, F.col("n")).otherwise(0)).alias(f"v_{t}") for t, _ in TYPES]
    filled = F.coalesce(F.sum(F.when(F.col("value") != "", F.col("n"))), F.lit(0)).alias("filled")
    first = Window.partitionBy(*keys).orderBy(F.col("value") == "", "row")
    values = values.withColumn("_k", F.row_number().over(first))
    firsts = [F.max(F.when((F.col("_k") == k) & (F.col("value") != ""), F.col("value"))).alias(f"s_{k}") for k in range(1, SAMPLES + 1)]
    out = values.groupBy(*keys).agg(F.sum("n").alias("n"), filled, F.count_if(F.col("value") != "").alias("n_distinct"), *votes, *firsts)
    samples = F.filter(F.array(*[f"s_{k}" for k in range(1, SAMPLES + 1)]), lambda x: x.isNotNull())
    type_ = F.when(F.col("filled") == 0, "empty")
    for t, _ in TYPES:
        type_ = type_.when(10 * F.col(f"v_{t}") >= VOTES * F.col("filled"), t)
    return out.select(*keys, "n", "filled", "n_distinct", type_.otherwise("text").alias("type"), samples.alias("samples"))


def roles(profiles_: DataFrame) -> DataFrame:
    """profiles with role: amount, share, date, flag, measure, key (all cells filled and different), person, organisation,
    category (a value stands five times on average), or text."""
    c, t = F.col("column"), F.col("type")
    role = (
        F.when(t == "empty", "empty")
        .when((t == "money") | (t.isin("number") & c.rlike(AMOUNTS)), "amount")
        .when(t == "percent", "share")
        .when(t.isin("date", "flag"), t)
        .when((F.col("n") > 1) & (F.col("n_distinct") == F.col("n")) & ~c.rlike(PEOPLE) & ~c.rlike(ORGANISATIONS), "key")
        .when(t == "number", "measure")
        .when(c.rlike(ORGANISATIONS), "organisation")
        .when(c.rlike(PEOPLE), "person")
        .when(5 * F.col("n_distinct") <= F.col("filled"), "category")
        .otherwise("text")
    )
    return profiles_.withColumn("role", role)


def kinds(docs: DataFrame, profiles_: DataFrame) -> DataFrame:
    """doc_id, kind: tabular if a document has a table with a filled column, else prose."""
    tabular = profiles_.where("filled > 0").select("doc_id").distinct().withColumn("_t", F.lit(True))
    return docs.select("doc_id").distinct().join(tabular, "doc_id", "left").select("doc_id", F.when(F.col("_t"), "tabular").otherwise("prose").alias("kind"))


def text_kinds(docs: DataFrame, parts: Column) -> DataFrame:
    """doc_id, kind: tabular if one of a document's parts (of docs: doc_id and what parts, texts in an array, are made of) has a
    table with a filled cell under its header, else prose. Told from the text itself: no cell is shuffled."""

    def tabular(text: Column) -> Column:
        def below(lines: Column) -> Column:
            return F.exists(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.exists(F.slice(x, F.lit(1), F.size(F.get(lines, F.lit(0)))), lambda c: c != ""))

        return F.exists(F.array(F.transform(table_lines(text), cells)), lambda lines: (F.size(lines) > 1) & below(lines))

    each = docs.select("doc_id", F.coalesce(F.exists(parts, tabular), F.lit(False)).alias("_t"))
    return each.groupBy("doc_id").agg(F.max("_t").alias("_t")).select("doc_id", F.when(F.col("_t"), "tabular").otherwise("prose").alias("kind"))


def together(kinds_: DataFrame, by: str) -> DataFrame:
    """kind of each group: that of all its documents, or mixed."""
    return kinds_.groupBy(by).agg(F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed").alias("kind"), F.count("*").alias("n"))


def _kept(profiles_: DataFrame) -> DataFrame:
    """The columns of the first sheets, up to the caps."""
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("sheet"))
    return profiles_.where(F.col("position") < COLUMNS).withColumn("_sheet", number).where(F.col("_sheet") <= SHEETS).drop("_sheet")


def suggestions(roles_: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, asks: up to so many questions that a document's columns can answer: amounts first, then who, then when, then shares
    and categories; where these don't do, about the whole."""
    ask = {
        "amount": lambda c: F.concat(F.lit("How much is "), c, F.lit(" in all?")),
        "person": lambda c: F.concat(F.lit("Who is named under "), c, F.lit("?")),
        "organisation": lambda c: F.concat(F.lit("Which organisations stand under "), c, F.lit("?")),
        "date": lambda c: F.concat(F.lit("What time does "), c, F.lit(" span?")),
        "share": lambda c: F.concat(F.lit("Where is "), c, F.lit(" highest?")),
        "category": lambda c: F.concat(F.lit("How many rows has each "), c, F.lit("?")),
    }
    rank, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (role, made) in enumerate(ask.items()):
        rank, text = F.when(F.col("role") == role, i).otherwise(rank), F.when(F.col("role") == role, made(F.col("column"))).otherwise(text)
    first = _kept(roles_).withColumn("rank", rank).groupBy("doc_id", "rank").agg(F.min(F.struct("sheet", "position", text.alias("ask"))).alias("x"))
    every = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "x.ask")))).alias("all"))
    always = F.array(F.lit("What do the rows have in common?"), F.lit("Which values come most often?"), F.lit("What do the first ten rows say?"))
    return every.select("doc_id", F.slice(F.concat(F.transform("all", lambda x: x["ask"]), always), 1, most).alias("asks"))


def summaries(roles_: DataFrame) -> DataFrame:
    """doc_id, sheets, columns, summary: how many are kept, and the sheets with their first columns and roles, in one line."""
    order = Window.partitionBy("doc_id").orderBy("sheet", "position")
    kept = _kept(roles_).withColumn("_named", (F.col("position") < NAMED).cast("int"))
    named = (F.col("_named") == 1) & (F.sum("_named").over(order) <= NAMED_IN_ALL)
    kept = kept.select("doc_id", "sheet", F.when(named, F.struct("position", F.concat("column", F.lit(" ("), "role", F.lit(")")).alias("t"))).alias("x"))
    sheet = kept.groupBy("doc_id", "sheet").agg(F.count("*").alias("columns"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ", ").alias("t"))
    line = F.when(F.col("t") != "", F.struct("sheet", "t"))
    every = sheet.groupBy("doc_id").agg(F.count("*").alias("sheets"), F.sum("columns").alias("columns"), F.array_sort(F.collect_list(line)).alias("all"))
    return every.select("doc_id", "sheets", "columns", F.array_join(F.transform("all", lambda x: F.concat(x["sheet"], F.lit(": "), x["t"])), "; ").alias("summary"))
