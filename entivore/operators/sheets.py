"""Imports and exports of matrices as sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entivore.sources.delimited import write_delimited


def typed_text(boolean: Column, numeric: Column, select: Column, text: Column) -> Column:
    """What a cell shows: its option, else its number, else yes or no, else its text."""
    number = F.when(numeric == F.floor(numeric), numeric.cast("long").cast("string")).otherwise(numeric.cast("string"))
    return F.coalesce(select, number, F.when(boolean, "Yes").when(~boolean, "No"), text, F.lit(""))


def wide_map(cells: DataFrame, entity: str, attribute: str, value: str) -> DataFrame:
    """entity, cells: a map of all attributes of each entity (its rows meet in one value, so a row's width is the bound)."""
    return cells.groupBy(entity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(attribute).cast("string").alias("k"), F.col(value).alias("v"))))).alias("cells"))


def wide_columns(cells: DataFrame, entity: str, attribute: str, value: str, attributes: Sequence[str]) -> DataFrame:
    """A column for each of attributes; empty cells are blank."""
    return cells.groupBy(entity).pivot(attribute, list(attributes)).agg(F.first(value)).fillna("", list(attributes))


def previewed(rows: DataFrame, label: str, external_id: str, attributes: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Imported rows (row: from 1) as entities (label, external_id: of the label's first row), cells (label, attribute,
    value: those that aren't blank) and errors (row, message: rows without a label; the header counts as a row)."""
    clean = rows.withColumn("_label", F.nullif(F.trim(F.col(label)), F.lit("")))
    errors = clean.where("_label IS NULL").select((F.col("row") + 1).alias("row"), F.lit("Missing entity label").alias("message"))
    good = clean.where("_label IS NOT NULL")
    first = F.min_by(F.struct(F.nullif(F.trim(F.col(external_id)), F.lit("")).alias("id")), "row")["id"]
    entities = good.groupBy(F.col("_label").alias("label")).agg(first.alias("external_id"))
    each = F.array(*[F.struct(F.lit(a).alias("attribute"), F.trim(F.col(a).cast("string")).alias("value")) for a in attributes])
    cells = good.select(F.col("_label").alias("label"), F.inline(each)).where("coalesce(value, '') != ''")
    return entities, cells, errors


def error_report(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """The rows that have errors (row, message), with all their messages, by the messages' order, in _error."""
    said = errors.groupBy(F.col("row").alias("_row")).agg(F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("_error"))
    return rows.join(said, F.col("row") == F.col("_row")).drop("_row")


def combined_report(parts: DataFrame, job: str, order: Sequence[str]) -> DataFrame:
    """job, report: the parts (title, body) of each job one after the other under their titles; a job's parts meet in one value."""
    block = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("body"))
    rows = parts.groupBy(job).agg(F.array_sort(F.collect_list(F.struct(*order, block.alias("block")))).alias("all"))
    return rows.select(job, F.array_join(F.transform("all", lambda x: x["block"]), "\n\n---\n\n").alias("report"))


def trend_series(scores: DataFrame) -> DataFrame:
    """date, entity_id, percent (null where an entity has no score), campaign: the date's average, for every date and
    entity. scores: date, entity_id, score (0 to 1)."""
    whole = scores.groupBy("date").agg((F.sum(F.round(F.col("score") * 10000).cast("long")) / F.count("*")).alias("all"))
    grid = whole.crossJoin(scores.select("entity_id").distinct())
    out = grid.join(scores, ["date", "entity_id"], "left")
    return out.select("date", "entity_id", F.round(F.col("score") * 100, 2).alias("percent"), F.round(F.col("all") / 100, 1).alias("campaign"))


def running_total(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    return rows.withColumn("total", F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def exported(entities: DataFrame, attributes: Sequence[tuple[str, str]], cells: DataFrame, path: str) -> None:
    """A campaign's matrix as delimited files: Entity, GWM ID and a column for each of attributes (id, label), in their order; a label
    that comes again is followed by its id. A cell shows its option, else its number, truth or text, safe for spreadsheets.

    entities: entity_id, label, gwm_id; cells: entity_id, attribute_id, value_select, value_numeric, value_boolean, value_text."""
    shown = F.coalesce(F.nullif("value_select", F.lit("")), F.col("value_numeric").cast("string"), F.initcap(F.col("value_boolean").cast("string")), "value_text", F.lit(""))
    keys = [key for key, _ in attributes]
    wide = wide_columns(cells.select("entity_id", "attribute_id", shown.alias("shown")), "entity_id", "attribute_id", "shown", keys)
    labels: list[str] = []
    for key, label in attributes:
        labels.append(label if label.lower() not in {x.lower() for x in ("Entity", "GWM ID", *labels)} else f"{label} ({key})")
    both = entities.select("entity_id", "label", "gwm_id").join(wide, "entity_id", "left").fillna("", keys)
    columns = [F.coalesce(c, F.lit("")).alias(name) for c, name in (("label", "Entity"), ("gwm_id", "GWM ID"))]
    write_delimited(both.select(*columns, *[F.col(f"`{k}`").alias(label) for k, label in zip(keys, labels, strict=True)]), path)
