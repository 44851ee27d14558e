"""Latest-wins, merges, diffs and scores over keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(by: Sequence[str]) -> list[Column]:
    """Columns by name; 'x desc' turns one round. Nulls come last either way."""
    return [F.col(c[:-5]).desc_nulls_last() if c.endswith(" desc") else F.col(c).asc_nulls_last() for c in by]


def first_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[str], n: int = 1) -> DataFrame:
    """The first n rows of each key in the order of by, which should be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(by)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def weighted_scores(results: DataFrame, weights: DataFrame) -> DataFrame:
    """Per entity_id: total_score (weights of present attributes), attributes_present, attributes_checked."""
    joined = results.join(weights.select("attribute_id", "weight"), "attribute_id")
    return joined.groupBy("entity_id").agg(
        F.sum(F.when(F.col("present"), F.col("weight")).otherwise(0)).cast("double").alias("total_score"), F.count_if("present").alias("attributes_present"), F.count("*").alias("attributes_checked")
    )


def matrix_scores(cells: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per entity_id the weighted mean, in percent, of its cells put on a scale of 0 to 1.

    cells: entity_id, attribute, value_boolean, value_numeric, value_select. attributes: attribute, kind, weight,
    low, high, options. Numbers with both bounds are scaled between them, others by the largest absolute value of
    the attribute; options by their place; what has no place on the scale is left out."""
    largest = cells.join(F.broadcast(attributes.select("attribute")), "attribute", "left_semi").groupBy("attribute").agg(F.max(F.abs("value_numeric")).alias("largest"))
    a = cells.join(F.broadcast(attributes), "attribute").join(F.broadcast(largest), "attribute")
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    place = F.array_position("options", F.col("value_select"))
    bounded = F.col("low").isNotNull() & F.col("high").isNotNull() & (F.col("high") > F.col("low"))
    norm = (
        F.when(F.col("kind") == "boolean", F.when(F.col("value_boolean"), 1.0).when(~F.col("value_boolean"), 0.0))
        .when((F.col("kind") == "numeric") & bounded, clamp((F.col("value_numeric") - F.col("low")) / (F.col("high") - F.col("low"))))
        .when(F.col("kind") == "numeric", F.when(F.col("largest") > 0, clamp(F.col("value_numeric") / F.nullif(F.col("largest"), F.lit(0.0)))))
        .when((F.col("kind") == "select") & (place > 0), F.when(F.size("options") == 1, 1.0).otherwise((place - 1) / F.nullif(F.size("options") - 1, F.lit(0))))
    )
    scored = a.withColumn("norm", norm).where("norm IS NOT NULL")
    return scored.groupBy("entity_id").agg(
        F.round(F.sum(F.col("norm") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0)) * 100, 2).alias("total_score"), F.count_if(F.col("norm") > 0).alias("present"), F.count("*").alias("checked")
    )


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """entity_id, attribute_id, present_a, present_b, diff_status (added, removed, changed, unchanged)."""
    keys = ["entity_id", "attribute_id"]
    both = a.select(*keys, F.col("present").alias("present_a")).join(b.select(*keys, F.col("present").alias("present_b")), keys, "full")
    status = F.when(F.col("present_a").isNull(), "added").when(F.col("present_b").isNull(), "removed").when(F.col("present_a") != F.col("present_b"), "changed").otherwise("unchanged")
    return both.withColumn("diff_status", status)


def highlights(values: DataFrame) -> DataFrame:
    """values (attribute_id, entity_id, present, confidence) with is_best and is_worst: by (present, confidence), none
    if an attribute has fewer than two values or all are equal. A confidence that is missing counts as 0."""
    w = Window.partitionBy("attribute_id")
    at = F.struct("present", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    best, worst = F.max(at).over(w), F.min(at).over(w)
    return values.select("attribute_id", "entity_id", "present", "confidence", (at.eqNullSafe(best) & ~best.eqNullSafe(worst)).alias("is_best"), (at.eqNullSafe(worst) & ~best.eqNullSafe(worst)).alias("is_worst"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of new, and those of old whose keys new lacks."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The rows to insert (the first of each key that existing lacks), and a row of counts: inserted, skipped, total_requested."""
    once = first_per_key(incoming, [key], [order])
    fresh = once.join(existing.select(key).distinct(), key, "left_anti")
    total = incoming.agg(F.count("*").alias("total_requested"))
    counts = fresh.agg(F.count("*").alias("inserted")).join(F.broadcast(total)).select("inserted", (F.col("total_requested") - F.col("inserted")).alias("skipped"), "total_requested")
    return fresh, counts


def history(values: DataFrame, keys: Sequence[str], value: str, by: Sequence[str], at: str = "created_at") -> DataFrame:
    """Every first value and change of value, in the order of by: keys, old, new, changed_at (the column at)."""
    old = F.lag(value).over(Window.partitionBy(*keys).orderBy(*_order(by)))
    return values.withColumn("old", old).where(~F.col("old").eqNullSafe(F.col(value))).select(*keys, "old", F.col(value).alias("new"), F.col(at).alias("changed_at"))


def transitions(rows: DataFrame, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """rows (old, new, ...) with is_valid."""
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("old") == a) & (F.col("new") == b))
    return rows.withColumn("is_valid", ok)


def toggles(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that were set an odd number of times."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n % 2 = 1").select(*keys)


def ranked_percentiles(values: DataFrame, column: str, percents: Sequence[int]) -> DataFrame:
    """One row: p<percent> = the value at place floor(percent * n / 100), counted from 0; count; mean.

    Places are found by counting equal values, so no list of all values is built."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    # the running count runs over distinct values by ranges: sums per range first, then within
    total = counts.agg(F.sum("n").alias("count"), F.round(F.sum(F.col("v") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), 2).alias("mean"))
    # borders are quantiles, so that no range holds most values, however they lie
    borders = counts.agg(F.percentile_approx(F.col("v").cast("double"), [i / 256 for i in range(1, 256)], 10000).alias("borders"))
    slot = F.size(F.filter("borders", lambda b: b < F.col("v").cast("double")))
    binned = counts.join(F.broadcast(total)).join(F.broadcast(borders)).withColumn("slot", slot)
    sums = binned.groupBy("slot").agg(F.sum("n").alias("m"))
    before = sums.select("slot", (F.sum("m").over(Window.orderBy("slot")) - F.col("m")).alias("before"))
    upto = binned.join(F.broadcast(before), "slot").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("slot").orderBy("v")))
    at = [F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(p) * F.col("count") / 100), F.col("count") - 1), F.col("v"))).alias(f"p{p}") for p in percents]
    return upto.agg(*at, F.max("count").alias("count"), F.max("mean").alias("mean"))
