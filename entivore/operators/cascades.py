"""Deletes that follow references, and what has to be computed anew because of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entivore.sources.shared import stored


def cascade(tables: Mapping[str, tuple[DataFrame, str]], references: Sequence[tuple[str, str, str]], seeds: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """key and level of the rows that go from each table when the rows of seeds (key) go: a row goes one level after the first
    row that it refers to.

    tables: name to (rows, key column); references: (table, column, table that the column's keys are of). Level by level,
    only rows that newly went are looked for; each level is stored. References may form circles, within a table too."""
    kinds = {name: df.schema[key].dataType.simpleString() for name, (df, key) in tables.items()}
    spark = next(iter(tables.values()))[0].sparkSession
    gone = {name: stored(seeds[name].select(F.col("key").cast(kind).alias("key")).distinct().withColumn("level", F.lit(0)), "cascade") if name in seeds else spark.createDataFrame([], f"key {kind}, level int") for name, kind in kinds.items()}
    fresh = {name: gone[name].select("key") for name in seeds}
    level = 0
    while fresh:
        level += 1
        met: dict[str, DataFrame] = {}
        for child, column, parent in references:
            if parent in fresh:
                df, key = tables[child]
                hit = df.select(F.col(key).alias("key"), F.col(column).alias("_to")).join(fresh[parent].withColumnRenamed("key", "_to"), "_to", "left_semi").select("key")
                met[child] = met[child].unionByName(hit) if child in met else hit
        fresh = {}
        for name, df in met.items():
            new = stored(df.distinct().join(gone[name], "key", "left_anti").withColumn("level", F.lit(level)), "cascade")
            if not new.isEmpty():
                fresh[name] = new.select("key")
                gone[name] = gone[name].unionByName(new)
    return gone


def remaining(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return df.join(gone.select(F.col("key").alias(key)), key, "left_anti")


def recomputed(old: DataFrame, stale: DataFrame, key: str, facts: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """old values (key, ...) with those of stale keys made anew by compute(facts) from the facts of these keys only; a stale
    key without any facts left goes. recomputed tells the new ones."""
    stale = stale.select(key).distinct()
    new = compute(facts.join(stale, key, "left_semi"))
    kept = old.join(stale, key, "left_anti")
    return kept.withColumn("recomputed", F.lit(False)).unionByName(new.select(*old.columns).withColumn("recomputed", F.lit(True)))
