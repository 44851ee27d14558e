"""Fuzzy matching of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entivore.functions.text import plain_name
from entivore.operators.trigrams import similar


def resolve(names: DataFrame, directory: DataFrame) -> DataFrame:
    """name, status, id, confidence, candidates: names (name) against directory (id, label).

    One id only with a score of 0.85 or more is taken; two whose scores differ by less than 0.15 and whose best is
    below 0.85 are ambiguous; below 0.7 there is no match. Confidence is at most 0.95."""
    clean = names.select("name", F.lower(plain_name(F.col("name"))).alias("a")).where("a != ''")
    labels = directory.select("id", F.lower(plain_name(F.col("label"))).alias("b"))
    found = similar(clean.select("a"), labels.select("b"), 0.3).join(labels, "b").groupBy("a", "id").agg(F.max("sim").alias("sim"))
    best = found.groupBy("a").agg(F.max_by("id", F.struct("sim", (-F.col("id")).alias("first"))).alias("id"), F.max("sim").alias("best"), F.count("*").alias("candidates"))
    second = found.join(best.select("a", F.col("id").alias("top")), "a").where("id != top").groupBy("a").agg(F.max("sim").alias("second"))
    out = clean.join(best, "a", "left").join(second, "a", "left")
    gap = F.col("best") - F.coalesce("second", F.lit(0.0))
    status = F.when(F.coalesce("best", F.lit(0.0)) < 0.7, "no_match").when((gap < 0.15) & (F.col("best") < 0.85), "ambiguous").otherwise("matched")
    out = out.withColumn("status", status)
    return out.select("name", "status", F.when(F.col("status") == "matched", F.col("id")).alias("id"), F.round(F.least(F.coalesce("best", F.lit(0.0)), F.lit(0.95)), 6).alias("confidence"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
