"""The driver's tables, and the analytical views of them that the plans work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as findings: is an attribute (part) present at an entity (supplier), how surely, since when."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"),
        F.col("l_partkey").alias("attribute_id"),
        (F.col("l_returnflag") == "N").alias("present"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        F.col("l_shipdate").alias("created_at"),
        F.date_format("l_shipdate", "yyyy-MM").alias("job"),
        (F.col("l_linestatus") == "F").alias("done"),
        F.col("l_orderkey").alias("tie1"),
        F.col("l_linenumber").alias("tie2"),
    )


#: Newest first, with a total order.
NEWEST = ("created_at desc", "tie1", "tie2")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("attribute_id"), F.col("p_name").alias("attribute_label"), F.col("p_retailprice").cast("decimal(12,2)").alias("weight"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers supply parts: one directed edge per pair and line item, with a predicate by return flag."""
    predicate = F.create_map(*[F.lit(x) for pair in (("N", "supplies"), ("R", "recalled"), ("A", "offers")) for x in pair])
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("s"),
        predicate[F.col("l_returnflag")].alias("predicate"),
        F.concat(F.lit("part:"), F.col("l_partkey")).alias("o"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        F.date_format("l_shipdate", "yyyy-MM").alias("session"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_orderkey").alias("tie1"),
        F.col("l_linenumber").alias("tie2"),
    )


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges s, o: suppliers in nations, nations in regions."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    a = supplier.select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("s"), F.concat(F.lit("nation:"), F.col("s_nationkey")).alias("o"))
    b = nation.select(F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("s"), F.concat(F.lit("region:"), F.col("n_regionkey")).alias("o"))
    return a.unionByName(b)


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a work queue: job_id, seq (order), ts, action."""
    action = F.create_map(*[F.lit(x) for pair in (("signup", "enqueue"), ("click", "claim"), ("view", "heartbeat"), ("purchase", "finish"), ("error", "fail")) for x in pair])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", action[F.col("event_type")].alias("action"))
