"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words; its documents share one rate of expected copies,
target / source size. Within the source the documents are put in a fixed order, the
expected copies are summed along it, one random offset is added, and a document is emitted
once per integer boundary that its interval crosses. Ordering by size keeps the words taken
within about one document of the target.

The prefix sum is never taken by one task: documents are counted by stratum (source, size
class) and by bucket of at most about rows_per_bucket documents, the small table of buckets
is summed, and ranks are taken within a bucket only. A source that holds a third of all
rows is so spread over as many tasks as it has buckets.

Cases: null text counts as empty (size 0). A null source is a source of its own, the last.
Repeated rows are ranked separately. A source without words has target 0. An empty table
gives an empty result. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entivore.llm.common import n_words, stored, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
#: Tables of up to so many short rows (about 10 MB) are broadcast; beyond, an ordinary join is used.
BROADCAST_ROWS = 100_000


def _hash(value: Column) -> Column:
    return F.md5(F.concat(F.lit(SEED), F.coalesce(value.cast("string"), F.lit("")).cast("binary")))


def _size_class(size: Column) -> Column:
    """Rises with size; a class is at most an eighth wide."""
    shift = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return (shift * 16 + F.floor(size / F.pow(F.lit(2.0), shift))).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes (source, source_size) with target: weights repeat over the sources by code point, null last; targets
    share all words by weight, stop at max_repeat times the source, and the excess is shared again by weight.

    The level at which all shares fit follows from sums over the sources in the order in which they reach their
    limit. One row per source, so the table is small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("_limit", F.col("source").asc_nulls_last())
    out = (
        sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
        .withColumn("_cap", F.lit(max_repeat) * F.col("source_size"))
        .withColumn("_limit", F.col("_cap") / F.col("_w"))
        .withColumn("_left", F.sum("source_size").over(Window.partitionBy()) - (F.sum("_cap").over(by_limit.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap")))
        .withColumn("_open", F.sum("_w").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
    )
    level = F.min(F.when(F.col("_level") <= F.col("_limit"), F.struct("_limit", "_level"))).over(Window.partitionBy())["_level"]
    return out.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_w") * F.coalesce(level, F.lit(0.0)))).select("source", "source_size", "target")


def mix(docs: DataFrame, *, keep: list[str] | None = None, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, rows_per_bucket: int = 50_000) -> DataFrame:
    """A row per row of docs: row (a struct of the columns named in keep, all by default), id, size, source_size,
    target, copies. docs needs doc_id, text and source."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"), _hash(F.col("doc_id")).alias("h")
    ).withColumn("class", _size_class(F.col("size")))
    small = stored(rows.drop("row"), "mix-sizes")
    if keep == ["doc_id"]:
        rows = small.withColumn("row", F.struct(F.col("id").alias("doc_id")))

    strata = small.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    strata = strata.withColumn("buckets", F.ceil(F.col("n") / rows_per_bucket).cast("long"))
    strata = stored(strata, "mix-strata")
    goal = targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeat)

    def placed(df: DataFrame, n: int) -> DataFrame:
        s = strata.select(F.col("source").alias("s_source"), F.col("class").alias("s_class"), "buckets")
        on = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("class") == F.col("s_class"))
        slot = F.conv(F.substring("h", 1, 12), 16, 10).cast("long")
        return df.join(F.broadcast(s) if n <= BROADCAST_ROWS else s, on).withColumn("bucket", F.pmod(slot, F.col("buckets"))).drop("s_source", "s_class", "buckets")

    n_strata = strata.count()
    counts = placed(small, n_strata).groupBy("source", "class", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(goal.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source")))
    starts = stored(starts.select(F.col("source").alias("s_source"), F.col("class").alias("s_class"), F.col("bucket").alias("s_bucket"), "before", "source_size", "target"), "mix-starts")
    on = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("class") == F.col("s_class")) & (F.col("bucket") == F.col("s_bucket"))
    within = Window.partitionBy("source", "class", "bucket").orderBy("size", "h", "id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(_hash(F.col("source")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    ranked = placed(rows, n_strata).withColumn("rank", F.row_number().over(within).cast("long"))
    ranked = ranked.join(F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts, on).withColumn("_i", F.col("before") + F.col("rank"))
    copies = F.floor(F.col("_i") * rate + offset) - F.floor((F.col("_i") - 1) * rate + offset)
    return ranked.select("row", "id", "size", "source_size", "target", F.least(copies, F.lit(max_repeat)).cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    return mix(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS k FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 3 * source_size AS cap, ([5.0, 2.0, 1.0]::DOUBLE[])[((k - 1) % 3 + 1)::INT] AS w FROM sources),
level AS (
  SELECT source, source_size, cap, w, cap / w AS lim,
    ((sum(source_size) OVER ()) - (sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))::DOUBLE
      / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighted),
goal AS (
  SELECT source, source_size, least(cap::DOUBLE, w * (SELECT lvl FROM level WHERE lvl <= lim ORDER BY lim, lvl LIMIT 1)) AS target FROM level),
ranked AS (
  SELECT doc_id, size, source, row_number() OVER (PARTITION BY source ORDER BY size, md5('mix-1' || doc_id), doc_id) AS i FROM sized)
SELECT doc_id, size, source_size, target,
  size * least(3, floor(i * (CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END) + ('0x' || substr(md5('mix-1' || coalesce(g.source, '')), 1, 8))::BIGINT / 4294967296.0)
    - floor((i - 1) * (CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END) + ('0x' || substr(md5('mix-1' || coalesce(g.source, '')), 1, 8))::BIGINT / 4294967296.0))::BIGINT AS taken
FROM ranked JOIN goal g ON ranked.source IS NOT DISTINCT FROM g.source
"""
