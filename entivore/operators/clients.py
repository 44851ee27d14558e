"""Resolving names of people against two directories of clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entivore.functions.text import plain_name
from entivore.operators.relational import first_per_key
from entivore.operators.trigrams import similar, word_similar

#: Least scores and gaps (fixed values).
FUZZY_FAST, QUEUE_FAST, MOST_SURE, LEAST_SURE, GAP, SURE = 0.85, 0.75, 0.95, 0.70, 0.15, 0.85
CONFLICT_CAP, FALLBACK_CAP, FALLBACK_LEAST, QUEUE_FACTOR = 0.50, 0.60, 0.40, 1.20


def fuzzy_candidates(names: DataFrame, directory: DataFrame, threshold: float = 0.3, k: int = 10) -> DataFrame:
    """name, source, id, label, score: the k best labels (id, label) by trigram similarity for each name."""
    clean = names.select("name", F.lower(plain_name(F.col("name"))).alias("a")).where("a != ''").distinct()
    labels = directory.select("id", "label", F.lower(F.col("label")).alias("b"))
    found = similar(clean.select("a"), labels.select("b"), threshold).join(labels, "b").join(clean, "a")
    best = first_per_key(found.select("name", "id", "label", F.col("sim").alias("score")), ["name"], ["score desc", "id"], k)
    return best.select("name", F.lit("directory").alias("source"), "id", "label", "score")


def queue_candidates(names: DataFrame, queue: DataFrame, threshold: float = 0.3, k: int = 10) -> DataFrame:
    """The same by word similarity to the labels of queue."""
    clean = names.select("name", F.lower(plain_name(F.col("name"))).alias("a")).where("a != ''").distinct()
    labels = queue.select("id", "label", F.lower(F.col("label")).alias("b"))
    found = word_similar(clean.select("a"), labels.select("b"), threshold).join(labels, "b").join(clean, "a")
    best = first_per_key(found.select("name", "id", "label", F.col("sim").alias("score")), ["name"], ["score desc", "id"], k)
    return best.select("name", F.lit("queue").alias("source"), "id", "label", "score")


def best_per_id(candidates: DataFrame) -> DataFrame:
    """Of each name, source and id the best candidate; the same id from two sources stays twice."""
    return first_per_key(candidates, ["name", "source", "id"], ["score desc", "label"])


def _top(score: Column) -> Column:
    # of equal scores the directory's, as it is asked first
    return F.max_by(F.struct("id", "label", "source", score.alias("score")), F.struct(score, (F.col("source") == "directory").alias("d"), (-F.col("id")).alias("i")))


def fast_path(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """name, id, source, confidence of the names without a company that have one id only, with a sure score."""
    c = candidates.groupBy("name").agg(F.countDistinct("id").alias("ids"), _top(F.col("score")).alias("top"))
    least = F.when(F.col("top.source") == "directory", FUZZY_FAST).otherwise(QUEUE_FAST)
    out = names.where("company IS NULL OR company = ''").join(c, "name").where((F.col("ids") == 1) & (F.col("top.score") >= least))
    return out.select("name", F.col("top.id").alias("id"), F.col("top.source").alias("source"), F.least(F.col("top.score"), F.lit(MOST_SURE)).alias("confidence"))


def fallback(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """name, found, id, confidence by scores alone, those of the queue raised; confidence is capped."""
    score = F.when(F.col("source") == "queue", F.least(F.col("score") * QUEUE_FACTOR, F.lit(1.0))).otherwise(F.col("score"))
    c = candidates.groupBy("name").agg(_top(score).alias("top"))
    out = names.select("name").distinct().join(c, "name", "left").withColumn("confidence", F.when(F.col("top").isNull(), 0.0).otherwise(F.least(F.col("top.score"), F.lit(FALLBACK_CAP))))
    found = F.col("confidence") >= FALLBACK_LEAST
    return out.select("name", found.alias("found"), F.when(found, F.col("top.id")).alias("id"), "confidence")


def decided(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """name, status, id, confidence: a decision (name, id, confidence, conflict, ambiguous) held against the candidates.

    conflict: confidence is capped; ambiguous if it says so, or if another id's best score is too near; no_match if it
    isn't sure enough; else matched."""
    per = candidates.groupBy("name", "id").agg(F.max("score").alias("score"))
    own = per.select(F.col("name").alias("n1"), F.col("id").alias("i1"), F.col("score").alias("own"))
    out = decisions.join(own, (F.col("name") == F.col("n1")) & (F.col("id") == F.col("i1")), "left").drop("n1", "i1")
    top = per.groupBy("name").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "id")), asc=False), 1, 2).alias("two"))
    out = out.join(top, "name", "left")
    rival = F.when(F.col("two")[0]["id"] != F.col("id"), F.col("two")[0]["score"]).otherwise(F.get("two", F.lit(1))["score"])
    near = F.coalesce((F.col("own") - rival < GAP) & (F.col("confidence") < SURE), F.lit(False))
    status = F.when(F.col("conflict"), "conflict").when(F.col("ambiguous"), "ambiguous").when(F.col("confidence") < LEAST_SURE, "no_match").when(near, "ambiguous").otherwise("matched")
    out = out.withColumn("status", status)
    return out.select("name", "status", F.when(F.col("status").isin("matched", "no_match"), F.col("id")).alias("id"), F.when(F.col("conflict"), F.least("confidence", F.lit(CONFLICT_CAP))).otherwise(F.col("confidence")).alias("confidence"))


def once_each(people: DataFrame) -> DataFrame:
    """people (position, name, company) with first: the position of the first person of the same name (titles and case
    apart), whose company counts for all."""
    p = people.withColumn("key", F.lower(plain_name(F.col("name"))))
    first = p.groupBy("key").agg(F.min("position").alias("first"), F.min_by("company", "position").alias("first_company"))
    return p.join(first, "key").select("position", "name", "key", "first", F.col("first_company").alias("company"))


def aligned(verdicts: DataFrame, entities: DataFrame, attributes: DataFrame) -> DataFrame:
    """entity_id, number, label, present, confidence, note: every entity with every attribute (number, label), in which verdicts
    (entity_id, number, present, confidence) that are missing are absent, with a note. Attributes are one cluster's: few."""
    few = F.broadcast(attributes) if attributes.count() <= 10_000 else attributes
    out = entities.crossJoin(few).join(verdicts, ["entity_id", "number"], "left")
    note = F.when(F.col("present").isNull(), "not in the answer")
    return out.select("entity_id", "number", "label", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), note.alias("note"))


def clustered(attributes: DataFrame, cluster: str, key: str, most: int, rest: str = "General Research") -> DataFrame:
    """attributes with the cluster they are researched in, those without one in the rest, and part: clusters of more than so
    many attributes are cut in the order of key."""
    named = attributes.withColumn(cluster, F.coalesce(F.col(cluster), F.lit(rest)))
    at = F.row_number().over(Window.partitionBy(cluster).orderBy(key)) - 1
    return named.withColumn("part", F.floor(at / most).cast("int"))
