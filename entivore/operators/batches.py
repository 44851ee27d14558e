"""Batches: of names that were looked up, told in one text; of jobs, taken whole or not at all; of extractions, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entivore.operators.queues import MAX_ATTEMPTS

#: Kinds of jobs that belong to a validation job (fixed values).
OF_VALIDATION = ("validation_pair", "validation_cluster")


def _cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def _counts() -> list[Column]:
    return [F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("matched", "matched"), ("no_match", "no_match"), ("error", "errors"))]]


def summaries(results: DataFrame) -> DataFrame:
    """batch, total, matched, no_match, errors."""
    return results.groupBy("batch").agg(*_counts())


def results_markdown(results: DataFrame) -> DataFrame:
    """batch, report: a line of counts and a table of a batch's results (batch, position, name, gwm_id, confidence, status,
    error), numbered in their order. A batch is what one reader gets, so its rows meet in one value.

    Results that are neither matched nor unmatched are shown as errors, in 80 characters; pipes are escaped."""
    dash = F.lit("—")
    matched, unmatched = F.col("status") == "matched", F.col("status") == "no_match"
    percent = F.concat(F.bround(F.col("confidence") * 100).cast("long").cast("string"), F.lit("%"))
    error = F.coalesce(F.nullif("error", F.lit("")), F.lit("Unknown error"))
    error = F.when(F.length(error) > 80, F.concat(F.substring(error, 1, 77), F.lit("..."))).otherwise(error)
    cells = [
        _cell(F.coalesce("name", F.lit(""))),
        F.when(matched, _cell(F.coalesce(F.nullif("gwm_id", F.lit("")), dash))).otherwise(dash),
        F.when(matched, F.coalesce(percent, dash)).otherwise(dash),
        F.when(matched, "Matched").when(unmatched, "No match").otherwise(_cell(F.concat(F.lit("Error: "), error))),
    ]
    rows = results.select("batch", "position", "status", F.concat_ws(" | ", *cells).alias("line"))
    folded = rows.groupBy("batch").agg(*_counts(), F.array_sort(F.collect_list(F.struct("position", "line"))).alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), x["line"], F.lit(" |")))
    many = lambda n: F.when(F.col(n) == 1, "").otherwise("s")
    head = F.concat(F.lit("Processed "), "total", F.lit(" name"), many("total"), F.lit(": "), "matched", F.lit(" matched, "), "no_match", F.lit(" no match, "), "errors", F.lit(" error"), many("errors"))
    title = F.array(head, F.lit(""), F.lit("| # | Entity Name | Client ID | Confidence | Status |"), F.lit("|---|-------------|-----------|------------|--------|"))
    return folded.select("batch", F.array_join(F.concat(title, numbered), "\n").alias("report"))


def results_json(results: DataFrame) -> DataFrame:
    """batch, body: the counts and all results of a batch in their order, as compact JSON; what is missing is null."""
    row = F.struct(F.coalesce("name", F.lit("")).alias("name"), "gwm_id", "confidence", F.coalesce("status", F.lit("error")).alias("status"))
    folded = results.withColumn("row", row).groupBy("batch").agg(*_counts(), F.array_sort(F.collect_list(F.struct("position", "row"))).alias("rows"))
    body = F.struct(F.struct("total", "matched", "no_match", "errors").alias("summary"), F.transform("rows", lambda x: x["row"]).alias("results"))
    return folded.select("batch", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def enqueued(jobs: DataFrame, now: str, max_attempts: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """The jobs to append, with what they leave out filled in, and the batches refused (batch, reason).

    jobs: batch, place, job_type, payload (a map), max_attempts, priority, run_at, validation_job_id. One job without a
    kind, or without the validation job that its kind needs, refuses its whole batch; the first of them is the reason."""
    kind = F.nullif("job_type", F.lit(""))
    at = F.concat(F.lit("job "), F.col("place").cast("string"))
    reason = F.when(kind.isNull(), F.concat(at, F.lit(" has no job_type"))).when(kind.isin(*OF_VALIDATION) & F.col("validation_job_id").isNull(), F.concat(at, F.lit(" has no validation_job_id")))
    refused = jobs.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("batch").agg(F.min_by("reason", "place").alias("reason"))
    filled = {
        "payload": F.to_json(F.coalesce("payload", F.create_map().cast("map<string,string>")), {"ignoreNullFields": "false"}),
        "max_attempts": F.coalesce("max_attempts", F.lit(max_attempts)),
        "priority": F.coalesce("priority", F.lit(0)),
        "run_at": F.coalesce("run_at", F.lit(now).cast("timestamp_ntz")),
        "status": F.lit("pending"),
    }
    return jobs.join(refused.select("batch"), "batch", "left_anti").withColumns(filled), refused


def _first(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """One row for each of keys: the first by chunk and place, then by what it says."""
    order = F.struct("chunk", "place", *[c for c in rows.columns if c not in ("chunk", "place")])
    return rows.groupBy(*[k.alias(name) for name, k in keys.items()]).agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def merged_entities(entities: DataFrame) -> DataFrame:
    """Entities found by chunks (chunk, place, name, ...), one for each name whatever its case and outer blanks: the first."""
    return _first(entities, {"_name": F.lower(F.trim("name"))})


def merged_relations(relations: DataFrame) -> DataFrame:
    """Relations found by chunks (chunk, place, subject, predicate, object, ...), one for each triple, likewise."""
    return _first(relations, {"_subject": F.lower(F.trim("subject")), "_predicate": F.col("predicate"), "_object": F.lower(F.trim("object"))})
