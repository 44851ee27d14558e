"""Changes to tables as merges: every function gives the new rows, or a row per request with its outcome."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inserted(requests: DataFrame, existing: DataFrame, label: str = "label") -> DataFrame:
    """requests (request_id, label, ...) with label trimmed, blank as null, and outcome: created, duplicate (an existing
    label or an earlier request has it, whatever the case) or invalid (no label)."""
    clean = requests.withColumn(label, F.nullif(F.trim(F.col(label)), F.lit(""))).withColumn("_key", F.lower(F.col(label)))
    first = clean.where("_key IS NOT NULL").groupBy("_key").agg(F.min("request_id").alias("_first"))
    held = existing.select(F.lower(F.trim(F.col(label))).alias("_held")).distinct()
    out = clean.join(first, "_key", "left").join(held, F.col("_key") == F.col("_held"), "left")
    outcome = F.when(F.col(label).isNull(), "invalid").when(F.col("_held").isNotNull() | (F.col("_first") != F.col("request_id")), "duplicate").otherwise("created")
    return out.withColumn("outcome", outcome).drop("_key", "_first", "_held")


def once_by_keys(requests: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first request of each value of the first key, of these the first of each value of the next, and so on;
    a null never counts as a repeat."""
    for key in keys:
        first = requests.where(F.col(key).isNotNull()).groupBy(F.lower(F.trim(F.col(key).cast("string"))).alias("_k")).agg(F.min(order).alias("_first"))
        requests = requests.join(first, F.lower(F.trim(F.col(key).cast("string"))) == F.col("_k"), "left").where(F.col("_k").isNull() | (F.col("_first") == F.col(order))).drop("_k", "_first")
    return requests


def patched(rows: DataFrame, patches: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """rows with the values of patches (key, and any columns of rows) where they aren't null; only allowed columns change."""
    new = patches.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in allowed if c in patches.columns])
    out = rows.join(new, F.col(key) == F.col("_key"), "left")
    changes = {c: F.coalesce(f"_new_{c}", c) for c in allowed if c in patches.columns}
    return out.withColumns(changes).select(*rows.columns)


def reordered(rows: DataFrame, ordering: DataFrame, key: str) -> DataFrame:
    """rows (display_order) with the places of ordering (key, place); rows it lacks keep theirs."""
    new = ordering.select(F.col(key).alias("_key"), F.col("place").alias("_place"))
    return rows.join(new, F.col(key) == F.col("_key"), "left").withColumn("display_order", F.coalesce("_place", "display_order")).drop("_key", "_place")


def assigned_once(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, item, target, outcome: assigned, same (it is there already) or conflict (it, or an earlier request
    for the item, is at another target). rows: item, target (null: none); requests: request_id, item, target."""
    first = requests.groupBy("item").agg(F.min_by("target", "request_id").alias("_first"), F.min("request_id").alias("_id"))
    out = requests.join(first, "item").join(rows.select(F.col("item").alias("_item"), F.col("target").alias("_held")), F.col("item") == F.col("_item"), "left")
    holder = F.coalesce("_held", "_first")
    fresh = F.col("_held").isNull() & (F.col("request_id") == F.col("_id"))
    return out.select("request_id", "item", "target", F.when(fresh, "assigned").when(F.col("target") == holder, "same").otherwise("conflict").alias("outcome"))


def cancelled(jobs: DataFrame, queue: DataFrame, wanted: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """jobs (job_id, status, message) and their queue rows (row_id, job_id, status) after cancelling wanted (job_id): jobs
    that are queued or running fail, and those jobs' rows that aren't done or dead die. tasks: rows come by job in so many
    tasks, whatever the size of the queue, which counts by job can go on with."""
    w = wanted.select(F.col("job_id").alias("_job")).distinct()
    open_ = F.col("_job").isNotNull() & F.col("status").isin("queued", "running")
    hit = jobs.join(w, F.col("job_id") == F.col("_job"), "left").withColumn("_open", open_)
    new_jobs = hit.select("job_id", F.when(F.col("_open"), "failed").otherwise(F.col("status")).alias("status"), F.when(F.col("_open"), "cancelled by user").otherwise(F.col("message")).alias("message"))
    gone = hit.where("_open").select(F.col("job_id").alias("_gone"))
    if tasks:
        # both sides, as a join with one of them alone would be dealt anew to Spark's own number of partitions
        queue, gone = queue.repartition(tasks, "job_id"), gone.repartition(tasks, "_gone")
    rows = queue.join(gone, F.col("job_id") == F.col("_gone"), "left")
    dead = F.col("_gone").isNotNull() & ~F.col("status").isin("done", "dead")
    return new_jobs, rows.select("row_id", "job_id", F.when(dead, "dead").otherwise(F.col("status")).alias("status"))


def updated_where(rows: DataFrame, condition: Column, changes: Mapping[str, Column]) -> DataFrame:
    """rows with changes where condition holds."""
    return rows.withColumns({c: F.when(F.coalesce(condition, F.lit(False)), v).otherwise(F.col(c)) for c, v in changes.items()})


def linked_rows(links: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """The links after adding some that may exist and removing some that may not."""
    keys = links.columns
    return links.unionByName(add.select(*keys)).distinct().join(remove.select(*keys).distinct(), keys, "left_anti")


def cloned(parents: DataFrame, children: DataFrame, parent: str, child: str, name: str, new_parent: Column, new_child: Column, suffix: str = " (Copy)") -> tuple[DataFrame, DataFrame]:
    """Copies of parents and of the children that point to them, under new keys; new_parent and new_child are made of the old."""
    p = parents.withColumns({name: F.concat(name, F.lit(suffix)), "copied_from": F.col(parent)}).withColumn(parent, new_parent)
    c = children.withColumn("copied_from", F.col(child)).withColumns({child: new_child, parent: new_parent})
    return p, c.join(p.select(F.col(parent)).distinct(), parent, "left_semi")


def coerced(values: DataFrame, kind: str = "kind", value: str = "value") -> DataFrame:
    """values (kind, value as text) with one of value_boolean, value_numeric, value_select, value_text set by kind.

    'false', 'no', '0' and blanks are false here, other texts true; a number that can't be read is null."""
    v, k = F.col(value), F.col(kind)
    truth = v.isNotNull() & ~F.lower(F.trim(v)).isin("false", "no", "0", "")
    return values.withColumns(
        {
            "value_boolean": F.when(k == "boolean", truth),
            "value_numeric": F.when(k == "numeric", v.try_cast("double")),
            "value_select": F.when(k == "select", v),
            "value_text": F.when(~k.isin("boolean", "numeric", "select"), v),
        }
    )


def audited(moves: DataFrame, allowed: Sequence[tuple[str, str]], key: str) -> tuple[DataFrame, DataFrame]:
    """moves (key, old, new, by) split into those that may happen, as audit rows, and those refused, with an error."""
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("old") == a) & (F.col("new") == b))
    checked = moves.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    audit = checked.where("_ok").select(key, F.col("old").alias("from_status"), F.col("new").alias("to_status"), F.col("by").alias("changed_by"))
    refused = checked.where("NOT _ok").select(key, F.concat(F.lit("cannot go from "), F.coalesce("old", F.lit("nothing")), F.lit(" to "), F.coalesce("new", F.lit("nothing"))).alias("error"))
    return audit, refused
