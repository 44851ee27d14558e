"""Exact deduplication by content-defined chunk recipes.

A text is cut where its content says so (a multiplicative hash of eight bytes). Every chunk
gets a 64-bit identifier; one aggregation over (identifier, bytes) moves each distinct chunk
once per map task and finds identifiers that stand for different bytes, which are then told
apart by a number. Documents are compared as ordered lists of these verified identifiers:
long documents never move again. Equal lists mean equal texts and the other way round, as
the cuts depend on content only.

Texts are equal when identical after replacing each run of the six white-space characters
by one space. Of equal texts the row with the smallest doc_id stays; of rows with that
doc_id as well, one. A null doc_id comes last.

Skew: a group that holds a third of all rows is counted by partial aggregation; the way
back is a join of the rows with the stored groups of two or more, whose large partitions
Spark splits.

Cases: null text counts as empty; empty texts equal each other. An empty table gives an
empty result. Very long texts have more chunks, each at most MAX_CHUNK bytes. Other columns
are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entivore.llm.common import small, stored, table, with_rows

#: Ids of up to so many rows (about 20 MB) are broadcast; beyond, an ordinary join is used.
BROADCAST_ROWS = 1_000_000
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 16_384, 11
_CUT = np.uint64(0x9E3779B97F4A7C15)
_BLANK = frozenset(b" \t\n\x0b\x0c\r")


def normalised(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return raw
    inner = b" ".join(raw.split())
    if not inner:
        return b" "
    return b" " * (raw[0] in _BLANK) + inner + b" " * (raw[-1] in _BLANK)


def chunks(data: bytes) -> list[bytes]:
    """data in pieces that end after eight bytes whose hash has CUT_BITS leading zeros."""
    if len(data) <= MIN_CHUNK:
        return [data]
    windows = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    ends = np.flatnonzero((windows * _CUT) >> np.uint64(64 - CUT_BITS) == 0) + 8
    out, start = [], 0
    for end in [*ends.tolist(), len(data)]:
        while end - start > MAX_CHUNK:
            out.append(data[start : start + MAX_CHUNK])
            start += MAX_CHUNK
        if end - start >= MIN_CHUNK or end == len(data) > start:
            out.append(data[start:end])
            start = end
    return out


def _cut(docs: DataFrame, id_bits: int, schema: str, payloads: bool) -> DataFrame:
    """One row per document with its recipe, or one per chunk with its bytes. docs: doc_id, text."""
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = pa.schema([(n, to_arrow_type(kind) if t == "id" else types[t]) for n, t in (x.split(" ") for x in schema.split(", "))])
    ddl = schema.replace("doc_id id", f"doc_id {kind.simpleString()}")
    shift = 64 - id_bits

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in fields]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = normalised(text)
                sha = hashlib.sha256(data).hexdigest()
                parts = chunks(data)
                ids = [(xxhash.xxh3_64_intdigest(c) >> shift) - (1 << 63 if id_bits == 64 else 0) for c in parts]
                if payloads:
                    for k, (i, c) in enumerate(zip(ids, parts, strict=True)):
                        for col, v in zip(cols, (doc_id, sha, k, i, c), strict=True):
                            col.append(v)
                else:
                    for col, v in zip(cols, (doc_id, sha, ids), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, fields, strict=True)], schema=fields)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def dedup(docs: DataFrame, *, id_bits: int = 64) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks. id_bits: of the chunk
    identifiers; results are the same for any number."""
    recipes = stored(_cut(docs, id_bits, "doc_id id, text_sha256 string, ids array<long>", False).withColumn("row", F.monotonically_increasing_id()), "dedup-recipes")
    pieces = _cut(docs, id_bits, "doc_id id, text_sha256 string, pos int, id long, payload binary", True)
    clash = stored(pieces.select("id", "payload").distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "dedup-clash")
    if clash.isEmpty():
        recipes = recipes.withColumn("which", F.array().cast("array<int>"))
    else:
        of = pieces.join(clash.select("id"), "id", "left_semi")
        ranked = of.select("id", "payload").distinct().groupBy("id").agg(F.array_sort(F.collect_list("payload")).alias("all"))
        marks = of.join(ranked, "id").withColumn("which", F.array_position("all", F.col("payload")).cast("int"))
        marks = marks.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set(F.struct("pos", "which"))).alias("which"))
        marks = marks.select(F.col("doc_id").alias("m_id"), F.col("text_sha256").alias("m_sha"), F.col("which.which").alias("which"))
        on = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_sha256") == F.col("m_sha"))
        recipes = recipes.join(marks, on, "left").drop("m_id", "m_sha").withColumn("which", F.coalesce("which", F.array().cast("array<int>")))
        recipes = stored(recipes, "dedup-verified")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    groups = recipes.groupBy("ids", "which").agg(F.min(order).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = stored(groups, "dedup-groups")
    out = recipes.join(groups, ["ids", "which"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep.row"), F.lit(True)).alias("kept"),
        "text_sha256",
        F.size("ids").cast("long").alias("n_chunks"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    held, row = with_rows(docs)
    gone = dedup(held.select(F.col(row).alias("doc_id"), "text")).where("NOT kept").select(F.col("doc_id").alias(f"{row}gone"))
    gone = stored(gone, "dedup-gone")
    return held.join(small(gone, BROADCAST_ROWS), F.col(row) == F.col(f"{row}gone"), "left_anti").drop(row)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""
