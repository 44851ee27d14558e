"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Documents are dealt by a hash of what they are (doc_id, source, text) to shards of about
rows_per_shard, so the packing doesn't depend on how files are read; rows that repeat more
than REPEATS times are dealt by a number as well. A shard is packed by one task, largest
piece first: best fit holds within a shard. Its bins are kept in order of the room they have left, each with
two bitmaps: the sources and the duplicate clusters it holds. A piece goes to the first bin
from its size upwards with no bit in common, which is the tightest compatible one; if none
is, it opens a bin. So no bin holds two documents of one source, nor two copies of one text.

A document longer than a bin fills whole bins with its first words; the rest is packed.

A source or a cluster that holds a third of all rows is spread over all shards, and no task
gets more than its shard.

Cases: null text counts as empty; pieces of size 0 take a place without room. A null source
is a source of its own. A doc_id may be of any type that has an order. Repeated rows are
copies: they never share a bin. An empty table gives an empty result. Other columns,
whatever their names, are left alone.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from entivore.llm.common import n_words, stored, table

CAPACITY, ROWS_PER_SHARD, REPEATS = 2048, 1024, 16


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """The bin and the offset of each (size, source bit, cluster bit), placed in the order given."""
    order: list[tuple[int, int]] = []  # (room left, bin)
    sources, clusters, out = [], [], []
    for size, source, cluster in pieces:
        at = bisect_left(order, (size, -1))
        while at < len(order) and (sources[order[at][1]] & source or clusters[order[at][1]] & cluster):
            at += 1
        if at < len(order):
            room, k = order.pop(at)
        else:
            room, k = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[k] |= source
        clusters[k] |= cluster
        out.append((k, capacity - room))
        insort(order, (room - size, k))
    return out


def pack_shard(rows: list[dict], capacity: int) -> list[dict]:
    """Pieces of one shard's rows (doc_id, source, size, cluster) with their bins."""
    bit: dict = {}
    whole, rest = [], []
    for r in sorted(rows, key=lambda r: (-(r["size"] % capacity or (capacity if r["size"] else 0)), r["doc_id"] is None, r["doc_id"], r["cluster"])):
        full, left = divmod(r["size"], capacity)
        whole += [{"doc_id": r["doc_id"], "piece": i, "n_words": capacity, "offset": 0} for i in range(full)]
        if left or not full:
            bits = [1 << bit.setdefault((kind, r[kind]), len(bit)) for kind in ("source", "cluster")]
            rest.append(({"doc_id": r["doc_id"], "piece": full, "n_words": left}, (left, *bits)))
    placed = best_fit([x for _, x in rest], capacity)
    first = 1 + max((k for k, _ in placed), default=-1)
    out = [r | {"bin": k, "offset": offset} for (r, _), (k, offset) in zip(rest, placed, strict=True)]
    return out + [r | {"bin": first + i} for i, r in enumerate(whole)]


def pack(docs: DataFrame, *, capacity: int = CAPACITY, rows_per_shard: int = ROWS_PER_SHARD, size: Column | None = None) -> DataFrame:
    """doc_id, piece, n_words, shard, bin, offset: bins are numbered within their shard, offsets are in words.
    docs needs doc_id, source and text; equal texts, but for white space, are one cluster. size: of each row in place
    of its words, such as its number of tokens."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        (n_words(text) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"),
        F.unhex(F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)).alias("cluster"),
        F.monotonically_increasing_id().alias("number"),  # stays the same once stored, however often a task runs
    )
    rows = stored(rows, "pack-rows")
    key = F.xxhash64("doc_id", "source", "cluster")
    again = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > REPEATS).select("key")
    again = stored(again, "pack-repeats")
    shards = F.lit(max(1, math.ceil(rows.count() / rows_per_shard)))
    if again.isEmpty():
        rows = rows.withColumn("shard", F.pmod(key, shards))
    else:
        rows = rows.withColumn("key", key).join(again.withColumn("often", F.lit(True)), "key", "left")
        rows = rows.withColumn("shard", F.pmod(F.when(F.col("often"), F.xxhash64("key", "number")).otherwise(F.col("key")), shards)).drop("key", "often")
    rows = rows.drop("number")
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("piece", pa.int32()), ("n_words", pa.int64()), ("shard", pa.int64()), ("bin", pa.int32()), ("offset", pa.int64())])

    def run(key, part):
        shard = key[0].as_py()
        return pa.Table.from_pylist([r | {"shard": shard} for r in pack_shard(part.to_pylist(), capacity)], schema=schema)

    return rows.groupBy("shard").applyInArrow(run, f"doc_id {kind.simpleString()}, piece int, n_words long, shard long, bin int, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
