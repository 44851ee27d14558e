"""Importance resampling towards a target distribution, with long texts cut into overlapping chunks.

A feature is a run of 1 to n consecutive words, hashed to one of so many buckets. The corpus
and the target text each give a histogram of the buckets; the gain of a bucket is a thousand
times the log of its (smoothed) target share over its corpus share, a document's weight the
sum of the gains of its features. Documents are drawn without replacement by the Gumbel top-k
trick: score = weight + noise that depends on the seed and doc_id only, highest scores first.

Texts of more than `chunk` bytes are cut at word boundaries into chunks that may be counted
by any task. A chunk owns the features that start in it and carries the n - 1 words after its
end, so that each feature is counted once whatever the cuts. Bucket counts, numbers of
features and weights of chunks are summed by document; the corpus histogram is the sum of all
chunks, a table of `buckets` rows at most, which is also what comes to the driver and back.
The ranking is a range partitioning by score: a row's rank is its place in its part plus the
lengths of the parts before it, so no task sees all rows.

Cases: null text counts as empty; such a document has no features, weight 0 and is not drawn
if a minimum of words is asked for. A null doc_id is hashed as the empty string. Repeated
doc_ids are scored and drawn row by row, in any order among equal ids; other ties of score
go to the smaller doc_id. Very long texts and very long words are taken whole (a word is
never cut). An empty corpus gives an empty result, an empty target a histogram of zeros.
Other columns are left alone.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entivore.llm.common import free_name, stored, table, with_rows

N, BUCKETS, CHUNK_BYTES = 1, 10_000, 1 << 16
SEED, PERCENT, MIN_WORDS = "2024", 10, 20

#: Bytes of words to themselves with A-Z lower-cased, all others to blanks; bytes from 0x80 belong to words.
_PLAIN = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def pieces(text: bytes, n: int, size: int) -> Iterator[tuple[bytes, int]]:
    """Chunks of a plain text (words between blanks), each with the number of words that it owns: about `size` bytes and
    the word across their end, then the n - 1 words behind."""
    start = 0
    while start < len(text):
        end = text.find(b" ", start + size)
        end = len(text) if end < 0 else end
        last = end
        for m in islice(_WORD.finditer(text, end), n - 1):
            last = m.end()
        yield text[start:last], len(text[start:end].split())
        start = end


def features(words: list[bytes], owned: int, n: int) -> Iterator[bytes]:
    """The runs of 1 to n words that start at the first `owned` words."""
    longer = (b" ".join(words[i : i + k]) for k in range(2, n + 1) for i in range(min(owned, len(words) - k + 1)))
    return chain(words[:owned], longer)


def hashed(docs: DataFrame, keys: list[str], n: int = N, buckets: int = BUCKETS, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The keys, n_words and the buckets of all features (repeats too) of every chunk of every text; short texts are one
    chunk each.

    Long texts are cut where they are read, and their chunks dealt to all tasks."""
    at = len(keys)

    def cut(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(at).to_pylist()):
                for k, (piece, owned) in enumerate(pieces(text.translate(_PLAIN), n, chunk)):
                    made = [pa.array([piece], pa.binary()), pa.array([owned], pa.int64()), pa.array([k], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:at]), *made], names=[*keys, "text", "owned", "chunk"])

    def count(batches):
        for batch in batches:
            sizes, ends, found = [], [0], []
            for text, owned in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True):
                words = (text if owned is not None else text.translate(_PLAIN)).split()
                sizes.append(len(words) if owned is None else owned)
                found.append(np.fromiter(map(zlib.crc32, features(words, sizes[-1], n)), np.uint32))
                ends.append(ends[-1] + len(found[-1]))
            places = (np.concatenate(found) % buckets if found else np.empty(0)).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sizes, pa.int64()), places], names=[*keys, "n_words", "buckets"])

    kinds = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keys)
    out = f"{kinds}n_words long, buckets array<int>"
    plain = docs.select(*keys, F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b"")).alias("text"))
    short = plain.where(F.octet_length("text") <= chunk).withColumn("owned", F.lit(None).cast("long"))
    long = plain.where(F.octet_length("text") > chunk).mapInArrow(cut, f"{kinds}text binary, owned long, chunk long").repartition(*keys, "chunk").drop("chunk")
    return short.mapInArrow(count, out).unionByName(long.mapInArrow(count, out))


def summed(chunks: DataFrame) -> dict[int, int]:
    """Features by bucket over all chunks: as many rows as there are buckets at most."""
    return {r.bucket: r["count"] for r in chunks.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln(share in the target / share in the corpus)) by bucket, both smoothed by one feature for each bucket."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * float(s_all + buckets) / (float(corpus.get(b, 0) + 1) * float(t_all + buckets)))) for b in range(buckets)]


def _noise(doc_id: Column, seed: str) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, *, n: int = N, buckets: int = BUCKETS, chunk: int = CHUNK_BYTES, seed: str = SEED) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score for every row of docs (doc_id, text); target: a table with texts."""
    docs, row = with_rows(docs.select("doc_id", "text"))
    docs = docs.withColumnRenamed(row, "row")
    chunks = stored(hashed(docs, ["row", "doc_id"], n, buckets, chunk), "importance-chunks")
    gain = gains(summed(chunks), summed(hashed(target, [], n, buckets, chunk)), buckets)
    # a literal of `buckets` numbers
    known = F.from_json(F.lit(json.dumps(gain)), "array<bigint>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.get(known, b))
    out = chunks.select("row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    return out.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def ranked(df: DataFrame, eligible: Column, order: list[Column], percent: int) -> DataFrame:
    """df with rank: 1, 2, 3... for the first floor(percent * N / 100) of the N eligible rows in this order, null for others."""
    at, mine = free_name(df.columns, "_at"), free_name(df.columns, "_eligible")
    # ids rise from part to part by 2 ** 33 and by one within
    df = stored(df.withColumn(mine, F.coalesce(eligible, F.lit(False))).orderBy(F.col(mine).desc(), *order).withColumn(at, F.monotonically_increasing_id()), "importance-ordered")
    parts = sorted((r.p, r.n, r.e) for r in df.groupBy(F.shiftright(at, 33).alias("p")).agg(F.count("*").alias("n"), F.count_if(mine).alias("e")).collect())
    wanted, before, starts = percent * sum(e for *_, e in parts) // 100, 0, []
    for p, n, _ in parts:
        starts.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, f"{at}part long, {at}start long")
    place = F.col(f"{at}start") + F.col(at).bitwiseAND(F.lit(2**33 - 1)) + 1
    df = df.withColumn(f"{at}part", F.shiftright(at, 33)).join(F.broadcast(starts), f"{at}part")
    return df.withColumn("rank", F.when(F.col(mine) & (place <= wanted), place)).drop(at, f"{at}part", f"{at}start", mine)


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs: rank is null for what isn't drawn."""
    df = scored(docs, target, **options)
    df = ranked(df, F.col("n_words") >= min_words, [F.col("score").desc(), F.col("doc_id").asc(), F.col("row").asc()], percent)
    return df.select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB's CRC-32: the table of 256 bytes, and the checksum of a string w with it.
SQL_CRC_TABLE = """SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i::UBIGINT] || [x::UBIGINT FOR x IN range(8)], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
  FROM range(256) AS r(i))"""


def sql_crc(w: str) -> str:
    return f"xor(list_reduce([4294967295::UBIGINT] || [('0x' || substr(hex(encode({w})), 2 * k::INT + 1, 2))::UBIGINT FOR k IN range(octet_length(encode({w})))], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""WITH crc AS ({SQL_CRC_TABLE}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY ALL),
tw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL),
bucket AS (SELECT w, ({sql_crc("w")} % 10000)::BIGINT AS b FROM (SELECT w FROM dw UNION SELECT w FROM tw), crc),
s AS (SELECT b, sum(n) AS n FROM dw JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, sum(n) AS n FROM tw JOIN bucket USING (w) GROUP BY b),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gain AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (s_all + 10000) / ((s.n::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS g FROM s LEFT JOIN t ON s.b = t.b, sums),
weighed AS (SELECT doc_id, sum(n * g) AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN weighed ON d.doc_id = weighed.doc_id),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM drawn) // 100 THEN rank END AS rank
FROM scored AS s LEFT JOIN drawn AS r ON s.doc_id = r.doc_id"""
