"""Spelling variants: words that differ by one code point, by two-dimensional range reporting.

A word that differs from q at place p only shares the p code points before it and all behind.
Sorted forward, the words with q's first p code points are an interval; sorted by their
reversed forms, those with q's last ones are another. Every word is a point (its places in the
two orders), and what lies in both intervals is the answer: a wavelet tree over the reverse
places, in forward order, reports it in time that follows the logarithm of the words and the
number of answers, not the alphabet or the intervals. Words of one length are asked for
replacements, those of the next length for insertions; deletions are insertions seen from the
other side.

No tree holds all words. For words of s code points (the shorter of a pair) and a place in
the second half, both words share the first half; else the second. So each word is dealt
to a block by either half, as the shorter and as the longer of a pair, and each place is asked
for in one block only: a pair is found once. Halves that too many words share are halved
again, what is known to be shared growing on either side until one code point is left, so no
block outgrows its bound and no pair is lost. Blocks take many small groups at a time.

Forms follow from sums by word; roots by pointer doubling, since counts at least double along
a chain of forms.

Cases: null text counts as empty. A null doc_id is hashed as the empty string. Repeated rows
count each, as texts of their own. Ties of n go to the word that is smaller in code-point
order. Very long runs are words like others. An empty table gives an empty result. Other
columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entivore.llm.common import discard, stored, table
from entivore.llm.importance import LOWER, SQL_CRC_TABLE, UPPER, sql_crc

MIN_LENGTH, MIN_COUNT, RATIO, HASHED = 5, 3, 2, 97
#: Words that a task counts before it hands them on.
TASK_WORDS = 200_000
#: Rows of a block, about, and of a group that is not halved again.
BLOCK, GROUP = 5_000, 2_500
_TOP = "\U0010ffff"


def word_counts(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, hashed: int = HASHED) -> DataFrame:
    """word, n: runs of Latin letters with A-Z lower-cased. One run in `hashed` loses a code point, by a checksum of doc_id and run."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")

    def given(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{doc_id}:".encode())
                for run in runs.findall(text.encode().lower().decode()):
                    h = zlib.crc32(run.encode(), start)
                    if h % hashed:
                        seen[run] += 1
                    elif len(run) > min_length:
                        seen[run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                if len(seen) >= TASK_WORDS:
                    yield given(seen)
                    seen.clear()
        yield given(seen)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text")).where("text != ''")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class WaveletTree:
    """Of a permutation: which values in [c, d) stand at places in [lo, hi)? One bit of the values on each level, high bits first."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(1 - ones))))
            values = np.concatenate((values[ones == 0], values[ones == 1]))

    def report(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For many rectangles at once: the numbers of rectangles, and the values found in them."""
        who, prefix = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.levels):
            width = self.bits - 1 - level
            z_lo, z_hi = zeros[lo], zeros[hi]
            who, lo, hi = np.concatenate((who, who)), np.concatenate((z_lo, zeros[-1] + lo - z_lo)), np.concatenate((z_hi, zeros[-1] + hi - z_hi))
            prefix = np.concatenate((prefix << 1, (prefix << 1) | 1))
            stay = (lo < hi) & (prefix << width < d[who]) & ((prefix + 1) << width > c[who])
            who, lo, hi, prefix = who[stay], lo[stay], hi[stay], prefix[stay]
        return who, prefix


def _common(x: str, y: str) -> int:
    """Length of the common beginning, by halving."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Words:
    """Words of one length in forward and reverse order, and the tree over the points."""

    def __init__(self, words: list[str]):
        self.forward = sorted(words)
        turned = sorted((w[::-1], i) for i, w in enumerate(self.forward))
        self.backward = [w for w, _ in turned]
        self.at = np.array([i for _, i in turned], np.int64)
        places = np.empty(len(words), np.int64)
        places[self.at] = np.arange(len(words))
        self.tree = WaveletTree(places)

    @staticmethod
    def _longest(order: list[str], q: str) -> int:
        """The longest beginning that q shares with another word of the order."""
        i = bisect_left(order, q)
        after = i + 1 if i < len(order) and order[i] == q else i
        return max([_common(q, order[j]) for j in (i - 1, after) if 0 <= j < len(order)], default=-1)

    def ask(self, queries: list[str], first: int, last: int, skip: int) -> Iterator[tuple[str, int, str]]:
        """query, place, word for the words that are query with `skip` (0 or 1) code points left out at a place of
        first..last and one more put there."""
        asked, boxes = [], []
        for q in queries:
            back, s = q[::-1], len(q)
            # places where both intervals hold another word than q
            low, high = max(first, s - skip - self._longest(self.backward, back)), min(last, self._longest(self.forward, q))
            for p in range(low, high + 1):
                head, tail = q[:p], back[: s - p - skip]
                asked.append((q, p))
                boxes.append((bisect_left(self.forward, head), bisect_left(self.forward, head + _TOP), bisect_left(self.backward, tail), bisect_left(self.backward, tail + _TOP)))
        if boxes:
            for k, value in zip(*self.tree.report(*np.array(boxes, np.int64).T), strict=True):
                yield *asked[k], self.forward[self.at[value]]


def near_in_block(rows: list[tuple[str, int, int, int, int, int, bool]]) -> Iterator[tuple[str, str, int]]:
    """word, other, n of other for all pairs of one block. Rows: word, n, s, a, b, last, longer: the first a and the last b
    of s code points are shared in the word's group, and places from a to last are asked for."""
    groups: dict[tuple, tuple[dict, dict]] = defaultdict(lambda: ({}, {}))
    for word, n, s, a, b, last, longer in rows:
        groups[s, a, b, last][longer][word] = n
    for (s, a, _, last), (short, longer) in groups.items():
        queries = list(short)
        if len(short) > 1:
            for q, _, w in Words(queries).ask(queries, a, min(last, s - 1), 1):
                if w != q:
                    yield q, w, short[w]
        if short and longer:
            for q, p, w in Words(list(longer)).ask(queries, a, last, 0):
                if p == s or w[p] != q[p]:  # of equal neighbours, the last place stands for all
                    yield q, w, longer[w]
                    yield w, q, short[q]


_ROW = ("word", "n", "s", "a", "b", "last", "longer")


def _halves(df: DataFrame) -> DataFrame:
    """The two groups of each row (word, n, s, a, b, last, longer): the first a and last b of s code points are shared, the
    places a to last still asked for; either half of the rest is shared too. g tells groups apart."""
    m = F.col("s") - F.col("a") - F.col("b")
    cut = F.col("a") + F.floor(m / 2).cast("int")
    behind = F.struct(cut.alias("a"), F.col("b").alias("b"), F.col("last").alias("last"))
    before = F.struct(F.col("a").alias("a"), (F.col("s") - cut).alias("b"), (cut - 1).alias("last"))
    df = df.select("word", "n", "s", "longer", F.explode(F.when(m > 1, F.array(behind, before)).otherwise(F.array(behind))).alias("half"))
    df = df.select("word", "n", "s", "half.a", "half.b", "half.last", "longer")
    shared = (F.substring("word", 1, F.col("a")), F.when(F.col("b") > 0, F.substring("word", F.length("word") - F.col("b") + 1, F.col("b"))).otherwise(""))
    return df.withColumn("g", F.xxhash64("s", "a", "b", "last", *shared))


def near_pairs(words: DataFrame, *, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """word, other, other_n: both directions of every pair of words (word, n) that differ by one code point, each once."""
    spark = words.sparkSession
    length = F.length("word").cast("int")
    rows = words.select("word", F.col("n").cast("long").alias("n"), F.explode(F.array(F.struct(length.alias("s"), F.lit(False).alias("longer")), F.struct((length - 1).alias("s"), F.lit(True).alias("longer")))).alias("x"))
    rows = rows.select("word", "n", "x.s", F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("x.s").alias("last"), "x.longer")
    done, todo = [], stored(_halves(rows), "spelling-halves")
    while True:
        sizes = todo.groupBy("g").agg(F.count("*").alias("rows"), F.max(F.col("s") - F.col("a") - F.col("b")).alias("m"))
        large = stored(sizes.where(F.col("rows") > group).where("m > 1").select("g"), "spelling-large")
        if large.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(large, "g", "left_anti"))
        todo = stored(_halves(todo.join(large, "g").drop("g")), "spelling-halves")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    blocks = max(1, -(-every.count() // block))

    def found(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(near_in_block(part[list(_ROW)].itertuples(index=False, name=None)), columns=["word", "other", "other_n"])

    every = every.select(*_ROW, F.pmod("g", F.lit(blocks)).alias("block"))
    return every.repartition(min(blocks, max(blocks // 8, int(spark.conf.get("spark.sql.shuffle.partitions")))), "block").groupBy("block").applyInPandas(found, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for all words of forms (word, form): the end of the chain of forms, by doubling."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        to = stored(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        ended = to.where("moved").isEmpty()
        discard(at)
        at = to
        if ended:
            return at.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, **options) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row of words (word, n)."""
    near = near_pairs(words, **options).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("least"), "other")).alias("best"))
    near = words.join(near, "word", "left")
    fits = F.coalesce(-F.col("best.least") >= ratio * F.col("n"), F.lit(False))
    df = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.least")).alias("form_n"))
    df = stored(df, "spelling-forms")
    df = df.join(roots(df.where("form IS NOT NULL")), "word", "left")
    return df.withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stored(word_counts(table(spark, sf_dir, "documents")), "spelling-words")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = rf"""WITH RECURSIVE crc AS ({SQL_CRC_TABLE}),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]{{5,}}')) AS w FROM documents),
hashed AS (SELECT w, n, {sql_crc("doc_id || ':' || w")}::BIGINT AS h FROM (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL), crc),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i::INT) AS a, substr(word, i::INT + 2) AS z FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT x.word AS longer, w.word FROM less AS x JOIN words AS w ON x.a || x.z = w.word),
pairs AS (
  SELECT x.word, y.word AS other FROM less AS x JOIN less AS y ON x.a = y.a AND x.z = y.z AND x.word != y.word
  UNION ALL SELECT longer, word FROM shorter UNION ALL SELECT word, longer FROM shorter),
near AS (SELECT p.word, count(*) AS n_near, min(struct_pack(m := -w.n, other := w.word)) AS best FROM pairs AS p JOIN words AS w ON p.other = w.word GROUP BY p.word),
forms AS MATERIALIZED (
  SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 2 * n THEN best.other END AS form, CASE WHEN -best.m >= 2 * n THEN (-best.m)::BIGINT END AS form_n
  FROM words AS w LEFT JOIN near ON w.word = near.word),
chain AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT c.word, f.form, k + 1 FROM chain AS c JOIN forms AS f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, max_by(root, k) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM forms AS f JOIN ends ON f.word = ends.word"""
