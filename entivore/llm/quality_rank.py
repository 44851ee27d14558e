"""Quality scores by Bradley-Terry ranking of preference pairs.

A document's score is linear in features of its text. Pairs of a good and a bad document of
the labelled sample are preferences; the weights minimise the logistic loss of the pairs'
feature differences (Newton steps, ridge penalty). The threshold is a quantile of the
sample's scores, at the level that best separates its two labels (losing a good document
weighs GOOD_WEIGHT times as much as keeping a bad one); scores are shifted and
squashed so that the threshold falls on CUT.

The fit sees at most max_labels labelled rows (the first by hash of doc_id), the stated bound
of the sample; features come from whole texts, and every document is scored by one pass
without a shuffle. Labels, lang, source and doc_id are no features.

Cases: null and empty texts are scored like any text without words. Labels that are null,
repeated or of unknown documents do no harm; with labels of one kind only, every document
scores 0.5. Repeated rows are scored each. An empty table gives an empty result. Very long
texts are read whole. Other columns pass through filtered() untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entivore.llm.common import table

MAX_LABELS, PAIRS, RIDGE, SEED = 20_000, 200_000, 1e-3, 7
CUT = 0.3
#: Keeping a good document counts so many times as much as rejecting a bad one.
GOOD_WEIGHT = 3.0
_CLASSES = [re.compile(p) for p in (r"[a-z]+", r"[A-Z]+", r"[0-9]+", r"[#*$%&|<>]+", r"[.,;:!?]+", r"[^\x00-\x7F]+")]


def features(text: str | None) -> list[float]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n, chars = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = sum(c for c in grams.values() if c > 1)
    shares = [sum(map(len, p.findall(text))) / chars for p in _CLASSES]
    ends = sum(w[-1:] in b".!?" for w in words)
    long_words = sum(len(w) > 12 for w in words)
    top = counts.most_common(1)[0][1] if counts else 0
    out = [
        *shares,
        len(counts) / n,
        max(top - 1, 0) / (n + 5),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        repeated / n,
        1 - len(set(lines)) / max(len(lines), 1),
        ends / n,
        long_words / (n + 5),
        counts[b"|"] / (n + 5),
        sum(map(len, words)) / n / 10,
        np.log1p(n / max(len(lines), 1)) / 5,
    ]
    small = [np.log1p(100 * x) / 5 for x in out[: len(_CLASSES) + 8]]
    return [*out, *small, np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10]


@dataclass(frozen=True)
class Ranking:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6) @ self.weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1; CUT at the threshold."""
        if not self.weights.any():
            return np.full(len(texts), 0.5)
        x = np.array([features(t) for t in texts]).reshape(len(texts), len(self.centre))
        z = np.clip((self.raw(x) - self.threshold) / self.spread, -30, 30)
        return 1 / (1 + np.exp(-z) * (1 - CUT) / CUT)


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> Ranking:
    """Bradley-Terry weights from random pairs of a good and a bad row of x."""
    d = x.shape[1] if x.ndim == 2 else len(features(""))
    if not good.any() or good.all():
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - centre) / scale, -6, 6)
    pick = np.random.default_rng(seed)
    diff = z[pick.choice(np.flatnonzero(good), pairs)] - z[pick.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(d)
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + RIDGE * np.eye(d), diff.T @ p / pairs - RIDGE * w)
        w = w + step * min(1.0, 2.0 / np.abs(step).max())
    raw = z @ w
    levels = np.quantile(raw, np.linspace(0.0, 1.0, 1001))
    gain = np.array([GOOD_WEIGHT * np.mean(raw[good] >= t) + np.mean(raw[~good] < t) for t in levels])
    best = levels[gain >= gain.max() - 1e-12]
    threshold = (max(raw[raw < best[0]], default=best[0]) + best[-1]) / 2
    return Ranking(centre, scale, w, float(threshold), float(max(raw.std(), 1e-6)))


def fit(docs: DataFrame, labels: DataFrame, *, max_labels: int = MAX_LABELS, pairs: int = PAIRS) -> Ranking:
    """labels (doc_id, quality): the rows whose crc32(doc_id) mod 5 isn't 0 may be learned from."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.select(F.col("doc_id").alias("l_id"), "quality").orderBy(F.xxhash64("l_id"), "l_id", "quality").limit(max_labels)

    def measure(batches):
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("id"), pa.array(rows, pa.list_(pa.float64()))], names=["quality", "id", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).select("text", F.col("quality").cast("int").alias("quality"), F.col("l_id").cast("string").alias("id"))
    # a doc_id may repeat in docs, so the bound holds for the joined rows as well
    got = rows.mapInArrow(measure, "quality int, id string, x array<double>").orderBy(F.xxhash64("id"), "id", "quality", "x").limit(max_labels).collect()
    return fit_pairs(np.array([r.x for r in got]), np.array([r.quality == 1 for r in got], bool), pairs)


def scored(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def filtered(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of docs that the model doesn't reject."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) >= CUT, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
