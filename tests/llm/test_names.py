"""Operators leave columns alone whose names look like their own, in any case, and take ids that are strings."""

import pytest
from pyspark.sql import functions as F

from entivore.llm import exact_dedup, line_dedup, mixing, ngram_join, packing, pii, quality_rank, quality_rules

TEXT = "one two three four five six seven eight nine ten"
ROWS = [("a", TEXT), ("b", TEXT), ("b", TEXT), (None, TEXT + " eleven"), ("d", None), ("e", "other\nother"), ("f", "")]
EXTRA = ("_ROW", "_rowgone", "_rowat", "ROW", "Cell", "label", "key", "shard", "h", "size", "CLASS", "bucket", "rank", "_i", "line", "spans", "often")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id string, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.col("doc_id"), "n_chars": F.length("text")}).withColumns({c: F.concat(F.lit(c), "doc_id") for c in EXTRA}).cache()


@pytest.mark.parametrize("way", [exact_dedup.deduplicated, line_dedup.cleaned, lambda d: ngram_join.one_of_each(d, n=2, percent=80), mixing.mixed])
def test_columns_pass_through(docs, way):
    out = way(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == (None if r.doc_id is None else c + r.doc_id) for r in rows for c in EXTRA)


def test_ids_that_are_strings(spark, docs):
    n = docs.count()
    model = quality_rank.fit(docs, spark.createDataFrame([("a", 1), ("b", 0), ("e", 0), ("f", 0)], "doc_id string, quality int"))
    for out in (exact_dedup.dedup(docs), line_dedup.decisions(docs), ngram_join.join_components(docs), packing.pack(docs), pii.find(docs), quality_rules.judge(docs), quality_rank.scored(docs, model), mixing.mix(docs, keep=["doc_id"]).withColumnRenamed("id", "doc_id")):
        assert out.schema["doc_id"].dataType.simpleString() == "string" and len(out.collect()) == n
    assert quality_rank.filtered(docs, model).columns == docs.columns


def test_rows_that_repeat_often_are_spread(spark):
    df = spark.range(200).select(F.lit(1).alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    got = packing.pack(df, capacity=8, rows_per_shard=20).collect()
    assert len(got) == 200 and len({r.shard for r in got}) > 5 and len({(r.shard, r.bin) for r in got}) == 200
