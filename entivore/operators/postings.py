"""Inverted indexes: ranked passages (BM25) with block bounds, and full-text search.

An index holds blocks of documents as they are read: for each block and term, the documents of
the block that hold the term. Making one moves no text between tasks. It is stored by the hash
of the term (bucket), so that a query reads the folders of its terms only.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entivore.functions import english
from entivore.sources.shared import stored

#: Documents of a block, and words after which it is closed before.
BLOCK_DOCS, BLOCK_WORDS = 512, 1_000_000
BUCKETS = 32
#: Terms that a task looks up when only some are indexed.
MOST_TERMS = 100_000
#: Blocks of each query that give the first bound from below.
FIRST_BLOCKS = 2
#: Queries that one task holds against a block at a time.
TASK_QUERIES = 256
#: Scores are compared to so many places.
PLACES = 6


#: What makes, in each task, the function that gives the places and terms of a text.
Split = Callable[[], Callable[[str], tuple[Sequence[int], Sequence[str]]]]


def plain_terms() -> Callable[[str], tuple[Sequence[int], Sequence[str]]]:
    def split(text: str) -> tuple[Sequence[int], Sequence[str]]:
        words = text.lower().split()
        return range(len(words)), words

    return split


def english_terms() -> Callable[[str], tuple[Sequence[int], Sequence[str]]]:
    known = english.Stems()

    def split(text: str) -> tuple[Sequence[int], Sequence[str]]:
        found = english.terms(text, known)
        return [i for i, _ in found], [t for _, t in found]

    return split


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """postings: block, term, docs, sizes (terms of each document), counts or places (of the term in each) and bucket;
    terms: term and df, the documents that hold it; n_docs, and n_words of all together."""

    postings: DataFrame
    terms: DataFrame
    n_docs: int
    n_words: int
    buckets: int

    def of_terms(self, terms: Sequence[str]) -> DataFrame:
        """The postings of the terms: of the stored folders, theirs only."""
        asked = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self.postings.where(F.col("bucket").isin(asked)).where(F.col("term").isin(list(terms)))


def _block(block: int, ids: pa.Array, sizes: list[int], places: list[Sequence[int]], terms: list[Sequence[str]], with_places: bool) -> pa.RecordBatch:
    """The postings of one block, put in order by term and document; under the empty term all documents and their sizes."""
    n = len(ids)
    codes, known = pd.factorize(np.array([t for own in terms for t in own], object))
    key = codes.astype(np.int64) * n + np.repeat(np.arange(n), [len(own) for own in terms])
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    term, doc = key[starts] // n, key[starts] % n
    ends = np.append(starts, len(key))
    offsets = pa.array(np.searchsorted(term, np.arange(len(known) + 1)), pa.int32())
    if with_places:
        at = np.fromiter((p for own in places for p in own), np.int32, len(key))[order]
        told = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at))
    else:
        told = pa.array(np.diff(ends), pa.int32())
    lists = [ids.take(pa.array(doc)), pa.array(np.array(sizes, np.int32)[doc]), told]
    columns = [pa.array(np.full(len(known), block)), pa.array(list(known), pa.string()), *(pa.ListArray.from_arrays(offsets, x) for x in lists)]
    whole = [pa.array([block]), pa.array([""]), *(pa.array([x.to_pylist()], c.type) for x, c in zip((ids, pa.array(sizes)), columns[2:4], strict=True)), pa.array([[]], columns[4].type)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(columns, whole, strict=True)], names=["block", "term", "docs", "sizes", "places" if with_places else "counts"])


def build(docs: DataFrame, split: Split = plain_terms, *, places: bool = False, only: DataFrame | None = None, block_docs: int = BLOCK_DOCS, buckets: int = BUCKETS) -> Index:
    """The index of docs (doc_id, text); with the places of terms, which phrases need, or their numbers only. only: a table
    of terms (term) that will be asked for; others are left out if these are no more than MOST_TERMS.

    Blocks are numbered by the task that makes them, once: the index is stored before it is read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = None if only is None else only.select("term").distinct().limit(MOST_TERMS + 1).collect()
    wanted = docs.sparkSession.sparkContext.broadcast({r.term for r in asked} if asked is not None and len(asked) <= MOST_TERMS else None)

    def run(batches):
        from pyspark import TaskContext

        terms_of, few = split(), wanted.value
        block, words = TaskContext.get().partitionId() << 32, 0
        own, sizes, at, terms, type_ = [], [], [], [], None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, found = terms_of(text)
                own.append(doc_id)
                sizes.append(len(found))
                if few is not None:
                    kept = [(i, t) for i, t in zip(where, found, strict=True) if t in few]
                    where, found = [i for i, _ in kept], [t for _, t in kept]
                at.append(where)
                terms.append(found)
                words += len(found)
                if len(own) >= block_docs or words >= BLOCK_WORDS:
                    yield _block(block, pa.array(own, type_), sizes, at, terms, places)
                    block, words = block + 1, 0
                    own, sizes, at, terms = [], [], [], []
        if own:
            yield _block(block, pa.array(own, type_), sizes, at, terms, places)

    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() * 2 < cores:  # few splits: a small table, whose texts are dealt to all cores
        texts = texts.repartition(cores)
    told = "places array<array<int>>" if places else "counts array<int>"
    postings = texts.mapInArrow(run, f"block long, term string, docs array<{kind}>, sizes array<int>, {told}")
    # rows of one bucket in few files; blocks of a frequent term are dealt to several tasks
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = postings.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartition(n, "bucket", F.pmod("block", F.lit(max(1, n // buckets))))
    postings = stored(postings, "postings", "bucket")
    terms = postings.where("term != ''").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    words = F.aggregate("sizes", F.lit(0).cast("long"), lambda total, n: total + n)
    whole = postings.where(F.col("bucket") == zlib.crc32(b"") % buckets).where("term = ''").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.size("docs"), "docs"), (words, "words"))]).first()
    return Index(postings, stored(terms, "posting-terms"), whole.docs, whole.words, buckets)


# ranked passages


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term: the distinct plain terms of each query (item_id, query)."""
    return queries.select("item_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != ""))).alias("term"))


def weights(index: Index, queries: DataFrame) -> DataFrame:
    """item_id, term, idf of the terms of queries that the index knows."""
    return query_terms(queries).join(index.terms, "term").select("item_id", "term", F.ln(1 + (index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _best(docs: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    order = np.lexsort((docs, -scores))
    return order[scores[order] > 0][:top]


def _scored(pairs: DataFrame, asked: DataFrame, parts: DataFrame, top: int, groups: int, kind: str) -> DataFrame:
    """item_id, doc_id, score: the best documents for each pair of a query and a block, by all terms of the query.

    A task holds one block with the terms that are asked for, and some queries at a time."""

    def run(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block):
            ids, at = np.unique(np.concatenate(block["docs"].to_list()), return_inverse=True)
            ends = np.cumsum(block["docs"].map(len))
            held = {t: (at[e - len(s) : e], np.asarray(s)) for t, e, s in zip(block["term"], ends, block["parts"], strict=True)}
            for item, own in queries.groupby("item_id", sort=False):
                scores = np.zeros(len(ids))
                for term, idf in zip(own["term"], own["idf"], strict=True):
                    if term in held:
                        where, part = held[term]
                        scores[where] += idf * part
                scores = np.round(scores, PLACES)
                out += [(item, ids[i], scores[i]) for i in _best(ids, scores, top)]
        return pd.DataFrame(out, columns=["item_id", "doc_id", "score"])

    group = F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("group")
    left = pairs.join(asked, "item_id").select("block", group, "item_id", "term", "idf")
    right = parts.join(pairs.select("block").distinct(), "block", "left_semi").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(run, kind)


def ranked(index: Index, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75, top: int = 5) -> DataFrame:
    """item_id, doc_id, score, rank of the best documents for each query (item_id, query).

    No document of a block scores more than the sum of the highest part of each term in it. The blocks with the highest
    such bounds are scored first; the fifth score that they give is a bound from below, and of all other blocks only those
    that can reach it are scored."""
    asked = stored(weights(index, queries), "bm25-asked")
    average = max(index.n_words, 1) / max(index.n_docs, 1)
    part = F.zip_with("counts", "sizes", lambda tf, size: tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average)))
    parts = stored(index.postings.join(asked.select("term").distinct(), "term", "left_semi").select("block", "term", "docs", part.alias("parts")), "bm25-parts")
    tops = parts.select("block", "term", F.array_max("parts").alias("most"))
    bounds = stored(asked.join(tops, "term").groupBy("item_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound")), "bm25-bounds")
    groups = max(1, -(-queries.select("item_id").distinct().count() // TASK_QUERIES))
    kinds = [f"{c} {t}" for c, t in (("item_id", queries.schema["item_id"].dataType.simpleString()), ("doc_id", index.postings.schema["docs"].dataType.elementType.simpleString()), ("score", "double"))]
    order = [F.desc("score"), F.asc("doc_id")]
    pairs = stored(first_by(bounds, "item_id", [F.desc("bound"), F.asc("block")], FIRST_BLOCKS).select("item_id", "block"), "bm25-pairs")
    best = stored(first_by(_scored(pairs, asked, parts, top, groups, ", ".join(kinds)), "item_id", order, top), "bm25-best")
    least = best.groupBy("item_id").agg(F.when(F.count("*") >= top, F.min("score")).alias("least"))
    rest = bounds.join(pairs, ["item_id", "block"], "left_anti").join(least, "item_id", "left")
    rest = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-PLACES)).select("item_id", "block")
    more = _scored(stored(rest, "bm25-pairs"), asked, parts, top, groups, ", ".join(kinds))
    return numbered(first_by(best.unionByName(more), "item_id", order, top), "item_id", order)


def first_by(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n of each in every task before it shuffles."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def numbered(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


# passages of one file


def in_files(passages: DataFrame, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75, top: int = 5, few: int = 3, cap: int = 15_000) -> DataFrame:
    """item_id, file, ix, score, text, rank: what a query (item_id, file, query) gets to read of one file's passages (file,
    ix, text): all of them if there are few; else those of the best scores above 0, by score; if there are none, the first.
    Texts together have cap characters at most, the last one cut. Scores are BM25 within the file.

    The passages of a file meet in one task, as do its queries; files may be many."""

    def best(file, own: list[dict], asked: list[dict]) -> Iterator[tuple]:
        own.sort(key=lambda x: x["ix"])
        words = [x["text"].lower().split() for x in own]
        sizes = np.array([len(w) for w in words], float)
        number = np.array([x["ix"] for x in own])
        wanted = {w for x in asked for w in (x["query"] or "").lower().split()}
        held: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for i, ws in enumerate(words):
            for w in ws:
                if w in wanted:
                    held[w][i] += 1
        average = max(sizes.sum(), 1) / len(own)
        for item, query in ((x["item_id"], x["query"]) for x in asked):
            scores = np.zeros(len(own))
            for term in dict.fromkeys((query or "").lower().split()):
                if term in held:
                    at, tf = (np.array(list(x)) for x in (held[term].keys(), held[term].values()))
                    scores[at] += np.log(1 + (len(own) - len(at) + 0.5) / (len(at) + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[at] / average))
            scores = np.round(scores, PLACES)
            order = np.arange(len(own)) if len(own) <= few else _best(number, scores, top)
            order = order if len(order) else np.arange(min(top, len(own)))
            left = cap
            for rank, i in enumerate(order, 1):
                if left <= 0:
                    break
                text = own[i]["text"][:left]
                left -= len(text)
                yield item, file, own[i]["ix"], float(scores[i]), text, rank

    def run(batches):
        for batch in batches:
            kinds_ = [batch.schema.field(2).type.value_type.field(0).type, batch.schema.field(0).type, pa.int32(), pa.float64(), pa.string(), pa.int32()]
            for start in range(0, len(batch), 100):  # so many files at a time
                out = [x for row in batch.slice(start, 100).to_pylist() for x in best(row["file"], row["own"], row["asked"])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds_, strict=True)], names=["item_id", "file", "ix", "score", "text", "rank"])

    kinds = f"item_id {queries.schema['item_id'].dataType.simpleString()}, file {passages.schema['file'].dataType.simpleString()}, ix int, score double, text string, rank int"
    texts = passages.select("file", F.struct(F.col("ix").cast("int").alias("ix"), F.coalesce("text", F.lit("")).alias("text")).alias("x")).groupBy("file").agg(F.collect_list("x").alias("own"))
    each = queries.select(F.col("file").alias("_file"), F.struct("item_id", "query").alias("x")).groupBy("_file").agg(F.collect_list("x").alias("asked"))
    return texts.join(each, F.col("file").eqNullSafe(F.col("_file"))).select("file", "own", "asked").mapInArrow(run, kinds)


# full text


def matching(index: Index, query: str) -> DataFrame:
    """doc_id, phrase: the documents whose stems hold all those of the query, which must have some; phrase: whether they
    stand together as in the query, with as many words between.

    Blocks that lack a term go by counting rows; the others hold a bounded number of documents each."""
    asked = english.terms(query)
    terms = sorted({t for _, t in asked})
    kind = index.postings.schema["docs"].dataType.elementType.simpleString()
    if not terms:
        return index.postings.sparkSession.createDataFrame([], f"doc_id {kind}, phrase boolean")
    held = index.of_terms(terms).groupBy("block").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("term", "docs", "places"))).alias("all")).where(F.col("n") == len(terms))
    row = {t: F.get("all", F.lit(i)) for i, t in enumerate(terms)}
    both = row[terms[0]]["docs"]
    for t in terms[1:]:
        both = F.array_intersect(both, row[t]["docs"])
    held = held.select("all", F.explode(both).alias("doc_id"))

    def at(term: str) -> Column:
        return F.get(row[term]["places"], (F.array_position(row[term]["docs"], F.col("doc_id")) - 1).cast("int"))

    places = held.select("doc_id", *[at(t).alias(f"p{i}") for i, t in enumerate(terms)])
    first, start = asked[0][1], asked[0][0]
    column = {t: f"p{i}" for i, t in enumerate(terms)}

    def together(p: Column) -> Column:
        out = F.lit(True)
        for place, term in asked[1:]:
            out = out & F.array_contains(column[term], p + (place - start))
        return out

    return places.select("doc_id", F.exists(column[first], together).alias("phrase"))
