"""Indexes, searches, differences and name joins against plain Python."""

import collections
import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from entivore.functions import english
from entivore.functions import text as X
from entivore.operators import diffs, postings
from entivore.operators import trigrams as T
from entivore.plans import searches

SF = "/root/testdata/sf0.001"


def test_stems_of_every_word_equal_those_of_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT text FROM '{SF}/documents.parquet'")
    more = "generously communism arsenal university skies dying innings proceeds relational conditional hopefulness analogously analogy happily nationally replacement adoption controll hopping hoping feed agreedly boy cries ties gas yes saying youthful ability possibly sensational formalize duplicate electricity electrical goodness formative revival inference defensible irritant adjustment dependent homologous effective probate rate cease eyed troubles sized falling hissing fizzed failing filing bbq"
    con.execute("CREATE TABLE more AS SELECT unnest(string_split(?, ' ')) AS w", [more])
    sql = rf"WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM documents UNION SELECT w FROM more), {searches.STEMS} SELECT w, stem FROM stems"
    rows = con.sql(sql).fetchall()
    assert len(rows) > 3000 and [(w, english.stem(w), s) for w, s in rows if english.stem(w) != s] == []


def test_stems_as_published():
    want = {"consignment": "consign", "consolatory": "consolatori", "conspicuously": "conspicu", "knackeries": "knackeri", "kneeling": "kneel", "skies": "sky", "dying": "die", "happy": "happi", "generate": "generat", "generous": "generous", "hoping": "hope", "hopped": "hop", "agreed": "agre", "rational": "ration", "innings": "inning", "sky": "sky", "ties": "tie", "cries": "cri"}
    assert {w: english.stem(w) for w in want} == want and len(english.STOP_WORDS) == 127


def bm25_by_hand(docs, query, k1=1.5, b=0.75):
    words = {i: t.lower().split() for i, t in docs.items()}
    average = max(sum(map(len, words.values())), 1) / len(words)
    out = dict.fromkeys(words, 0.0)
    for term in dict.fromkeys(query.lower().split()):
        df = sum(term in w for w in words.values())
        for i, w in words.items():
            if tf := w.count(term):
                out[i] += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / average))
    return {i: round(s, 6) for i, s in out.items()}


@pytest.mark.parametrize("block_docs", [3, 17, 1000])
def test_block_bounds_lose_no_document(spark, block_docs):
    rng = random.Random(block_docs)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = {i: " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40))) for i in range(300)} | {300: None}
    queries = {f"q{j}": " ".join(rng.choices(vocabulary, k=rng.randint(1, 12))) for j in range(12)} | {"none": "zz", "empty": ""}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = postings.ranked(postings.build(df, block_docs=block_docs, buckets=4), spark.createDataFrame(list(queries.items()), "item_id string, query string"))
    want = []
    for j, q in queries.items():
        scores = bm25_by_hand({i: t or "" for i, t in docs.items()}, q)
        want += [(j, i, k + 1) for k, i in enumerate(sorted((i for i in scores if scores[i] > 0), key=lambda i: (-scores[i], i))[:5])]
    assert sorted((r.item_id, r.doc_id, r["rank"]) for r in got.collect()) == sorted(want)


def test_bounds_leave_blocks_out(spark):
    """A passage that a few documents hold: the blocks of all others are never scored."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 400 == 7, "the of rare words of a passage").otherwise(F.concat(F.lit("the of common words "), F.col("id"))).alias("text"))
    index = postings.build(docs, block_docs=20)
    scored = []
    whole = postings._scored
    postings._scored = lambda pairs, *a: scored.append(pairs.count()) or whole(pairs, *a)
    try:
        got = postings.ranked(index, spark.createDataFrame([(1, "the rare passage")], "item_id long, query string"))
        assert [r.doc_id for r in got.orderBy("rank").collect()] == [7, 407, 807, 1207, 1607]
    finally:
        postings._scored = whole
    assert sum(scored) <= 21 and index.postings.select("block").distinct().count() >= 100


def test_passages_of_files(spark):
    rng = random.Random(3)
    files = {f"f{k}": [" ".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(n)] for k, n in enumerate((1, 3, 4, 9, 30))}
    asked = [(10 * k + j, f, q) for k, f in enumerate([*files, "gone"]) for j, q in enumerate(("a b", "zz", None))]
    p = spark.createDataFrame([(f, i, t) for f, ts in files.items() for i, t in enumerate(ts)], "file string, ix int, text string")
    q = spark.createDataFrame(asked, "item_id long, file string, query string")
    got = collections.defaultdict(list)
    for r in postings.in_files(p, q, cap=40).orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.ix, r.text))
    for item, f, query in asked:
        texts = files.get(f, [])
        scores = bm25_by_hand(dict(enumerate(texts)), query or "") if texts else {}
        order = list(scores) if len(texts) <= 3 else sorted((i for i in scores if scores[i] > 0), key=lambda i: (-scores[i], i))[:5] or list(range(min(5, len(texts))))
        want, left = [], 40
        for i in order:
            if left > 0:
                want.append((i, texts[i][:left]))
                left -= len(texts[i])
        assert got[item] == want


def test_full_text(spark):
    rows = [(1, "The horses carried boxes."), (2, "a box; tired horse, carrying"), (3, "horses"), (4, None), (5, "carry the BOX of horses"), (6, "boxing horses carry a box"), (7, "horse carried (the) boxes")]
    index = postings.build(spark.createDataFrame(rows, "doc_id long, text string"), postings.english_terms, places=True, block_docs=2, buckets=8)
    found = lambda q: {r.doc_id: r.phrase for r in postings.matching(index, q).collect()}
    assert found("horse carries a box") == {1: False, 2: False, 5: False, 6: True, 7: True}
    assert found("horses") == {1: True, 2: True, 3: True, 5: True, 6: True, 7: True}
    assert found("the of") == {} and found("unicorn horse") == {}
    plan = postings.matching(index, "horses")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_common_subsequences_are_longest():
    rng = random.Random(8)
    for _ in range(800):
        a, b = (rng.choices(range(rng.randint(1, 7)), k=rng.randint(0, 25)) for _ in range(2))
        got = diffs.common(a, b)
        assert len(got) == lcs(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))
    assert len(diffs.common("a c a c d e f d f".split(), "d d f e d b c a a".split())) == 3


def test_word_diff(spark):
    rows = [(1, "a b c d", "a x c d e"), (2, None, "n"), (3, "s", "s"), (4, "", ""), (5, "one\ntwo\nthree", "one\n2\nthree")]
    df = spark.createDataFrame(rows, "id int, old string, new string")
    got = collections.defaultdict(list)
    for r in diffs.word_diff(df).orderBy("id", "ix").collect():
        got[r.id].append((r.kind, r.text))
    assert got[1] == [("same", "a"), ("remove", "b"), ("add", "x"), ("same", "c d"), ("add", "e")]
    assert got[2] == [("add", "n")] and got[3] == [("same", "s")] and 4 not in got
    assert [(r.kind, r.text) for r in diffs.word_diff(df.where("id = 5"), most_words=3).orderBy("ix").collect()] == [("same", "one"), ("remove", "two"), ("add", "2"), ("same", "three")]


def test_long_texts_are_compared_in_bounded_memory(spark):
    rng = random.Random(2)
    old = [f"w{rng.randint(0, 900)}" for _ in range(4900)]
    new = [w if rng.random() > 0.1 else "x" for w in old if rng.random() > 0.05]
    kinds = collections.Counter()
    sides = {"remove": [], "add": [], "same": []}
    for kind, text in diffs.runs(" ".join(old), " ".join(new)):
        kinds[kind] += len(text.split())
        sides[kind] += text.split()
    assert kinds["same"] >= 0.9 * len(new) - 200 and kinds["same"] + kinds["remove"] == len(old) and kinds["same"] + kinds["add"] == len(new)


def test_messages_put_together_again(spark):
    rows = searches.q_word_diff(spark, SF).orderBy("id", "ix").collect()
    texts = {f"{r.conv_id}:{r.turn}": (r.text or "").split() for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    new, old = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        if r.kind != "remove":
            new[r.id] += r.text.split()
        if r.kind != "add":
            old[r.id] += r.text.split()
    for key, words in texts.items():
        conv, turn = key.split(":")
        assert new[key] == words and old[key] == texts.get(f"{conv}:{int(turn) - 1}", [])


@pytest.mark.parametrize(("threshold", "chunk"), [(0.3, 5000), (0.3, 4), (0.7, 3)])
def test_names_and_labels_that_are_alike(spark, threshold, chunk):
    rng = random.Random(6)
    parts = ["small", "smal", "red", "ring", "blue", "box", "boxes", "large", "o'ring", "ünder", "a"]
    names = sorted({" ".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(60)} | {"", "  ", "Red RING"})
    labels = sorted({" ".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(60)} | {""})
    left, right = spark.createDataFrame([(n,) for n in names], "a string"), spark.createDataFrame([(x,) for x in labels], "b string")
    every = left.crossJoin(right)
    for join, score in ((T.similar, X.similarity), (T.word_similar, X.word_similarity)):
        want = {(r.a, r.b, round(r.s, 9)) for r in every.withColumn("s", score(F.col("a"), F.col("b"))).where(F.col("s") >= threshold).collect()}
        got = [(r.a, r.b, round(r.sim, 9)) for r in join(left, right, threshold, chunk).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
