"""Licenses, spelling variants and importance resampling against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from entivore.llm import importance, licenses, spelling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans(importance.UPPER, importance.LOWER)
ODD = [(1, None), (2, ""), (3, " \n.,"), (4, "word " * 30), (4, "word " * 30), (5, "x" * 3000 + " tail"), (None, "a b c " * 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in ODD], "doc_id long, text string, row int, words string, rank int, block int")


# 13: importance resampling
def features(text, n):
    words = WORD.findall((text or "").translate(SMALL))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def by_hand(rows, target, n, buckets, percent, least):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(map(place, features(text, n)[1]))
    for text in target:
        t.update(map(place, features(text, n)[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out, sized = [], []
    for doc_id, text in rows:
        words, found = features(text, n)
        weight = sum(gain[place(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        sized.append(len(words) >= least)
    order = sorted((i for i, ok in enumerate(sized) if ok), key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0))
    for k, i in enumerate(order[: percent * len(order) // 100]):
        out[i][4] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("n", "buckets", "chunk"), [(1, 10_000, 1 << 16), (1, 50, 40), (3, 1000, 64), (2, 1000, 1)])
def test_resampling_equals_plain_python_however_texts_are_cut(spark, docs, n, buckets, chunk):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = importance.resampled(docs, target, n=n, buckets=buckets, chunk=chunk, percent=25)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows, [r.text for r in target.collect()], n, buckets, 25, 20)


def test_pieces_own_every_word_once():
    text = b"aa bb   cc " + b"d" * 50 + b" ee ff"
    for n, size in itertools.product((1, 2, 4), (1, 3, 10, 1000)):
        got = list(importance.pieces(text, n, size))
        assert sum(owned for _, owned in got) == len(text.split())
        found = sorted(f for piece, owned in got for f in importance.features(piece.split(), owned, n))
        assert found == sorted(importance.features(text.split(), 100, n))


def test_resampling_of_odd_rows(spark, odd):
    target = spark.createDataFrame([("word",), (None,)], "text string")
    got = importance.resampled(odd, target, percent=50, chunk=100)
    drawn = [r.doc_id for r in got.collect() if r["rank"]]
    assert got.count() == len(ODD) and sorted(map(tuple, got.collect()), key=repr) == by_hand(ODD, ["word", None], 1, 10_000, 50, 20)
    assert len(drawn) == 1 and drawn[0] in (4, None)  # of three rows that are long enough
    assert importance.resampled(odd.limit(0), target).count() == 0
    assert importance.resampled(odd, target.limit(0)).count() == len(ODD)


def test_ranks_across_parts(spark):
    df = spark.range(0, 3000, 1, 16).withColumn("score", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = importance.ranked(df, F.col("id") % 3 != 0, [F.col("score").desc(), F.col("id").asc()], 30)
    rows = {r.id: (r.score, r["rank"]) for r in got.collect()}
    order = sorted((i for i in rows if i % 3), key=lambda i: (-rows[i][0], i))
    assert {i: r for i, (_, r) in rows.items() if r} == {i: k + 1 for k, i in enumerate(order[:600])}


# 12: spelling variants
def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def variants_by_hand(words):
    out, form = {}, {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = [n, len(close)]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] += [form[w], words.get(form[w]), root]
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize(("alphabet", "lengths", "block", "group"), [("ab", (1, 9), 5000, 2500), ("ab", (4, 7), 16, 3), ("abcé", (2, 5), 40, 2), ("ÿa", (6, 8), 1, 1)])
def test_near_words_equal_all_pairs(spark, alphabet, lengths, block, group):
    rng = random.Random(f"{alphabet}{lengths}")
    words = {"".join(rng.choices(alphabet, k=rng.randint(*lengths))): int(2 ** rng.uniform(0, 12)) for _ in range(220)}
    words |= {"a" * 300: 3, "a" * 299: 9, "a" * 150 + "b" + "a" * 149: 40, "b" + "a" * 299: 1}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.near_pairs(df, block=block, group=group)
    pairs = sorted((r.word, r.other) for r in got.collect())
    assert pairs == sorted((x, y) for x, y in itertools.permutations(words, 2) if near(x, y))  # each once
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df, block=block, group=group).collect()}
    assert found == variants_by_hand(words)


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        lo, c = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        hi, d = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        who, what = spelling.WaveletTree(values).report(lo, hi, c, d)
        want = sorted((k, v) for k in range(50) for v in values[lo[k] : hi[k]] if c[k] <= v < d[k])
        assert sorted(zip(who.tolist(), what.tolist(), strict=True)) == want


def test_word_counts(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, "ÀÉÿßx Straßen_straßen Iİstanbul"), (-2, None)]
    want = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == {w: n for w, n in want.items() if n >= 3}
    got = {r.word: r.n for r in spelling.word_counts(odd, min_count=1, min_length=4).collect()}
    assert sum(got.get(w, 0) for w in ("word", "wor")) <= 60 and max(map(len, got)) in (2999, 3000)
    assert spelling.variants(spelling.word_counts(odd.limit(0))).count() == 0


# 11: license scans
def scan_by_hand(text, templates=licenses.TEMPLATES, percent=85, block=64):
    words = WORD.findall((text or "").translate(SMALL))
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    more, best = set(), 0.0
    for at in range(0, max(len(words) - block // 2, 1), block // 2):
        here = set(words[at : at + block])
        met = {}
        for label, family, notice in templates:
            own = set(notice.split())
            if 100 * len(own & here) >= percent * len(own):
                met[family] = max(met.get(family, (0,)), (len(own & here) / len(own), len(own), label))
        more |= {m[2] for m in met.values()}
        best = max([best, *(m[0] for m in met.values())])
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(base | more), 1.0 if base else best


def test_license_scan_equals_all_pairs(spark, docs):
    rng = random.Random(11)
    notices = [t[2].split() for t in licenses.TEMPLATES]
    rows = [(r.doc_id, r.text) for r in docs.limit(40).collect()]
    for i in range(300):
        parts = []
        for _ in range(rng.randint(0, 4)):
            notice = [w for w in rng.choice(notices) if rng.random() > 0.12]
            parts += rng.choices(["the", "of", "and", "lorem", "gnu", "cc", "by", "nc", "é"], k=rng.randint(0, 60)) + notice
        rows.append((1_000_000 + i, rng.choice([" ", ",\n* ", "-"]).join(parts).replace("license", "LICENSE")))
    rows += [(-1, "CC-BY-NC, cc by\nnc; (cc by ncx) Under  the\tMIT license"), (-2, "under the MİT license"), (-3, "apache license version 2.0"), (-4, None), (-5, "cc bý nc"), (-6, "cc by nc " * 40), (-7, "gnu K")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(df).collect()}
    assert got == {i: scan_by_hand(t) for i, t in rows}
    assert got[-1][1:6] == (3, 0, 9, ["cc-by-nc", "mit"], ["cc-by-nc", "mit"]) and sum(len(v[5]) > len(v[4]) for v in got.values()) > 50


def test_the_filters_leave_few_pairs(spark):
    """Prose with the common words of notices isn't compared with any template."""
    prose = " ".join("the of and to in a is it with for or by this that you be as on are may".split() * 40)
    df = spark.createDataFrame([(i, prose + f" tail{i}") for i in range(50)] + [(99, prose + " redistribution and use")], "doc_id long, text string")
    scanned = licenses.blocks(df).cache()
    order = licenses.frequency_order(scanned)
    assert order.index("redistribution") < order.index("the") and licenses.matches(scanned).isEmpty()


def test_license_scan_of_odd_rows(spark, odd):
    got = licenses.scan(odd)
    assert sorted((r.doc_id or 0, r.n_words) for r in got.collect()) == sorted((i or 0, len(WORD.findall(t or ""))) for i, t in ODD)
    assert all((r.labels, r.score, r.first_word) == ([], 0.0, None) for r in got.collect())
    assert licenses.scan(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="can't hold"):
        licenses.scan(odd, block=8)
