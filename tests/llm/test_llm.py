"""The operators on training data against brute force, and on odd inputs."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from entivore.llm import exact_dedup, line_dedup, mixing, ngram_join, packing, pii, quality_rank, quality_rules, token_count, warc
from entivore.llm.common import components, linked

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id int, size int"
LONG = " ".join(f"word{i}" for i in range(30_000))
#: Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names.
ODD = [
    (1, "a b c d e f g h", "en", "s", 1, "x", 1, 1),
    (2, "a b  c d\te f g h", "en", "s", 1, "x", 1, 1),
    (2, "a b  c d\te f g h", "en", "s", 1, "x", 1, 1),
    (None, None, None, None, None, None, None, None),
    (None, "a b c d e f g h", None, None, None, None, None, None),
    (5, "", "en", "t", 0, "x", 1, 1),
    (6, " \n\n ", "de", "t", 0, "x", 1, 1),
    (7, LONG, "fr", None, 0, "x", 1, 1),
    (8, LONG + " end", "fr", "t", 0, "x", 1, 1),
    (9, "héllo wörld ☃ 😀 mail a@b.cd", "es", "t", 0, "x", 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return WORD.findall(text or "")


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components(spark):
    pick = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(pick.randrange(200, 300), pick.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(300, edges)
    assert got == {i: want[i] for e in edges for i in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_large_cell(spark):
    """A cell of many ids in three groups: all links are found without all pairs."""
    cells = spark.createDataFrame([(1, i, 1) for i in range(90)] + [(2, 90, 1), (2, 3, 1)], "cell long, id long, size int")
    tried = []

    def verify(pairs):
        tried.append(pairs.count())
        return pairs.where("a % 3 = b % 3 AND a < 90 AND b < 90").select("a", "b")

    got = {r.node: r.label for r in linked(cells, verify).collect()}
    assert got == {i: i % 3 for i in range(90)}
    assert sum(tried) < 90 * 89 / 2


# 1 mixing
def test_mix(spark, docs, odd, none):
    for df in (docs, odd):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        want = collections.Counter()
        for r in df.collect():
            want[r.source] += len(words(r.text))
        taken, target = collections.Counter(), {}
        for r in rows:
            assert r.source_size == want[r.row.source] and r["size"] == len(words(r.row.text)) and 0 <= r.copies <= 3
            taken[r.row.source] += r.copies * r["size"]
            target[r.row.source] = r.target
        assert math.isclose(sum(target.values()), sum(want.values()), rel_tol=1e-6)
        largest = max(r["size"] for r in rows)
        assert all(abs(taken[s] - target[s]) <= 3 * largest for s in want)
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


# 2 exact dedup
def test_exact_dedup(spark, docs, odd, none):
    for df, bits in ((docs, 64), (docs, 8), (odd, 64)):  # with 8 bits, identifiers clash
        groups = collections.defaultdict(list)
        for r in df.collect():
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
        want = []
        for t, ids in groups.items():
            ids.sort(key=lambda i: (i is None, i))
            want += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(df, id_bits=bits).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        kept = exact_dedup.deduplicated(df)
        assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.dedup(none).count() == 0


# 3 WARC
def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "n", "é" * 50_000), (6, "c", "é" * 50_000), (7, "u", "y\r\n\r\nz")]
    df = spark.createDataFrame([(*p, "more") for p in pages], "page_id long, url string, html string, sha256 string")
    warc.write_archive(df, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.summary(records).collect()}
    best = {"x": 2, "": 4, "é" * 50_000: 6, "y\r\n\r\nz": 7}
    for i, _, html in pages:
        data, b = (html or "").encode(), best[html or ""]
        kind = ("response", None) if i == b else ("revisit", b)
        assert got[i] == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *kind)
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 4
    parsed = [warc.parse_record(warc.record_bytes(bytes(r.header), r.frame and bytes(r.frame))) for r in records.collect()]
    assert {p["payload"] for p in parsed if p["payload"] is not None} == {k.encode() for k in best}
    warc.write_warc(records, str(tmp_path / "files"))
    whole = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "files").glob("part-*.gz")))
    found = []
    while whole:
        head, _, rest = whole.partition(b"\r\n\r\n")
        n = int(re.search(rb"\r\nContent-Length: ([0-9]+)", head)[1])
        found.append(warc.parse_record(head + b"\r\n\r\n" + rest[: n + 4]))
        whole = rest[n + 4 :]
    assert len(found) == len(pages) == len({x["WARC-Record-ID"] for x in found})
    assert {x["WARC-Refers-To"] for x in found if "WARC-Refers-To" in x} <= {x["WARC-Record-ID"] for x in found}
    named = df.withColumn("page_id", F.concat(F.lit("p-:/"), F.col("page_id").cast("string")))
    warc.write_archive(named.union(named.where("page_id = 'p-:/1'")), str(tmp_path / "s"))
    texts = [(r.page_id, r.record_type, r.refers_to) for r in warc.summary(warc.read_records(spark, str(tmp_path / "s")), "string").collect()]
    assert len(texts) == 8 and texts.count(("p-:/1", "revisit", "p-:/2")) == 2 and (None, "revisit", "p-:/6") in texts
    warc.write_archive(df.limit(0), str(tmp_path / "e"))
    assert warc.summary(warc.read_records(spark, str(tmp_path / "e"))).count() == 0


# 4 line dedup
def line_sets(rows):
    place, lines = [], {}
    for k, r in enumerate(rows):
        for n, raw in enumerate((r.text or "").split("\n")):
            line = re.sub(r"[\x20\x09-\x0D]+", " ", raw.lower()).strip(" ")
            if line:
                place.append((k, n, lines.setdefault(line, len(lines))))
    return place, [frozenset(x[i : i + 5] for i in range(len(x) - 4)) or frozenset([x]) for x in lines]


def test_line_dedup(spark, docs):
    pick = random.Random(3)
    base = [" ".join("".join(pick.choices("abcdefghij", k=pick.randrange(2, 8))) for _ in range(n)) for n in (6, 12, 13, 30, 60) * 8]
    near = []
    for x in base:
        w = x.split(" ")
        w[pick.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    texts = ["\n".join(base), "\n".join(near), None, "", base[0].upper() + "\n\n" + base[0], base[1]]
    small = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df, recall in ((docs.select("doc_id", "text"), 0.97), (small, 0.97)):
        rows = sorted(df.collect(), key=lambda r: r.doc_id)
        place, sets = line_sets(rows)
        by = collections.defaultdict(list)
        for i, s in enumerate(sets):
            for g in s:
                by[g].append(i)
        common = collections.Counter((a, b) for x in by.values() for k, a in enumerate(x) for b in x[k + 1 :])
        root = roots(len(sets), [(a, b) for (a, b), i in common.items() if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i)])
        first, want = {}, set()
        for k, n, line in place:
            if first.setdefault(root[line], (k, n)) != (k, n):
                want.add((rows[k].doc_id, n))
        got = {(r.doc_id, n) for r in line_dedup.decisions(df).collect() for n in r.removed}
        assert len(got & want) >= recall * len(want) and len(got - want) <= 0.03 * len(want) + 1


def test_line_dedup_odd(spark, odd, none):
    assert line_dedup.decisions(none).count() == 0
    out = line_dedup.cleaned(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert sum(len(words(r.text)) for r in out.collect()) == 8 + 30_000 + 6  # each line once
    assert {r.n_lines for r in line_dedup.decisions(odd).where("doc_id = 6").collect()} == {0}


# 5 packing
def test_packing(spark, docs, odd, none):
    for df in (docs, odd):
        size = collections.Counter()
        rows = df.withColumn("c", F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)).collect()
        about = collections.defaultdict(list)
        for r in rows:
            size[r.doc_id] += len(words(r.text))
            about[r.doc_id].append((r.source, r.c))
        bins, seen = collections.defaultdict(list), collections.Counter()
        for r in packing.pack(df, capacity=256, rows_per_shard=50).collect():
            seen[r.doc_id] += r.n_words
            bins[r.shard, r.bin].append(r)
        assert seen == size
        for x in bins.values():
            x.sort(key=lambda r: (r.offset, r.n_words))
            assert sum(r.n_words for r in x) <= 256
            assert all(a.offset + a.n_words <= b.offset for a, b in zip(x, x[1:], strict=False))
            if all(len(about[r.doc_id]) == 1 for r in x):
                assert len({about[r.doc_id][0][0] for r in x}) == len({about[r.doc_id][0][1] for r in x}) == len(x)
    assert packing.pack(none).count() == 0


def test_best_fit_takes_the_tightest_bin():
    pick, pieces = random.Random(5), []
    for _ in range(300):
        pieces.append((pick.randrange(0, 100), 1 << pick.randrange(6), 1 << pick.randrange(6, 12)))
    pieces.sort(key=lambda p: -p[0])
    bins, want = [], []  # [room, bits]
    for size, a, b in pieces:
        fit = [(room, k) for k, (room, bits) in enumerate(bins) if room >= size and not bits & (a | b)]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([100, 0])
        want.append((k, 100 - bins[k][0]))
        bins[k][0] -= size
        bins[k][1] |= a | b
    assert packing.best_fit(pieces, 100) == want


# 6 quality
def test_quality_rank(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rank.fit(docs, labels)
    out = {r.doc_id: r for r in quality_rank.scored(docs, model).collect()}
    good, bad = [], []
    for r in labels.collect():
        assert out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if out[r.doc_id].held_out:
            (good if r.quality else bad).append(out[r.doc_id].score)
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.9
    assert sum(s >= 0.3 for s in good) >= 0.95 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    kept = quality_rank.filtered(odd, model)
    assert kept.columns == odd.columns and quality_rank.scored(odd, model).count() == len(ODD) and quality_rank.scored(none, model).count() == 0
    one = labels.where("quality = 1")
    assert {r.score for r in quality_rank.scored(odd, quality_rank.fit(docs, one)).collect()} == {0.5}


# 7 tokens
def test_token_counts(spark, docs, odd, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = token_count.load(path)
    special = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "I'll it's  '’ x²½ Ünïcode İstanbul ǅ"), (3, "\x00\x1f a b c")], "doc_id long, text string")
    for df in (docs, odd, special):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in df.collect())
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(df, path).collect()) == want
    assert token_count.token_counts(none, path).count() == 0


# 8 n-gram join
def shingle_set(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(zip(w, w[1:], w[2:], w[3:], strict=False)) if len(w) > 3 else frozenset([tuple(w)] if w else [])


def test_ngram_join(spark, docs, odd, none):
    pick = random.Random(8)
    base = [f"w{pick.randrange(5000)}" for _ in range(300)]
    near = []
    for i in range(120):  # a large group of near copies: chains of edits
        t = list(base)
        for _ in range(pick.randrange(0, 8)):
            t[pick.randrange(len(t))] = f"e{i}"
        near.append((1000 + i, " ".join(t)))
    many = spark.createDataFrame(near, "doc_id long, text string")
    for df in (docs, many):
        rows = sorted(df.collect(), key=lambda r: r.doc_id)
        sets = [shingle_set(r.text) for r in rows]
        by = collections.defaultdict(list)
        for i, s in enumerate(sets):
            for g in s:
                by[g].append(i)
        common = collections.Counter((a, b) for x in by.values() for k, a in enumerate(x) for b in x[k + 1 :])
        root = roots(len(sets), [(a, b) for (a, b), i in common.items() if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i)])
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(df).collect()}
        assert got == {r.doc_id: (len(sets[i]), rows[root[i]].doc_id) for i, r in enumerate(rows)}
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(odd).collect())
    assert got == collections.Counter([(1, 5, 1), (2, 5, 1), (2, 5, 1), (None, 0, None), (None, 5, 1), (5, 0, 5), (6, 0, 6), (7, 29_997, 7), (8, 29_998, 7), (9, 3, 9)])
    assert ngram_join.join_components(none).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 6


def test_prefix_tree_finds_what_counting_finds():
    import numpy as np

    pick = random.Random(2)
    sets = list({tuple(sorted(pick.sample(range(40), pick.randrange(1, 30)))) for _ in range(200)})
    sets = [np.array(s, np.int64) for s in [*sets, (1,), (1, 2), (1, 2, 3)]]
    tree = ngram_join.PrefixTree(sets)
    for q in [*sets[:40], np.array([41, 42])]:
        has = np.zeros(50, bool)
        has[q] = True
        want = {(i, n) for i, s in enumerate(sets) if (n := len(np.intersect1d(q, s))) * 100 >= 60 * (len(q) + len(s) - n)}
        assert set(tree.walk(has, 60)) == want


def test_sketches_never_lose_a_link():
    import numpy as np

    pick = np.random.default_rng(3)
    base = pick.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: int(n)][pick.random(int(n)) > cut], pick.integers(0, 1 << 63, int(n * cut)).astype(np.uint64)])) for n in (1, 5, 30, 40, 300, 350, 2500, 3000) for cut in (0.0, 0.02, 0.05, 0.1, 0.5)]
    compare = ngram_join.Sketches(np.array([len(s) for s in sets]), [ngram_join.sketch(s, 80) for s in sets], 80)
    told = 0
    for i, a in enumerate(sets):
        near = compare.compatible(np.full(len(sets), i), np.arange(len(sets)))
        for j, b in enumerate(sets):
            n = len(np.intersect1d(a, b))
            link = 100 * n >= 80 * (len(a) + len(b) - n)
            assert near[j] or not link
            told += not near[j]
    assert told > 800


def test_ngram_join_in_chunks(spark):
    """Hot cells and large blocks are split without any loss."""
    pick = random.Random(5)
    base = [f"w{pick.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(pick.randrange(0, 6)):
            t[pick.randrange(len(t))] = f"e{i}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(df).collect()}
    assert 10 < len({x[2] for x in want}) < 140
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(df, cell_rows=20, block=2000).collect()} == want


# 9 personal data
BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark, docs, odd, none):
    hard = ["a@b.c@d.ef 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 +1 (212) 555-0100", "😀 x@y.zz 4111111111111111 4111-1111-1111-1112", "my iban is DE89 3704 0044 0532 0130 00", "+49 30 901820 +1 23", "@@..@a.b a@b a@b.", "0000.0001.2.3 1.2.3", "ssn 078-05-1120"]
    extra = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    for df in (docs, odd, extra):
        want = []
        for r in df.collect():
            found = {k: [f"{k}:{m.start()}:{m.end()}" for m in p.finditer(r.text or "") if ok(m[0])] for k, p, ok in BASE}
            digest = hashlib.sha256(",".join(x for k in found for x in found[k]).encode()).hexdigest()
            want.append((str(r.doc_id), *[len(found[k]) for k in found], digest))
        f = pii.find(df)
        got = f.select("doc_id", *[F.size(k).alias(k) for k in pii.BASE], F.sha2(pii._listed(pii.BASE).cast("binary"), 256).alias("h")).collect()
        assert sorted(map(repr, want)) == sorted(repr((str(r[0]), *tuple(r)[1:])) for r in got)
    clean = {r.doc_id: r.text for r in pii.redacted(pii.find(extra)).collect()}
    assert clean[2] == "my iban is <iban>" and clean[6] == "ssn <national_id>"
    assert pii.find(none).count() == 0


# 10 quality rules
def test_quality_rules(spark, docs, odd, none):
    for df in (docs, odd):
        want = []
        for r in df.collect():
            w, lines = words(r.text), [x for x in (r.text or "").split("\n") if words(x)]
            grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
            failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
            want.append((str(r.doc_id), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(hit), failed))
        got = quality_rules.judge(df).collect()
        assert sorted((str(r[0]), *tuple(r)[1:7]) for r in got) == sorted(want)
        assert not any(r.kept and r.base_failed for r in got)
        assert all(r[c] is None or 0 <= r[c] <= 1 for r in got for c in ("class_distance", "word_distance"))
    assert quality_rules.judge(none).count() == 0


def test_quality_rules_keep_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r for r in quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    good = [kept[r.doc_id] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()]
    fit = [r for r in good if not r.base_failed]
    assert sum(r.kept for r in fit) >= 0.97 * len(fit)


# pipeline
def test_pipeline(spark, docs):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality", "exact dedup", "near dedup", "mix", "pack"]
    rows = P.run(spark, SF).collect()
    model = quality_rank.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {r.doc_id for r in quality_rank.scored(docs, model).where("predicted = 1").collect()}
    one = {r.keep_id for r in exact_dedup.dedup(docs.where(F.col("doc_id").isin(*keep))).collect()}
    ids = {r.doc_id for r in rows}
    assert ids <= one and len(ids) > 0.5 * len(one)
    near = ngram_join.join_components(docs.where(F.col("doc_id").isin(*one)))
    assert ids <= {r.component_id for r in near.collect()} | {r.doc_id for r in near.where("n_shingles = 0").collect()}
