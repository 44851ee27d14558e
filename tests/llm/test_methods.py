"""What the methods decide, against plain Python: distances, spans, weights, signatures, mixes and packings."""

import collections
import math
import random
import re
import string
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from entivore.llm import line_dedup, mixing, packing, pii, quality_rank, quality_rules, registry, token_count

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# 10: distances
def histograms(text, frequent):
    def class_of(c):
        kind = unicodedata.category(c)
        if c in " \t\n\x0b\x0c\r":
            return 1
        if kind in ("Ll", "Lo", "Lm") or kind[0] == "M":
            return 0
        return 2 if kind in ("Lu", "Lt") else 3 if kind == "Nd" else 4 if c in "#*$%&|<>" else 5 if kind[0] in "PS" else 6

    chars = [0] * 7
    for c in text:
        chars[class_of(c)] += 1
    words = [w.lower() for w in WORD.findall(text)]
    common = [words.count(w) for w in frequent]
    return np.array(chars), np.array([*common, len(words) - sum(common)])


def frequent_words(texts):
    seen = collections.Counter(w.lower() for t in texts for w in WORD.findall(t))
    return sorted(seen, key=lambda w: (-seen[w], w))[: quality_rules.COMMON_WORDS]


def jensen_shannon(x, y):
    if not x.sum() or not y.sum():
        return None
    p, q = x / x.sum(), y / y.sum()
    m = (p + q) / 2
    part = lambda a: sum(v * math.log2(v / w) for v, w in zip(a, m, strict=True) if v)
    return math.sqrt(max(part(p) + part(q), 0.0) / 2)


def test_distances_to_language_references(spark, docs):
    extra = [(-1, "xx", "Qq !! " * 100), (-2, None, "der die und den von zu das " * 30), (-3, "en", "der die und den von zu das " * 30)]
    df = docs.select("doc_id", "lang", "text").union(spark.createDataFrame(extra, "doc_id long, lang string, text string"))
    rows = {r.doc_id: (r.lang, r.text or "") for r in df.collect()}
    by = collections.defaultdict(list)
    for k, (lang, _) in rows.items():
        by[lang].append(k)
    frequent = {lang: frequent_words([rows[k][1] for k in ks]) for lang, ks in by.items() if lang is not None and len(ks) > quality_rules.MIN_SUPPORT}
    hist = {k: histograms(t, frequent[lang]) for k, (lang, t) in rows.items() if lang in frequent}
    refs = {lang: [sum(hist[k][i] for k in by[lang]) for i in (0, 1)] for lang in frequent}
    assert len(refs) >= 2
    for r in quality_rules.judge(df).collect():
        lang, text = rows[r.doc_id]
        for i, got, enough in ((0, r.class_distance, len(text) >= quality_rules.MIN_CHARS), (1, r.word_distance, r.n_words >= quality_rules.MIN_WORDS)):
            assert (got is None) == (not enough or lang not in refs)
            if got is not None:
                h = hist[r.doc_id][i]
                assert abs(got - jensen_shannon(h, refs[lang][i] - h)) < 1e-9
    kept = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert not kept[-1] and not kept[-2] and not kept[-3]


def test_a_row_is_no_reference_of_its_own(spark, docs):
    prose = docs.where("lang = 'en' AND n_chars > 400").select("doc_id", F.lit("zz").alias("lang"), "text").limit(quality_rules.MIN_SUPPORT)
    junk = spark.createDataFrame([(-1, "zz", "| " * 3000)], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in quality_rules.judge(prose.union(junk)).collect()}
    assert len(got) == quality_rules.MIN_SUPPORT + 1 and got[-1].class_distance > 0.5
    # one fewer, and nothing is left to compare with
    assert all(r.class_distance is None for r in quality_rules.judge(prose.limit(quality_rules.MIN_SUPPORT - 1).union(junk)).collect())


LANGUAGES = {
    "ru": "и в не на что он с как это по но они мы из у за дом город человек время работа слово книга дорога вечер стол окно река говорил пришёл увидел большой новый старый",
    "pl": "i w nie na że się z do to jak ale po dom miasto człowiek czas praca słowo książka droga wieczór stół okno rzeka mówił przyszedł zobaczył duży nowy stary źródło łąka",
    "it": "e di che la il un a per non in del le casa città uomo tempo lavoro parola libro strada sera tavolo finestra fiume diceva venne vide grande nuovo vecchio perché",
    "zh": "的 是 在 了 我 有 他 这 们 来 到 说 房子 城市 人们 时间 工作 词语 书本 道路 晚上 桌子 窗户 河流 看见 大的 新的 旧的 山水 朋友",
}


def test_sound_texts_of_any_language_stay(spark):
    rng = random.Random(10)
    rows, junk = [], []
    for k, (lang, words) in enumerate(LANGUAGES.items()):
        words = words.split()
        weights = [1 / (i + 1) for i in range(len(words))]
        text = lambda: ". ".join(" ".join(rng.choices(words, weights, k=rng.randint(6, 14))).capitalize() for _ in range(rng.randint(20, 40)))  # noqa: B023, E731
        rows += [(1000 * k + i, lang, text()) for i in range(60)]
        rows.append((1000 * k + 500, f"{lang}-rare", text()))  # nobody else names it
        junk += [(1000 * k + 900, lang, "".join(rng.choices("{}[]();=+_/\\|<>0123456789 ", k=2000))), (1000 * k + 901, lang, " ".join("".join(rng.choices(string.ascii_letters + string.digits, k=9)) for _ in range(300)))]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows + junk, "doc_id long, lang string, text string")).collect()}
    assert [i for i, *_ in rows if not got[i].kept and not got[i].base_failed] == [] and sum(got[i].kept for i, *_ in rows) > 200
    assert all(not got[i].kept for i, *_ in junk)
    assert all(got[i].word_distance is None for i, lang, _ in rows if lang.endswith("-rare"))


# 9: spans
def test_spans_scores_and_time(spark):
    cases = {
        "ssn 078-05-1120": "national_id:4:15",
        "ssn 000-05-1120, ssn 666-05-1120, ssn 078-00-1120, ssn 912-05-1120": "",
        "number 078-05-1120": "",
        "número de seguridad social 078-05-1120": "national_id:27:38",
        "Kreditkarte 378282246310005": "short_card:12:27",
        "x 378282246310005": "",
        "Konto DE89 3704 0044 0532 0130 00": "iban:6:33",
        "😀😀 mail a@b.cd": "email:8:14",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = pii.find(df)
    got = {r.doc_id: r.spans for r in found.select("doc_id", pii._listed([k.name for k in pii.KINDS]).alias("spans")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    scores = {r.doc_id: [s.score for s in r.email] for r in found.where("doc_id = 7").collect()}
    assert scores == {7: [pytest.approx(1.3)]}
    # many matches in one text: every place as a search gives it
    many = " ".join(f"u{i}@h{i % 7}.example.org" + "é" * (i % 3) for i in range(3000))
    want = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", many)]
    row = pii.find(spark.createDataFrame([(1, many)], "doc_id long, text string")).select("email", "text").first()
    assert [(s.start, s.end) for s in row.email] == want
    clean = pii.redacted(pii.find(spark.createDataFrame([(1, many)], "doc_id long, text string"))).first().text
    assert clean == re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>", many)


# 6: weights
def test_weights_minimise_the_logistic_loss():
    pick = np.random.default_rng(1)
    x, good = pick.normal(size=(400, 5)), pick.random(400) < 0.5
    x[good] += [0.8, -0.5, 0.0, 0.2, 0.0]
    model = quality_rank.fit_pairs(x, good, pairs=5000)
    centre, scale = x.mean(0), x.std(0)
    z = np.clip((x - centre) / scale, -6, 6)
    pick = np.random.default_rng(quality_rank.SEED)
    diff = z[pick.choice(np.flatnonzero(good), 5000)] - z[pick.choice(np.flatnonzero(~good), 5000)]
    w = np.zeros(5)
    for _ in range(20000):  # plain gradient descent on the same pairs
        w += 0.5 * (diff.T @ (1 / (1 + np.exp(diff @ w))) / 5000 - quality_rank.RIDGE * w)
    assert np.abs(model.weights - w).max() < 1e-3


# 4: signatures
def test_recall_of_lines_by_kind(spark):
    pick = random.Random(11)
    cjk = ["".join(chr(pick.randrange(0x4E00, 0x9F00)) for _ in range(pick.randrange(60, 300))) for _ in range(60)]
    urls = ["https://a.example/" + "".join(pick.choices(string.ascii_lowercase + string.digits + "/", k=pick.randrange(80, 200))) for _ in range(60)]
    long = ["".join(pick.choices(string.ascii_letters, k=pick.randrange(300, 900))) for _ in range(60)]
    prose = [" ".join("".join(pick.choices(string.ascii_lowercase, k=pick.randrange(2, 9))) for _ in range(pick.randrange(5, 60))) for _ in range(60)]

    def edited(line):  # a run is replaced, so that the similarity is 0.8 to 0.9
        n = max(1, len(line) * pick.randrange(3, 8) // 100)
        at = pick.randrange(len(line) - n)
        return line[:at] + "".join(pick.choices("QXZJ", k=n)) + line[at + n :]

    def similarity(a, b):
        x, y = ({t.lower()[i : i + 5] for i in range(max(len(t) - 4, 1))} for t in (a, b))
        return len(x & y) / len(x | y)

    for base in (cjk, urls, long, prose):
        near = [edited(x) for x in base]
        rows = [(0, "\n".join(base)), (1, "\n".join(near))]
        got = {r.doc_id: set(r.removed) for r in line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        want = {i for i, (a, b) in enumerate(zip(base, near, strict=True)) if similarity(a, b) >= 0.8}
        assert got[0] == set() and got[1] <= want and len(got[1]) >= 0.95 * len(want) and len(want) > 40


def test_lines_with_one_beginning_do_not_share_cells(spark):
    pick = random.Random(12)
    urls = ["https://example.org/articles/" + "".join(pick.choices(string.ascii_lowercase + string.digits, k=120)) for _ in range(3000)]
    cells = line_dedup.signed(spark.createDataFrame([(u,) for u in urls], "line string")).cache().select(F.explode("bands").alias("cell")).groupBy("cell").count()
    assert cells.agg(F.max("count")).first()[0] < 300 and cells.count() > 20_000


# 7: another tokenizer
def test_other_tokenizers_are_left_to_the_library(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = token_count.load(path)
    assert token_count.specials(tokenizer) is None
    few = docs.limit(40)
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in few.collect()}
    assert {r.doc_id: r.n_tokens for r in token_count.token_counts(few, path).collect()} == want


# SQL of the subpackage
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


# pipeline: the mix and the packing it makes
def test_mix_and_pack_of_the_pipeline(spark, docs):
    import hashlib

    kept = docs.where("doc_id % 3 != 0")
    size = lambda t: len(WORD.findall(t or ""))
    rows = [(r.doc_id, r.source, size(r.text)) for r in kept.collect()]
    goal = {r.source: (r.target, r.source_size) for r in mixing.mix(kept).select("row.source", "target", "source_size").distinct().collect()}
    copies = collections.Counter()
    for source, (target, whole) in goal.items():
        h = lambda v: hashlib.md5((mixing.SEED + str(v)).encode()).hexdigest()
        rate, offset = target / whole if whole else 0.0, int(h("" if source is None else source)[:8], 16) / 2**32
        own = sorted((n, h(d), d) for d, s, n in rows if s == source)
        for i, (_, _, d) in enumerate(own, 1):
            copies[d] = min(3, math.floor(i * rate + offset) - math.floor((i - 1) * rate + offset))
    got = collections.Counter(r.doc_id for r in corpus_pipeline.mix(spark, kept, SF).select("doc_id").collect())
    assert got == +copies
    mixed = corpus_pipeline.mix(spark, kept, SF)
    packed = corpus_pipeline.pack(spark, mixed, SF).collect()
    words = collections.Counter()
    for r in packed:
        words[r.doc_id] += r.n_words
    sizes = {d: n for d, _, n in rows}
    assert words == collections.Counter({d: n * sizes[d] for d, n in got.items()})
    # each shard is what the plain packer makes of its rows
    shards = collections.defaultdict(list)
    for r in packed:
        shards[r.shard].append(r)
    texts = {r.doc_id: r for r in kept.collect()}
    for part in shards.values():
        ids = [r.doc_id for r in part if r.piece == 0]
        plain = [{"doc_id": d, "source": texts[d].source, "size": sizes[d], "cluster": hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d].text or "").encode()).digest()} for d in ids]
        want = sorted((x["doc_id"], x["piece"], x["n_words"], x["bin"], x["offset"]) for x in packing.pack_shard(plain, packing.CAPACITY))
        assert sorted((r.doc_id, r.piece, r.n_words, r.bin, r.offset) for r in part) == want


def test_packing_within_shards_fills_as_one_packing_does(spark, docs):
    """Shards of a hundred rows need few more bins than one packing of all."""
    bins = lambda n: len({(r.shard, r.bin) for r in packing.pack(docs, rows_per_shard=n).collect()})
    assert bins(100) <= 1.1 * bins(10**9)


# 7: pre-tokens of any script
def test_no_script_skips_the_tiers(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = token_count.load(path)
    special = token_count.specials(tokenizer)
    rng = random.Random(7)
    pools = ["abc ABC é“”’—… 123", "дом Дом и Я ё", "漢字かなカナ。、", "αβγ ΑΣς", "İıſKÅ", "á ẹ̈ ́̀", "😀👩‍👩‍👧 🇩🇪", "ا ب ت ١٢٣", "한국어 각 각", "ﬁ ﬃ Ⅻ ²", "\u2003\u3000 \u0085\x1c", "हिन्दी ನಮ"]
    texts = ["".join(rng.choice("".join(rng.sample(pools, 2))) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["It’s “quoted” — привет, 世界!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(df, path).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert all(token_count.pre_tokens(t, special, tokenizer) is not None for t in texts if not any(x in t for x in special))


# 1: classes beyond one bucket, 5: repeats
def test_mixes_of_many_buckets(spark, docs):
    def mix(df, n):
        return {r.id: (r.source_size, r.target, r.size, r.copies) for r in mixing.mix(df, keep=["doc_id"], rows_per_bucket=n).collect()}

    one, many = mix(docs, 50_000), mix(docs, 1)
    assert many == mix(docs.repartition(3), 1) and set(many) == set(one)
    for source_size, target in {x[:2] for x in one.values()}:
        mine = [x for x in many.values() if x[:2] == (source_size, target)]
        assert abs(sum(x[2] * x[3] for x in mine) - target) <= 0.1 * target + 3 * max(x[2] for x in mine)
    assert all(0 <= x[3] <= 3 for x in many.values()) and many != one


def test_repeated_rows_are_dealt_once(spark):
    rows = [(1, "s", "one two three")] * 500 + [(2, "s", "four")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    packed = packing.pack(df, capacity=10, rows_per_shard=50)
    assert packed.count() == len(rows) and packed.select("shard").distinct().count() > 5
    assert "monotonically" not in packed._jdf.queryExecution().optimizedPlan().toString()
