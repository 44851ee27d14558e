"""Quality rules: base limits, then divergence from the language's usual histograms.

Every document gets two histograms: its characters by class (letters of any script among them),
and its words by the COMMON_WORDS most frequent words of the language it names, all others being
one more class. These words are found in the corpus itself, by counts over all documents of the
language. The reference of a language is the sum of the histograms of all other documents that
name it (the judged row is taken away, so it can't make up its own reference), if there are
MIN_SUPPORT of them at least, whatever the language. The distance is the Jensen-Shannon distance
(base 2, 0 to 1). Texts of at least MIN_CHARS characters fail beyond MAX_CLASS_DISTANCE, those of
at least MIN_WORDS words beyond MAX_WORD_DISTANCE; shorter ones are too short to tell, and
documents without a language, or of one that few name, have nothing to be compared with: these
are judged by the base limits only.

All is built of Spark's own functions. Nothing is shuffled but counts of words and sums per
language; repeated three-word windows are found inside a row by sorting their hashes. Words and
references are a row for each language, joined back, by broadcast where they are few.

Cases: null text counts as empty and fails the base limits. A null lang has no reference. Very
long texts are read whole, in time n log n. Repeated rows are judged each, and are each other's
references. Ties of frequency go to the smaller word. An empty table gives an empty result.
Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entivore.llm.common import WORD, small, stored, table

MIN_CHARS, MIN_WORDS = 200, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.26
MIN_SUPPORT = 20
#: Words of each language that are classes of their own.
COMMON_WORDS = 8
#: Languages up to which their words and references are broadcast (a few hundred bytes each), and looked up as one set.
FEW_LANGUAGES = 2_000
#: Character classes in the order in which they are counted and taken away.
CLASSES = (("lower", r"[a-z\p{Ll}\p{Lo}\p{Lm}\p{M}]+"), ("blank", r"[\x20\x09-\x0D]+"), ("upper", r"[A-Z\p{Lu}\p{Lt}]+"), ("digit", r"[0-9\p{Nd}]+"), ("symbol", r"[#*$%&|<>]+"), ("mark", r"[\x21-\x7E\p{P}\p{S}]+"))


def common_words(docs: DataFrame) -> DataFrame:
    """lang, list: the most frequent words of each language that more than MIN_SUPPORT documents name."""
    named = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL")
    known = named.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") > MIN_SUPPORT).select("lang")
    words = named.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # every task keeps the first of each language before they are shuffled
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    first = words.withColumn("place", place).where(F.col("place") <= COMMON_WORDS).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("x"))
    return known.join(first, "lang", "left").select("lang", F.coalesce(F.transform("x", lambda x: x["word"]), F.array().cast("array<string>")).alias("list"))


def measured(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, n_words, the base counts, and the histograms chars and common (null without a list)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    few = lists.limit(FEW_LANGUAGES + 1).collect()
    every = sorted({w for r in few for w in r.list}) if len(few) <= FEW_LANGUAGES else None
    df = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text")).join(small(lists, FEW_LANGUAGES), "lang", "left").withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    left = df.select("doc_id", "lang", "list", "text", "words", F.regexp_replace("text", CLASSES[0][1], "").alias("t0"))
    for i, (_, pattern) in enumerate(CLASSES[1:], 1):
        left = left.withColumn(f"t{i}", F.regexp_replace(f"t{i - 1}", pattern, ""))
    lengths = [F.length("text"), *[F.length(f"t{i}") for i in range(len(CLASSES))]]
    chars = F.array(*[(a - b).cast("long") for a, b in zip(lengths, lengths[1:], strict=False)], lengths[-1].cast("long"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    low = F.transform("words", lambda w: F.lower(w))
    common = F.filter(low, lambda w: w.isin(every)) if every else low if every is None else F.array().cast("array<string>")
    common = F.when(F.col("list").isNotNull(), common)
    n = F.size("words")
    keys = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<long>"))
    df = left.select("doc_id", "lang", "list", n.cast("long").alias("n_words"), chars.alias("chars"), lines.alias("lines"), common.alias("hits"), keys.alias("keys"))
    df = df.withColumn("ordered", F.when(F.size(F.array_distinct("keys")) < F.size("keys"), F.sort_array("keys")).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("double", F.array_distinct(F.filter("ordered", lambda x, i: (i > 0) & (x == F.get("ordered", i - 1)))))
    pairs = F.when(F.size("double") > 32, F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i")))))
    df = df.withColumn("pairs", pairs)
    few = F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: F.array_contains("double", F.get("keys", i)))
    many = F.filter("pairs", lambda p, j: F.coalesce(F.get("pairs", j - 1)["k"] == p["k"], F.lit(False)) | F.coalesce(F.get("pairs", j + 1)["k"] == p["k"], F.lit(False)))
    places = F.when(F.size("double") == 0, F.array().cast("array<int>")).when(F.col("pairs").isNull(), few).otherwise(F.sort_array(F.transform(many, lambda p: p["i"])))
    covered = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    own = F.transform("list", lambda w: F.size(F.filter("hits", lambda x: x == w)).cast("long"))
    return df.select(
        "doc_id",
        "lang",
        "n_words",
        (F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b) - F.get("chars", F.lit(1))).alias("word_chars"),
        F.get("chars", F.lit(4)).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        "chars",
        F.transform(F.array(own), lambda h: F.concat(h, F.array(F.col("n_words") - _total(h))))[0].alias("common"),
    )


def references(df: DataFrame) -> DataFrame:
    """lang, all_chars, all_common: sums of the histograms of each language that has a list of words."""
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(COMMON_WORDS + 1)]
    g = df.where("common IS NOT NULL").groupBy("lang").agg(F.max(F.size("common")).alias("m"), *sums)
    common = F.slice(F.array(*[f"w{i}" for i in range(COMMON_WORDS + 1)]), F.lit(1), F.col("m"))
    return g.select("lang", F.array(*[f"c{i}" for i in range(len(CLASSES) + 1)]).alias("all_chars"), common.alias("all_common"))


def _total(hist) -> Column:
    return F.aggregate(hist, F.lit(0).cast("long"), lambda a, b: a + b)


def _distance(hist: str, reference: Column) -> Column:
    """The Jensen-Shannon distance of two histograms; null if one is empty."""
    # totals are values of their own, made once
    both = F.array(F.struct(F.col(hist).alias("x"), reference.alias("y"), _total(F.col(hist)).alias("n"), _total(reference).alias("m")))

    def whole(b: Column) -> Column:
        def term(x: Column, y: Column) -> Column:
            p, r = x / b["n"], y / b["m"]
            return F.when(p > 0, p * F.log2(2 * p / (p + r))).otherwise(0.0) + F.when(r > 0, r * F.log2(2 * r / (p + r))).otherwise(0.0)

        sum_ = F.aggregate(F.zip_with(b["x"], b["y"], term), F.lit(0.0), lambda a, c: a + c)
        return F.when((b["n"] > 0) & (b["m"] > 0), F.sqrt(F.greatest(sum_, F.lit(0.0)) / 2))

    return F.transform(both, whole)[0]


def _divergence(hist: str, reference: str) -> Column:
    """From the row's own language, less the row itself; null without a reference."""
    less = F.transform(F.array(reference), lambda ref: F.zip_with(ref, F.col(hist), lambda a, b: a - b))[0]
    return F.when(F.col(reference).isNotNull() & F.col(hist).isNotNull(), _distance(hist, less))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance,
    word_distance for every row of docs (doc_id, text, lang). Distances are null where the text is too short, or its
    language has no reference."""
    df = stored(measured(docs, stored(common_words(docs), "rules-words")), "rules-measured")
    df = df.join(small(stored(references(df), "rules-references"), FEW_LANGUAGES), "lang", "left")
    df = df.withColumn("class_distance", F.when(_total("chars") >= MIN_CHARS, _divergence("chars", "all_chars")))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, _divergence("common", "all_common")))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")
