"""License scans: an exact set-similarity join of text blocks with license templates.

Words are lower-cased (A-Z) and run together over punctuation and lines, so that wrapped and
differently spaced notices are alike. A block is a window of BLOCK words, one begun every
BLOCK / 2, so that every passage of up to BLOCK / 2 + 1 words lies whole in some block; the
longest template is shorter. A block meets a template when it holds at least PERCENT percent
of the template's distinct words.

The join finds every such pair, and no block is compared with all templates. Words are
ordered by how many blocks of the corpus hold them, rarest first. A template of t words of
which k must be found is listed under its first t - k + 1 words (prefix filter): a block that
misses all of these misses too many. Blocks hold only words of templates after the scan, and
at least k of them (length filter); a word that is the i-th of t here and the j-th of b there
must leave min(t - i, b - j) >= k (positional filter). What passes is counted. Of templates of
one family the one of largest containment labels the block, the longer one where equal.

Licenses named by the phrases of PHRASES are found as well, wherever their words stand
together; they are the base labels, and every other label comes from the join. score is the
largest containment of a matched template, 1 with a base label, 0 without any label.

All is built of Spark's own functions. Texts are read once; what is stored of them is the
template words by block. The order of words comes to the driver: one row for each word of
TEMPLATES. The list under which blocks look for templates is as long as all prefixes.

Cases: null text counts as empty and has no words, labels or places. Very long texts are read
whole, block by block. Repeated rows are scanned each, repeated doc_ids too. Ties of frequency
are broken by the word. An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entivore.llm.common import stored, table

# Phrases that name a license, and its label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Words of public license notices. (label, family, words)
TEMPLATES = (
    ("mit", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("isc", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear"),
    ("apache-2", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "gnu", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl", "gnu", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu", "this work is licensed under the gnu lesser general public license version 3"),
    ("agpl", "gnu", "this work is licensed under the gnu affero general public license version 3"),
    ("mpl-2", "mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "cc", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "cc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "cc", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("unlicense", "public-domain", "this is free and unencumbered software released into the public domain"),
    ("cc0", "public-domain", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)
PERCENT, BLOCK = 85, 64
_GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Words of lower-cased text; bounds and gaps between words.
WORD = f"[^{_GAP}]+"
_HEAD, _TAIL = f"(?<![^{_GAP}])", f"(?![^{_GAP}])"


def _needed(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def _lower(text: Column) -> Column:
    """Lower case for matches with ASCII words: the one other character whose small form is ASCII (the Kelvin sign) stays another."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))


def blocks(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """row, doc_id, n_words, n_base, first_word, last_word, base_labels and blocks: for each window that holds enough of
    them, the distinct words of it that are in templates. row is a number that tells the rows apart, once stored."""
    known = sorted({w for _, _, words in templates for w in words.split()})
    least = min(_needed(len(set(words.split())), percent) for _, _, words in templates)
    df = docs.select("doc_id", _lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("low"))
    df = df.withColumn("words", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))
    stride = block // 2

    def within(k: Column) -> Column:
        return F.array_distinct(F.filter(F.slice("words", k * stride + 1, F.lit(block)), lambda w: w.isin(known)))

    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / stride).cast("int") - 2, F.lit(0))), within)
    n_words = F.size("words").cast("long")
    places = []
    for phrase, label in PHRASES:
        words = phrase.split()
        pattern = _HEAD + f"[{_GAP}]++".join(words) + _TAIL
        gaps = F.when(F.col("low").contains(words[-1]) & F.col("low").contains(words[0]), F.split("low", pattern, -1))
        # the words before the first place, and those behind the last
        ends = F.transform(F.array(gaps), lambda g: F.when(F.size(g) > 1, F.struct((F.size(g) - 1).cast("long").alias("n"), F.regexp_count(F.get(g, F.lit(0)), F.lit(WORD)).cast("long").alias("first"), F.regexp_count(F.element_at(g, -1), F.lit(WORD)).cast("long").alias("behind"))))
        places.append((label, len(words), F.get(ends, F.lit(0)).alias(f"p{len(places)}")))
    df = df.select("doc_id", n_words.alias("n_words"), windows.alias("blocks"), *[p for *_, p in places])
    found = [F.col(f"p{i}") for i in range(len(places))]
    n = sum((F.coalesce(p["n"], F.lit(0)) for p in found), F.lit(0).cast("long"))
    last = [F.col("n_words") - p["behind"] - size for p, (_, size, _) in zip(found, places, strict=True)]
    labels = F.array_compact(F.array(*[F.when(p.isNotNull(), label) for p, (label, *_) in zip(found, places, strict=True)]))
    enough = F.filter("blocks", lambda b: F.size(b) >= least)
    return df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", n.alias("n_base"), F.least(*[p["first"] for p in found]).alias("first_word"), F.greatest(*last).alias("last_word"), F.sort_array(labels).alias("base_labels"), enough.alias("blocks"))


def frequency_order(scanned: DataFrame, templates=TEMPLATES) -> list[str]:
    """The words of templates, the one that the fewest blocks hold first."""
    seen = scanned.select(F.explode("blocks").alias("b")).select(F.explode("b").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    known = {w: 0 for _, _, words in templates for w in words.split()} | {r.w: r.n for r in seen}
    return sorted(known, key=lambda w: (known[w], w))


def matches(scanned: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """row, block, label, family, containment: every block that meets a template, with the best one of each family."""
    order = frequency_order(scanned, templates)
    rank = {w: i for i, w in enumerate(order)}
    listed = []
    for label, family, words in templates:
        own = sorted(set(words.split()), key=rank.__getitem__)
        need = _needed(len(own), percent)
        listed += [(w, label, family, i, need, own) for i, w in enumerate(own[: len(own) - need + 1])]
    prefixes = sorted({x[0] for x in listed})
    # as many rows as the prefixes of the templates
    index = scanned.sparkSession.createDataFrame(listed, "word string, label string, family string, i int, need int, own array<string>")
    here = scanned.select("row", F.posexplode("blocks").alias("block", "words")).withColumn("hits", F.filter("words", lambda w: w.isin(prefixes))).where(F.size("hits") > 0)
    # places in the global order, for blocks that may match only
    places = F.sort_array(F.transform("words", lambda w: F.array_position(F.lit(order), w)))
    here = here.select("row", "block", "words", places.alias("places"), F.explode("hits").alias("word"))
    both = here.join(F.broadcast(index), "word").where(F.size("words") >= F.col("need"))
    j = F.array_position("places", F.array_position(F.lit(order), F.col("word"))) - 1
    both = both.where(F.least(F.size("own") - F.col("i"), F.size("words") - j) >= F.col("need"))
    both = both.withColumn("shared", F.size(F.array_intersect("words", "own"))).where("shared >= need")
    best = F.max(F.struct((F.col("shared") / F.size("own")).alias("containment"), F.size("own").alias("size"), "label")).alias("best")
    return both.groupBy("row", "block", "family").agg(best).select("row", "block", "best.label", "family", "best.containment")


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score for every row of docs (doc_id, text)."""
    longest = max(len(words.split()) for _, _, words in templates)
    if 2 * longest > block + 2:
        raise ValueError(f"blocks of {block} words can't hold a template of {longest}")
    scanned = stored(blocks(docs, templates, percent, block), "license-blocks")
    found = matches(scanned, templates, percent).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    df = scanned.drop("blocks").join(found, "row", "left")
    labels = F.sort_array(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ","))


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql() -> str:
    """Every block against every template, without any filter."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    phrases = " UNION ALL ".join(f"SELECT {_sql_list(p.split())} AS p, '{label}' AS label" for p, label in PHRASES)
    notices = " UNION ALL ".join(f"SELECT {i} AS t, '{label}' AS label, '{family}' AS family, {_sql_list(sorted(set(words.split())))} AS own" for i, (label, family, words) in enumerate(TEMPLATES))
    known = _sql_list(sorted({w for *_, words in TEMPLATES for w in words.split()}))
    half = BLOCK // 2
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS words FROM documents),
phrases AS ({phrases}),
notices AS ({notices}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1] = p[1] AND words[i + 1 : i + len(p)] = p)) AS i FROM d, phrases WHERE len(list_intersect(words, p)) = len(p)),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
windows AS (
  SELECT doc_id, k, list_distinct(list_filter(words[k * {half} + 1 : k * {half} + {BLOCK}], lambda w: list_contains({known}, w))) AS b
  FROM (SELECT doc_id, words, unnest(range(greatest(ceil(len(words) / {half})::BIGINT - 1, 1))) AS k FROM d)),
met AS (
  SELECT doc_id, k, family, max(struct_pack(c := shared / len(own), size := len(own), label := label)) AS best
  FROM (SELECT *, len(list_intersect(b, own)) AS shared FROM windows, notices WHERE len(b) >= 9) WHERE 100 * shared >= {PERCENT} * len(own) GROUP BY ALL),
more AS (SELECT doc_id, list(DISTINCT best.label) AS labels, max(best.c) AS c FROM met GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(more.c, 0)::DOUBLE END AS score
FROM d LEFT JOIN base ON d.doc_id = base.doc_id LEFT JOIN more ON d.doc_id = more.doc_id"""


ORACLE = _sql()
