"""Searches over documents by indexes made of them, and differences of messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from entivore.functions import english
from entivore.functions import text as X
from entivore.operators import diffs, postings
from entivore.operators.documents import fixed_chunks
from entivore.sources.tables import table

#: What is asked for: words of a passage, and words that stand apart as well.
ASKED = ("onesen erblest it hein", "things and attions", "the erbles")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def q_bm25_top5(spark, sf_dir):
    """The five best documents for every benchmark text."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    return postings.ranked(postings.build(_docs(spark, sf_dir), only=postings.query_terms(asked)), asked)


def q_passage_search(spark, sf_dir):
    """Every document in passages of 400 characters, asked with one of the benchmark texts; at most 1000 characters are read."""
    passages = fixed_chunks(_docs(spark, sf_dir), 400).select(F.col("doc_id").alias("file"), "ix", F.col("chunk").alias("text"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    asked = _docs(spark, sf_dir).select(F.col("doc_id").alias("file"), F.pmod("doc_id", F.lit(40)).alias("item_id")).join(asked, "item_id")
    return postings.in_files(passages, asked, cap=1000).select("item_id", "file", "ix", "score", F.length("text").alias("chars"), "rank")


def q_text_search(spark, sf_dir):
    """Documents that hold all words of what is asked, by their stems, and whether as a phrase."""
    index = postings.build(_docs(spark, sf_dir), postings.english_terms, places=True)
    found = [postings.matching(index, asked).select(F.lit(asked).alias("asked"), "doc_id", "phrase") for asked in ASKED]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def q_hits_first(spark, sf_dir):
    """The first page of documents that are full-text hits or hold the letters: full-text hits first, phrases before others."""
    asked = "attion thing"
    index = postings.build(_docs(spark, sf_dir), postings.english_terms, places=True)
    hits = postings.matching(index, asked).select("doc_id", "phrase", F.lit(True).alias("hit"))
    like = _docs(spark, sf_dir).where(X.ilike(F.col("text"), "hattion")).select("doc_id")
    both = hits.join(like, "doc_id", "full").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("phrase", F.lit(False)).alias("phrase"))
    return both.orderBy(F.desc("hit"), F.desc("phrase"), "doc_id").limit(100)


def q_word_diff(spark, sf_dir):
    """Each message of a conversation against the one before: runs that are the same, removed and added."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.lag("text").over(w).alias("old"), F.col("text").alias("new"))
    return diffs.word_diff(c)


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


def _map(table_: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table_.items()) + "}"


def _ending(endings) -> str:
    return f"regexp_extract(x, '({'|'.join(sorted(endings, key=lambda e: -len(e)))})$')"


_SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
#: From words (w) to stems (w, stem), step by step.
STEMS = rf"""s0 AS (SELECT w, regexp_replace(w, '(^|[aeiouy])y', '\1Y', 'g') AS x FROM words WHERE w NOT IN {_list(english.STOP_WORDS)}),
s1 AS (SELECT w, x, CASE WHEN regexp_matches(x, '^(gener|arsen)') THEN 5 WHEN starts_with(x, 'commun') THEN 6 ELSE length(coalesce(nullif(regexp_extract(x, '^.*?[aeiouy][^aeiouy]'), ''), x)) END AS r1 FROM s0),
s2 AS (SELECT w, x, r1, r1 + length(coalesce(nullif(regexp_extract(substr(x, r1 + 1), '^.*?[aeiouy][^aeiouy]'), ''), substr(x, r1 + 1))) AS r2 FROM s1),
s3 AS (SELECT w, r1, r2, CASE WHEN x LIKE '%sses' THEN left(x, -2) WHEN x LIKE '%ied' OR x LIKE '%ies' THEN CASE WHEN length(x) > 4 THEN left(x, -2) ELSE left(x, -1) END
  WHEN x LIKE '%s' AND x NOT LIKE '%us' AND x NOT LIKE '%ss' AND regexp_matches(left(x, -2), '[aeiouy]') THEN left(x, -1) ELSE x END AS x FROM s2),
s4 AS (SELECT *, {_ending(("eed", "eedly", "ed", "edly", "ing", "ingly"))} AS e, left(x, length(x) - length(e)) AS rest FROM s3),
s5 AS (SELECT w, r1, r2, CASE WHEN e LIKE 'eed%' THEN CASE WHEN length(rest) >= r1 THEN rest || 'ee' ELSE x END WHEN e = '' OR NOT regexp_matches(rest, '[aeiouy]') THEN x
  WHEN regexp_matches(rest, '(at|bl|iz)$') THEN rest || 'e' WHEN regexp_matches(rest, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(rest, -1) WHEN r1 >= length(rest) AND regexp_matches(rest, '{_SHORT}') THEN rest || 'e' ELSE rest END AS x FROM s4),
s6 AS (SELECT w, r1, r2, regexp_replace(x, '^(.+[^aeiouy])[yY]$', '\1i') AS x FROM s5),
s7 AS (SELECT *, {_ending(english.SECOND)} AS e, left(x, length(x) - length(e)) AS rest FROM s6),
s8 AS (SELECT w, r1, r2, CASE WHEN e != '' AND length(rest) >= r1 AND (e != 'ogi' OR rest LIKE '%l') AND (e != 'li' OR regexp_matches(rest, '[cdeghkmnrt]$')) THEN rest || {_map(english.SECOND)}[e] ELSE x END AS x FROM s7),
s9 AS (SELECT *, {_ending(english.THIRD)} AS e, left(x, length(x) - length(e)) AS rest FROM s8),
s10 AS (SELECT w, r1, r2, CASE WHEN e != '' AND length(rest) >= CASE WHEN e = 'ative' THEN r2 ELSE r1 END THEN rest || {_map(english.THIRD)}[e] ELSE x END AS x FROM s9),
s11 AS (SELECT *, {_ending(english.FOURTH)} AS e, left(x, length(x) - length(e)) AS rest FROM s10),
s12 AS (SELECT w, r1, r2, CASE WHEN e != '' AND length(rest) >= r2 AND (e != 'ion' OR regexp_matches(rest, '[st]$')) THEN rest ELSE x END AS x FROM s11),
s13 AS (SELECT w, CASE WHEN x LIKE '%e' AND (length(x) > r2 OR length(x) > r1 AND NOT regexp_matches(left(x, -1), '{_SHORT}')) OR x LIKE '%ll' AND length(x) > r2 THEN left(x, -1) ELSE x END AS x FROM s12),
stems AS MATERIALIZED (SELECT w, CASE WHEN length(w) < 3 THEN w ELSE coalesce({_map(english.IRREGULAR)}[w], CASE WHEN rtrim(w, 's') IN {_list(english.UNCHANGED)} THEN rtrim(w, 's') END, replace(x, 'Y', 'y')) END AS stem FROM s13)"""
_HELD = r"""words_of AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM words_of)"""


def _search(asks) -> str:
    """CTEs that end with hits (asked, doc_id, phrase)."""
    rows = ", ".join(f"('{a}')" for a in asks)
    return rf"""asks AS (SELECT asked, regexp_extract_all(lower(asked), '[\p{{L}}\p{{N}}]+') AS ws FROM (VALUES {rows}) v(asked)), {_HELD},
asked_at AS (SELECT asked, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM asks),
words AS (SELECT w FROM placed UNION SELECT w FROM asked_at), {STEMS},
q AS (SELECT asked, stem, i FROM asked_at JOIN stems USING (w)), d AS (SELECT doc_id, stem, i FROM placed JOIN stems USING (w) WHERE stem IN (SELECT stem FROM q)),
n AS (SELECT asked, count(DISTINCT stem) AS terms, count(*) AS words FROM q GROUP BY 1),
m AS (SELECT asked, doc_id FROM (SELECT asked, doc_id, count(DISTINCT stem) AS c FROM q JOIN d USING (stem) GROUP BY ALL) JOIN n USING (asked) WHERE c = terms),
p AS (SELECT DISTINCT asked, doc_id FROM (SELECT asked, doc_id, d.i - q.i AS start, count(*) AS c FROM q JOIN d USING (stem) GROUP BY ALL) JOIN n USING (asked) WHERE c = words),
hits AS (SELECT m.asked, m.doc_id, p.doc_id IS NOT NULL AS phrase FROM m LEFT JOIN p ON p.asked = m.asked AND p.doc_id = m.doc_id)"""


_SPLIT = r"list_filter(regexp_split_to_array(lower({}), '[\x20\x09-\x0D]+'), lambda w: w != '')"
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_bm25_top5": rf"""WITH d AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS t FROM documents), n AS (SELECT count(*) AS n_docs, sum(len(t)) / count(*) AS avg_len FROM d),
q AS (SELECT DISTINCT item_id, unnest({_SPLIT.format("text")}) AS term FROM benchmark),
h AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg_len))), 6) AS score FROM q JOIN h USING (term) JOIN f USING (term) JOIN d USING (doc_id) CROSS JOIN n GROUP BY ALL)
SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM s QUALIFY rank <= 5""",
    "q_passage_search": rf"""WITH c AS (SELECT doc_id, ix, substr(text, ix * 400 + 1, 400) AS text FROM (SELECT doc_id, text, unnest(range(((length(text) + 399) // 400)::BIGINT))::INT AS ix FROM documents WHERE text != '')),
t AS (SELECT doc_id, ix, length(text) AS chars, {_SPLIT.format("text")} AS t FROM c), n AS (SELECT doc_id, count(*) AS n, greatest(sum(len(t)), 1) / count(*) AS avg_len FROM t GROUP BY 1),
q AS (SELECT DISTINCT doc_id, item_id, unnest({_SPLIT.format("b.text")}) AS term FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40),
h AS (SELECT doc_id, ix, term, count(*) AS tf FROM (SELECT doc_id, ix, unnest(t) AS term FROM t) JOIN q USING (doc_id, term) GROUP BY ALL), f AS (SELECT doc_id, term, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT h.doc_id, h.ix, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg_len))), 6) AS score FROM h JOIN f ON f.doc_id = h.doc_id AND f.term = h.term JOIN t ON t.doc_id = h.doc_id AND t.ix = h.ix JOIN n ON n.doc_id = h.doc_id GROUP BY ALL),
a AS (SELECT t.doc_id, t.ix, t.chars, n.n, coalesce(score, 0.0) AS score, max(coalesce(score, 0.0)) OVER (PARTITION BY t.doc_id) AS best FROM t JOIN n ON n.doc_id = t.doc_id LEFT JOIN s ON s.doc_id = t.doc_id AND s.ix = t.ix),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n <= 3 THEN 0 ELSE -score END, ix) AS rank FROM a WHERE n <= 3 OR best = 0 OR score > 0 QUALIFY n <= 3 OR rank <= 5),
k AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id % 40 AS item_id, doc_id AS file, ix::INT AS ix, score::DOUBLE AS score, least(chars, 1000 - before)::INT AS chars, rank::INT AS rank FROM k WHERE before < 1000""",
    "q_text_search": f"WITH {_search(ASKED)} SELECT asked, doc_id, phrase FROM hits",
    "q_hits_first": f"WITH {_search(('attion thing',))}, l AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'hattion')) SELECT coalesce(h.doc_id, l.doc_id) AS doc_id, h.doc_id IS NOT NULL AS hit, coalesce(phrase, false) AS phrase FROM hits h FULL JOIN l ON h.doc_id = l.doc_id ORDER BY hit DESC, phrase DESC, 1 LIMIT 100",
}
