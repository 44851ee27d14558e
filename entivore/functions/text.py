"""Column expressions on text and time: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles and suffixes that names are compared without (fixed values).
HONORIFICS = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Rev", "Sr", "Jr", "Esq", "II", "III", "IV", "V", "MD", "PhD", "DDS", "DVM", "JD", "CPA")


def ilike(column: Column, needle: str) -> Column:
    """Whether column contains needle, whatever the case; % and _ in it are plain characters."""
    return F.contains(F.lower(column), F.lit(needle.lower()))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the words of text, each padded with two blanks before and one after; sorted."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))))
    return F.array_sort(F.array_distinct(grams))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Shared share of trigrams, 0 to 1."""
    return overlap(trigrams(a), trigrams(b))


def staleness(ts: Column, ref_ts: str) -> Column:
    """fresh within 3 days of ref_ts, warm within 14, stale within 30, else (or null) expired; limits excluded."""
    ref = F.lit(ref_ts).cast("timestamp_ntz")
    tier = F.lit("expired")
    for days, name in ((30, "stale"), (14, "warm"), (3, "fresh")):
        tier = F.when(ts > ref - F.make_dt_interval(F.lit(days)), name).otherwise(tier)
    return tier


def plain_name(name: Column) -> Column:
    """A person's name without titles and suffixes, with single blanks; the case is kept."""
    bare = F.regexp_replace(name, rf"(?i)(?<![A-Za-z])(?:{'|'.join(HONORIFICS)})\.?(?=\s|$)", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def normal_key(label: Column) -> Column:
    return F.lower(F.trim(label))


def claims(text: Column) -> Column:
    """Amounts such as $1,250.5M or 12% as numbers, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\$[0-9][0-9,]*\.?[0-9]*[BMTKbmtk]?|[0-9]+\.?[0-9]*%"), F.lit(0))
    scale = lambda c: F.when(F.upper(F.right(c, F.lit(1))) == "K", 1e3).when(F.upper(F.right(c, F.lit(1))) == "M", 1e6).when(F.upper(F.right(c, F.lit(1))) == "B", 1e9).when(F.upper(F.right(c, F.lit(1))) == "T", 1e12).otherwise(1.0)
    return F.transform(found, lambda c: F.regexp_replace(c, "[^0-9.]", "").try_cast("double") * scale(c))


def result_type(error: Column, matches: Column) -> Column:
    """How an answer is shown: error if there is one, empty without matches, table if the first match has several columns,
    prose if it has places in a text, count if it is the only one and a number, amount or percentage, else list.

    matches: an array of struct<value, columns, places>: value as text, columns and places as their numbers."""
    first = F.get(matches, F.lit(0))
    return (
        F.when(error.isNotNull() & (error != ""), "error")
        .when(F.coalesce(F.size(matches), F.lit(0)) < 1, "empty")
        .when(first["columns"] > 1, "table")
        .when(first["places"] > 0, "prose")
        .when((F.size(matches) == 1) & F.trim(first["value"]).rlike(r"^\$?[0-9,]+\.?[0-9]*\s*[KMBkmb%]?$"), "count")
        .otherwise("list")
    )


def csv_safe(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(value.rlike(r"^[=+\-@|\t]"), F.concat(F.lit("'"), value)).otherwise(value)


def plain_markdown(text: Column) -> Column:
    """Without bold, italics, code marks and link targets."""
    for pattern, to in ((r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]*)`", "$1")):
        text = F.regexp_replace(text, pattern, to)
    return text


def ordered_trigrams(text: Column) -> Column:
    """The trigrams of the words of text in the order in which they come, repeats included."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))))


def word_similarity(query: Column, text: Column) -> Column:
    """The best similarity of query's trigrams with those of a contiguous part of text: for short labels, as its time
    grows with the square of their length."""
    values = F.array(F.struct(trigrams(query).alias("q"), ordered_trigrams(text).alias("t")))

    def best(v: Column) -> Column:
        n = F.size(v["t"])
        part = lambda i, k: overlap(v["q"], F.array_distinct(F.slice(v["t"], i, k)))
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_max(F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: part(i, k))))
        return F.when(n > 0, F.array_max(each)).otherwise(0.0)

    return F.transform(values, best)[0]


def band(value: Column, steps: tuple[tuple[float, str], ...], rest: str) -> Column:
    """The name of the first step (downwards) that value reaches, or rest."""
    out = F.lit(rest)
    for least, name in reversed(steps):
        out = F.when(value >= least, name).otherwise(out)
    return out


CONFIDENCE_BANDS = ((0.85, "high"), (0.6, "medium"))
FILL_BANDS = ((0.8, "full"), (0.5, "half"), (0.3, "thin"))


def cited_urls(text: Column) -> Column:
    """The targets of markdown links, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[.*?\]\((https?://[^)]+)\)"), F.lit(1)))
