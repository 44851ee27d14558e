"""Joins of names by their trigrams, through a stored table of trigrams.

The table holds, for each distinct name, its trigrams from the rarest to the most frequent, and
a row for each of them that a match can't do without. Names meet by such a row only if their
numbers of trigrams and the places of the common one leave room for enough common ones; the
first common one alone counts, so that no pair is made twice. Where very many names share a
trigram they are dealt to chunks, and the other side's to all of these, so that no task gets
more than a chunk of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entivore.functions.text import ordered_trigrams, overlap, trigrams
from entivore.sources.shared import stored

#: Names that share a trigram in one chunk.
CHUNK = 5_000


def rarity(*sides: DataFrame) -> DataFrame:
    """g, n: how many names (name, grams) hold each trigram."""
    every = sides[0].select("grams")
    for side in sides[1:]:
        every = every.unionByName(side.select("grams"))
    return every.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"))


def rarest_first(names: DataFrame, counts: DataFrame) -> DataFrame:
    """names (name, grams) with grams from the rarest to the most frequent."""
    ranked = names.select("name", F.explode("grams").alias("g")).join(counts, "g")
    return ranked.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("x")).select("name", F.transform("x", lambda x: x["g"]).alias("grams"))


def needed_of(size: Column, threshold: float) -> Column:
    """How many of a name's trigrams any match has, at least."""
    return F.greatest(F.ceil(size * threshold - 1e-9), F.lit(1)).cast("int")


def listed(names: DataFrame, threshold: float | None) -> DataFrame:
    """A row for each trigram under which a name is found: g, place (from 0), name, grams. With a threshold for the
    beginnings only that a match can't do without."""
    size = F.size("grams")
    own = F.col("grams") if threshold is None else F.slice("grams", F.lit(1), size - needed_of(size, threshold) + 1)
    return names.select("name", "grams", F.posexplode(own).alias("place", "g"))


def met(left: DataFrame, right: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of left and right (from listed) that share g, columns a_ and b_; both sides of a frequent g by chunks."""
    sizes = left.groupBy("g").agg(F.count("*").alias("l")).join(right.groupBy("g").agg(F.count("*").alias("r")), "g")
    hot = sizes.where((F.col("l") > chunk) | (F.col("r") > chunk)).select("g", *[F.ceil(F.col(c) / chunk).cast("int").alias(c) for c in ("l", "r")])
    a = left.select("g", *[F.col(c).alias(f"a_{c}") for c in ("name", "grams", "place")])
    b = right.select("g", *[F.col(c).alias(f"b_{c}") for c in ("name", "grams", "place")])
    # hot trigrams are few: at most the rows of a side over the size of a chunk
    hot = stored(hot, "hot-trigrams")
    if hot.isEmpty():
        return a.join(b, "g")
    some = F.broadcast(hot) if hot.count() <= 100_000 else hot
    one = F.lit(1)

    def dealt(df: DataFrame, own: str, other: str, name: str) -> DataFrame:
        df = df.join(some, "g", "left").withColumn("own", F.pmod(F.xxhash64(name), F.coalesce(own, one)).cast("int"))
        return df.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))).drop("l", "r")

    a = dealt(a, "l", "r", "a_name").withColumnsRenamed({"own": "lc", "other": "rc"})
    b = dealt(b, "r", "l", "b_name").withColumnsRenamed({"own": "rc", "other": "lc"})
    return a.join(b, ["g", "lc", "rc"])


def similar(left: DataFrame, right: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """a, b, sim of the pairs of names (left.a, right.b) whose trigram similarity is threshold or more, which is above 0."""
    named = stored(left.select(F.col("a").alias("name")).distinct().select("name", trigrams(F.col("name")).alias("grams")), "names")
    other = stored(right.select(F.col("b").alias("name")).distinct().select("name", trigrams(F.col("name")).alias("grams")), "names")
    counts = rarity(named, other)
    sides = [stored(listed(rarest_first(side, counts), threshold), "trigrams") for side in (named, other)]
    n, m = F.size("a_grams"), F.size("b_grams")
    # of n and m trigrams so many must be common
    need = F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)
    room = F.least(n - F.col("a_place"), m - F.col("b_place"))
    pairs = met(*sides, chunk).where((n >= threshold * m - 1e-9) & (m >= threshold * n - 1e-9) & (room >= need))
    first = F.array_intersect(_beginning("a_grams", threshold), _beginning("b_grams", threshold))[0] == F.col("g")
    scored = pairs.where(first).select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), overlap(F.col("a_grams"), F.col("b_grams")).alias("sim"))
    return scored.where(F.col("sim") >= threshold)


def _beginning(grams: str, threshold: float) -> Column:
    size = F.size(grams)
    return F.slice(grams, F.lit(1), size - needed_of(size, threshold) + 1)


def best_part(query: Column, text: Column) -> Column:
    """The best similarity of a set of trigrams with a contiguous part of a text's trigrams (ordered, with repeats): parts that
    begin and end at a trigram of the query are enough, as any other only adds trigrams that aren't common."""
    hits = F.filter(F.transform(text, lambda g, i: F.when(F.array_contains(query, g), i)), lambda i: i.isNotNull())
    values = F.array(F.struct(query.alias("q"), text.alias("t"), hits.alias("h")))

    def part(v: Column, i: Column, j: Column) -> Column:
        return overlap(v["q"], F.array_distinct(F.slice(v["t"], i + 1, j - i + 1)))

    def best(v: Column) -> Column:
        each = F.transform(v["h"], lambda i: F.array_max(F.transform(F.filter(v["h"], lambda j: j >= i), lambda j: part(v, i, j))))
        return F.when(F.size(v["h"]) > 0, F.array_max(each)).otherwise(0.0)

    return F.transform(values, best)[0]


def word_similar(left: DataFrame, right: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """a, b, sim of the pairs of names and labels (left.a, right.b) whose word similarity is threshold or more.

    A part of a label that is similar enough holds at least threshold of the name's trigrams, so the label does: labels are
    listed under all their trigrams, names under the rarest, and what has too few in common isn't compared by parts."""
    named = stored(left.select(F.col("a").alias("name")).distinct().select("name", trigrams(F.col("name")).alias("grams")), "names")
    labels = stored(right.select(F.col("b").alias("name")).distinct().select("name", trigrams(F.col("name")).alias("grams")), "names")
    counts = rarity(labels, named)
    names = stored(listed(rarest_first(named, counts), threshold), "trigrams")
    pairs = met(names, listed(labels, None), chunk)
    shared = F.array_intersect("a_grams", "b_grams")
    # the first common one of the name's is always among those it is listed under
    pairs = pairs.withColumn("shared", shared).where((F.col("shared")[0] == F.col("g")) & (F.size("shared") >= needed_of(F.size("a_grams"), threshold)))
    scored = pairs.select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), best_part(F.col("a_grams"), ordered_trigrams(F.col("b_name"))).alias("sim"))
    return scored.where(F.col("sim") >= threshold)
