"""Fuzzy deduplication of lines by MinHash.

Lines are compared in lower case with single spaces. A line's set holds the hashes of its
character shingles: all runs of SHINGLE UTF-16 units, whatever the line's length or script.
Each distinct line is signed once by one permutation: its hashes are sorted, and each of
BANDS points, spread evenly over the hash range, takes the ROWS hashes that follow it
(beyond the last, the first). These are the ROWS least values of the hashes counted from
that point, so two lines share a band if the ROWS least of their union are common: for
similarity s with a chance of about s ** ROWS, found by any band with
1 - (1 - s ** ROWS) ** BANDS: 0.986 at 0.8, 0.999 at 0.85. Lines of up to SHORT shingles have
SHORT_BANDS more, of SHORT_ROWS hashes, as a few long windows would hold most of the line.

Lines that share a band are candidates, all pairs of them at once where up to FEW lines share
it. Each line of a band that more share has a parity sketch: WORDS longs, in which every hash of
its set flips one bit. Two sketches differ in no more bits than the sets differ in hashes, so pairs
whose sketches differ in more than similar sets can do are dropped where they meet, without their
texts, and this loses no pair. A band that more than CROWD lines share, as those that begin with
the same words do, says too little even for that: its lines meet by a rare shingle instead.
Shingles of such lines are ordered by how many of them hold each; two similar lines share one of
their rarest, of as many as a line can't miss all of, so this loses no pair either, and lines that
have but the frequent ones in common are never compared. Candidates whose sets have a Jaccard
similarity of 0.8 or more, counted exactly, are linked. A distributed union-find joins links to
components; of each component, and of equal lines, the first line (by doc_id, row and line number)
stays.

All is built of Spark's own functions. Equal lines are summed within the map task, and then
once more; from there on only hashes move, and texts of candidates.

Skew: a hot line is one row after partial sums; a large group of near copies is linked by
rounds of a few comparisons for each line (see common.linked), never by all pairs.

Cases: blank lines are no lines: they stay, and never match. Null text counts as empty and
has none. A null doc_id comes last. Repeated rows: the first row keeps its lines. An empty
table gives an empty result. Very long texts are read whole. Other columns, whatever their
names, pass through cleaned() untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entivore.llm.common import discard, linked, small, stored, table, with_rows

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 14, 6
SHORT, SHORT_BANDS, SHORT_ROWS = 40, 8, 3
#: Lines of a band beyond which their sketches are compared first, and beyond which they meet by rare shingles.
FEW, CROWD = 16, 4000
#: Longs of a line's parity sketch.
WORDS = 8
#: Keys of up to so many rows (about 40 MB) are broadcast; beyond, an ordinary join is used.
BROADCAST_ROWS = 500_000


def _every(line: Column) -> Column:
    """The hashes of the line's shingles, in order, with repeats."""

    def made(units: Column) -> Column:
        # the step is that of the bytes, so that the lambda does no arithmetic
        every = F.transform(F.sequence(F.lit(1), F.length(units) - (2 * SHINGLE - 1), F.lit(2)), lambda i: F.xxhash64(F.substr(units, i, F.lit(2 * SHINGLE))))
        return F.when(F.length(units) < 2 * SHINGLE, F.array(F.xxhash64(units))).otherwise(every)

    # a lambda's argument is a value, made once
    return F.transform(F.array(F.encode(line, "UTF-16BE")), made)[0]


def _lines(docs: DataFrame, *keep: str) -> DataFrame:
    """A row per line of docs: the columns of keep, line_no from 0, and line (normalised; null where blank)."""
    held = docs.select(*keep, F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    odd = F.lit(False)
    for blank in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains("text", F.lit(blank))
    held = held.withColumn("text", F.when(odd, F.regexp_replace("text", r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(F.col("text")))
    split = held.select(*keep, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    return split.select(*keep, "line_no", F.nullif(F.trim("raw"), F.lit("")).alias("line"))


def _keys(line: str) -> list[Column]:
    return [F.xxhash64(F.lit(i), line).alias(f"k{i}") for i in (1, 2)]


def _points(bands: int) -> list[int]:
    return [(b << 64) // bands - (1 << 63) for b in range(bands)]


def _with_points(hashes: Column, bands: int) -> Column:
    return F.concat(hashes, F.array(*[F.lit(p).cast("long") for p in _points(bands)]))


def _places(among: str, bands: int) -> Column:
    """among: distinct hashes and the points, sorted, so that a point's place tells how many hashes precede it: the place of
    the first hash after each point, once the points are taken out."""
    return F.array(*[F.array_position(among, F.lit(p)).cast("int") - b for b, p in enumerate(_points(bands))])


def _bands(places: str, more: str, rows: int, bands: int) -> Column:
    """Hashes of the windows of so many rows after each point; more: the sorted hashes, and the first of them again."""
    return F.array(*[F.xxhash64(F.lit(100 * rows + b), F.slice(more, F.col(places)[b], F.lit(rows))) for b in range(bands)])


def signed(lines: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep, and of the column line: k1, k2, size (of its set) and bands (an array of hashes)."""
    none = F.array().cast("array<long>")
    made = lines.select(*keep, *_keys("line"), F.array_distinct(_every(F.col("line"))).alias("s"))
    made = made.select(*keep, "k1", "k2", F.sort_array("s").alias("s"), F.sort_array(_with_points(F.col("s"), BANDS)).alias("among"), F.when(F.size("s") <= SHORT, F.sort_array(_with_points(F.col("s"), SHORT_BANDS))).alias("few"))
    # a projection with a lambda is compiled apart, in small methods; within the whole stage's one method these steps would be too large for that
    apart = F.transform(F.array("k1"), lambda k: k)[0].alias("k1")
    made = made.select(*keep, apart, "k2", F.size("s").alias("size"), F.concat("s", F.slice("s", 1, ROWS)).alias("more"), _places("among", BANDS).alias("at"), F.when(F.size("s") <= SHORT, _places("few", SHORT_BANDS)).alias("few_at"))
    bands = F.concat(_bands("at", "more", ROWS, BANDS), F.when(F.col("size") <= SHORT, _bands("few_at", "more", SHORT_ROWS, SHORT_BANDS)).otherwise(none))
    return made.select(*keep, apart, "k2", "size", bands.alias("bands"))


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, sa, sb: sizes, la, lb: lines) that reach the similarity. Repeats don't count: an intersection has each hash once."""
    shared = F.size(F.array_intersect(_every(F.col("la")), _every(F.col("lb"))))
    fits = 100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb")
    return pairs.where(fits).where((100 + percent) * shared >= percent * (F.col("sa") + F.col("sb"))).select("a", "b")


def sketches(texts: DataFrame) -> DataFrame:
    """id and bits (WORDS longs, in which each hash of the line's set flips one bit) of texts: id, size, line."""
    hashes = texts.select("id", F.explode(F.array_distinct(_every(F.col("line")))).alias("h")).select("id", F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit"), F.expr(f"pmod(shiftright(h, 6), {WORDS})").alias("w"))
    words = [F.bit_xor(F.when(F.col("w") == i, F.col("bit")).otherwise(0)).alias(f"w{i}") for i in range(WORDS)]
    return hashes.groupBy("id").agg(*words).select("id", F.struct(*[f"w{i}" for i in range(WORDS)]).alias("bits"))


def may_be_similar(percent: int) -> Callable[[str, str], Column]:
    """A condition on rows x and y (size, bits), true for all that reach the similarity: of sets as similar, no more hashes are in one only."""

    def near(x: str, y: str) -> Column:
        differ = sum((F.bit_count(F.col(f"{x}.bits.w{i}").bitwiseXOR(F.col(f"{y}.bits.w{i}"))) for i in range(WORDS)), F.lit(0))
        sizes = F.col(f"{x}.size"), F.col(f"{y}.size")
        return (100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & ((100 + percent) * differ <= (100 - percent) * (sizes[0] + sizes[1]))

    return near


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def by_rare_shingles(crowds: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Cells (cell, id, size) for the ids of crowds: one for each shingle that some of them share and that similar ids can't do
    without. texts: id, size, line."""
    members = crowds.select("id").distinct()
    sets = stored(texts.join(members, "id").select("id", "size", F.explode(F.array_distinct(_every(F.col("line")))).alias("h")), "lines-sets")
    common = sets.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    shared = sets.join(common, "h").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("all"))
    # of size shingles so many may differ; those that no other line holds come first among them
    spare = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.size("all"))
    rare = shared.select(F.explode(F.transform(F.slice("all", F.lit(1), F.greatest(spare, F.lit(0)).cast("int")), lambda x: F.xxhash64(F.lit("rare"), x["h"]))).alias("cell"), "id", "size")
    out = stored(rare.select("cell", "id", "size"), "lines-refined")
    discard(sets)
    return out


def decisions(docs: DataFrame, *, row: Column | None = None, percent: int = PERCENT) -> DataFrame:
    """A row per row of docs (doc_id, text): row, doc_id, n_lines, n_kept, removed (numbers of the lines that go,
    counted from 0). row: a column that tells rows apart; one is made if none is given."""
    row = F.monotonically_increasing_id() if row is None else row
    places = _lines(docs.select("text", "doc_id", row.alias("row")), "row", "doc_id")
    places = stored(places.select("row", "doc_id", "line_no", F.col("line").isNotNull().alias("has"), *_keys("line")), "lines-places")
    lines = _lines(docs.select("text")).where("line IS NOT NULL").groupBy("line").agg(F.count("*").alias("n"))
    lines = stored(signed(lines, "line", "n").select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "n", "size", "bands", "line"), "lines")

    bands = lines.select(F.explode("bands").alias("cell"), "id", "size")
    shared = stored(bands.groupBy("cell").agg(F.count("*").alias("c")).where("c > 1"), "lines-shared")
    cells = stored(bands.join(small(shared, 2 * BROADCAST_ROWS), "cell"), "lines-cells")
    discard(shared)
    texts = stored(lines.select("id", "k1", "k2", "size", "line").join(small(cells.select("id").distinct(), BROADCAST_ROWS), "id"), "lines-texts")
    wanted = texts.select("id", "k1", "k2")

    def verify(pairs: DataFrame, texts: DataFrame = texts) -> DataFrame:
        a, b = (texts.select(F.col("id").alias(x), F.col("size").alias(f"s{x}"), F.col("line").alias(f"l{x}")) for x in "ab")
        return _similar(pairs.join(a, "a").join(b, "b"), percent)

    a, b = (cells.where(F.col("c") <= FEW).select("cell", F.col("id").alias(x), F.col("size").alias(f"s{x}")) for x in "ab")
    fits = 100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb")
    pairs = a.join(b, "cell").where(F.col("a") < F.col("b")).where(fits).select("a", "b").distinct()
    links = stored(verify(pairs), "lines-links")
    many = cells.where(F.col("c") > FEW)
    bits = stored(sketches(texts.join(small(many.select("id").distinct(), BROADCAST_ROWS), "id")), "lines-sketches")
    held, rare = many.where(F.col("c") <= CROWD).select("cell", "id", "size"), None
    if not (crowds := many.where(F.col("c") > CROWD)).isEmpty():
        rare = by_rare_shingles(crowds, texts, percent)
        held = held.unionByName(rare)
    labels = linked(held.join(bits, "id"), lambda pairs: verify(pairs, texts.join(small(_ends(pairs), BROADCAST_ROWS), "id")), links, may_be_similar(percent))
    discard(cells, bits, links, rare)
    fuzzy = wanted.join(labels.withColumnRenamed("node", "id"), "id").select("k1", "k2", "label")
    exact = lines.where("n > 1").select("k1", "k2")
    groups = exact.join(fuzzy, ["k1", "k2"], "full").select("k1", "k2", F.col("label").isNotNull().alias("g0"), F.coalesce("label", "k1").alias("g1"), F.when(F.col("label").isNull(), F.col("k2")).otherwise(F.lit(0)).alias("g2"))
    groups = stored(groups, "lines-groups")
    discard(lines, texts, labels)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line_no")
    copies = stored(places.where("has").join(small(groups, BROADCAST_ROWS), ["k1", "k2"]).select("g0", "g1", "g2", order.alias("at")), "lines-copies")
    discard(groups)
    keep = stored(copies.groupBy("g0", "g1", "g2").agg(F.min("at").alias("keep")), "lines-keep")
    # a hot line's rows stay where they are
    gone = copies.join(small(keep, BROADCAST_ROWS), ["g0", "g1", "g2"]).where("at.row != keep.row OR at.line_no != keep.line_no")
    gone = gone.groupBy(F.col("at.row").alias("row")).agg(F.sort_array(F.collect_list("at.line_no")).alias("removed"))
    counts = places.groupBy("row", "doc_id").agg(F.count(F.when(F.col("has"), 1)).alias("n_lines"))
    out = counts.join(gone, "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return out.select("row", "doc_id", "n_lines", (F.col("n_lines") - F.size("removed")).alias("n_kept"), "removed")


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """docs without the lines that go; the columns of docs."""
    held, mark = with_rows(docs)
    gone = decisions(held, row=F.col(mark), **options).where("n_kept < n_lines").select(F.col("row").alias(f"{mark}at"), F.col("removed").alias(f"{mark}gone"))
    lines = F.split("text", "\n", -1)
    text = F.when(F.col(f"{mark}gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(f"{mark}gone", i)), "\n"))
    return held.join(gone, F.col(mark) == F.col(f"{mark}at"), "left").withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents")).drop("row")
