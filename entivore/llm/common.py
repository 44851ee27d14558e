"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes what stored() wrote for frames that nothing reads any more."""
    for df in frames:
        if df is not None and (path := df.__dict__.get("stored_at")):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def free_name(columns: list[str], name: str) -> str:
    """name, lengthened until no column begins with it in any case: it may be lengthened further and stay free."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, whose name is given too, that tells its rows apart: doc_id where it does, or else a
    number, for which docs are written once so that it stays the same."""
    name = free_name(docs.columns, "_row")
    again = docs.select(F.col("doc_id").alias("i")).groupBy("i").agg(F.count("*").alias("n")).where("n > 1 OR i IS NULL")
    if again.isEmpty():
        return docs.withColumn(name, F.col("doc_id")), name
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _near(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: node and label (the smallest node of its component) for every node of edges (a, b).

    In every round each node points to the neighbour (or itself) that is first by hash, pointers are followed once
    more, and the edges are drawn between what is pointed to; a component of n nodes takes about log n rounds.
    Sums run before shuffles, and nothing but emptiness comes to the driver."""

    def first(v: str) -> Column:
        return F.struct(F.xxhash64(v).alias("h"), F.col(v).alias("v"))

    edges = stored(edges.where("a != b").select("a", "b").distinct(), "cc-edges")
    names = None
    while not edges.isEmpty():
        low = _near(edges).groupBy("u").agg(F.min(first("v")).alias("low"))
        hop = stored(low.select("u", F.least(first("u"), F.col("low"))["v"].alias("p")), "cc-hop")
        hops = stored(hop.join(hop.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p")), "cc-hops")
        discard(hop)
        to = hops.select(F.col("u").alias("node"), F.col("p").alias("label"))
        if names is not None:
            to = names.join(hops, names["label"] == hops["u"], "left").select("node", F.coalesce("p", "label").alias("label"))
        names, old = stored(to, "cc-names"), names
        to = edges.join(hops.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(hops.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        to = stored(to.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        discard(old, hops, edges)
        edges = to
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    least = names.groupBy("label").agg(F.min("node").alias("least"))
    out = stored(names.join(least, "label").select("node", F.col("least").alias("label")), "cc")
    discard(names, edges)
    return out


#: Pairs of different components for each row of a cell, up to which all of them are compared.
CROSS_PAIRS = 2
STAR_ROUNDS = 6
#: Rows of cells that are broadcast for that (about 40 MB).
SMALL_ROWS = 300_000
#: Another round of comparisons with few members follows if one of so many was a link.
MIN_YIELD = 20


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node and label, the smallest node of its component) once the ends of links (a, b) are in one component too."""
    if labels is None:
        return components(links)
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    to = components(ends)
    moved = labels.join(to.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    out = stored(moved.unionByName(to.join(labels.select("node"), "node", "left_anti")), "link-labels")
    discard(labels, to)
    return out


def linked(cells: DataFrame, verify: Callable[[DataFrame], DataFrame], links: DataFrame | None = None, near: Callable[[str, str], Column] = lambda x, y: F.lit(True)) -> DataFrame:
    """node and label for every id that a chain of links leads to another; cells (cell, id, size and what near reads, once each):
    ids that share a cell are candidates if near(x, y), a condition on the rows x and y of both, holds; verify keeps the links
    of pairs (a, b); links: those (a, b) that are known before.

    Rows that are near no row of another component are dropped before each round. A cell of n similar ids has n * n / 2
    links, but n - 1 connect it. While cells hold many pairs of ids in different components, each id is compared with a few members
    only, new ones each round and twice as many, of the largest components of its cells. Then all near pairs that still lie
    in different components are compared, so that no component is missed."""
    own = [c for c in cells.columns if c not in ("cell", "id")]
    partitions = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = None if links is None else components(links)

    def labelled(cells: DataFrame) -> DataFrame:
        if labels is None:
            return cells.withColumn("label", F.col("id"))
        return cells.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))

    def met(here: DataFrame, apart: Callable[[Column, Column], Column], how: str) -> DataFrame:
        """Rows x of here with rows y of their cells that are near and apart; a few rows of large cells can give many pairs: the rows are dealt out first."""
        x, y = here.repartition(partitions, "id").alias("x"), small(here, SMALL_ROWS).alias("y")
        return x.join(y, (F.col("x.cell") == F.col("y.cell")) & apart(F.col("x.label"), F.col("y.label")) & near("x", "y"), how)

    rounds, ranked = 0, None
    for k in range(STAR_ROUNDS + 1):
        here = stored(labelled(cells if ranked is None else ranked), "link-cells")
        near_rows = stored(met(here, lambda x, y: x != y, "left_semi"), "link-near")
        discard(here, ranked)
        here = near_rows
        if ranked is None:
            rank = here.join(here.groupBy("cell").agg(F.count("*").alias("m")), "cell").groupBy("id").agg(F.sum("m").alias("rank"))
            here = stored(here.join(small(rank, SMALL_ROWS), "id"), "link-ranked")
            discard(near_rows)
        ranked = here.drop("label")
        ranked.__dict__["stored_at"] = here.__dict__["stored_at"]
        # members that meet many others first: an original comes before its edited copies
        order = F.xxhash64("id", "cell", F.lit(k)) if k % 2 else F.col("rank")
        parts = here.groupBy("cell", "label").agg(F.count("*").alias("n"), F.max(F.struct(order.alias("o"), "id", *own)).alias("pick"))
        heads = parts.groupBy("cell").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("own"), F.max(F.struct("n", F.col("pick.o").alias("o"), "label", "pick")).alias("head"))
        heads = stored(heads.where("all * all > own").select("cell", "all", ((F.col("all") * F.col("all") - F.col("own")) / 2).alias("pairs"), "head.label", "head.pick.id", *[F.col(f"head.pick.{c}") for c in own]), "link-heads")
        size = heads.agg(F.sum("pairs").alias("pairs"), F.sum("all").alias("rows")).first()
        if not size.pairs:
            discard(heads)
            break
        last = rounds == STAR_ROUNDS or size.pairs <= CROSS_PAIRS * size.rows
        if last:
            pairs = met(here, lambda x, y: x < y, "inner").select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        else:
            stars = here.alias("x").join(heads.alias("y"), (F.col("x.cell") == F.col("y.cell")) & (F.col("x.label") != F.col("y.label")) & near("x", "y"))
            stars = stars.groupBy(F.col("x.id").alias("id"), F.col("y.id").alias("head")).agg(F.count("*").alias("n"))
            best = F.slice(F.sort_array(F.collect_list(F.struct("n", "head")), asc=False), 1, 2**k)
            pairs = stars.groupBy("id").agg(best.alias("best")).select(F.explode("best.head").alias("a"), F.col("id").alias("b"))
        pairs = stored(pairs, "link-pairs")
        found = stored(verify(pairs), "links")
        if n_found := found.count():
            labels = joined(labels, found)
        # where few of the pairs are links, more rounds would change little
        rounds = k + 1 if n_found * MIN_YIELD >= pairs.count() else STAR_ROUNDS
        discard(heads, pairs, found)
        if last:
            break
    discard(ranked)
    return components(cells.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"))) if labels is None else labels
