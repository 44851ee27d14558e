"""Knowledge-graph operators over edge tables (s, predicate, o, ...)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entivore.functions.text import ilike, similarity
from entivore.sources.shared import stored


def degrees(edges: DataFrame) -> DataFrame:
    """name, degree: both ends count, a loop twice."""
    return edges.select(F.col("s").alias("name")).unionAll(edges.select(F.col("o").alias("name"))).groupBy("name").agg(F.count("*").alias("degree"))


def neighbourhood(edges: DataFrame, seeds: Sequence[str], depth: int) -> DataFrame:
    """s, o, hop of the distinct edges within depth steps of the seeds, either way; hop is the first that meets the edge.

    The frontier is a DataFrame; a step is a join of edges with the nodes reached so far."""
    edges = edges.select("s", "o").distinct()
    spark = edges.sparkSession
    both = edges.select(F.col("s").alias("node"), F.col("o").alias("to")).unionByName(edges.select(F.col("o").alias("node"), F.col("s").alias("to"))).distinct()
    reached = spark.createDataFrame([(x, 0) for x in seeds], "node string, hop int")
    for k in range(1, depth):
        step = both.join(reached.where(F.col("hop") == k - 1), "node").select(F.col("to").alias("node"), F.lit(k).alias("hop"))
        reached = reached.unionByName(step).groupBy("node").agg(F.min("hop").alias("hop"))
    a = edges.join(reached.select(F.col("node").alias("s"), F.col("hop").alias("hs")), "s", "left").join(reached.select(F.col("node").alias("o"), F.col("hop").alias("ho")), "o", "left")
    return a.where("hs IS NOT NULL OR ho IS NOT NULL").select("s", "o", (F.least("hs", "ho") + 1).alias("hop"))


def paths(edges: DataFrame, start: str, end: str, max_hops: int, limit: int) -> DataFrame:
    """hops, path (nodes joined by '>') of the limit shortest directed simple paths from start to end.

    A path goes on only by nodes from which end is within the hops that remain. Edges and these nodes are stored, so that no step
    finds them anew."""
    edges = stored(edges.select("s", "o").where("s != o").distinct(), "path-edges")
    reach = [edges.sparkSession.createDataFrame([(end,)], "node string")]
    for _ in range(1, max_hops):
        before = edges.join(reach[-1], F.col("o") == F.col("node"), "left_semi").select(F.col("s").alias("node"))
        reach.append(stored(reach[-1].unionByName(before).distinct(), "path-nodes"))
    walk = edges.where(F.col("s") == start).join(reach[max_hops - 1], F.col("o") == F.col("node"), "left_semi").select("o", F.array("s", "o").alias("nodes"))
    found = None
    for k in range(1, max_hops + 1):
        done = walk.where(F.col("o") == end).select(F.lit(k).alias("hops"), F.array_join("nodes", ">").alias("path"))
        found = done if found is None else found.unionByName(done)
        if k < max_hops:
            on = edges.select(F.col("s").alias("from"), F.col("o").alias("to")).join(reach[max_hops - k - 1], F.col("to") == F.col("node"), "left_semi")
            walk = walk.where(F.col("o") != end).join(on, F.col("o") == F.col("from")).where(~F.array_contains("nodes", F.col("to"))).select(F.col("to").alias("o"), F.concat("nodes", F.array("to")).alias("nodes"))
    return found.orderBy("hops", "path").limit(limit)


#: People of one object that are paired in one task.
CROWD = 2_000
#: Deals in one list.
LISTED = 1_000
#: Pairs that a task puts together, about, and the most of one person there.
TASK_PAIRS, HUB = 2_000_000, 8_000_000
#: Pairs whose lists of others a task makes, about.
LIST_PAIRS = 8_000_000
#: Names that are broadcast; more are joined.
MOST_NAMES = 1_000_000


def pairs_of(edges: DataFrame, crowd: int = CROWD) -> DataFrame:
    """person1 < person2 and o, once for each object o that both point to.

    The people of an object that very many point to are dealt to chunks, and its pairs to pairs of chunks, so that a task
    gets no more than two chunks of an object."""
    e = edges.select("s", "o").distinct()
    chunks = e.groupBy("o").agg(F.ceil(F.count("*") / crowd).cast("int").alias("n")).where("n > 1")
    e = e.join(chunks, "o", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("s"), "n").cast("int"))
    # each chunk meets itself and all others, in the order of their numbers
    meets = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    dealt = e.select("s", "o", "own", F.explode(meets).alias("m")).select("s", "o", "own", "m.i", "m.j")
    a, b = (dealt.select(F.col("s").alias(name), F.col("own").alias(own), "o", "i", "j") for name, own in (("person1", "own1"), ("person2", "own2")))
    both = a.join(b, ["o", "i", "j"]).where("person1 < person2 AND (i = j OR own1 != own2)")
    return both.select("person1", "person2", "o")


def _met(edges: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """person1, o, others: each person with those after them in the crowd of an object, by number, so that no row is shuffled for
    a pair; the people (name, id: numbers in the order of names); those with more than HUB others; and how many pairs there are."""
    e = stored(edges.select("s", "o").where("s IS NOT NULL AND o IS NOT NULL").distinct(), "deals")
    people = stored(e.select(F.col("s").alias("name")).distinct().orderBy("name").withColumn("id", F.monotonically_increasing_id()), "people")
    sizes = e.groupBy("o").agg(F.count("*").alias("size"), F.ceil(F.count("*") / crowd).cast("int").alias("n"))
    e = stored(e.join(sizes, "o").join(people, F.col("s") == F.col("name")).select("id", "o", "size", "n"), "numbered-deals")
    hubs = stored(e.groupBy("id").agg(F.sum(F.col("size") - 1).alias("others")).where(F.col("others") > HUB).select("id"), "hubs")
    n_pairs = e.agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("n")).first().n // 2
    dealt = e.withColumn("own", F.pmod(F.xxhash64("id"), "n").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    # lists are far longer than the rows they are made of, so their tasks go by pairs and aren't coalesced by the size of rows
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-n_pairs // LIST_PAIRS))
    dealt = dealt.select("id", "o", "own", F.explode(meets).alias("m")).repartition(tasks, "o", "m").groupBy("o", "m").agg(F.array_sort(F.collect_list(F.struct("id", "own"))).alias("all"))
    after = dealt.select("o", "m", "all", F.posexplode("all").alias("at", "x")).withColumn("rest", F.slice("all", F.col("at") + 2, F.size("all")))
    others = F.when(F.col("m.i") == F.col("m.j"), F.col("rest")["id"]).otherwise(F.filter("rest", lambda y: y["own"] != F.col("x.own"))["id"])
    return after.select(F.col("x.id").alias("person1"), "o", others.alias("others")).where("size(others) > 0"), people, hubs, n_pairs


def _paired(edges: DataFrame, crowd: int, listed: int | None) -> DataFrame:
    """person1, person2, n_shared and, in lists of `listed` at most, part and deals. The people after a person meet in the task that
    the person is dealt to, of which there are as many as the pairs need; people with more than HUB are joined instead."""
    met, people, hubs, n_pairs = _met(edges, crowd)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        rank = None
        if listed:
            known = t["o"].combine_chunks().dictionary_encode()
            order = pc.array_sort_indices(known.dictionary)
            names, rank = known.dictionary.take(order), np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            rank = rank[known.indices.to_numpy()]
            rows = np.argsort(rank, kind="stable")
            t, rank = t.take(pa.array(rows)), rank[rows]
        many = pc.list_value_length(t["others"]).to_numpy()
        one, ones = pd.factorize(t["person1"].to_numpy())
        two, twos = pd.factorize(pc.list_flatten(t["others"]).to_numpy())
        key = np.repeat(one, many) * len(twos) + two
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(np.append(starts, len(key)))
        if listed:
            parts = -(-n // listed)
            part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            starts, key, n = np.repeat(starts, parts) + part * listed, np.repeat(key[starts], parts), np.repeat(n, parts)
        else:
            key = key[starts]
        out = [pa.array(ones[key // len(twos)]), pa.array(twos[key % len(twos)]), pa.array(n)]
        if listed:
            offsets = pa.array(np.append(starts, len(order)), pa.int32())
            out += [pa.array(part, pa.int32()), pa.ListArray.from_arrays(offsets, names.take(pa.array(np.repeat(rank, many)[order])))]
        b = pa.RecordBatch.from_arrays(out, names=["id1", "id2", "n_shared", "part", "deals"][: len(out)])
        yield from (b.slice(i, 10_000) for i in range(0, len(b), 10_000))

    few = hubs.isEmpty()
    light = met if few else met.join(hubs.select(F.col("id").alias("person1")), "person1", "left_anti")
    kinds = "id1 long, id2 long, n_shared long" + (", part int, deals array<string>" if listed else "")
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-n_pairs // TASK_PAIRS))
    out = (light if listed else light.drop("o")).repartition(tasks, "person1").mapInArrow(run, kinds)
    named = F.broadcast(people) if people.count() <= MOST_NAMES else people
    for i in ("1", "2"):
        out = out.join(named.select(F.col("id").alias(f"id{i}"), F.col("name").alias(f"person{i}")), f"id{i}")
    out = out.select("person1", "person2", "n_shared", *(("part", "deals") if listed else ()))
    if few:
        return out
    pairs = pairs_of(edges, crowd).join(people.join(hubs, "id").select(F.col("name").alias("person1")), "person1", "left_semi")
    counts = pairs.groupBy("person1", "person2").agg(F.count("*").alias("n_shared"))
    if not listed:
        return out.unionByName(counts)
    part = F.pmod(F.xxhash64("o"), F.ceil(F.col("n_shared") / listed)).cast("int")
    return out.unionByName(pairs.join(counts, ["person1", "person2"]).groupBy("person1", "person2", "n_shared", part.alias("part")).agg(F.array_sort(F.collect_list("o")).alias("deals")))


def partners(edges: DataFrame, crowd: int = CROWD) -> DataFrame:
    """person1 < person2 and n_shared, the number of objects both point to."""
    return _paired(edges, crowd, None)


def shared_deals(edges: DataFrame, crowd: int = CROWD, listed: int = LISTED) -> DataFrame:
    """person1, person2, n_shared, part, deals: the objects both point to, in order, in lists of about `listed` at most."""
    return _paired(edges, crowd, listed)


def conflicts(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges of one pair and family in the order of by, each against the one before: status new, duplicate or conflict
    (another predicate of the family takes its place). Without a column family all predicates are of one."""
    family = ["family"] if "family" in edges.columns else []
    w = Window.partitionBy("s", "o", *family).orderBy(*by)
    old = F.lag("predicate").over(w)
    status = F.when(F.col("old_predicate").isNull(), "new").when(F.col("old_predicate") == F.col("predicate"), "duplicate").otherwise("conflict")
    return edges.withColumn("old_predicate", old).withColumn("status", status)


#: Losers at one end of edges that are broadcast; more are joined.
FEW_LOSERS = 100_000
#: Edges that a task puts together, about.
TASK_EDGES = 1_000_000


def merged(edges: DataFrame, winners: DataFrame) -> DataFrame:
    """Distinct edges with ends re-pointed by winners (loser, winner); loops go, and so do losers' edges where the winner
    has one of its own of the same family (without that column: the same predicate) to the same end.

    Edges are shuffled for an end at which many losers stand, and once by their new ends, not for each of the steps there."""
    ends = F.explode(F.array(*[F.struct(F.lit(x).alias("end"), F.col(x).alias("loser")) for x in "so"]))
    met = stored(winners.join(edges.select(ends.alias("x")).select("x.*").distinct(), "loser").select("end", "loser", "winner"), "losers")
    many = {r.end: r.n for r in met.groupBy("end").agg(F.count("*").alias("n")).collect()}
    out = edges.select("s", "predicate", F.col("family" if "family" in edges.columns else "predicate").alias("family"), "o")
    for end in "so":
        w = met.where(F.col("end") == end).select(F.col("loser").alias(end), F.col("winner").alias(f"{end}_new"))
        out = out.join(F.broadcast(w) if many.get(end, 0) <= FEW_LOSERS else w, end, "left")
    own = F.col("s_new").isNull() & F.col("o_new").isNull()
    out = out.select(F.coalesce("s_new", "s").alias("s"), "predicate", "family", F.coalesce("o_new", "o").alias("o"), own.alias("own")).where("s != o")
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // TASK_EDGES))
    once = out.repartition(tasks, "s", "o").groupBy("s", "o", "family", "predicate").agg(F.max("own").alias("own"))
    held = F.max("own").over(Window.partitionBy("s", "o", "family")) & F.col("family").isNotNull()
    return once.withColumn("held", held).where("own OR NOT held").select("s", "predicate", "o").distinct()


def merged_entities(entities: DataFrame, winners: DataFrame) -> DataFrame:
    """entities (id, name, aliases, ...) without the losers (loser, winner); a winner's aliases are joined by the names and aliases
    of those that it stands for, each once, in order. Others stay as they are."""
    none = F.array().cast("array<string>")
    lost = entities.join(winners, F.col("id") == F.col("loser")).select(F.col("winner").alias("id"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", none))).alias("alias"))
    gained = lost.where("alias IS NOT NULL").groupBy("id").agg(F.collect_set("alias").alias("_gained"))
    kept = entities.join(winners.select(F.col("loser").alias("id")), "id", "left_anti").join(gained, "id", "left")
    union = F.array_sort(F.array_union(F.coalesce("aliases", none), "_gained"))
    return kept.withColumn("aliases", F.when(F.col("_gained").isNull(), F.col("aliases")).otherwise(union)).drop("_gained")


def with_degree(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits, a page of entities (id, ...), with degree: only edges at them are counted."""
    ids = hits.select(F.col("id").alias("end")).distinct()
    ends = edges.select(F.explode(F.array("s", "o")).alias("end"))
    found = ends.join(F.broadcast(ids), "end", "left_semi").groupBy("end").agg(F.count("*").alias("degree"))
    return hits.join(found, F.col("id") == F.col("end"), "left").drop("end").withColumn("degree", F.coalesce("degree", F.lit(0)))


def searched(entities: DataFrame, edges: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The newest entities (id, name, aliases, description, updated_at) whose name or description holds query or of whose aliases
    one is it, whatever the case, with their degree."""
    low = query.lower()
    hit = ilike(F.col("name"), query) | F.exists("aliases", lambda a: F.lower(a) == low) | ilike(F.col("description"), query)
    page = entities.where(F.coalesce(hit, F.lit(False))).orderBy(F.desc_nulls_first("updated_at"), "id").limit(limit)
    return with_degree(page, edges)


def suggested(entities: DataFrame, edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """id, name, sim, degree of the entities (id, name) most like query, of those that hold it or are somewhat like it; 1 to 50."""
    sim = similarity(F.lower("name"), F.lit(query.lower()))
    near = entities.select("id", "name", sim.alias("sim")).where((F.col("sim") > 0.1) | ilike(F.col("name"), query))
    return with_degree(near.orderBy(F.desc("sim"), "name", "id").limit(min(max(limit, 1), 50)), edges)


def promotable(edges: DataFrame, min_confidence: float, min_sessions: int) -> DataFrame:
    """Subjects whose edges are sure enough and from several sessions: name, avg_conf, sessions."""
    g = edges.groupBy(F.col("s").alias("name")).agg((F.sum(F.col("confidence").cast("decimal(4,2)")) / F.count("*")).cast("double").alias("avg_conf"), F.countDistinct("session").alias("sessions"))
    return g.where((F.col("avg_conf") >= min_confidence) & (F.col("sessions") >= min_sessions)).select("name", F.round("avg_conf", 6).alias("avg_conf"), "sessions")


def find_or_create(names: DataFrame, team: DataFrame, master: DataFrame) -> DataFrame:
    """name, resolution_mode: found in team by key, copied from master, or created; each key once."""
    from entivore.functions.text import normal_key

    once = names.select(normal_key(F.col("name")).alias("key"), "name").groupBy("key").agg(F.min("name").alias("name"))
    t, m = (d.select(normal_key(F.col("name")).alias("key")).distinct().withColumn(x, F.lit(True)) for d, x in ((team, "in_team"), (master, "in_master")))
    out = once.join(t, "key", "left").join(m, "key", "left")
    return out.select("name", F.when(F.col("in_team"), "team").when(F.col("in_master"), "copied").otherwise("created").alias("resolution_mode"))
