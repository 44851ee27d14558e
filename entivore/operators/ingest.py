"""Taking entities and edges into a team's graph, and from there into the shared (master) graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entivore.functions import ontology
from entivore.functions.text import normal_key


def contexts_conflict(a: Column, b: Column) -> Column:
    """Whether two descriptions are of different things: both have words of more than three letters, and share none."""

    def long_words(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda w: F.length(w) > 3))

    one, two = long_words(a), long_words(b)
    return (F.size(one) > 0) & (F.size(two) > 0) & ~F.arrays_overlap(one, two)


def merged_aliases(*lists: Column) -> Column:
    """The distinct names of all lists, sorted; nulls and blanks go."""
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != ""))))


def resolved(requests: DataFrame, team: DataFrame, master: DataFrame) -> DataFrame:
    """key, mode, entity_id, aliases, context: where each asked name (requests: request_id, name, aliases, context) is
    found: team_hit by name, team_alias_hit unless contexts conflict, master_copy by name, else created (no id yet).

    A name that is asked for more than once is asked with the aliases of all and the first context that isn't blank.
    team, master: entity_id, name, aliases, context."""
    asked = requests.withColumn("key", normal_key(F.col("name"))).groupBy("key").agg(
        F.flatten(F.collect_list("aliases")).alias("more"), F.min(F.when(F.coalesce("context", F.lit("")) != "", F.struct("request_id", "context")))["context"].alias("ctx")
    )

    def side(df: DataFrame, tag: str, key: Column) -> DataFrame:
        one = df.select(key.alias(f"{tag}_key"), F.struct("entity_id", "aliases", "context").alias(tag))
        return one.groupBy(f"{tag}_key").agg(F.min_by(tag, f"{tag}.entity_id").alias(tag))

    named = side(team, "t", normal_key(F.col("name")))
    aliased = side(team.withColumn("_alias", F.explode("aliases")), "a", F.lower("_alias"))
    shared = side(master, "m", normal_key(F.col("name")))
    out = asked.join(named, F.col("key") == F.col("t_key"), "left").join(aliased, F.col("key") == F.col("a_key"), "left").join(shared, F.col("key") == F.col("m_key"), "left")
    by_alias = F.col("a").isNotNull() & ~contexts_conflict(F.col("ctx"), F.col("a.context"))
    mode = F.when(F.col("t").isNotNull(), "team_hit").when(by_alias, "team_alias_hit").when(F.col("m").isNotNull(), "master_copy").otherwise("created")
    out = out.withColumn("mode", mode)
    held = F.when(F.col("mode") == "team_hit", F.col("t")).when(F.col("mode") == "team_alias_hit", F.col("a")).when(F.col("mode") == "master_copy", F.col("m"))
    out = out.withColumn("held", held)
    context = F.coalesce(F.nullif(F.col("held.context"), F.lit("")), F.col("ctx"), F.lit(""))
    return out.select("key", "mode", F.when(F.col("mode") != "master_copy", F.col("held.entity_id")).alias("entity_id"), merged_aliases(F.col("held.aliases"), F.col("more")).alias("aliases"), context.alias("context"))


def edge_outcomes(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """edges (s, o, family, canonical, keep, symmetric, ...) with outcome, in the order of by:

    unknown (no canonical predicate), irrelevant (not sure enough), loop, new, duplicate, or conflict (another
    predicate of the family was active: it is replaced). A symmetric predicate is the same edge from either end."""
    turned = F.coalesce("symmetric", F.lit(False)) & (F.col("s") > F.col("o"))
    e = edges.withColumns({"_s": F.when(turned, F.col("o")).otherwise(F.col("s")), "_o": F.when(turned, F.col("s")).otherwise(F.col("o"))})
    checked = F.when(F.col("canonical").isNull(), "unknown").when(~F.col("keep"), "irrelevant").when(F.col("s") == F.col("o"), "loop")
    e = e.withColumn("outcome", checked)
    w = Window.partitionBy("_s", "_o", "family").orderBy(*by)
    kept = e.where("outcome IS NULL").withColumn("_old", F.lag("canonical").over(w))
    kept = kept.withColumn("outcome", F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("canonical"), "duplicate").otherwise("conflict"))
    return kept.select(*edges.columns, F.col("_old").alias("replaces"), "outcome").unionByName(e.where("outcome IS NOT NULL").select(*edges.columns, F.lit(None).cast("string").alias("replaces"), "outcome"))


def active_edges(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """The edges that are active after all outcomes: of each pair and family the last new one or conflict."""
    turned = F.coalesce("symmetric", F.lit(False)) & (F.col("s") > F.col("o"))
    e = outcomes.where("outcome IN ('new', 'conflict')").withColumns({"_s": F.when(turned, F.col("o")).otherwise(F.col("s")), "_o": F.when(turned, F.col("s")).otherwise(F.col("o"))})
    last = F.row_number().over(Window.partitionBy("_s", "_o", "family").orderBy(*[F.col(c).desc() for c in by]))
    return e.withColumn("_last", last).where("_last = 1").drop("_last", "_s", "_o")


def counters(outcomes: DataFrame) -> DataFrame:
    """One row: how many edges had each outcome."""
    names = ("new", "duplicate", "conflict", "unknown", "irrelevant", "loop")
    return outcomes.agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def relevance(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """entity, kind, high, medium, score, keep for every entity of kinds (entity, kind) by the signals of its edges (s, o, signal)."""
    ends = edges.select(F.col("s").alias("entity"), "signal").unionAll(edges.where("s != o").select(F.col("o").alias("entity"), "signal"))
    n = ends.groupBy("entity").agg(F.count_if(F.col("signal") == "high").alias("high"), F.count_if(F.col("signal") == "medium").alias("medium"), F.count_if(F.col("signal") == "low").alias("low"))
    out = kinds.join(n, "entity", "left").fillna(0, ["high", "medium", "low"])
    score = ontology.relevance(F.col("kind"), F.col("high"), F.col("medium"), (F.col("low") > 0) & (F.col("high") + F.col("medium") == 0))
    return out.select("entity", "kind", "high", "medium", F.round(score, 6).alias("score")).withColumn("keep", F.col("kind").isin(*ontology.TYPE_FLOORS) & (F.col("score") >= ontology.KEEP_ENTITY))


def promoted(team: DataFrame, master: DataFrame) -> DataFrame:
    """The master's entities after team's are promoted (name, aliases, description, metadata): found by name, aliases
    are joined, a description that is there stays, and the team's metadata win; others are added."""
    t = team.select(normal_key(F.col("name")).alias("key"), F.struct("name", "aliases", "description", "metadata").alias("t"))
    m = master.select(normal_key(F.col("name")).alias("key"), F.struct("name", "aliases", "description", "metadata").alias("m"))
    j = t.join(m, "key", "full")
    empty = F.create_map().cast("map<string,string>")
    right = F.coalesce("t.metadata", empty)
    left = F.map_filter(F.coalesce("m.metadata", empty), lambda k, v: ~F.map_contains_key(right, k))
    return j.select(
        F.coalesce("m.name", "t.name").alias("name"),
        merged_aliases(F.col("m.aliases"), F.col("t.aliases")).alias("aliases"),
        F.coalesce(F.nullif(F.col("m.description"), F.lit("")), F.col("t.description"), F.lit("")).alias("description"),
        F.map_concat(left, right).alias("metadata"),
        F.when(F.col("m").isNull(), "added").when(F.col("t").isNull(), "kept").otherwise("merged").alias("outcome"),
    )


def promoted_edges(edges: DataFrame, mapping: DataFrame, master: DataFrame, least: float = 0.85) -> DataFrame:
    """s, predicate, o (in the master's ids) and outcome of the sure edges both of whose ends are mapped (id, master_id):
    skipped (the master has it), superseding (it has another of the family) or added. master: s, o, family, predicate."""
    of = lambda end: mapping.select(F.col("id").alias(end), F.col("master_id").alias(f"m_{end}"))
    e = edges.where(F.col("confidence") >= least).join(of("s"), "s").join(of("o"), "o").where("m_s != m_o")
    e = e.select(F.col("m_s").alias("s"), F.col("m_o").alias("o"), "family", "predicate").distinct()
    held = master.groupBy("s", "o", "family").agg(F.collect_set("predicate").alias("held"))
    out = e.join(held, ["s", "o", "family"], "left")
    return out.select("s", "predicate", "o", F.when(F.col("held").isNull(), "added").when(F.array_contains("held", F.col("predicate")), "skipped").otherwise("superseding").alias("outcome"))


def synced(team: DataFrame, master: DataFrame) -> DataFrame:
    """team (entity_id, master_id, name, description) with name and description of the master's entity, where it has one."""
    m = master.select(F.col("entity_id").alias("_m"), F.col("name").alias("_name"), F.col("description").alias("_description"))
    return team.join(m, F.col("master_id") == F.col("_m"), "left").select("entity_id", "master_id", F.coalesce("_name", "name").alias("name"), F.coalesce("_description", "description").alias("description"), F.col("_m").isNotNull().alias("synced"))


def within_team(edges: DataFrame, teams: DataFrame) -> DataFrame:
    """edges (s, o) with ok: whether both ends are of one team (teams: entity, team)."""
    of = lambda end: teams.select(F.col("entity").alias(end), F.col("team").alias(f"_{end}"))
    return edges.join(of("s"), "s", "left").join(of("o"), "o", "left").withColumn("ok", F.coalesce(F.col("_s") == F.col("_o"), F.lit(False))).drop("_s", "_o")


def explored(edges: DataFrame, start: str, depth: int, per_hop: int) -> DataFrame:
    """s, o, hop of the edges met from start, either way, at most per_hop new ones a hop (the first by s and o); only ends
    that weren't visited go on."""
    spark = edges.sparkSession
    edges = edges.select("s", "o").distinct()
    front = spark.createDataFrame([(start,)], "node string")
    seen, met = front, None
    for hop in range(1, depth + 1):
        out = edges.join(front.select(F.col("node").alias("s")), "s", "left_semi").unionByName(edges.join(front.select(F.col("node").alias("o")), "o", "left_semi")).distinct()
        out = out if met is None else out.join(met.select("s", "o"), ["s", "o"], "left_anti")
        out = out.orderBy("s", "o").limit(per_hop).withColumn("hop", F.lit(hop))
        met = out if met is None else met.unionByName(out)
        ends = out.select(F.col("s").alias("node")).unionByName(out.select(F.col("o").alias("node"))).distinct()
        front = ends.join(seen, "node", "left_anti")
        seen = seen.unionByName(front)
    return met
