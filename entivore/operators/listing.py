"""Filters, sorts and pages whose parts are optional, access scopes, and reads by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entivore.functions.text import ilike
from entivore.operators import postings
from entivore.operators.relational import first_per_key


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The row of one key; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def where_given(df: DataFrame, *, search: tuple[str, Sequence[str]] | None = None, least: Mapping | None = None, among: Mapping | None = None, none_of: Mapping | None = None, **equal) -> DataFrame:
    """Rows that meet every condition that is given; those that are None don't count. search: a text and the columns
    of which one must hold it; least: lower bounds; among, none_of: lists of values."""
    for name, value in equal.items():
        df = df if value is None else df.where(F.col(name) == F.lit(value))
    for name, value in (least or {}).items():
        df = df if value is None else df.where(F.col(name) >= F.lit(value))
    for name, values in (among or {}).items():
        df = df if values is None else df.where(F.col(name).isin(*values))
    for name, values in (none_of or {}).items():
        df = df if not values else df.where(~F.col(name).isin(*values))
    if search and search[0] and is_keyword(search[0]):
        hit = F.lit(False)
        for c in search[1]:
            hit = hit | F.coalesce(ilike(F.col(c), search[0]), F.lit(False))
        df = df.where(hit)
    return df


def is_keyword(query: str) -> bool:
    """Whether a query says something: not empty, nor a star or another single sign."""
    q = query.strip()
    return len(q) > 1 or q.isalnum()


def paged(df: DataFrame, allowed: Mapping[str, str], sort: str, direction: str, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in the order of a column of allowed (name asked for: column), nulls last, then by key; limit 0: all that follow.

    Orders that aren't allowed are refused, so callers can't name columns of their own."""
    if sort not in allowed or direction not in ("asc", "desc"):
        raise ValueError(f"no such order: {sort} {direction}")
    c = F.col(allowed[sort])
    out = df.orderBy(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last(), key)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def in_order(df: DataFrame, key: str, wanted: Sequence) -> DataFrame:
    """A row for each of wanted, in its order (position, from 0), found or not."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    asked = spark.createDataFrame(list(enumerate(wanted)), f"position int, asked {kind}")
    # the list is short: the table is searched for it in place, and only what is found meets the list again
    hits = df.join(F.broadcast(asked.select("asked").distinct()), F.col("asked") == F.col(key), "left_semi")
    return asked.join(hits, F.col("asked") == F.col(key), "left").withColumn("found", F.col(key).isNotNull()).drop(key).withColumnRenamed("asked", key)


def accessible(items: DataFrame, members: DataFrame, user) -> DataFrame:
    """items (owner, team, visibility) that user owns, or that a team of the user's (members: user, team) sees."""
    teams = members.where(F.col("user") == F.lit(user)).select(F.col("team").alias("_team")).distinct()
    seen = items.join(teams, F.col("team") == F.col("_team"), "left").withColumn("_mine", F.col("owner") == F.lit(user))
    return seen.where(F.coalesce("_mine", F.lit(False)) | (F.col("_team").isNotNull() & (F.col("visibility") == "team"))).drop("_team", "_mine")


def either_exists(df: DataFrame, key: str, one: DataFrame, other: DataFrame) -> DataFrame:
    """df with in_one, in_other and any: whether its key is in either list."""
    a, b = (x.select(F.col(key).alias(f"_{n}")).distinct() for x, n in ((one, "a"), (other, "b")))
    out = df.join(a, F.col(key) == F.col("_a"), "left").join(b, F.col(key) == F.col("_b"), "left")
    return out.withColumns({"in_one": F.col("_a").isNotNull(), "in_other": F.col("_b").isNotNull(), "any": F.col("_a").isNotNull() | F.col("_b").isNotNull()}).drop("_a", "_b")


def touching(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Edges (s, o) that leave node, enter it, or both."""
    ways = {"outgoing": F.col("s") == node, "incoming": F.col("o") == node, "both": (F.col("s") == node) | (F.col("o") == node)}
    return edges.where(ways[direction])


def due(rows: DataFrame, at: str, now: Column) -> DataFrame:
    """Active rows whose time has come, longest due first."""
    return rows.where(F.col("active") & (F.col(at) <= now))


def own_or_teams(campaigns: DataFrame, user, teams: Sequence) -> DataFrame:
    """Campaigns (owner, team) that are the user's or one of the teams'."""
    return campaigns.where((F.col("owner") == F.lit(user)) | F.col("team").isin(*teams)) if teams else campaigns.where(F.col("owner") == F.lit(user))


def searched_in_scope(campaigns: DataFrame, entities: DataFrame, attributes: DataFrame, programs: DataFrame, query: str, user, teams: Sequence, limit: int = 20) -> DataFrame:
    """category, id, label, hit, rank: what a search box shows, so many of each kind. Campaigns (campaign_id, label, description,
    owner, team, created_at) that the user sees and programs (id, label, description, team, created_at) of the user's teams go by the
    letters; entities and attributes (id, campaign_id, label, description, created_at) of such campaigns by their words (hit: all
    of the query's stems) or by the letters, hits first. Then the newest come first; attributes go by label."""
    own = own_or_teams(campaigns, user, teams)
    like = lambda *columns: reduce(or_, [F.coalesce(ilike(F.col(c), query), F.lit(False)) for c in columns])
    no = F.lit(False)
    found = [("campaigns", own.where(like("label", "description")).select(F.col("campaign_id").alias("id"), "label", no.alias("hit"), "created_at"), [F.desc("created_at"), F.col("id")])]
    for name, rows, order in (("entities", entities, [F.desc("created_at"), F.col("id")]), ("attributes", attributes, [F.col("label"), F.col("id")])):
        seen = rows.join(own.select("campaign_id"), "campaign_id", "left_semi")
        index = postings.build(seen.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "label", "description").alias("text")), postings.english_terms, places=True)
        hits = postings.matching(index, query).select(F.col("doc_id").alias("id"), F.lit(True).alias("hit"))
        both = seen.join(hits, "id", "left").withColumn("hit", F.coalesce("hit", no)).where(F.col("hit") | like("label", "description"))
        found.append((name, both.select("id", "label", "hit", "created_at"), [F.desc("hit"), *order]))
    mine = programs.where(F.col("team").isin(*teams)) if teams else programs.limit(0)
    found.append(("programs", mine.where(like("label", "description")).select("id", "label", no.alias("hit"), "created_at"), [F.desc("created_at"), F.col("id")]))
    pages = [rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(F.lit(name).alias("category"), F.col("id").cast("string").alias("id"), "label", "hit", "rank") for name, rows, order in found]
    return reduce(DataFrame.unionByName, pages)


def newest_each(rows: DataFrame, key: str, at: str, tie: str, limit: int = 50) -> DataFrame:
    """The newest rows of each key; tasks keep no more than that of each before they shuffle."""
    return first_per_key(rows, [key], [f"{at} desc", tie], limit)

