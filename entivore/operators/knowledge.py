"""What is known of entities: lookups by team and age, comparisons side by side, counts of campaigns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entivore.functions.text import staleness
from entivore.operators.listing import in_order
from entivore.operators.relational import highlights

PAIR = ["gwm_id", "attribute_label"]
#: Tiers young enough to be used.
HITS = ("fresh", "warm")


def _asked(pairs: DataFrame) -> DataFrame:
    """Each pair once; those whose gwm_id is missing or blank are no questions."""
    return pairs.where(F.col("gwm_id").rlike(r"\S")).select(*PAIR).distinct()


def staleness_map(pairs: DataFrame, known: DataFrame, team: str | None, now: str, order: Sequence[str] = ()) -> DataFrame:
    """gwm_id, attribute_label, tier, cached: for each pair asked the age of the best that is known, and that row if it is
    fresh or warm, else null. The team's own rows come before those of all (team null), then the newest, then what is
    largest in the columns of order; without a team, rows of all count only. A pair nothing is known of is expired.

    Both sides meet by the pair, and each pair's rows are folded where they meet: one shuffle, no sort of a pair's rows."""
    own = F.lit(False) if team is None else F.col("team") == team
    seen = known.where(F.col("team").isNull() | own)
    values = [c for c in known.columns if c not in PAIR]
    found = _asked(pairs).join(seen, PAIR, "left")
    best = found.groupBy(*PAIR).agg(F.max_by(F.struct(*values), F.struct(F.coalesce(own, F.lit(False)).alias("own"), "last_updated", *order)).alias("best"))
    tier = staleness(F.col("best.last_updated"), now)
    return best.select(*PAIR, tier.alias("tier"), F.when(tier.isin(*HITS), F.col("best")).alias("cached"))


def lookup(pairs: DataFrame, known: DataFrame, team: str, now: str, order: Sequence[str] = ()) -> DataFrame:
    """The pairs whose best row is fresh or warm, with that row's columns and its tier."""
    hits = staleness_map(pairs, known, team, now, order).where("cached IS NOT NULL")
    return hits.select(*PAIR, "cached.*", "tier")


def lookup_young(pairs: DataFrame, known: DataFrame, now: str, max_age_hours: float = 168) -> DataFrame:
    """The rows of known that are asked for and younger than so many hours, whatever their team."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_hours * 3600))
    return known.where(F.col("last_updated") > since).join(_asked(pairs), PAIR, "left_semi")


def known_of(entities: DataFrame, known: DataFrame, now: str) -> DataFrame:
    """campaign_id and what is known, with its tier, of each campaign's entities (campaign_id, gwm_id)."""
    of = entities.where("gwm_id IS NOT NULL").select("campaign_id", "gwm_id").distinct()
    return known.join(of, "gwm_id").withColumn("tier", staleness(F.col("last_updated"), now))


def compared(entities: DataFrame, attributes: DataFrame, latest: DataFrame, wanted: Sequence) -> DataFrame:
    """A row for each attribute and each of two to five entities (wanted, repeats left out) with position, the attribute's
    columns, the entity's label, its latest finding (null if there is none), and is_best and is_worst.

    Another number of entities is a ValueError, one that isn't there a LookupError that names it. latest: entity_id,
    attribute_id, present, confidence, once for each pair."""
    ids = list(dict.fromkeys(wanted))
    if not 2 <= len(ids) <= 5:
        raise ValueError(f"two to five different entities are compared, not {len(ids)}")
    asked = in_order(entities.select("entity_id", "label"), "entity_id", ids).collect()  # five rows at most
    missing = [r.entity_id for r in asked if not r.found]
    if missing:
        raise LookupError(f"no such entities: {missing}")
    kind = entities.schema["entity_id"].dataType
    columns = F.array(*[F.struct(F.lit(r.position).alias("position"), F.lit(r.entity_id).cast(kind).alias("entity_id"), F.lit(r.label).alias("entity_label")) for r in sorted(asked)])
    grid = attributes.select("*", F.inline(columns))
    shown = highlights(latest.where(F.col("entity_id").isin(*ids)))
    out = grid.join(shown, ["attribute_id", "entity_id"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_best", "is_worst")})


def with_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """parents with the number of rows of each of children (by name) that hold its key, 0 if none; counted before they meet."""
    for name, rows in children.items():
        parents = parents.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parents


def totals(counts: Mapping[str, DataFrame], distinct: Mapping[str, tuple[DataFrame, Sequence[Column]]]) -> DataFrame:
    """One row: how many rows each of counts has, and how many different values each of distinct has."""
    rows = [df.agg(F.count("*").alias(name)) for name, df in counts.items()]
    rows += [df.select(*columns).distinct().agg(F.count("*").alias(name)) for name, (df, columns) in distinct.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.join(F.broadcast(row))
    return out


def effective_weights(attributes: DataFrame, links: DataFrame) -> DataFrame:
    """campaign_id, attribute_id, weight, overridden: of each link (campaign_id, attribute_id, weight_override) its own weight,
    else the attribute's (attribute_id, weight), else 1."""
    both = links.join(attributes.select("attribute_id", "weight"), "attribute_id", "left")
    return both.select("campaign_id", "attribute_id", F.coalesce("weight_override", "weight", F.lit(1.0)).alias("weight"), F.col("weight_override").isNotNull().alias("overridden"))


def once_across(shares: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """session, sid, display_name: the members (team, sid) of all teams that a session is shared with (session, team), once each."""
    of = shares.select("session", "team").distinct().join(members.select("team", "sid").distinct(), "team").select("session", "sid").distinct()
    return of.join(users.select("sid", "display_name"), "sid").select("session", "sid", "display_name")
