"""The ontology of relationships as tables, and the rules that hold raw ones against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Families in the order in which they are searched; predicates with their signal; least confidences;
# spellings of predicates; suffixes that are stripped from unknown ones.
FAMILIES = ("ownership", "investment", "role", "deal_network", "life_event", "affinity", "location")
PREDICATES = {
    "ownership": {"owns": "high", "minority_stake_in": "high", "co_owns": "high", "formerly_owned": "medium", "controls": "high", "subsidiary_of": "medium"},
    "investment": {"invested_in": "high", "lp_in": "high", "gp_of": "high", "co_invested_with": "high", "donated_to": "medium", "exited": "high"},
    "role": {"ceo_of": "high", "board_member_of": "high", "founded": "high", "executive_at": "medium", "advisor_to": "medium", "plays_for": "medium", "coaches": "low"},
    "deal_network": {"partnered_on_deal": "high", "bid_for": "high", "merged_with": "high", "competes_with": "low", "sponsors": "medium", "endorsed_by": "medium"},
    "affinity": {"fan_of": "medium", "attended_event": "low", "played_sport": "medium", "named_in_honor_of": "low"},
    "life_event": {"married": "high", "divorced": "high", "inherited_from": "high", "succession_from": "high"},
    "location": {"headquartered_in": "medium", "resides_in": "medium", "operates_in": "low", "plays_in": "low"},
}
SYMMETRIC = ("co_owns", "co_invested_with", "partnered_on_deal", "merged_with", "competes_with")
LEAST = {
    ("ownership", "high"): 0.50,
    ("investment", "high"): 0.50,
    ("role", "high"): 0.55,
    ("deal_network", "high"): 0.55,
    ("life_event", "high"): 0.60,
    ("ownership", "medium"): 0.70,
    ("investment", "medium"): 0.70,
    ("role", "medium"): 0.70,
    ("deal_network", "medium"): 0.70,
    ("affinity", "medium"): 0.75,
    ("location", "medium"): 0.65,
    ("life_event", "medium"): 0.70,
}
DROPPED = (("role", "low"), ("deal_network", "low"), ("affinity", "low"), ("location", "low"))
FLOOR, DEFAULT_LEAST = 0.50, 0.70
SPELLINGS = {
    "ownership": {
        "owns": ["buys", "bought", "purchased", "acquires", "acquired", "has_ownership", "is_owner_of", "owner_of", "takes_ownership", "takes_over", "completes_acquisition", "acquires_team", "buys_team", "purchases_team"],
        "minority_stake_in": ["minority_owns", "minority_owner", "partial_owner", "holds_stake", "lp_in", "limited_partner_in", "invested_equity_in"],
        "co_owns": ["co_owner", "co_owner_of", "joint_owner", "majority_owns"],
        "controls": ["controlling_owner", "controlling_interest_in", "voting_control_of"],
        "formerly_owned": ["previously_owned", "sold_stake_in", "divested"],
        "subsidiary_of": ["parent_of", "parent_company_of", "holding_company_of", "owned_by", "belongs_to"],
    },
    "investment": {
        "invested_in": ["invests_in", "investor_in", "backed", "funded", "financed", "committed_capital_to", "acquired_stake_in", "put_money_into", "writing_check_into", "deployed_capital_in"],
        "lp_in": ["limited_partner_in", "lp_commitment_in", "fund_investor_in"],
        "gp_of": ["general_partner_of", "fund_manager_of", "manages_fund", "runs_fund"],
        "co_invested_with": ["co_invest_with", "co_investor_with", "coinvested_with", "joint_investor_with", "syndicate_partner_with"],
        "donated_to": ["contributed_to", "gifted_to", "supports_foundation"],
        "exited": ["sold", "sold_stake", "ipo", "took_public", "completed_exit", "realized_investment", "sold_to", "divested_from"],
    },
    "role": {
        "ceo_of": ["chief_executive_of", "leads", "heads", "runs", "president_of", "managing_director_of", "md_of"],
        "board_member_of": ["on_board_of", "director_of", "board_director_of", "board_chair_of", "chairman_of", "trustee_of"],
        "founded": ["founder_of", "co_founded", "co_founder_of", "started", "established"],
        "executive_at": ["works_for", "employed_by", "coo_of", "cfo_of", "vp_of", "svp_of", "partner_at", "senior_partner_at", "managing_partner_at"],
        "advisor_to": ["advises", "advisory_board_of", "strategic_advisor_to"],
        "plays_for": ["athlete_at", "plays_on", "signed_with", "drafted_by"],
        "coaches": ["head_coach_of", "coached_by", "assistant_coach_of"],
    },
    "deal_network": {
        "partnered_on_deal": ["partnered_with_on_deal", "co_investor_in_deal", "joint_venture_with", "jv_with", "syndicated_with", "clubbed_with"],
        "bid_for": ["bid_on", "submitted_bid_for", "loi_for", "letter_of_intent_for", "made_offer_for", "attempted_to_acquire", "failed_bid_for"],
        "merged_with": ["merges_with", "merger_with", "combined_with"],
        "competes_with": ["rival_of", "competitor_of", "competes_against"],
        "sponsors": ["sponsored_by", "title_sponsor_of", "jersey_sponsor_of", "naming_rights_with"],
        "endorsed_by": ["endorses", "brand_ambassador_for", "spokesperson_for"],
    },
    "affinity": {
        "fan_of": ["supporter_of", "lifelong_fan_of", "avid_fan_of", "passionate_about", "follows"],
        "attended_event": ["attended", "was_at", "present_at"],
        "played_sport": ["played", "former_player_of", "played_professionally", "collegiate_athlete_at"],
        "named_in_honor_of": ["named_after", "honors"],
    },
    "life_event": {
        "married": ["wed", "got_married_to", "married_to", "spouse_of"],
        "divorced": ["divorced_from", "separated_from", "split_from"],
        "inherited_from": ["inherited", "heir_of", "beneficiary_of", "received_estate_from"],
        "succession_from": ["succeeded", "took_over_from", "assumed_control_from"],
    },
    "location": {
        "headquartered_in": ["hq_in", "based_in", "located_in", "registered_in", "incorporated_in"],
        "resides_in": ["lives_in", "home_in", "domiciled_in", "resident_of"],
        "operates_in": ["has_office_in", "branch_in", "active_in"],
        "plays_in": ["home_arena_in", "home_stadium_in", "market_in"],
    },
}
SUFFIXES = ("_of", "_by", "_with", "_in", "_for", "_at", "_to", "_from")
#: Floors of the relevance of entity types, and what edges add or take.
TYPE_FLOORS = {"person": 0.4, "sports_team": 0.6, "sports_league": 0.7, "company": 0.5, "pe_fund": 0.65, "sports_foundation": 0.55, "transaction_event": 0.7, "location": 0.3, "life_event": 0.6, "media_rights_deal": 0.7}
HIGH_EDGE, HIGH_MOST, MEDIUM_EDGE, MEDIUM_MOST, ONLY_LOW, KEEP_ENTITY = 0.20, 0.40, 0.10, 0.20, 0.10, 0.40


def vocabulary(spark: SparkSession) -> DataFrame:
    """key, family, canonical, place (of the family in the search): every predicate under its own name and spellings."""
    rows = []
    for place, family in enumerate(FAMILIES):
        own = PREDICATES[family]
        rows += [(p, family, p, place) for p in own]
        rows += [(key, family, p, place) for p, keys in SPELLINGS[family].items() for key in keys if key not in own]
    return spark.createDataFrame(rows, "key string, family string, canonical string, place int")


def rules(spark: SparkSession) -> DataFrame:
    """family, canonical, signal, symmetric, least (the confidence it takes; null: never kept)."""
    rows = [(f, p, signal, p in SYMMETRIC, None if (f, signal) in DROPPED else LEAST.get((f, signal), DEFAULT_LEAST)) for f, own in PREDICATES.items() for p, signal in own.items()]
    return spark.createDataFrame(rows, "family string, canonical string, signal string, symmetric boolean, least double")


def predicate_key(raw: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(raw)), "[ -]", "_")


def normalised(df: DataFrame, raw: str = "raw", hint: str | None = None) -> DataFrame:
    """df with canonical and family for its column raw: by the family that hint names, else by the first family that
    knows it, else by the first that knows it without the first of SUFFIXES that helps; null if none does.

    The vocabulary is a fixed small table and is broadcast."""
    spark = df.sparkSession
    words = vocabulary(spark)
    first = words.groupBy("key").agg(F.min(F.struct("place", "family", "canonical")).alias("x")).select("key", F.col("x.family").alias("family"), F.col("x.canonical").alias("canonical"))
    bare = [F.when(F.col("key").endswith(s), F.expr(f"substr(key, 1, length(key) - {len(s)})")) for s in SUFFIXES]
    out = df.withColumn("key", predicate_key(F.col(raw)))
    if hint is not None:
        hinted = words.select(F.col("key").alias("k0"), F.col("family").alias("f0"), F.col("canonical").alias("c0"))
        out = out.join(F.broadcast(hinted), (F.col("key") == F.col("k0")) & (F.col(hint) == F.col("f0")), "left")
    else:
        out = out.withColumns({"f0": F.lit(None).cast("string"), "c0": F.lit(None).cast("string"), "k0": F.lit(None).cast("string")})
    names = ["0"]
    for i, key in enumerate([F.col("key"), *bare], 1):
        side = first.select(F.col("key").alias(f"k{i}"), F.col("family").alias(f"f{i}"), F.col("canonical").alias(f"c{i}"))
        out = out.join(F.broadcast(side), key == F.col(f"k{i}"), "left")
        names.append(str(i))
    out = out.withColumns({"family": F.coalesce(*[F.col(f"f{i}") for i in names]), "canonical": F.coalesce(*[F.col(f"c{i}") for i in names])})
    return out.drop("key", *[f"{x}{i}" for i in names for x in "kfc"])


def gated(df: DataFrame) -> DataFrame:
    """df (family, canonical, confidence) with signal, symmetric and keep: whether the edge is sure enough for its rule."""
    out = df.join(F.broadcast(rules(df.sparkSession)), ["family", "canonical"], "left")
    keep = (F.col("confidence") >= FLOOR) & (F.col("confidence") >= F.col("least"))
    return out.withColumn("keep", F.coalesce(keep, F.lit(False))).drop("least")


def relevance(kind: Column, high: Column, medium: Column, only_low: Column) -> Column:
    """0 to 1 for an entity of a kind by its number of edges of high and of medium signal; 0 for unknown kinds."""
    floor = F.create_map(*[x for k, v in TYPE_FLOORS.items() for x in (F.lit(k), F.lit(v))])[kind]
    score = floor + F.least(high * F.lit(HIGH_EDGE), F.lit(HIGH_MOST)) + F.least(medium * F.lit(MEDIUM_EDGE), F.lit(MEDIUM_MOST)) - F.when(only_low, ONLY_LOW).otherwise(0.0)
    return F.coalesce(F.least(score, F.lit(1.0)), F.lit(0.0))
