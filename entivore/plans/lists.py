"""Lists, filters and reads over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from entivore.operators import listing as L
from entivore.plans.queues import _states
from entivore.plans.scores import LATEST
from entivore.sources.tables import edges, table

SORTS = {"label": "s_name", "balance": "s_acctbal", "nation": "s_nationkey"}
NOW = "timestamp '2024-01-20 00:00:00'"


def q_get_by_id(spark, sf_dir):
    return L.by_id(table(spark, sf_dir, "supplier"), "s_suppkey", 7).select("s_suppkey", "s_name", "s_nationkey")


def q_filter_optional(spark, sf_dir):
    """Line items of one flag with a least quantity; the clauses that aren't given don't count."""
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_linestatus")
    return L.where_given(r, l_returnflag="R", l_linenumber=None, least={"l_quantity": 45, "l_orderkey": None}, among={"l_linestatus": ["F", "X"]}, none_of={"l_linenumber": [7]})


def q_list_sorted(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"), "s_nationkey")
    return L.paged(s, SORTS, "balance", "desc", "s_suppkey", limit=15, offset=5)


def q_list_all(spark, sf_dir):
    """Limit 0: every row; a query that says nothing doesn't filter."""
    s = L.where_given(table(spark, sf_dir, "supplier"), search=("*", ["s_name"])).select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    return L.paged(s, SORTS, "label", "asc", "s_suppkey", limit=0).select("s_suppkey", "s_name")


def q_ids_in_order(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return L.in_order(s, "s_suppkey", [5, 3, 999_999_999, 1])


def q_access_scope(spark, sf_dir):
    """Orders as items: their customer owns them, the clerk's number mod 5 is their team; customer 1 is in teams 1 and 3."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"), F.pmod("o_orderkey", F.lit(5)).alias("team"), F.when(F.col("o_orderstatus") == "F", "team").otherwise("private").alias("visibility"))
    members = spark.createDataFrame([(1, 1), (1, 3), (2, 0)], "user long, team long")
    return L.accessible(o, members, 1)


def q_exists_either(spark, sf_dir):
    """Customers with an open order, or with an event."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return L.either_exists(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", o, e)


def q_edge_direction(spark, sf_dir):
    e = edges(spark, sf_dir)
    ways = [L.touching(e, "part:7", way).agg(F.count("*").alias("n")).select(F.lit(way).alias("way"), "n") for way in ("outgoing", "incoming", "both")]
    return ways[0].unionByName(ways[1]).unionByName(ways[2])


def q_due(spark, sf_dir):
    """Events as monitors: due a day after they were made, active unless they are errors; the fifty longest due."""
    m = table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr("interval 1 day")).alias("next_run_at"), (F.col("event_type") != "error").alias("active"))
    return L.due(m, "next_run_at", F.expr(NOW)).orderBy("next_run_at", "event_id").limit(50).select("event_id", F.date_format("next_run_at", "yyyy-MM-dd'T'HH:mm:ss").alias("next_run_at"))


def q_metadata_filter(spark, sf_dir):
    """Parts whose metadata (a map) has a key with a value that holds a text."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("brand"), "p_brand", F.when(F.col("p_size") > 25, "large").otherwise("small"), "p_name").alias("metadata"))
    return p.where(F.map_contains_key("metadata", F.lit("large")) & F.contains(F.lower(F.col("metadata")["large"]), F.lit("re"))).select("p_partkey", F.col("metadata")["brand"].alias("brand"))


def q_alias_member(spark, sf_dir):
    """Parts that have a name among their aliases, whatever the case."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.split(F.upper("p_name"), " ").alias("aliases"))
    return p.where(F.exists("aliases", lambda a: F.lower(a) == "small"))


def q_rows_from_json(spark, sf_dir):
    """Lines of each order as a JSON array, and back as rows."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("n"), F.col("l_partkey").alias("part"))))).alias("body"))
    return lines.select("l_orderkey", F.inline(F.from_json("body", "array<struct<n:int,part:bigint>>")))


def q_rows_from_arrays(spark, sf_dir):
    """Pairs (supplier, part) given as two arrays, and what is known of them; pairs that nothing is known of stay."""
    asked = spark.createDataFrame([([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 999_999_999])], "a array<bigint>, b array<bigint>").select(F.inline(F.arrays_zip("a", "b")))
    known = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("b")).join(F.broadcast(asked.select("b").distinct()), "b", "left_semi")
    return asked.join(known.groupBy("b").agg(F.count("*").alias("n")), "b", "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("known"))


def q_edges_with_names(spark, sf_dir):
    """Nation and supplier edges with the names of both ends."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    v = s.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.col("n_name").alias("name")))
    e = s.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("s"), F.concat(F.lit("nation:"), "s_nationkey").alias("o"))
    return e.join(v.select(F.col("id").alias("s"), F.col("name").alias("subject")), "s").join(v.select(F.col("id").alias("o"), F.col("name").alias("object")), "o").select("s", "o", "subject", "object")


def q_last_days(spark, sf_dir):
    """Events of the week before the reference time, by type."""
    e = table(spark, sf_dir, "events").where(F.expr(f"ts > {NOW} - interval 7 days AND ts <= {NOW}"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(F.concat_ws(":", "user_id", "event_type")).alias("pairs"))


def q_users_once(spark, sf_dir):
    """Each customer with orders once, with the first priority by name."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("first_priority"))


def q_rank_by_degree(spark, sf_dir):
    """The hundred edges whose better connected end has most edges, sure ones first."""
    e = edges(spark, sf_dir)
    d = e.select(F.col("s").alias("n")).unionAll(e.select(F.col("o").alias("n"))).groupBy("n").agg(F.count("*").alias("d"))
    j = e.join(d.select(F.col("n").alias("s"), F.col("d").alias("ds")), "s", "left").join(d.select(F.col("n").alias("o"), F.col("d").alias("do")), "o", "left")
    rank = F.greatest(F.coalesce("ds", F.lit(0)), F.coalesce("do", F.lit(0)))
    return j.select("s", "o", rank.alias("rank"), "confidence", "tie1", "tie2").orderBy(F.desc("rank"), F.desc("confidence"), "s", "o", "tie1", "tie2").limit(100)


def q_role_order(spark, sf_dir):
    """The highest role of each customer among its orders: viewer < member < admin < owner."""
    roles = ("viewer", "member", "admin", "owner")
    at = F.pmod(F.col("o_orderkey"), F.lit(4))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(at).alias("at"))
    return g.select("o_custkey", F.element_at(F.array(*[F.lit(r) for r in roles]), F.col("at").cast("int") + 1).alias("role"))


def q_newest_runs(spark, sf_dir):
    """The five newest orders of each customer."""
    from entivore.operators.relational import first_per_key

    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return first_per_key(o, ["o_custkey"], ["o_orderdate desc", "o_orderkey"], 5)


def q_expired(spark, sf_dir):
    """Conversations of events: users whose last event is over a day before the reference time are expired."""
    e = table(spark, sf_dir, "events").where(F.expr(f"ts <= {NOW}")).groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.select("user_id", F.expr(f"last + interval 1 day < {NOW}").alias("expired"), F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss").alias("last"))


def q_messages_in_order(spark, sf_dir):
    """Each message with its number in the conversation and the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("number"), F.lag("role").over(w).alias("after"))


def q_dead_jobs(spark, sf_dir):
    """The two hundred newest dead jobs, and what they are when they are tried again."""
    from entivore.operators.queues import states
    from entivore.sources.tables import queue_events

    e = queue_events(spark, sf_dir)
    dead = states(e).where("status = 'dead'").select("job_id", "attempts")
    last = e.groupBy("job_id").agg(F.max("ts").alias("failed_at"))
    out = dead.join(last, "job_id").orderBy(F.desc("failed_at"), "job_id").limit(200)
    return out.select("job_id", "failed_at", "attempts", F.lit("pending").alias("retried_as"), F.lit(0).alias("retried_attempts"))


def q_membership(spark, sf_dir):
    """For each nation whether supplier 1 is a member, and whether it has any customers."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"))
    own = table(spark, sf_dir, "supplier").where("s_suppkey = 1").select(F.col("s_nationkey").alias("team"))
    others = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("team"))
    return L.either_exists(n, "team", own, others).select("team", F.col("in_one").alias("is_member"), F.col("in_other").alias("has_customers"))


def q_job_detail(spark, sf_dir):
    """Lines of one month, with the suppliers and parts that are asked for."""
    from entivore.sources.tables import results

    return L.where_given(results(spark, sf_dir), job="1996-03", among={"entity_id": [1, 2, 3], "attribute_id": None}, present=True).select("entity_id", "attribute_id", "confidence", "tie1", "tie2")


def q_activity(spark, sf_dir):
    """The fifty newest events with who is behind them."""
    e = table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(50)
    return e.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left").select("event_id", "event_type", "c_name")


def q_dashboard(spark, sf_dir):
    """Counts of several tables in one row."""
    o = table(spark, sf_dir, "orders").agg(F.count("*").alias("jobs"), F.countDistinct("o_custkey").alias("owners"), F.count_if(F.col("o_orderstatus") == "P").alias("running"))
    e = table(spark, sf_dir, "events").where(F.expr(f"ts > {NOW} - interval 7 days AND ts <= {NOW}")).agg(F.count("*").alias("recent"), F.countDistinct(F.concat_ws(":", "user_id", "event_type")).alias("pairs"))
    return o.crossJoin(e).crossJoin(table(spark, sf_dir, "supplier").agg(F.count("*").alias("entities")))


def q_duplicate_groups(spark, sf_dir):
    """Names that more than one part has."""
    p = table(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return p.where("n > 1")


def q_recent_entities(spark, sf_dir):
    """The twenty suppliers with the newest edges."""
    e = edges(spark, sf_dir).groupBy("s").agg(F.max("created_at").alias("seen"))
    return e.orderBy(F.desc("seen"), "s").limit(20).select("s")


def q_cached_or_research(spark, sf_dir):
    """For each supplier and the part after each of its own: the cached finding if it is young enough, else research is due."""
    from entivore.plans.scores import latest

    asked = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), (F.col("l_partkey") + 1).alias("attribute_id")).distinct()
    young = latest(spark, sf_dir).where(F.expr("created_at > timestamp '1997-01-01 00:00:00'")).select("entity_id", "attribute_id", "present", "confidence")
    out = asked.join(young, ["entity_id", "attribute_id"], "left")
    return out.select("entity_id", "attribute_id", "present", F.when(F.col("present").isNull(), "research").otherwise("cache").alias("source"))


def q_weight_override(spark, sf_dir):
    """The weight that counts for a part: its own, else its type's, else 1."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_type") == "PROMO", 2.0)
    own = F.when(F.col("p_size") % 5 == 0, F.col("p_size").cast("double"))
    return p.select("p_partkey", F.coalesce(own, kind, F.lit(1.0)).alias("weight"))


def q_rankings(spark, sf_dir):
    """Suppliers by the share of checked parts, then of those present, then by name; those over a least share only."""
    from entivore.plans.scores import latest

    g = latest(spark, sf_dir).groupBy(F.col("entity_id").alias("s_suppkey")).agg(F.count("*").alias("checked"), F.count_if("present").alias("present"))
    out = g.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey").where("present * 10 >= checked * 3")
    return out.orderBy(F.desc("checked"), F.desc("present"), "s_name").limit(50).select("s_name", "checked", "present")


EDGE = "e AS (SELECT 'supplier:' || l_suppkey AS s, 'part:' || l_partkey AS o, round(1 - l_discount, 2) AS confidence, l_orderkey AS tie1, l_linenumber AS tie2 FROM lineitem)"
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_get_by_id": "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey = 7",
    "q_filter_optional": "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_linestatus FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 AND l_linestatus IN ('F', 'X') AND l_linenumber != 7",
    "q_list_sorted": "SELECT s_suppkey, s_name, s_acctbal::DOUBLE AS s_acctbal, s_nationkey FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 15 OFFSET 5",
    "q_list_all": "SELECT s_suppkey, s_name FROM supplier",
    "q_ids_in_order": "SELECT a.position, a.s_suppkey, s_name, s_name IS NOT NULL AS found FROM (VALUES (0, 5), (1, 3), (2, 999999999), (3, 1)) a(position, s_suppkey) LEFT JOIN supplier s ON s.s_suppkey = a.s_suppkey",
    "q_access_scope": "SELECT o_orderkey, o_custkey AS owner, o_orderkey % 5 AS team, CASE WHEN o_orderstatus = 'F' THEN 'team' ELSE 'private' END AS visibility FROM orders WHERE o_custkey = 1 OR (o_orderkey % 5 IN (1, 3) AND o_orderstatus = 'F')",
    "q_exists_either": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS in_one, c_custkey IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) AS in_other, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') OR c_custkey IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) AS \"any\" FROM customer",
    "q_edge_direction": "SELECT 'outgoing' AS way, 0::BIGINT AS n UNION ALL SELECT 'incoming', count(*) FROM lineitem WHERE l_partkey = 7 UNION ALL SELECT 'both', count(*) FROM lineitem WHERE l_partkey = 7",
    "q_due": f"SELECT event_id, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') AS next_run_at FROM events WHERE event_type != 'error' AND ts + INTERVAL 1 DAY <= {NOW} ORDER BY ts, event_id LIMIT 50",
    "q_metadata_filter": "SELECT p_partkey, p_brand AS brand FROM part WHERE p_size > 25 AND contains(lower(p_name), 're')",
    "q_alias_member": "SELECT p_partkey, string_split(upper(p_name), ' ') AS aliases FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'small')",
    "q_rows_from_json": "SELECT l_orderkey, l_linenumber::INT AS n, l_partkey AS part FROM lineitem",
    "q_rows_from_arrays": "SELECT a, b, coalesce(n, 0) AS n, n IS NOT NULL AS known FROM (SELECT unnest([1, 2, 3, 4, 5, 6])::BIGINT AS a, unnest([1, 2, 3, 4, 5, 999999999])::BIGINT AS b) LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = b",
    "q_edges_with_names": "SELECT 'supplier:' || s_suppkey AS s, 'nation:' || s_nationkey AS o, s_name AS subject, n_name AS object FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "q_last_days": f"SELECT event_type, count(*) AS n, count(DISTINCT user_id || ':' || event_type) AS pairs FROM events WHERE ts > {NOW} - INTERVAL 7 DAYS AND ts <= {NOW} GROUP BY 1",
    "q_users_once": "SELECT o_custkey, min(o_orderpriority) AS first_priority FROM orders GROUP BY 1",
    "q_rank_by_degree": f"WITH {EDGE}, d AS (SELECT n, count(*) AS d FROM (SELECT s AS n FROM e UNION ALL SELECT o FROM e) GROUP BY 1) SELECT s, o, greatest(a.d, b.d) AS rank, confidence, tie1, tie2 FROM e JOIN d a ON a.n = s JOIN d b ON b.n = o ORDER BY rank DESC, confidence DESC, s, o, tie1, tie2 LIMIT 100",
    "q_role_order": "SELECT o_custkey, ['viewer', 'member', 'admin', 'owner'][(max(o_orderkey % 4) + 1)::INT] AS role FROM orders GROUP BY 1",
    "q_newest_runs": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5",
    "q_expired": f"SELECT user_id, max(ts) + INTERVAL 1 DAY < {NOW} AS expired, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last FROM events WHERE ts <= {NOW} GROUP BY 1",
    "q_dead_jobs": f"WITH RECURSIVE {_states()} SELECT x.job_id, failed_at, x.attempts, 'pending' AS retried_as, 0::INT AS retried_attempts FROM (SELECT r.job_id, r.status, r.attempts FROM r JOIN (SELECT job_id, max(n) AS n FROM o GROUP BY 1) m ON m.job_id = r.job_id AND m.n = r.i WHERE r.status = 'dead') x JOIN (SELECT job_id, max(ts) AS failed_at FROM ev GROUP BY 1) l USING (job_id) ORDER BY failed_at DESC, job_id LIMIT 200",
    "q_membership": "SELECT n_nationkey AS team, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1) AS is_member, n_nationkey IN (SELECT c_nationkey FROM customer) AS has_customers FROM nation",
    "q_job_detail": "SELECT l_suppkey AS entity_id, l_partkey AS attribute_id, round(1 - l_discount, 2) AS confidence, l_orderkey AS tie1, l_linenumber AS tie2 FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1996-03' AND l_suppkey IN (1, 2, 3) AND l_returnflag = 'N'",
    "q_activity": "WITH e AS (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 50) SELECT event_id, event_type, c_name FROM e LEFT JOIN customer ON c_custkey = user_id",
    "q_dashboard": f"SELECT * FROM (SELECT count(*) AS jobs, count(DISTINCT o_custkey) AS owners, count(*) FILTER (WHERE o_orderstatus = 'P') AS running FROM orders), (SELECT count(*) AS recent, count(DISTINCT user_id || ':' || event_type) AS pairs FROM events WHERE ts > {NOW} - INTERVAL 7 DAYS AND ts <= {NOW}), (SELECT count(*) AS entities FROM supplier)",
    "q_duplicate_groups": "SELECT lower(trim(p_name)) AS name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1",
    "q_recent_entities": "SELECT 'supplier:' || l_suppkey AS s FROM lineitem GROUP BY 1 ORDER BY max(l_shipdate) DESC, s LIMIT 20",
    "q_cached_or_research": f"WITH {LATEST}, a AS (SELECT DISTINCT l_suppkey AS entity_id, l_partkey + 1 AS attribute_id FROM lineitem) SELECT a.entity_id, a.attribute_id, present, CASE WHEN present IS NULL THEN 'research' ELSE 'cache' END AS source FROM a LEFT JOIN (SELECT * FROM latest WHERE created_at > TIMESTAMP '1997-01-01 00:00:00') l ON l.entity_id = a.entity_id AND l.attribute_id = a.attribute_id",
    "q_weight_override": "SELECT p_partkey, coalesce(CASE WHEN p_size % 5 = 0 THEN p_size::DOUBLE END, CASE WHEN p_type = 'PROMO' THEN 2.0::DOUBLE END, 1.0::DOUBLE) AS weight FROM part",
    "q_rankings": f"WITH {LATEST} SELECT any_value(s_name) AS s_name, count(*) AS checked, count(*) FILTER (WHERE present) AS present FROM latest JOIN supplier ON s_suppkey = entity_id GROUP BY entity_id HAVING count(*) FILTER (WHERE present) * 10 >= count(*) * 3 ORDER BY checked DESC, present DESC, s_name LIMIT 50",
    "q_messages_in_order": "SELECT conv_id, turn, (row_number() OVER w)::INT AS number, lag(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
}
