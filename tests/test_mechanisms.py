"""Partners, cascades, profiles, histories, closings and chunks against plain Python."""

import collections
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from entivore.operators import cascades, postings
from entivore.operators import clients as C
from entivore.operators import documents as D
from entivore.operators import graph as G
from entivore.operators import listing as L
from entivore.operators import passages as P
from entivore.operators import profiles as R
from entivore.operators import queues as U


@pytest.mark.parametrize("crowd", [2000, 7])
def test_partners_of_hot_objects(spark, crowd):
    rng = random.Random(crowd)
    points = [(f"p{i}", "hot") for i in range(60)] + [(f"p{rng.randint(0, 59)}", f"o{rng.randint(0, 30)}") for _ in range(300)]
    df = spark.createDataFrame(points + points[:50], "s string, o string")
    by = collections.defaultdict(set)
    for s, o in points:
        by[o].add(s)
    want = collections.defaultdict(list)
    for o, people in by.items():
        for a, b in itertools.combinations(sorted(people), 2):
            want[a, b].append(o)
    assert {(r.person1, r.person2): r.n_shared for r in G.partners(df, crowd).collect()} == {k: len(v) for k, v in want.items()}
    got = collections.defaultdict(list)
    for r in G.shared_deals(df, crowd, 2).collect():
        assert r.n_shared == len(want[r.person1, r.person2])
        got[r.person1, r.person2] += r.deals
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_ten_thousand_people_of_one_object(spark):
    df = spark.range(10_000).select(F.concat(F.lit("p"), "id").alias("s"), F.lit("hot").alias("o"))
    assert G.pairs_of(df, 1000).count() == 10_000 * 9_999 // 2


def test_cascades_of_levels_and_circles(spark):
    tables = {
        "a": (spark.createDataFrame([(i, i - 1 if i % 5 else None) for i in range(20)], "id int, before int"), "id"),  # chains of five
        "b": (spark.createDataFrame([(100 + i, i % 20, 100 + (i * 7) % 40) for i in range(40)], "id int, a int, b int"), "id"),
        "c": (spark.createDataFrame([(f"c{i}", 100 + i) for i in range(40)], "id string, b int"), "id"),
    }
    references = [("a", "before", "a"), ("b", "a", "a"), ("b", "b", "b"), ("c", "b", "b")]
    gone = cascades.cascade(tables, references, {"a": spark.createDataFrame([(7,), (999,)], "key int")})
    rows = {name: [tuple(r) for r in df.collect()] for name, (df, _) in tables.items()}
    want = {("a", 7): 0, ("a", 999): 0}
    level, fresh = 0, set(want)
    while fresh:
        level += 1
        met = set()
        for child, column, parent in references:
            at = tables[child][0].columns.index(column)
            met |= {(child, r[0]) for r in rows[child] if (parent, r[at]) in fresh}
        fresh = met - set(want)
        want |= dict.fromkeys(fresh, level)
    assert {(name, r.key): r.level for name, df in gone.items() for r in df.collect()} == want and level > 3
    left = cascades.remaining(tables["c"][0], "id", gone["c"])
    assert {r.id for r in left.collect()} == {r[0] for r in rows["c"]} - {k for t, k in want if t == "c"}


def test_only_stale_values_are_made_anew(spark):
    facts = spark.createDataFrame([(k, v) for k in range(6) for v in range(k + 1)], "k int, v int")
    seen = []

    def compute(df):
        seen.append({r.k for r in df.select("k").distinct().collect()})
        return df.groupBy("k").agg(F.sum("v").alias("total"))

    old = facts.groupBy("k").agg(F.sum("v").alias("total"))
    stale = spark.createDataFrame([(2,), (4,), (0,)], "k int")
    got = cascades.recomputed(old, stale, "k", facts.where("v != 1 AND k != 0"), compute)
    assert {r.k: (r.total, r.recomputed) for r in got.collect()} == {1: (1, False), 2: (2, True), 3: (6, False), 4: (9, True), 5: (15, False)}
    assert seen == [{2, 4}]


def test_profiles_roles_and_questions(spark):
    table = "| Owner name | Spent | Share | When | Team | Kind | n | |\n|---|---|---|---|---|---|---|---|\n" + "".join(f"| Ann {i} | ${i},000.5 | {i} % | 2024-01-0{i} | Reds {i % 2} | {'big' if i % 2 else 'small'} | {i * i} |\n" for i in range(1, 10)) + "| x |\n"
    docs = spark.createDataFrame([(1, "s", table * 1), (2, "s", "prose | with a bar"), (3, "s", "| note |\n| --- |\n| some words |"), (4, "s", None)], "doc_id long, sheet string, text string")
    p = R.profiles(R.table_cells(docs))
    got = {r.column: r for r in R.roles(p).where("doc_id = 1").collect()}
    assert {c: r.role for c, r in got.items()} == {"Owner name": "person", "Spent": "amount", "Share": "share", "When": "date", "Team": "organisation", "Kind": "text", "n": "measure", "column 8": "empty"}
    assert (got["Owner name"].n, got["Owner name"].filled, got["Spent"].filled, got["Team"].n_distinct) == (10, 10, 9, 2) and got["Spent"].samples == ["$1,000.5", "$2,000.5", "$3,000.5"]
    assert {r.doc_id: r.kind for r in R.kinds(docs, p).collect()} == {1: "tabular", 2: "prose", 3: "tabular", 4: "prose"}
    k = R.kinds(docs, p).withColumn("g", F.when(F.col("doc_id") < 3, "x").otherwise("y"))
    assert {r.g: r.kind for r in R.together(k, "g").collect()} == {"x": "mixed", "y": "mixed"}
    asks = {r.doc_id: r.asks for r in R.suggestions(R.roles(p)).collect()}
    assert len(asks[1]) == 3 and "Spent" in asks[1][0] and "Owner name" in asks[1][1] and asks[3][0].startswith("What do the rows")
    wide = "| " + " | ".join(f"c{i}" for i in range(30)) + " |\n|---|\n| " + " | ".join("v" for _ in range(30)) + " |"
    many = spark.createDataFrame([(9, f"s{i:02}", wide) for i in range(12)], "doc_id long, sheet string, text string")
    s = R.summaries(R.roles(R.profiles(R.table_cells(many)))).first()
    assert (s.sheets, s.columns) == (10, 200) and s.summary.count("(") == 10 and s.summary.count(";") == 1


def trimmed_by_hand(turns, budget):
    cost = lambda t: len(t[2] or "") // 4 + 4
    left = list(turns)
    for tool in (True, False):
        for t in list(left):
            if sum(map(cost, left)) > budget and (t[1] == "tool") == tool:
                left.remove(t)
    while left and any(t[1] in ("user", "system") for t in left) and left[0][1] not in ("user", "system"):
        left.pop(0)
    return [t[0] for t in left]


def test_histories_are_trimmed(spark):
    rng = random.Random(12)
    convs = {c: [(i, rng.choice(["user", "assistant", "tool", "system"]), rng.choice([None, "x" * rng.randint(0, 90)])) for i in range(rng.randint(1, 9))] for c in range(60)}
    df = spark.createDataFrame([(c, *t) for c, ts in convs.items() for t in ts], "conv_id int, turn int, role string, text string")
    got = collections.defaultdict(list)
    for r in D.trimmed_turns(df, 40).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append(r.turn)
    assert {c: got[c] for c in convs} == {c: trimmed_by_hand(ts, 40) for c, ts in convs.items()}
    texts = collections.defaultdict(str)
    for r in D.capped(df, 50).orderBy("conv_id", "turn").collect():
        texts[r.conv_id] += r.text or ""
    assert all(texts[c] == "".join(t[2] or "" for t in ts)[:50] for c, ts in convs.items())


def test_memories(spark):
    df = spark.createDataFrame([(1, "Red Ring", 5), (2, "red ring", 7), (3, "blue", 9), (4, "RINGS", 1), (5, "box", 8)], "id int, entity string, created int")
    assert [r.id for r in D.remembered(df, "the rings of red ring").collect()] == [2, 4]
    assert D.remembered(df, "a of").count() == 0 and [r.id for r in D.remembered(df, "ring blue", 1).collect()] == [3]


def test_overlapping_pieces_of_texts_without_blanks(spark):
    rng = random.Random(5)
    texts = {1: "w " * 30 + "x" * 20_000, 2: "漢字" * 3000, 3: "".join(rng.choice("ab    ") for _ in range(9000)), 4: "short", 5: "a" * 8000, 6: "a" * 8001, 7: " " * 9000}
    got = collections.defaultdict(list)
    for r in P.overlapping_chunks(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), 8000, 200).orderBy("doc_id", "ix").collect():
        got[r.doc_id].append(r.chunk)
    for i, chunks in got.items():
        assert all(len(c) <= 8000 for c in chunks) and len(chunks) <= 2 + len(texts[i]) // 7000
        assert chunks[0] + "".join(c[200:] for c in chunks[1:]) == texts[i]
    assert len(got[1]) == 3 or len(got[1]) == 4


def test_closings(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    children = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (3, 1), (3, 2), (4, 1)], "root int, child int")
    ended = spark.createDataFrame([(1, 1, at(9), 1, "dead"), (1, 2, at(5), 2, "done"), (1, 2, at(50), 9, "dead"), (2, 1, at(3), 3, "dead"), (3, 1, at(4), 4, "done"), (3, 1, at(6), 5, "done")], "root int, child int, ts timestamp_ntz, seq int, status string")
    got = {r.root: (r.closed_at, r.closed_by, r.dead, r.final_status, r.message) for r in U.closings(children, ended).collect()}
    assert got == {1: (at(9), 1, 1, "done", "1 of 2 pair(s) failed"), 2: (at(3), 1, 1, "failed", None)}


def test_lists_are_found_in_place(spark):
    df = spark.range(100_000).withColumn("name", F.concat(F.lit("n"), "id"))
    out = L.in_order(df, "id", [7, -1, 3, 7])
    assert [(r.position, r.id, r.name, r.found) for r in out.orderBy("position").collect()] == [(0, 7, "n7", True), (1, -1, None, False), (2, 3, "n3", True), (3, 7, "n7", True)]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_clusters_and_alignment(spark):
    a = spark.createDataFrame([(i, "c" if i < 23 else None) for i in range(26)], "k int, cluster string")
    parts = collections.Counter((r.cluster, r.part) for r in C.clustered(a, "cluster", "k", 10).collect())
    assert parts == {("c", 0): 10, ("c", 1): 10, ("c", 2): 3, ("General Research", 0): 3}


def test_an_index_of_some_terms_scores_alike(spark):
    docs = spark.createDataFrame([(i, f"common w{i % 7} w{i % 5} tail{i}") for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common w3 w4"), (2, "tail9 w1")], "item_id long, query string")
    full, some = postings.build(docs, block_docs=16), postings.build(docs, only=postings.query_terms(asked), block_docs=16)
    assert some.postings.count() < full.postings.count() / 3 and (some.n_docs, some.n_words) == (full.n_docs, full.n_words) == (200, 800)
    assert sorted(map(tuple, postings.ranked(full, asked).collect())) == sorted(map(tuple, postings.ranked(some, asked).collect()))


@pytest.mark.parametrize("hub", [8_000_000, 40])
def test_pairs_are_put_together_without_a_row_for_each(spark, monkeypatch, hub):
    """Rows that are shuffled are people of objects, not pairs; people with very many others go by joins, with the same results."""
    monkeypatch.setattr(G, "HUB", hub)
    df = spark.range(60).select(F.concat(F.lit("p"), "id").alias("s"), F.explode(F.sequence(F.lit(0), F.when(F.col("id") < 8, 9).otherwise(0))).alias("k")).select("s", F.concat(F.lit("o"), "k").alias("o"))
    names = sorted(f"p{i}" for i in range(60))
    both = {(a, b): 10 if int(a[1:]) < 8 and int(b[1:]) < 8 else 1 for a, b in itertools.combinations(names, 2)}
    counted, listed = G.partners(df), G.shared_deals(df)
    assert {(r.person1, r.person2): r.n_shared for r in counted.collect()} == both
    assert {(r.person1, r.person2): r.deals for r in listed.collect()} == {k: [f"o{i}" for i in range(n)] for k, n in both.items()}
    if hub > 40:
        for out in (counted, listed):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "HashAggregate(keys=[person1" not in plan


def test_kinds_are_told_from_texts(spark):
    """The same kinds as by profiles, without a row for a cell; profiles take their values once, without a join."""
    texts = ["| A | | Price |\n|---|---|---|\n| x\\|y | $1,000 | 5% |\n|  | $2 |", "no table", "| only a head |", "| a |\n|  |\n|  | b |", "|q|\n| 1 |", None]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, sheet string, text string")
    told, profiles = R.text_kinds(docs, F.array("text")), R.profiles(R.table_cells(docs))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, R.kinds(docs, profiles).collect())) == [(i, "tabular" if i in (0, 4) else "prose") for i in range(6)]
    assert "explode" not in told._jdf.queryExecution().executedPlan().toString()
    for out in (profiles, R.summaries(R.roles(profiles))):
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_texts_of_tables_are_made_once(spark):
    """A filter before an explode would make a text anew, which is here a sort of a whole order's lines."""
    from entivore.plans import passages, profiles

    for query in (profiles.q_column_profiles, profiles.q_plan_simple, passages.q_table_extract_one, passages.q_table_extract_several):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Filter")]
        assert not [f for f in filters if "array_sort" in f or "collect_list" in f]


def test_no_step_runs_a_frame_for_each_document_or_edges_anew(spark):
    """Documents pass their tasks in batches, not as a pandas frame each; paths read the edges that are stored."""
    from entivore.plans import graphs, passages, searches

    for query in (searches.q_passage_search, passages.q_page_batches):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "InPandas" not in plan
    assert "lineitem" not in graphs.q_kg_paths(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_batches_of_pages_over_many_documents(spark):
    pages = [(d, p, "x" * ((7 * d + 3 * p) % 11)) for d in range(30) for p in range(d % 9)]
    want = []
    for d in range(30):
        batches = []
        for _, p, t in (x for x in pages if x[0] == d):
            if batches and sum(map(len, batches[-1][1])) + len(t) <= 12:
                batches[-1][1].append(t)
            else:
                batches.append((p, [t]))
        want += [(d, i, p, len(ts), "\n\n".join(ts)) for i, (p, ts) in enumerate(batches)]
    df = spark.createDataFrame(random.Random(1).sample(pages, len(pages)), "doc_id long, page int, text string")
    from entivore.operators import passages as operators

    assert sorted(map(tuple, operators.batched(df, 12).collect())) == want


def test_lists_of_partners_are_dealt_by_pairs(spark, monkeypatch):
    """The lists of one task hold about LIST_PAIRS pairs, however few rows they are made of."""
    monkeypatch.setattr(G, "LIST_PAIRS", 1_000)
    edges = spark.range(4_000).select((F.col("id") % 50).cast("string").alias("s"), F.concat(F.lit("o"), (F.col("id") / 50).cast("int")).alias("o"))
    met, _, _, n_pairs = G._met(edges, G.CROWD)
    tasks = [r.n for r in met.groupBy(F.spark_partition_id()).agg(F.sum(F.size("others")).alias("n")).collect()]
    assert sum(tasks) == n_pairs == 80 * 50 * 49 // 2 and max(tasks) <= 10_000


@pytest.mark.parametrize("few", (0, 100))
def test_edges_are_merged_in_one_shuffle_beside_the_joins(spark, monkeypatch, few):
    """Distinct edges, those held by winners and distinct results share a shuffle; few losers at an end need none."""
    monkeypatch.setattr(G, "FEW_LOSERS", few, raising=False)
    rng = random.Random(12)
    rows = [(rng.choice("abcdef"), rng.choice("pqr"), rng.choice(("f", "g", None)), rng.choice("abcdefx")) for _ in range(300)] + [(None, "p", "f", "a"), ("y", None, "f", "x"), ("y", "p", "f", "x"), ("y", "p", "g", "x")]
    win = {"b": "a", "d": "c", "x": "a"}
    moved = {(win.get(s, s), p, f, win.get(o, o), s not in win and o not in win) for s, p, f, o in rows}
    held = {(s, f, o) for s, _, f, o, own in moved if own and f}
    want = {(s, p, o) for s, p, f, o, own in moved if s and o and s != o and (own or (s, f, o) not in held)}
    got = G.merged(spark.createDataFrame(rows, "s string, predicate string, family string, o string"), spark.createDataFrame(list(win.items()), "loser string, winner string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    if few:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("broadcast", ("10MB", "-1"))
def test_rows_of_cancelled_jobs_are_dealt_by_their_number(spark, monkeypatch, broadcast):
    from entivore.plans import changes

    monkeypatch.setattr(changes, "TASK_ROWS", 500, raising=False)
    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        counts = changes.q_cancel_rows(spark, sf)
        tasks = [r.n for r in counts.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(tasks) == spark.read.parquet(f"{sf}/lineitem.parquet").count() and max(tasks) <= 1_000


def test_lines_of_tables_are_cut_once(spark):
    """All that comes of a table is exploded at once, and cells are those of the patterns, also for odd lines."""
    import re

    lines = ["| a | b |", "||", "|", "a|b", " | a | b | ", "| a \\| b | c |", "| a \\|", "|a||b|", "a | |", "| x |\t", "", "|\\||"]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, line string").orderBy("i").select(P.cells(F.col("line")).alias("c")).collect()
    assert [r.c for r in got] == [[c.strip(" ").replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\s*\||\|\s*\Z", "", x))] for x in lines]
    texts = ["see\n| Part | Flag | z |\n|---|---|---|\n| p | f |\n| q | | 1 |\n| | g | 2 |\n| r | h | 3 | 4 |\nend", "none", None, "| flag |\n| a |", "| part | PART |\n| a | b |"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = P.extracted(docs, ["part", "flag"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    assert sorted(map(tuple, out.collect())) == [(0, 1, "Flag", "f"), (0, 1, "Part", "p"), (0, 4, "Flag", "h"), (0, 4, "Part", "r"), (4, 1, "PART", "b"), (4, 1, "part", "a")]
    assert sorted(map(tuple, P.extracted(docs, ["flag"]).collect())) == [(0, 1, "Flag", "f"), (0, 3, "Flag", "g"), (0, 4, "Flag", "h"), (3, 1, "flag", "a")]
    assert sorted(map(tuple, P.extracted(docs, []).where("doc_id = 0 AND row = 3").collect())) == [(0, 3, "Flag", "g"), (0, 3, "z", "2")]
