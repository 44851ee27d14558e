"""Worked cases of lookups, comparisons, batches, merges, exports and scoped searches."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from entivore.operators import batches as B
from entivore.operators import graph as G
from entivore.operators import knowledge as K
from entivore.operators import listing as L
from entivore.operators import passages as P
from entivore.operators import sheets as H
from entivore.sources import delimited

NOW = "2024-01-31 00:00:00"
KNOWN = "gwm_id string, attribute_label string, team string, last_updated timestamp_ntz, present boolean"


def ago(days):
    return dt.datetime(2024, 1, 31) - dt.timedelta(days=days)


@pytest.fixture(scope="module")
def known(spark):
    rows = [
        ("a", "x", "t", ago(10), True), ("a", "x", None, ago(1), False), ("a", "x", "other", ago(0.5), False),  # the team's own counts, though it is older
        ("a", "y", "t", ago(20), True), ("a", "y", None, ago(2), True),  # the team's own is stale: no hit
        ("b", "x", None, ago(3), True),  # a limit is excluded: warm
        ("b", "y", "t", None, True), ("b", "y", "t", ago(14), False),  # the time that is missing comes last; 14 days are stale
        ("c", "x", "other", ago(1), True),
    ]
    return spark.createDataFrame(rows, KNOWN)


PAIRS = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "x"), ("d", "x"), (" \t", "x"), ("", "x"), (None, "x")]


def test_staleness_by_team_and_age(spark, known):
    pairs = spark.createDataFrame(PAIRS, "gwm_id string, attribute_label string")
    got = {(r.gwm_id, r.attribute_label): (r.tier, r.cached and r.cached.present) for r in K.staleness_map(pairs, known, "t", NOW).collect()}
    assert got == {("a", "x"): ("warm", True), ("a", "y"): ("stale", None), ("b", "x"): ("warm", True), ("b", "y"): ("stale", None), ("c", "x"): ("expired", None), ("d", "x"): ("expired", None)}
    shared = {(r.gwm_id, r.attribute_label): r.tier for r in K.staleness_map(pairs, known, None, NOW).collect()}
    assert shared == {("a", "x"): "fresh", ("a", "y"): "fresh", ("b", "x"): "warm", ("b", "y"): "expired", ("c", "x"): "expired", ("d", "x"): "expired"}
    assert sorted((r.gwm_id, r.attribute_label, r.tier) for r in K.lookup(pairs, known, "t", NOW).collect()) == [("a", "x", "warm"), ("b", "x", "warm")]
    assert sorted((r.gwm_id, r.attribute_label, r.team or "") for r in K.lookup_young(pairs, known, NOW).collect()) == [("a", "x", ""), ("a", "x", "other"), ("a", "y", ""), ("b", "x", ""), ("c", "x", "other")]
    assert K.lookup_young(pairs, known, NOW, 12.5).count() == 1


def test_no_pairs_and_nothing_known(spark, known):
    none = spark.createDataFrame([], "gwm_id string, attribute_label string")
    assert K.staleness_map(none, known, "t", NOW).count() == 0
    one = spark.createDataFrame([("a", "x")], "gwm_id string, attribute_label string")
    assert [(r.tier, r.cached) for r in K.staleness_map(one, known.limit(0), "t", NOW).collect()] == [("expired", None)]


def test_known_of_campaigns(spark, known):
    e = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None), (3, "a")], "campaign_id int, gwm_id string")
    got = sorted((r.campaign_id, r.gwm_id, r.tier) for r in K.known_of(e, known, NOW).collect())
    a = [("a", "fresh"), ("a", "fresh"), ("a", "fresh"), ("a", "stale"), ("a", "warm")]
    assert got == [(1, *x) for x in a] + [(2, "b", "expired"), (2, "b", "stale"), (2, "b", "warm")] + [(3, *x) for x in a]


def test_entities_side_by_side(spark):
    e = spark.createDataFrame([(i, f"e{i}") for i in range(1, 8)], "entity_id long, label string")
    a = spark.createDataFrame([(1, "one"), (2, "two")], "attribute_id long, attribute_label string")
    found = spark.createDataFrame([(3, 1, True, 0.9), (1, 1, False, 0.8), (1, 2, True, None), (6, 1, True, 1.0)], "entity_id long, attribute_id long, present boolean, confidence double")
    got = [tuple(r) for r in K.compared(e, a, found, [3, 1, 3]).select("attribute_id", "position", "entity_label", "present", "is_best", "is_worst").orderBy("attribute_id", "position").collect()]
    assert got == [(1, 0, "e3", True, True, False), (1, 1, "e1", False, False, True), (2, 0, "e3", None, False, False), (2, 1, "e1", True, False, False)]
    for wrong in ([1], [2, 2], [1, 2, 3, 4, 5, 6]):
        with pytest.raises(ValueError, match="two to five"):
            K.compared(e, a, found, wrong)
    with pytest.raises(LookupError, match="99"):
        K.compared(e, a, found, [1, 99])


def test_counts_and_totals(spark):
    c = spark.createDataFrame([(1,), (2,)], "campaign_id int")
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (9, "z")], "campaign_id int, v string")
    assert sorted(tuple(r) for r in K.with_counts(c, "campaign_id", n=rows, none=rows.limit(0)).collect()) == [(1, 2, 0), (2, 0, 0)]
    got = K.totals({"a": rows, "b": rows.limit(0)}, {"v": (rows, [F.col("v")])}).collect()
    assert [r.asDict() for r in got] == [{"a": 4, "b": 0, "v": 3}]


def test_weights_of_links(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "attribute_id int, weight double")
    links = spark.createDataFrame([(7, 1, None), (8, 1, 0.0), (7, 2, None), (7, 3, None)], "campaign_id int, attribute_id int, weight_override double")
    assert sorted(tuple(r) for r in K.effective_weights(a, links).collect()) == [(7, 1, 2.0, False), (7, 2, 1.0, False), (7, 3, 1.0, False), (8, 1, 0.0, True)]


LOOKUP = "batch int, position int, name string, gwm_id string, confidence double, status string, error string"


def test_results_in_one_text(spark):
    rows = [(1, 9, "b|c", "g1", 0.125, "matched", None), (1, 2, None, None, None, "no_match", None), (1, 30, "d", None, None, "error", "x" * 81), (1, 31, "e", "g", 0.5, None, None), (2, 1, "f", "", None, "matched", None), (3, 1, "g", None, None, "error", "")]
    got = {r.batch: r.report.split("\n") for r in B.results_markdown(spark.createDataFrame(rows, LOOKUP)).collect()}
    assert got[1][0] == "Processed 4 names: 1 matched, 1 no match, 1 error"
    assert got[1][4:] == ["| 1 |  | — | — | No match |", r"| 2 | b\|c | g1 | 12% | Matched |", f"| 3 | d | — | — | Error: {'x' * 77}... |", "| 4 | e | — | — | Error: Unknown error |"]
    assert got[2] == ["Processed 1 name: 1 matched, 0 no match, 0 errors", "", *got[1][2:4], "| 1 | f | — | — | Matched |"]
    assert got[3][-1] == "| 1 | g | — | — | Error: Unknown error |"
    body = {r.batch: r.body for r in B.results_json(spark.createDataFrame(rows, LOOKUP)).collect()}
    assert json.loads(body[1])["summary"] == {"total": 4, "matched": 1, "no_match": 1, "errors": 1}
    assert json.loads(body[1])["results"][0] == {"name": "", "gwm_id": None, "confidence": None, "status": "no_match"}
    assert body[2] == '{"summary":{"total":1,"matched":1,"no_match":0,"errors":0},"results":[{"name":"f","gwm_id":"","confidence":null,"status":"matched"}]}'


def test_a_wrong_job_refuses_its_batch(spark):
    schema = "batch int, place int, job_type string, payload map<string,string>, max_attempts int, priority int, run_at timestamp_ntz, validation_job_id long"
    rows = [(1, 0, "report", {"a": None, "b": "1"}, None, None, None, None), (1, 1, "validation_pair", None, 7, 2, ago(1), 5), (2, 0, "report", {}, None, None, None, None), (2, 1, "validation_cluster", {}, None, None, None, None), (2, 2, None, {}, None, None, None, 1), (3, 0, "", {}, None, None, None, 1)]
    jobs, refused = B.enqueued(spark.createDataFrame(rows, schema), NOW)
    got = [tuple(r) for r in jobs.select("place", "payload", "max_attempts", "priority", "run_at", "status").orderBy("place").collect()]
    assert got == [(0, '{"a":null,"b":"1"}', 3, 0, ago(0), "pending"), (1, "{}", 7, 2, ago(1), "pending")]
    assert sorted(tuple(r) for r in refused.collect()) == [(2, "job 1 has no validation_job_id"), (3, "job 0 has no job_type")]


def test_extractions_once_each(spark):
    e = spark.createDataFrame([(2, 0, "ann", "p"), (1, 5, " Ann ", "q"), (1, 7, "BOB", "r"), (3, 1, "bob", None)], "chunk int, place int, name string, kind string")
    assert sorted(tuple(r) for r in B.merged_entities(e).collect()) == [(1, 5, " Ann ", "q"), (1, 7, "BOB", "r")]
    r = spark.createDataFrame([(1, 1, "A", "owns", "B"), (1, 2, "a ", "owns", " b"), (1, 3, "a", "Owns", "b")], "chunk int, place int, subject string, predicate string, object string")
    assert sorted(x.place for x in B.merged_relations(r).collect()) == [1, 3]


def test_first_results_of_chunks(spark):
    r = spark.createDataFrame([(2, 1, "x"), (1, 9, "x"), (1, 3, "x"), (5, 5, None)], "chunk int, place int, value string")
    got = P.merged_first(r, ["value"], ["chunk", "place"])
    assert got.columns == ["chunk", "place", "value", "n"]
    assert sorted(map(tuple, got.collect())) == [(1, 3, "x", 3), (5, 5, None, 1)]


def test_aliases_of_merged_entities(spark):
    e = spark.createDataFrame([("w", "Win", ["z"], 1), ("l1", "Lose", None, 2), ("l2", "Win", ["z", "a"], 3), ("o", "Other", ["q", "b"], 4), ("v", "V", None, 5), ("l3", None, ["k"], 6)], "id string, name string, aliases array<string>, extra int")
    w = spark.createDataFrame([("l1", "w"), ("l2", "w"), ("l3", "v")], "loser string, winner string")
    got = {r.id: (r.name, r.aliases, r.extra) for r in G.merged_entities(e, w).collect()}
    assert got == {"w": ("Win", ["Lose", "Win", "a", "z"], 1), "o": ("Other", ["q", "b"], 4), "v": ("V", ["k"], 5)}


def test_search_with_degree(spark):
    e = spark.createDataFrame([("1", "Alpha", ["First"], None, 5), ("2", "beta", None, "has ALPHA", 9), ("3", "gamma", ["alpha"], None, 7), ("4", "delta", ["alphabet"], None, None)], "id string, name string, aliases array<string>, description string, updated_at int")
    edges = spark.createDataFrame([("1", "1"), ("1", "2"), ("4", "1"), ("4", "9")], "s string, o string")
    assert sorted((r.id, r.degree) for r in G.searched(e, edges, "aLpha").collect()) == [("1", 4), ("2", 1), ("3", 0)]
    assert [r.id for r in G.searched(e, edges, "alpha", 1).collect()] == ["2"]
    assert sorted((r.id, r.degree) for r in G.suggested(e, edges, "ALPH").collect()) == [("1", 4)]
    assert G.suggested(e, edges, "a", 0).count() == 1


def test_matrix_as_files(spark, tmp_path):
    e = spark.createDataFrame([(1, "=sum", "g1"), (2, 'say "a, b"', None), (3, None, "g3")], "entity_id int, label string, gwm_id string")
    schema = "entity_id int, attribute_id string, value_select string, value_numeric decimal(9,2), value_boolean boolean, value_text string"
    from decimal import Decimal as D

    cells = spark.createDataFrame([(1, "a", "opt", D("1.00"), True, "t"), (1, "b", "", D("-2.50"), True, "t"), (2, "a", None, None, False, "t"), (2, "b", None, None, None, "+1\nline"), (9, "a", "x", None, None, None), (1, "unknown", "x", None, None, None)], schema)
    H.exported(e, [("a", "Size"), ("b", "size"), ("c", "Entity")], cells, str(tmp_path / "m"))
    back = delimited.read_delimited(spark, str(tmp_path / "m"))
    assert back.columns == ["Entity", "GWM ID", "Size", "size (b)", "Entity (c)"]
    assert sorted(map(tuple, back.collect())) == [("", "g3", "", "", ""), ("'=sum", "g1", "opt", "'-2.50", ""), ('say "a, b"', "", "False", "'+1\nline", "")]


def test_files_of_a_session(spark):
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | x |" for i in range(9))
    texts = ["[Page 1]\none two\n[Page 3]\n" + "w " * 30, table, f"## Sheet: Q: 1\n{table}\n## Sheet: Empty\nno table", "plain text", None, "without metadata"]
    meta = [("a.PDF", None), ("odd.bin", "csv"), ("b.xlsx", ""), (None, None), ("e.txt", None)]
    s = spark.createDataFrame([("s:1", texts, meta), ("s2", None, meta), ("s3", ["x"], [])], "session_id string, texts array<string>, metadata array<struct<filename string, type string>>")
    got = P.session_chunks(s, size=40, rows=8).orderBy("file", "page", "ix").collect()
    assert {r.session_id for r in got} == {"s:1"}
    assert [(r.file, r.filename, r.page, r.ix) for r in got] == [(0, "a.PDF", "1", 0), (0, "a.PDF", "3", 0), (0, "a.PDF", "3", 1), (1, "odd.bin", "1", 0), (1, "odd.bin", "1", 1), (2, "b.xlsx", "Q: 1", 0), (2, "b.xlsx", "Q: 1", 1), (3, "unknown", "1", 0)]
    assert got[4].chunk == "| a | b |\n| 8 | x |" and got[0].chunk == "one two" and got[7].chunk == "plain text"


def test_search_within_scope(spark):
    c = spark.createDataFrame([(1, "Cats", None, "me", None, 1), (2, "x", "all cats", "you", 5, 2), (3, "cats", None, "you", 6, 3)], "campaign_id int, label string, description string, owner string, team int, created_at int")
    e = spark.createDataFrame([(1, 1, "one CAT", None, 1), (2, 2, "concatsed", None, 9), (3, 3, "cats", None, 9), (4, 1, "dog", "a cat's", 5)], "id int, campaign_id int, label string, description string, created_at int")
    p = spark.createDataFrame([(1, "cats!", None, 5, 1), (2, "cats!", None, 6, 1)], "id int, label string, description string, team int, created_at int")

    def found(teams, limit=20):
        return sorted((r.category, r["rank"], r.id, r.hit) for r in L.searched_in_scope(c, e, e.limit(0), p, "cats", "me", teams, limit).collect())

    assert found([5]) == [("campaigns", 1, "2", False), ("campaigns", 2, "1", False), ("entities", 1, "4", True), ("entities", 2, "1", True), ("entities", 3, "2", False), ("programs", 1, "1", False)]
    assert found([]) == [("campaigns", 1, "1", False), ("entities", 1, "4", True), ("entities", 2, "1", True)]
    assert [x[:3] for x in found([5], 1)] == [("campaigns", 1, "2"), ("entities", 1, "4"), ("programs", 1, "1")]


def test_newest_of_each(spark):
    r = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", None, 4)], "k string, at int, id int")
    assert sorted(x.id for x in L.newest_each(r, "k", "at", "id", 1).collect()) == [2, 4]


def test_members_of_several_teams_once(spark):
    shares = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2), ("t", 3)], "session string, team int")
    members = spark.createDataFrame([(1, "u"), (2, "u"), (2, "v"), (3, "gone"), (4, "w")], "team int, sid string")
    users = spark.createDataFrame([("u", "U"), ("v", None), ("w", "W")], "sid string, display_name string")
    assert sorted((r.session, r.sid) for r in K.once_across(shares, members, users).collect()) == [("s", "u"), ("s", "v")]
