"""Worked cases of operators that SQL can't hold to account alone."""

import pytest
from pyspark.sql import functions as F

from entivore.functions import ontology as O
from entivore.functions import text as X
from entivore.operators import clients as C
from entivore.operators import graph as G
from entivore.operators import ingest as N
from entivore.operators import listing as L
from entivore.operators import mutations as U
from entivore.operators import passages as P
from entivore.operators import queues as Q
from entivore.operators import sheets as H
from entivore.plans import catalog
from entivore.sources import delimited

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text(spark):
    got = one(spark, F.round(X.word_similarity(F.lit("word"), F.lit("two words")), 6), F.round(X.similarity(F.lit("word"), F.lit("two words")), 6), X.csv_safe(F.lit("|x")), X.csv_safe(F.lit("\tx")), X.csv_safe(F.lit("\rx")))
    assert got == (0.8, 0.363636, "'|x", "'\tx", "\rx")
    assert one(spark, X.cited_urls(F.lit("[a](http://a/b) and [c](https://c) [a](http://a/b)")))[0] == ["http://a/b", "https://c"]


def test_result_types(spark):
    m = "array<struct<value:string,columns:int,places:int>>"
    rows = [("x", [("1", 1, 0)], "error"), (None, [], "empty"), (None, None, "empty"), (None, [("a", 2, 0)], "table"), (None, [("a", 1, 3)], "prose"), (None, [("$1,200.5 K", 1, 0)], "count"), (None, [("12%", 1, 0)], "count"), (None, [("12", 1, 0), ("13", 1, 0)], "list"), (None, [("one", 1, 0)], "list")]
    df = spark.createDataFrame([(e, v, w) for e, v, w in rows], f"e string, m {m}, want string")
    assert all(r.kind == r.want for r in df.select("want", X.result_type(F.col("e"), F.col("m")).alias("kind")).collect())


def test_ontology(spark):
    assert sum(map(len, O.PREDICATES.values())) == 37 and len(O.LEAST) + len(O.DROPPED) == 16
    rows = [("Buys", None, "owns", "ownership", 0.5, True), ("limited partner-in", "investment", "lp_in", "investment", 0.5, True), ("limited partner in", None, "minority_stake_in", "ownership", 0.49, False), ("fan of", None, "fan_of", "affinity", 0.74, False), ("leads_of", None, "ceo_of", "role", 0.55, True), ("coaches", None, "coaches", "role", 1.0, False), ("is near", None, None, None, 1.0, False)]
    df = spark.createDataFrame([r[:2] + r[4:5] for r in rows], "raw string, hint string, confidence double")
    got = {(r.raw, r.hint): (r.canonical, r.family, r.keep) for r in O.gated(O.normalised(df, "raw", "hint")).collect()}
    assert got == {(r[0], r[1]): (r[2], r[3], r[5]) for r in rows}


def test_edges_of_one_family_take_each_others_place(spark):
    rows = [(1, "a", "b", "ownership", "owns"), (2, "a", "b", "ownership", "owns"), (3, "a", "b", "ownership", "controls"), (4, "a", "b", "role", "founded"), (5, "b", "a", "deal_network", "merged_with"), (6, "a", "b", "deal_network", "merged_with"), (7, "a", "a", "role", "founded")]
    e = O.gated(spark.createDataFrame([(*r, 0.9) for r in rows], "t int, s string, o string, family string, canonical string, confidence double"))
    out = N.edge_outcomes(e, ["t"])
    assert {r.t: r.outcome for r in out.collect()} == {1: "new", 2: "duplicate", 3: "conflict", 4: "new", 5: "new", 6: "duplicate", 7: "loop"}
    assert {(r.family, r.canonical) for r in N.active_edges(out, ["t"]).collect()} == {("ownership", "controls"), ("role", "founded"), ("deal_network", "merged_with")}
    g = spark.createDataFrame([(1, "a", "b", "x", "f"), (2, "a", "b", "y", "g"), (3, "a", "b", "z", "f")], "t int, s string, o string, predicate string, family string")
    assert [r.status for r in G.conflicts(g, ["t"]).orderBy("t").collect()] == ["new", "new", "conflict"]


def test_find_or_create(spark):
    kind = "entity_id long, name string, aliases array<string>, context string"
    team = spark.createDataFrame([(1, "Ann Lee", ["AL"], ""), (2, "Bob Ray", ["Bobby"], "acme bank")], kind)
    master = spark.createDataFrame([(9, "Cy Fox", ["Foxy"], "north"), (8, "Bobby", [], "")], kind)
    asked = [(1, " ann lee ", ["Annie"], ""), (2, "ANN LEE", ["Anna"], "late"), (3, "bobby", ["B"], "acme corp"), (4, "cy fox", [], None), (5, "Di", ["D", ""], "new")]
    df = spark.createDataFrame(asked, "request_id int, name string, aliases array<string>, context string")
    got = {r.key: (r["mode"], r.entity_id, list(r.aliases), r.context) for r in N.resolved(df, team, master).collect()}
    assert got["ann lee"] == ("team_hit", 1, ["AL", "Anna", "Annie"], "late")
    assert got["bobby"] == ("team_alias_hit", 2, ["B", "Bobby"], "acme bank")
    assert got["cy fox"] == ("master_copy", None, ["Foxy"], "north")
    assert got["di"] == ("created", None, ["D"], "new")
    clash = df.where("request_id = 3").withColumn("context", F.lit("other firm"))
    assert [r["mode"] for r in N.resolved(clash, team, master).collect()] == ["master_copy"]


def test_merge_keeps_the_winners_own_edges(spark):
    e = spark.createDataFrame([("w", "p", "x", "f"), ("l", "q", "x", "f"), ("l", "q", "x", "g"), ("l", "p", "w", "f"), ("y", "p", "l", "f")], "s string, predicate string, o string, family string")
    win = spark.createDataFrame([("l", "w")], "loser string, winner string")
    assert {tuple(r) for r in G.merged(e, win).collect()} == {("w", "p", "x"), ("w", "q", "x"), ("y", "p", "w")}


def test_only_claimed_jobs_are_stale(spark):
    acts = {1: "enqueue claim", 2: "enqueue claim finish", 3: "enqueue claim fail", 4: "enqueue"}
    rows = [(j, 10 * j + k, f"2024-01-01 00:0{k}:00", a) for j, x in acts.items() for k, a in enumerate(x.split())]
    e = spark.createDataFrame(rows, "job_id int, seq int, ts string, action string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.job_id for r in Q.stale_claims(e, "2024-01-02 00:00:00", 600).collect()] == [1]
    kinds = spark.createDataFrame([(3, "k", 1), (4, "k", 5), (1, "k", 9)], "job_id int, kind string, priority int").withColumn("run_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert [r.job_id for r in Q.claimable(e, "2024-01-02 00:00:00", kinds, 5).collect()] == [4, 3]


def test_clients(spark):
    cands = spark.createDataFrame([("a", "directory", 1, "x", 0.9), ("a", "queue", 1, "x", 0.8), ("b", "directory", 1, "x", 0.9), ("b", "directory", 2, "y", 0.8), ("c", "queue", 3, "z", 0.7), ("e", "queue", 3, "z", 0.3)], "name string, source string, id long, label string, score double")
    names = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", None), ("e", "firm")], "name string, company string")
    assert [tuple(r) for r in C.fast_path(names, cands).collect()] == [("a", 1, "directory", 0.9)]
    fall = {r.name: (r.found, r.id, round(r.confidence, 6)) for r in C.fallback(names, cands).collect()}
    assert fall == {"a": (True, 1, 0.6), "b": (True, 1, 0.6), "c": (True, 3, 0.6), "d": (False, None, 0.0), "e": (False, None, 0.36)}
    said = [("a", 1, 0.9, False, False), ("b", 1, 0.8, False, False), ("c", 3, 0.69, False, False), ("d", 4, 0.9, True, False), ("e", 3, 0.9, False, True)]
    d = spark.createDataFrame(said, "name string, id long, confidence double, conflict boolean, ambiguous boolean")
    assert {r.name: (r.status, r.id, r.confidence) for r in C.decided(d, cands).collect()} == {"a": ("matched", 1, 0.9), "b": ("ambiguous", None, 0.8), "c": ("no_match", 3, 0.69), "d": ("conflict", None, 0.5), "e": ("ambiguous", None, 0.9)}


def test_names_meet_with_every_label(spark):
    """Resolution finds what comparing each name with each label finds."""
    from entivore.plans import clients

    names, queue = clients._names(spark, SF), clients._queue(spark, SF)
    got = {(r.name, r.id) for r in C.queue_candidates(names, queue, 0.6, 10**6).collect()}
    every = names.select("name", F.lower(X.plain_name(F.col("name"))).alias("a")).crossJoin(queue)
    assert got == {(r.name, r.id) for r in every.where(X.word_similarity(F.col("a"), F.col("label")) >= 0.6).collect()}
    assert catalog.QUERIES["q_resolve_client"](spark, SF).where("status = 'matched'").count() > 10


def test_chunks_are_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.where("coalesce(text, '') != ''").collect()}
    got = {}
    for r in P.recursive_chunks(docs, 500).orderBy("doc_id", "ix").collect():
        assert 0 < len(r.chunk) <= 500
        got[r.doc_id] = got.get(r.doc_id, "") + r.chunk
    assert got == texts
    over = {}
    for r in P.overlapping_chunks(docs, 800, 100).orderBy("doc_id", "ix").collect():
        over.setdefault(r.doc_id, []).append(r.chunk)
    for d, chunks in over.items():
        assert all(len(c) <= 800 for c in chunks) and chunks[0] == texts[d][: len(chunks[0])] and texts[d].endswith(chunks[-1])
        at = 0
        for a, b in zip(chunks, chunks[1:], strict=False):
            at += len(a) - 100
            assert texts[d][at : at + len(b)] == b


def test_csv_files(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿Team;Owners;Note\nReds;"Ann; Bob";"said ""hi"""\nBlues;;"two\nlines"\n')
    got = delimited.read_delimited(spark, str(path))
    assert got.columns == ["Team", "Owners", "Note"]
    assert [tuple(r) for r in got.collect()] == [("Reds", "Ann; Bob", 'said "hi"'), ("Blues", None, "two\nlines")]
    delimited.write_delimited(spark.createDataFrame([("=1+1", 2), ("ok", None)], "a string, b int"), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).fillna("").collect()) == [("'=1+1", "2"), ("ok", "")]


def test_lists(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id int, name string")
    assert [r.id for r in L.paged(df, {"n": "name"}, "n", "desc", "id", limit=0).collect()] == [1, 3, 2]
    assert [r.id for r in L.paged(df, {"n": "name"}, "n", "asc", "id", limit=1, offset=1).collect()] == [1]
    with pytest.raises(ValueError):
        L.paged(df, {"n": "name"}, "id", "asc", "id")
    assert L.where_given(df, search=("*", ["name"])).count() == 3 and L.where_given(df, search=("A", ["name"]), id=None).count() == 1


def test_previews_and_reports(spark):
    rows = spark.createDataFrame([(1, " x ", "7", "v", ""), (2, "", "8", "w", "u"), (3, "x", "9", None, "t")], "row int, label string, ext string, a string, b string")
    entities, cells, errors = H.previewed(rows, "label", "ext", ["a", "b"])
    assert [tuple(r) for r in entities.collect()] == [("x", "7")]
    assert sorted(tuple(r) for r in cells.collect()) == [("x", "a", "v"), ("x", "b", "t")]
    assert [tuple(r) for r in errors.collect()] == [(3, "Missing entity label")]
    jobs = spark.createDataFrame([(1, "queued", None), (2, "done", None), (3, "running", None)], "job_id int, status string, message string")
    queue = spark.createDataFrame([(10, 1, "pending"), (11, 1, "done"), (20, 2, "pending"), (30, 3, "pending")], "row_id int, job_id int, status string")
    new, after = U.cancelled(jobs, queue, jobs.where("job_id < 3").select("job_id"))
    assert {r.job_id: r.status for r in new.collect()} == {1: "failed", 2: "done", 3: "running"}
    assert {r.row_id: r.status for r in after.collect()} == {10: "dead", 11: "done", 20: "pending", 30: "pending"}
