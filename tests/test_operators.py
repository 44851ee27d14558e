"""Worked cases for the operators."""

import datetime as dt

from pyspark.sql import functions as F

from entivore.functions import text as X
from entivore.operators import documents as D
from entivore.operators import graph as G
from entivore.operators import matching as M
from entivore.operators import trigrams as T
from entivore.operators import queues as U
from entivore.operators import relational as R


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_matrix_scores(spark):
    cells = spark.createDataFrame(
        [("e1", "a1", True, None, None), ("e1", "a2", None, 50.0, None), ("e1", "a3", None, 10.0, None), ("e1", "a4", None, None, "High"), ("e2", "a1", False, None, None), ("e2", "a2", None, 120.0, None), ("e2", "a3", None, -5.0, None), ("e2", "a4", None, None, "Mid"), ("e3", "a4", None, None, "X"), ("e4", "a3", None, 2.0, None)],
        "entity_id string, attribute string, value_boolean boolean, value_numeric double, value_select string",
    )
    attributes = spark.createDataFrame(
        [("a1", "boolean", 1.0, None, None, None), ("a2", "numeric", 2.0, 0.0, 100.0, None), ("a3", "numeric", 1.0, None, None, None), ("a4", "select", 2.0, None, None, ["Low", "Mid", "High"])], "attribute string, kind string, weight double, low double, high double, options array<string>"
    )
    got = {r.entity_id: (r.total_score, r.present, r.checked) for r in R.matrix_scores(cells, attributes).collect()}
    assert got == {"e1": (83.33, 4, 4), "e2": (50.0, 2, 4), "e4": (20.0, 1, 1)}


def test_diff(spark):
    a = spark.createDataFrame([("x", "p", True), ("x", "q", False), ("y", "p", True)], "entity_id string, attribute_id string, present boolean")
    b = spark.createDataFrame([("x", "p", True), ("x", "q", True), ("z", "p", False)], a.schema)
    assert {(r.entity_id, r.attribute_id): r.diff_status for r in R.diff(a, b).collect()} == {("x", "p"): "unchanged", ("x", "q"): "changed", ("y", "p"): "removed", ("z", "p"): "added"}


def test_highlights(spark):
    rows = spark.createDataFrame([(1, "a", True, 0.9), (1, "b", True, 0.9), (1, "c", False, 0.4), (2, "a", True, 0.5), (3, "a", True, 0.5), (3, "b", True, 0.5)], "attribute_id int, entity_id string, present boolean, confidence double")
    got = R.highlights(rows).collect()
    assert {(r.attribute_id, r.entity_id) for r in got if r.is_best} == {(1, "a"), (1, "b")}
    assert {(r.attribute_id, r.entity_id) for r in got if r.is_worst} == {(1, "c")}


def test_staleness(spark):
    ref = "2024-02-01 00:00:00"
    tier = lambda t: value(spark, X.staleness(F.lit(t).cast("timestamp_ntz"), ref))
    assert [tier(t) for t in ("2024-01-30", "2024-01-29", "2024-01-18", "2024-01-02", None)] == ["fresh", "warm", "stale", "expired", "expired"]


def test_trigrams_and_names(spark):
    assert round(value(spark, X.similarity(F.lit("word"), F.lit("two words"))), 6) == 0.363636
    assert value(spark, X.similarity(F.lit(""), F.lit(""))) == 0
    names = {"Prof. Ines Maro": "Ines Maro", "ms Tove Lind": "Tove Lind", "Otis Vane IV": "Otis Vane", "Kim Ode, PhD": "Kim Ode,", " Ro\t Abe ": "Ro Abe", "Drake Mrsic": "Drake Mrsic", "": ""}
    assert [value(spark, X.plain_name(F.lit(n))) for n in names] == list(names.values())


def test_similar_names_finds_all(spark):
    names = ["small red ring", "small ring", "large blue box", "blue box", "ring", "Ring small", ""]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    got = {(r.a, r.b) for r in T.similar(df, df.withColumnRenamed("a", "b"), 0.3).collect()}
    want = {(a, b) for a in names for b in names if value(spark, X.similarity(F.lit(a), F.lit(b))) >= 0.3}
    assert got == want


def test_pages_and_batches(spark):
    docs = spark.createDataFrame([(1, "[Page 3]\nred\n[Page 8]\nblue fox"), (2, "before\n[Page 1]\n  after  \n[Page 2]\n \n"), (3, "no mark [Page 4]"), (4, None), (5, "")], "doc_id int, text string")
    got = sorted((r.doc_id, r.page, r.text) for r in D.pages(docs).collect())
    assert got == [(1, 3, "red"), (1, 8, "blue fox"), (2, 0, "before"), (2, 1, "after"), (3, 1, "no mark [Page 4]")]
    sizes = lambda x: F.lit(x).cast("array<long>")
    assert value(spark, D.greedy_batches(sizes([4, 4, 4, 9, 1, 1]), 10)) == [0, 0, 1, 2, 2, 3]
    assert value(spark, D.greedy_batches(sizes([15]), 10)) == [0]


def test_percentiles(spark):
    rows = spark.createDataFrame([(10.0,)] * 90 + [(100.0,)] * 8 + [(500.0,)] * 2, "x double")
    assert tuple(R.ranked_percentiles(rows, "x", (50, 95, 99)).first()) == (10.0, 100.0, 500.0, 100, 27.0)
    assert tuple(R.ranked_percentiles(rows.limit(1).select(F.lit(42.0).alias("x")), "x", (50, 99)).first())[:3] == (42.0, 42.0, 1)


def test_graph(spark):
    e = spark.createDataFrame([("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "d"), ("a", "owns", "c"), ("d", "knows", "d")], "s string, predicate string, o string")
    assert {(r.s, r.o): r.hop for r in G.neighbourhood(e, ["a"], 2).collect()} == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 2, ("c", "d"): 2}
    assert [(r.hops, r.path) for r in G.paths(e, "a", "d", 3, 5).collect()] == [(2, "a>c>d"), (3, "a>b>c>d")]
    assert {r.name: r.degree for r in G.degrees(e).collect()} == {"a": 2, "b": 2, "c": 3, "d": 3}
    winners = spark.createDataFrame([("b", "a")], "loser string, winner string")
    assert {tuple(r) for r in G.merged(e, winners).collect()} == {("a", "knows", "c"), ("c", "knows", "d"), ("a", "owns", "c")}


EVENTS = [("j1", ["enqueue", "claim", "finish", "fail"]), ("j2", ["claim", "enqueue", "claim", "fail", "claim", "fail", "claim", "fail", "claim"]), ("j3", ["heartbeat"])]


def event_rows():
    start = dt.datetime(2024, 1, 1)
    return [(i, 100 * i + k, start + dt.timedelta(seconds=20 * k), a) for i, (_, actions) in enumerate(EVENTS) for k, a in enumerate(actions)]


SCHEMA = "job_id long, seq long, ts timestamp_ntz, action string"


def test_queue_states(spark):
    got = {r.job_id: (r.status, r.attempts) for r in U.states(spark.createDataFrame(event_rows(), SCHEMA)).collect()}
    assert got == {0: ("done", 0), 1: ("dead", 3), 2: ("unknown", 0)}


def test_streams_match_their_batch_twins(spark, tmp_path):
    from entivore.streaming import queues as S

    rows = event_rows()
    for k in range(3):  # one file after the other, in order
        spark.createDataFrame([r for r in rows if r[1] % 100 // 3 == k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    # a late event far ahead closes all windows
    spark.createDataFrame([(9, 999, dt.datetime(2025, 1, 1), "heartbeat")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: S.read_events(spark, str(tmp_path / "in"), SCHEMA, 10)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = {(r.job_id, r.status, r.attempts) for r in run(S.states(stream()), "states", "update").collect() if r.job_id != 9}
    assert got == {(r.job_id, r.status, r.attempts) for r in U.states(batch).collect()}
    got = {(r.job_id, r.n, r.limited) for r in run(S.rate_windows(stream(), 60, 2), "windows", "append").collect()}
    assert got == {(r.job_id, r.n, r.limited) for r in U.rate_windows(batch, 60, 2).collect()}
    got = {(r.job_id, r.n) for r in run(S.sessions(stream(), 30), "sessions", "append").collect()}
    assert got == {(r.job_id, r.n) for r in U.sessions(batch, 30).collect()}
