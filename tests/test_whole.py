"""Queries over all their rows, against SQL or cases without any cut."""

import datetime as dt

import duckdb

from entivore.plans import graphs, queues, scores, searches, texts

SF = "/root/testdata/sf0.001"


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def duck(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(sql).fetchall()


def test_claims_of_the_pages_themselves(spark, tmp_path):
    rows = [(1, "<p>$1,250.5M or $1B</p>"), (2, "12% of 14.5%"), (3, "no claim"), (4, None), (5, "$0 and $3")]
    got = {r.page_id: (r.low, r.high, r.conflict) for r in texts.q_claims_conflict(spark, saved(spark, tmp_path, "pages", rows, "page_id long, html string")).collect()}
    assert got == {1: (1e9, 1250.5e6, True), 2: (12.0, 14.5, False), 3: (None, None, None), 4: (None, None, None), 5: (0.0, 3.0, None)}


LINES = "l_suppkey long, l_partkey long, l_returnflag string, l_discount double, l_shipdate timestamp_ntz, l_orderkey long, l_linenumber int"


def test_graph_of_all_suppliers_and_months(spark, tmp_path):
    saved(spark, tmp_path, "supplier", [(1, 1), (9, 2)], "s_suppkey long, s_nationkey long")
    saved(spark, tmp_path, "nation", [(1, 1), (2, 0)], "n_nationkey long, n_regionkey long")
    sf = saved(spark, tmp_path, "lineitem", [(s, 7, "N", 0.1, dt.datetime(1994 + s % 3, 5, 1), s, 1) for s in (1, 9)], LINES)
    assert [tuple(r) for r in graphs.q_kg_paths(spark, sf).collect()] == [(4, "supplier:1>part:7>supplier:9>nation:2>region:0")]
    assert [tuple(r) for r in graphs.q_deal_partners(spark, sf).collect()] == [("supplier:1", "supplier:9", 1)]


def test_paths_and_partners_on_the_smallest_tables(spark):
    sql = graphs.ORACLES["q_kg_paths"]
    assert [(r.hops, r.path) for r in graphs.q_kg_paths(spark, SF).collect()] == duck(sql, "lineitem", "supplier", "nation")
    sql = graphs.ORACLES["q_deal_partners"]
    assert sorted((r.person1, r.person2, r.n_shared) for r in graphs.q_deal_partners(spark, SF).collect()) == sorted(duck(sql, "lineitem"))


def test_only_pending_jobs_are_claimable(spark, tmp_path):
    acts = {1: ("signup", "click", "purchase"), 2: ("signup",), 3: ("signup", "click"), 4: ("signup", "click", "error"), 5: ("click",), 6: ("signup", *("click", "error") * 3)}
    rows = [(100 * j + k, j, dt.datetime(2024, 1, 10 - j, k), a) for j, x in acts.items() for k, a in enumerate(x)]
    sf = saved(spark, tmp_path, "events", rows, "event_id long, user_id long, ts timestamp_ntz, event_type string")
    assert [(r.job_id, r.waiting_since) for r in queues.q_queue_claim(spark, sf).collect()] == [(4, dt.datetime(2024, 1, 6)), (2, dt.datetime(2024, 1, 8))]


def test_bm25_asks_the_whole_passage(spark, tmp_path):
    saved(spark, tmp_path, "benchmark", [(1, "a b c d e f g h i late")], "item_id long, text string")
    sf = saved(spark, tmp_path, "documents", [(1, "x y"), (2, "a late word"), (3, "a z w")], "doc_id long, text string")
    assert [r.doc_id for r in searches.q_bm25_top5(spark, sf).orderBy("rank").collect()] == [2, 3]
    sql = f"SELECT item_id, doc_id, score, rank FROM ({searches.ORACLES['q_bm25_top5']})"
    columns = ("item_id", "doc_id", "score", "rank")
    got, want = sorted(tuple(r[c] for c in columns) for r in searches.q_bm25_top5(spark, SF).collect()), sorted(duck(sql, "documents", "benchmark"))
    assert [(i, d, r) for i, d, _, r in got] == [(i, d, r) for i, d, _, r in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_markdown_tables_of_all_parts(spark, tmp_path):
    sql = texts.ORACLES["q_md_table_roundtrip"]
    got = sorted((r.row, r.column, r.value) for r in texts.q_md_table_roundtrip(spark, SF).collect())
    assert got == sorted(duck(sql, "part"))
    rows = [(k, f"n{k}", "b", 50) for k in (5, 99, 100, 350, 99_999, 100_000, 5_000_000)]
    sf = saved(spark, tmp_path, "part", rows, "p_partkey long, p_name string, p_brand string, p_size int")
    got = {r.row: r.value for r in texts.q_md_table_roundtrip(spark, sf).where("column = 'p_partkey'").collect()}
    assert got == {i + 1: str(k[0]) for i, k in enumerate(rows)}


def test_matrix_cells_are_not_sorted_by_attribute(spark):
    plan = scores.q_matrix_score(spark, SF)._jdf.queryExecution().toString()
    assert "Window" not in plan and "largest" in plan


def test_jobs_that_come_late_are_claimed_as_well(spark, tmp_path):
    """The whole table counts: a job enqueued on the 25th waits, one that finishes then doesn't."""
    rows = [(1, 1, dt.datetime(2024, 1, 25), "signup"), (2, 2, dt.datetime(2024, 1, 2), "signup"), (3, 2, dt.datetime(2024, 1, 24), "click"), (4, 2, dt.datetime(2024, 1, 25), "purchase")]
    sf = saved(spark, tmp_path, "events", rows, "event_id long, user_id long, ts timestamp_ntz, event_type string")
    assert [(r.job_id, r.waiting_since) for r in queues.q_queue_claim(spark, sf).collect()] == [(1, dt.datetime(2024, 1, 25))]


def test_claims_of_the_later_days_are_idle_as_well(spark, tmp_path):
    """A job that is claimed on the 15th and not seen again idles at the reference time of the 20th."""
    rows = [(1, 1, dt.datetime(2024, 1, 15), "signup"), (2, 1, dt.datetime(2024, 1, 15, 1), "click"), (3, 2, dt.datetime(2024, 1, 2), "signup"), (4, 2, dt.datetime(2024, 1, 3), "click"), (5, 2, dt.datetime(2024, 1, 12), "purchase")]
    sf = saved(spark, tmp_path, "events", rows, "event_id long, user_id long, ts timestamp_ntz, event_type string")
    assert [(r.job_id, r.last_seen) for r in queues.q_idle_claims(spark, sf).collect()] == [(1, dt.datetime(2024, 1, 15, 1))]
