"""Delimited files against Python's own reader, cut into splits of any size."""

import csv
import random

import pytest

from entivore.sources import delimited


def by_hand(text, sep=","):
    rows = list(csv.reader(text.splitlines(keepends=True), delimiter=sep))
    return rows[0], [r for r in rows[1:] if r and any(c.strip() for c in r)]


@pytest.fixture
def split_size(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = [spark.conf.get(n, None) for n in names]

    def set_(size):
        for n, v in zip(names, (str(size), "1", "1"), strict=True):
            spark.conf.set(n, v)

    yield set_
    for n, v in zip(names, old, strict=True):
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("size", [16, 100, 333, 1 << 20])
def test_records_across_splits(spark, tmp_path, split_size, size):
    split_size(size)
    rng = random.Random(1)
    cells = ["plain", "", "two\nlines", 'said "hi"', "a,b", '"', '""', "\n", "x" * 40, "é\n\n\n\nü", "3"]
    want = [[rng.choice(cells) for _ in range(3)] + [str(i)] for i in range(120)]
    path = tmp_path / "in.csv"
    with path.open("w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["Team", "Owner, or\nowners", "Note", "id"])
        w.writerows(want)
    got = delimited.read_delimited(spark, str(path))
    assert got.columns == ["Team", "Owner, or\nowners", "Note", "id"]
    assert sorted((tuple(c or "" for c in r) for r in got.collect()), key=lambda r: int(r[3])) == [tuple(r) for r in want]
    if size <= 333:
        assert delimited.records(spark, str(path)).select("split").distinct().count() > 3


def test_headers_delimiters_and_ragged_rows(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('﻿Name\tOwners\t\tname\r\nReds\t"Ann; Bob"\tx\ty\r\nBlues\r\n\r\n  \r\nGreens\t""\tx\ty\tmore\r\n')
    got = delimited.read_delimited(spark, str(tmp_path / "a.tsv"))
    assert got.columns == ["Name", "Owners", "column_3", "name_4"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == [("Blues", None, None, None), ("Greens", "", "x", "y"), ("Reds", "Ann; Bob", "x", "y")]


def test_many_files_and_stray_quotes(spark, tmp_path, split_size):
    split_size(8)
    for i in range(4):
        (tmp_path / f"{i}.csv").write_text(f'k,v\n{i},"a\nb{i}"\n{i + 10},c\n')
    got = delimited.read_delimited(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(str(i), f"a\nb{i}") for i in range(4)] + [(str(i + 10), "c") for i in range(4)])
    (tmp_path / "5.csv").write_text('k,v\n1,"open\n' + "2,x\n" * 50)
    with pytest.raises(Exception, match="stray quote"):
        delimited.read_delimited(spark, str(tmp_path / "5.csv"), most_lines=20).collect()
    (tmp_path / "empty.csv").write_text("")
    assert delimited.read_delimited(spark, str(tmp_path / "empty.csv")).count() == 0


def test_written_files_come_back(spark, tmp_path):
    rows = [(1, " a ", "=x"), (2, None, '"q"\n,'), (3, "", "\ttab"), (4, "b\n", "c")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    delimited.write_delimited(df, str(tmp_path / "out"), ";")
    got = delimited.read_delimited(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == [("1", " a ", "'=x"), ("2", None, '"q"\n,'), ("3", "", "'\ttab"), ("4", "b\n", "c")]


def test_records_of_one_line_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "d.csv")
    with open(path, "w") as f:
        f.write("a,b\n" + "".join(f'{i},"x\ny"\n' if i % 50 == 0 else f"{i},z\n" for i in range(1000)))
    df = delimited.read_delimited(spark, path)
    assert df.count() == 1000 and df.where("b = 'x\ny'").count() == 20
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan
