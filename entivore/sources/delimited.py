"""Delimited files of any size with quoted line breaks, read by many tasks.

A line of the file begins inside quotes if the quotes before it are odd in number. Splits of
the file are read side by side: each one counts its quotes and notes where its last record
would begin, for either case of how it starts; a running sum over the splits (one row each)
tells which case holds. Records of one line, nearly all, stay where they are; only lines of
longer records are put together by a shuffle.

Quotes belong to quoted fields, as the format has it; a stray one makes records of many lines,
and one of more than MOST_LINES is an error.
"""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entivore.functions.text import csv_safe
from entivore.sources.files import delimiter, without_mark
from entivore.sources.shared import stored

MOST_LINES = 100_000
#: Splits or files whose table is broadcast; with more it is joined.
MOST_SPLITS = 100_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files as they are read, with the quotes of each, whether those before it in its split are odd in number, and
    for either case of how the split starts (last0: outside of quotes) the last line up to it that begins a record.

    A task reads a split in order, so this takes neither a shuffle nor a sort."""

    def run(batches):
        key, total, last = None, 0, [-1, -1]
        for batch in batches:
            quotes, n = pc.count_substring(batch["value"], '"').to_numpy().astype(np.int64), batch["n"].to_numpy()
            files = batch["file"].dictionary_encode()
            split, code = batch["split"].to_numpy(), files.indices.to_numpy()
            odd, begun = np.empty(len(n), np.int32), [np.empty(len(n), np.int64), np.empty(len(n), np.int64)]
            starts = np.flatnonzero(np.append(True, (np.diff(split) != 0) | (np.diff(code) != 0))) if len(n) else []
            for start, end in zip(starts, [*starts[1:], len(n)], strict=True):
                own = (files.dictionary[code[start]].as_py(), split[start])
                if own != key:
                    key, total, last = own, 0, [-1, -1]
                up_to = total + np.cumsum(quotes[start:end])
                odd[start:end] = (up_to - quotes[start:end]) % 2
                total = int(up_to[-1])
                for i in (0, 1):
                    held = np.maximum(np.maximum.accumulate(np.where(odd[start:end] == i, n[start:end], -1)), last[i])
                    begun[i][start:end], last[i] = held, held[-1]
            more = [pa.array(quotes), pa.array(odd), *(pa.array(x, mask=x < 0) for x in begun)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "quotes", "odd", "last0", "last1"])

    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = lines.coalesce(tasks)  # very many splits in fewer files; each is read whole and in order
    return stored(lines.mapInArrow(run, "value string, file string, split long, n long, quotes long, odd int, last0 long, last1 long"), "csv-lines")


def _small(df: DataFrame, name: str) -> DataFrame:
    """df, one row for each split or file: broadcast unless these are very many."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= MOST_SPLITS else df


def records(spark: SparkSession, path: str, most_lines: int = MOST_LINES) -> DataFrame:
    """file, split, n, record: the records of delimited files, line breaks in quotes included; n rises within a split."""
    return _records(_lines(spark, path), most_lines)


def _records(lines: DataFrame, most_lines: int) -> DataFrame:
    # both cases of a split: where its last record begins if it starts outside of quotes, or inside
    splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"), *[F.max(f"last{i}").alias(f"last{i}") for i in (0, 1)])
    by_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("starts", (F.coalesce(F.sum("quotes").over(by_file), F.lit(0)) % 2).cast("int"))
    last = F.when(F.col("starts") == 0, F.col("last0")).otherwise(F.col("last1"))
    splits = _small(splits.withColumn("carried", F.last(last, ignorenulls=True).over(by_file)).select("file", "split", "starts", "carried"), "csv-splits")
    lines = lines.join(splits, ["file", "split"]).withColumn("inside", (F.col("odd") + F.col("starts")) % 2)
    after = (F.col("inside") + F.col("quotes")) % 2
    one = lines.where((F.col("inside") == 0) & (after == 0)).select("file", "split", "n", F.col("value").alias("record"))
    parts = lines.withColumn("begun", F.coalesce(last, "carried")).where((F.col("inside") != 0) | (after != 0))
    whole = parts.groupBy("file", "begun").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("split", "n", "value"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: x["value"]), "\n")
    many = whole.select("file", F.get("all", F.lit(0))["split"].alias("split"), F.col("begun").alias("n"), F.when(F.col("lines") <= most_lines, text).otherwise(F.raise_error(F.concat(F.lit(f"a record of more than {most_lines} lines: is there a stray quote in "), "file"))).alias("record"))
    return one.unionByName(many)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, most_lines: int = MOST_LINES) -> DataFrame:
    """The rows of delimited files (a file, a folder, a pattern) with a header each, all columns strings. The delimiter is told
    from the first header, unless it is given. Short rows are filled with nulls, what is beyond the header is left out, blank
    lines go. Empty fields are null, quoted empty ones empty."""
    lines = _lines(spark, path)
    every = _records(lines, most_lines).withColumn("record", F.regexp_replace("record", "\r$", ""))
    # the first line of the first split of each file: one row for each file
    firsts = _small(lines.where("split = 0").groupBy("file").agg(F.min("n").alias("first")), "csv-firsts")
    top = firsts.orderBy("file").first()
    head = top and every.where((F.col("file") == top.file) & (F.col("n") == top["first"])).select(without_mark(F.col("record")).alias("record"), delimiter(F.col("record")).alias("sep")).first()
    if head is None:
        return spark.createDataFrame([], "value string")
    sep = sep or head.sep
    names: list[str] = []
    for i, name in enumerate(next(csv.reader([head.record], delimiter=sep))):
        name = name.strip() or f"column_{i + 1}"
        names.append(name if name.lower() not in {x.lower() for x in names} else f"{name}_{i + 1}")
    rows = every.join(firsts, "file", "left").where(~((F.col("split") == 0) & (F.col("n") == F.col("first")))).where("trim(record) != ''")
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    parsed = F.from_csv("record", schema, {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(len(names) + 20_000), "emptyValue": "", "nullValue": "\0", "columnNameOfCorruptRecord": "_none"})
    return rows.select(parsed.alias("r")).select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)])


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """df as delimited files with a header, cells made safe for spreadsheets; blanks at their ends stay."""
    out = df.select(*[csv_safe(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]).write.option("header", True).option("sep", sep)
    out.option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", '""').csv(path)
