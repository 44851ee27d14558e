"""Cutting documents into passages and tables, and putting results of passages together."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entivore.operators.documents import pages

SHEET = r"(?m)^## Sheet: *(.+?) *$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sheet_parts(text: Column) -> Column:
    """The texts of all sheets, blank ones and what comes before the first included."""
    return F.split(text, SHEET, -1)


def sheets(docs: DataFrame) -> DataFrame:
    """doc_id, sheet, text: split at lines '## Sheet: name'; text before the first is _preamble, without any all is
    Sheet1; blank sheets go. (What is exploded comes by outer forms here and filters follow: a filter before would make the text
    anew, which may be a whole table's rows put in order.)"""
    names = F.regexp_extract_all("text", F.lit(SHEET), F.lit(1))
    zipped = F.arrays_zip(F.concat(F.array(F.when(F.size(names) > 0, "_preamble").otherwise("Sheet1")), names).alias("sheet"), sheet_parts(F.col("text")).alias("part"))
    out = docs.select("doc_id", F.size(names).alias("n"), F.explode_outer(zipped).alias("x")).where("x.part IS NOT NULL")
    return out.select("doc_id", "n", F.col("x.sheet").alias("sheet"), stripped(F.col("x.part")).alias("text")).where("n = 0 OR text != ''").drop("n")


def _pieces(text: str, size: int, marks: Sequence[str]) -> Iterator[str]:
    if len(text) <= size:
        yield text
        return
    mark = next((m for m in marks if m in text[:-1]), "")
    if not mark:
        yield from (text[i : i + size] for i in range(0, len(text), size))
        return
    held = ""
    for part in text.replace(mark, mark + "\0").split("\0"):
        if held and len(held) + len(part) > size:
            yield from _pieces(held, size, marks[marks.index(mark) + 1 :])
            held = ""
        held += part
    yield from _pieces(held, size, marks[marks.index(mark) + 1 :])


def recursive_chunks(docs: DataFrame, size: int, marks: Sequence[str] = ("\n\n", "\n", ". ", " ")) -> DataFrame:
    """doc_id, ix, chunk: pieces of at most size characters, cut at the first of marks that a too long piece holds.
    Pieces together are the text. Cutting depends on what came before, so it runs in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, c) for d, t in zip(b["doc_id"], b["text"], strict=True) if t for i, c in enumerate(_pieces(t.replace("\0", " "), size, list(marks)))]
            yield pd.DataFrame(rows, columns=["doc_id", "ix", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ix int, chunk string")


def overlapping_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, ix, chunk: pieces of at most size characters that end at their last blank, if it comes after what they repeat;
    each begins overlap characters, which must be fewer than half of size, before the end of the one before."""

    def cut(text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > size:
            # a blank that leaves more than what is repeated, so that every piece brings the text forward
            end = text.rfind(" ", start + overlap + 1, start + size)
            end = start + size if end < 0 else end
            yield text[start:end]
            start = end - overlap
        yield text[start:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, c) for d, t in zip(b["doc_id"], b["text"], strict=True) if t for i, c in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "ix", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ix int, chunk string")


def table_lines(text: Column) -> Column:
    """The pipe lines of text that aren't rulers."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^[\s|:-]+$"))


def cells(line: Column) -> Column:
    """Lines that begin and end with a pipe, and those without an escaped one, need no pattern; one that is split by is compiled for
    each line."""
    plain = F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|")) & (F.length(line) > 1)
    inner = F.when(plain, F.substring(line, F.lit(2), F.length(line) - 2)).otherwise(F.regexp_replace(line, r"^\s*\||\|\s*$", ""))
    escaped = F.contains(line, F.lit("\\|"))
    parts = F.when(escaped, F.split(inner, r"(?<!\\)\|")).otherwise(F.split(inner, r"\|"))
    own = F.transform(parts, lambda c: F.trim(c))
    return F.when(escaped, F.transform(own, lambda c: F.replace(c, F.lit("\\|"), F.lit("|")))).otherwise(own)


def first_table(text: Column) -> Column:
    """The lines of the first run of pipe lines, or null."""
    return F.nullif(F.regexp_extract(text, r"(?m)(?:^[ \t]*\|.*\|[ \t]*(?:\n|\z))+", 0), F.lit(""))


def table_chunks(docs: DataFrame, rows: int, columns: Sequence[str] | None = None) -> DataFrame:
    """doc_id, ix, chunk: the rows of a document's markdown table by so many, the header before each; of columns (any
    case), if the header knows one of them, only those."""
    lines = table_lines(F.col("text"))
    held = docs.select("doc_id", lines.alias("lines")).where("size(lines) > 1").withColumn("head", cells(F.col("lines")[0]))
    wanted = F.filter(F.sequence(F.lit(0), F.size("head") - 1), lambda i: F.lower(F.get("head", i)).isin(*[c.lower() for c in columns or ()]) if columns else F.lit(True))
    held = held.withColumn("at", F.when(F.size(wanted) > 0, wanted).otherwise(F.sequence(F.lit(0), F.size("head") - 1)))
    parts = held.select("doc_id", "lines", "at", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 2) / rows).cast("int"))).alias("ix"))
    line = lambda x: F.concat(F.lit("| "), F.array_join(F.transform("at", lambda i: F.coalesce(F.get(cells(x), i), F.lit(""))), " | "), F.lit(" |"))
    own = F.slice("lines", F.col("ix") * rows + 2, F.lit(rows))
    return parts.select("doc_id", "ix", F.array_join(F.concat(F.array(line(F.col("lines")[0])), F.transform(own, line)), "\n").alias("chunk"))


def extracted(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """doc_id, row, column, value: what a document's table says in columns (any case): without any, every cell that isn't
    empty; of one, its cells that aren't; of several, all of them in rows where none is empty."""
    low = [c.lower() for c in columns]
    # each line is cut once; what several steps need is a column of its own, and all that comes of a table is exploded at once
    cut = docs.select("doc_id", F.transform(table_lines(F.col("text")), cells).alias("cut"))
    head = F.get("cut", F.lit(0))
    wanted = F.filter(F.transform(head, lambda x, i: F.when(F.lower(x).isin(*low) if low else x.isNotNull(), i)), lambda i: i.isNotNull())
    cut = cut.select("doc_id", "cut", head.alias("head"), wanted.alias("at"))

    def told(line: Column, row: Column) -> Column:
        whole = row > 0
        if len(low) > 1:
            whole = whole & (F.size("at") == len(low)) & F.forall("at", lambda i: F.coalesce(F.get(line, i), F.lit("")) != "")
        all_ = F.transform("at", lambda i: F.struct(row.alias("row"), F.get("head", i).alias("column"), F.get(line, i).alias("value")))
        return F.when(whole, all_).otherwise(F.array().cast("array<struct<row:int,column:string,value:string>>"))

    return cut.select("doc_id", F.inline_outer(F.flatten(F.transform("cut", told)))).where("coalesce(value, '') != '' AND column IS NOT NULL")


def batched(pages: DataFrame, target: int) -> DataFrame:
    """doc_id, batch, first_page, n_pages, text: pages (doc_id, page, text) in order, joined by a blank line, closed when the next
    would go beyond target characters. A page is never cut. A document's pages pass one task one after the other; only the open batch is held."""

    kind = pages.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own, size, type_ = None, 0, None  # the batch that is being filled: doc_id, batch, first_page, texts
        out: list[tuple] = []
        told = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [type_, pa.int32(), pa.int32(), pa.int32(), pa.string()], strict=True)], names=["doc_id", "batch", "first_page", "n_pages", "text"])
        for batch in batches:
            type_ = batch.schema.field(0).type
            for doc_id, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and own[0] == doc_id and size + len(text) <= target:
                    own[3].append(text)
                    size += len(text)
                    continue
                number = own[1] + 1 if own and own[0] == doc_id else 0
                if own:
                    out.append((*own[:3], len(own[3]), "\n\n".join(own[3])))
                own, size = (doc_id, number, page, [text]), len(text)
            if out:
                yield told()
                out.clear()
        if own:
            out.append((*own[:3], len(own[3]), "\n\n".join(own[3])))
            yield told()

    in_order = pages.select("doc_id", "page", "text").repartition("doc_id").sortWithinPartitions("doc_id", "page", "text")
    return in_order.mapInArrow(run, f"doc_id {kind}, batch int, first_page int, n_pages int, text string")


def merged_first(results: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """results with one row per keys: the first by order, and how many there were (n). Each task folds its own rows first."""
    first = results.groupBy(*keys).agg(F.min_by(F.struct(*results.columns), F.struct(*order)).alias("_first"), F.count("*").alias("n"))
    return first.select("_first.*", "n")


def overriding(*frames: DataFrame, key: str) -> DataFrame:
    """The rows of all frames, the last frame's where a key is in more than one."""
    tagged = [df.withColumn("_place", F.lit(i)) for i, df in enumerate(frames)]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_place")))
    return every.withColumn("_last", last).where("_last = 1").drop("_last", "_place")


#: What a file is by the ending of its name, where nothing else says so.
ENDINGS = {"pdf": "pdf", "csv": "csv", "tsv": "csv", "xlsx": "xlsx", "xls": "xlsx"}


def session_chunks(sessions: DataFrame, size: int = 2000, rows: int = 8) -> DataFrame:
    """session_id, file, filename, page (a number or a sheet), ix, chunk of the files of each session (session_id, texts, metadata: structs of filename
    and type). Texts and metadata go in pairs as far as both reach. Tables are cut by rows, with their header (csv: the text,
    xlsx: each sheet); pages and other texts by characters."""
    n = F.least(F.size("texts"), F.size("metadata"))
    pairs = F.arrays_zip(F.slice("texts", F.lit(1), n).alias("text"), F.slice("metadata", F.lit(1), n).alias("meta"))
    files = sessions.where("texts IS NOT NULL AND metadata IS NOT NULL").select("session_id", F.posexplode(pairs).alias("file", "x"))
    files = files.select("session_id", "file", F.coalesce("x.meta.filename", F.lit("unknown")).alias("filename"), "x.meta.type", F.col("x.text").alias("text"))
    known = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    ending = F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))
    kind = F.coalesce(F.nullif("type", F.lit("")), F.try_element_at(known, ending), F.lit("txt"))
    files = files.select(F.concat_ws(":", "session_id", "file").alias("doc_id"), "session_id", "file", "filename", kind.alias("kind"), "text").where("text IS NOT NULL")
    of = {k: files.where(F.col("kind") == k).select("doc_id", "text") for k in ("pdf", "csv", "xlsx")}

    def by_part(parts: DataFrame, page: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Chunks of a file's parts (doc_id, page, text)."""
        chunks = cut(parts.select(F.to_json(F.array("doc_id", F.col(page).cast("string"))).alias("doc_id"), "text"))
        key = F.from_json("doc_id", "array<string>")
        return chunks.select(key[0].alias("doc_id"), key[1].alias("page"), "ix", "chunk")

    rest = files.where(~F.col("kind").isin(*of)).select("doc_id", "text")
    every = by_part(pages(of["pdf"]), "page", lambda d: recursive_chunks(d, size))
    every = every.unionByName(table_chunks(of["csv"], rows).withColumn("page", F.lit("1")))
    every = every.unionByName(by_part(sheets(of["xlsx"]), "sheet", lambda d: table_chunks(d, rows)))
    every = every.unionByName(recursive_chunks(rest, size).withColumn("page", F.lit("1")))
    return every.join(files.select("doc_id", "session_id", "file", "filename"), "doc_id").select("session_id", "file", "filename", "page", "ix", "chunk")
