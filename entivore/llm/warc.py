"""A content-addressed WARC archive.

An archive is two tables in a folder: payloads holds the bytes of each distinct payload once
(a zstd frame) under its SHA-256, headers holds the exact header block of every record with
the digest it points to. Original records are put together again by a join on the digest;
every payload is checked against its SHA-256 and SHA-1 as it is read. write_warc() gives the
records as standard .warc.gz files.

Of records with equal payloads of at least min_bytes bytes, the one with the largest page_id
is the response and the others revisit it; smaller ones are all responses. Repeated rows of
that page_id are all responses; every record has an id of its own.

Skew: groups of equal payloads are found by partial aggregation over digests; the way back
is a join with the stored groups of two or more. Payloads join with responses only, whose
digests are unique, so a payload that a third of the pages share moves once.

Cases: null html counts as empty; a null url leaves the target out; control characters in a
url are percent-encoded; a page_id may be of any type that has an order and can be cast from
its text; a null page_id stays null and never wins over another. An empty table gives an
empty archive. Other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from entivore.llm.common import scratch, stored, table

DATE = "2024-01-01T00:00:00Z"
_ID, _NONE = "urn:page:", "-"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digests(pages: DataFrame, frames: bool) -> DataFrame:
    names = ["sha256", "frame"] if frames else ["page_id", "url", "n", "sha1", "sha256"]
    kind = pages.schema["page_id"].dataType
    kinds = {"page_id": to_arrow_type(kind), "url": pa.string(), "n": pa.int64(), "sha1": pa.string(), "sha256": pa.binary(), "frame": pa.binary()}
    schema = pa.schema([(n, kinds[n]) for n in names])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            urls, texts = (batch.column(i).to_pylist() for i in (1, 2))
            data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            cols = {"page_id": batch.column(0), "url": urls, "n": [len(x) for x in data], "sha256": [hashlib.sha256(x).digest() for x in data]}
            if frames:
                cols["frame"] = [pack.compress(x) for x in data]
            else:
                cols["sha1"] = [sha1_base32(x) for x in data]
            yield pa.RecordBatch.from_arrays([cols[n] if n == "page_id" else pa.array(cols[n], type=kinds[n]) for n in names], schema=schema)

    ddl = "sha256 binary, frame binary" if frames else f"page_id {kind.simpleString()}, url string, n long, sha1 string, sha256 binary"
    return pages.select("page_id", "url", "html").mapInArrow(run, ddl)


def record_id(page_id: str | None, row: int) -> str:
    return f"<{_ID}{_NONE if page_id is None else quote(page_id, safe='').replace(_NONE, '%2D')}:{row}>"


def header(own_id: str, url: str | None, n: int, sha1: str, refers_to: str | None, revisit: bool) -> bytes:
    """The bytes of a record up to its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own_id}"]
    lines += [f"WARC-Target-URI: {target}"] * (url is not None)
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + http


def write_archive(pages: DataFrame, path: str, *, min_bytes: int = 0) -> None:
    """Writes the archive of pages (page_id, url, html) to path/headers and path/payloads."""
    index = stored(_digests(pages, False).withColumn("row", F.monotonically_increasing_id()), "warc-index")
    same = index.groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("best"), F.count("*").alias("copies"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("sha1").alias("sha1_min"), F.max("sha1").alias("sha1_max"))
    same = stored(same.where("copies > 1"), "warc-groups")
    if not same.where("n_min != n_max OR sha1_min != sha1_max").isEmpty():
        raise ValueError("two payloads share a SHA-256")
    typed = index.join(same.select("sha256", "best"), "sha256", "left")
    typed = typed.withColumn("revisit", F.coalesce((F.col("n") >= min_bytes) & F.col("best").isNotNull() & ~F.col("best.page_id").eqNullSafe(F.col("page_id")), F.lit(False)))

    def heads(batches):
        for batch in batches:
            rows = batch.to_pylist()
            made = [header(record_id(r["page_id"], r["row"]), r["url"], r["n"], r["sha1"], record_id(r["best_id"], r["best_row"]) if r["revisit"] else None, r["revisit"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("sha256"), batch.column("revisit"), pa.array(made, pa.binary())], names=["sha256", "revisit", "header"])

    typed.select(F.col("page_id").cast("string").alias("page_id"), "row", "url", "n", "sha1", "sha256", F.col("best.page_id").cast("string").alias("best_id"), F.col("best.row").alias("best_row"), "revisit").mapInArrow(heads, "sha256 binary, revisit boolean, header binary").write.parquet(f"{path}/headers")
    _digests(pages, True).groupBy("sha256").agg(F.first("frame").alias("frame")).write.parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive, byte for byte: header, and the payload's zstd frame (null for revisits)."""
    heads = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    full = heads.where("NOT revisit").join(payloads, "sha256").select("sha256", "header", "frame")
    return full.unionByName(heads.where("revisit").select("sha256", "header", F.lit(None).cast("binary").alias("frame")))


def record_bytes(head: bytes, frame: bytes | None) -> bytes:
    """A WARC record as it stands in a file."""
    return head + (b"" if frame is None else zstandard.ZstdDecompressor().decompress(frame)) + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Header fields, and the payload (None for revisits), of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[int(fields["Content-Length"]) :] != b"\r\n\r\n":
        raise ValueError("the record's length doesn't fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload_bytes"] = int(http.rsplit(b"Content-Length: ", 1)[1])
    return fields | {"payload": payload if fields["WARC-Type"] == "response" else None}


def _page(own_id: str) -> str | None:
    value = own_id.strip("<>").removeprefix(_ID).rpartition(":")[0]
    return None if value == _NONE else unquote(value)


def write_warc(records: DataFrame, path: str) -> None:
    """The records as WARC files: path/part-*.txt.gz, each a run of whole records in one gzip stream."""

    def run(batches):
        for batch in batches:
            # every record ends in two line breaks, which the writer adds
            texts = [record_bytes(h, f)[:-4].decode("utf-8", "surrogatepass") for h, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    records.select("header", "frame").mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def summary(records: DataFrame, page_id: str = "long") -> DataFrame:
    """Per record what its bytes say: page_id (of the type named), payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                got = parse_record(record_bytes(r["header"], r["frame"]))
                digest = got["WARC-Payload-Digest"].removeprefix("sha1:")
                if (p := got["payload"]) is not None and (hashlib.sha256(p).digest() != r["sha256"] or sha1_base32(p) != digest or len(p) != got["payload_bytes"]):
                    raise ValueError(f"the payload of {got['WARC-Record-ID']} isn't what was written")
                to = got.get("WARC-Refers-To")
                rows.append({"page_id": _page(got["WARC-Record-ID"]), "payload_bytes": got["payload_bytes"], "payload_digest": digest, "record_type": got["WARC-Type"], "refers_to": _page(to) if to else None})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = records.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(page_id) for c in ("page_id", "refers_to")})


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write_archive(pages, path)
    return summary(read_records(spark, path), pages.schema["page_id"].dataType.simpleString())


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS best FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, ((5 * i) // 4 + 1)::INT, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM d
"""
