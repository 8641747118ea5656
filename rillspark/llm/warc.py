"""WARC archives whose repeated payloads are revisit records, written and resolved by shuffling headers only.

Digests and identifiers are grouped by payload digest; of each group one record keeps its payload.  The others become revisit
records that refer to it and carry no payload.  Which rows of the pages are responses is told where they are read, by two Bloom
filters; payloads are shuffled only of the few rows that these leave open.

Archives are files of gzip members, one for each record, under one folder.  They are written and read through Spark's own writers
and readers, so that any store that Spark reaches will do and what lost tasks wrote is never seen.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen_rows, cut, fresh_path, read_table, scratch, spread_join

#: Compressed bytes at which an archive file ends, after a whole record: writers and readers hold a file at a time.  A longer record
#: is a file alone; a text that Spark can hold has less than the 2 GB that its reader of whole files allows.
FILE_BYTES = 16 << 20
#: A gzip member ends in the length of its content; up to this length the last byte is 0, so longer records take several members.
MEMBER = 1 << 24
#: The date in fresh headers; a parameter, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
#: Records that a reader passes on at a time.
ROWS = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@F.arrow_udf(T.StringType())
def payload_digest(html: pa.Array) -> pa.Array:
    """Base32 SHA-1 of the UTF-8 bytes; null counts as empty."""
    return pa.array([base64.b32encode(hashlib.sha1(h.as_py()).digest()).decode() for h in html.cast(pa.binary()).fill_null(b"")], pa.string())


def headers(pages: DataFrame) -> DataFrame:
    """``(page_id, url, digest, bytes, copies)``: what is shuffled, a row for each different one."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload_digest(F.col("html").cast("string")).alias("digest"),
        F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("bytes"),
    )
    return rows.groupBy("page_id", "url", "digest", "bytes").agg(F.count(F.lit(1)).alias("copies"))


def originals(rows: DataFrame, least_bytes: int) -> DataFrame:
    """``(digest, page_id, url)`` of the record in each group that keeps its payload: the smallest page_id, nulls last."""
    key = F.struct(F.col("page_id").isNull(), "page_id", "url")
    grouped = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(key).alias("first"))
    return grouped.select(F.col("digest").alias("of_digest"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))


def record_id(page_id: Column, url: Column, digest: Column, number: Column) -> Column:
    """A name-based identifier of the record, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit("")), digest, number.cast("string")).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _record(kind: str, more: list[Column], block: Column) -> Column:
    """The record as text."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    # A line end inside a URL would end the header early.
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("about:blank")), r"[\r\n]", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        *more,
        F.when(F.col("page_id").isNotNull(), line("Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, block, F.lit("\r\n\r\n"))


def _http(length: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES, member: int = MEMBER) -> None:
    """Write every row of ``pages`` as a response or a revisit record below ``path``.

    Payloads below ``least_bytes`` are always responses.  A null html is an empty payload, a null url ``about:blank``, a null
    page_id has no Page-ID header.  Of rows that are equal in everything one is the response, the rest revisit it.  An empty
    table writes no record.  Other columns are left out, so their names can't clash; a file ends after the record with which it has
    ``file_bytes``, and a longer record is a file alone.
    """
    with scratch():
        rows = cut(headers(pages), "warc-headers")
        firsts = cut(originals(rows, least_bytes), "warc-originals")
        known = spread_join(rows, firsts.withColumn("digest", F.col("of_digest")), "digest", "left", label="warc")
        is_first = F.col("of_digest").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
        # Revisit records need headers only: all copies but the one that is the response.
        numbers = F.explode(F.sequence(F.when(is_first, F.lit(1)).otherwise(F.lit(0)), F.col("copies").cast("int") - 1))
        revisits = (
            known.filter(F.col("of_digest").isNotNull() & ~(is_first & (F.col("copies") == 1)))
            .select("*", numbers.alias("number"))
            .withColumn("record_id", record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("number")))
        )
        to = F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("first_id"), F.col("first_url"), F.col("digest"), F.lit(0)), F.lit("\r\n"))
        revisit_records = revisits.select(_record("revisit", [to], _http(F.col("bytes"))).alias("value"))
        responses = _with_payload(pages, known.withColumn("is_first", is_first), least_bytes)
        html = F.coalesce(F.col("html"), F.lit(""))
        response_records = responses.select(_record("response", [], F.concat(_http(F.octet_length(html)), html)).alias("value"))
        files = response_records.unionByName(revisit_records).mapInArrow(_files(file_bytes, member), "value binary")
        # Every file ends in a zero byte, which is left to the writer as its line end.
        files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def _files(file_bytes: int, member: int):
    """From records to contents of archive files, each without its last byte: whole records, of gzip members."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0
        for batch in rows:
            for record in batch.column(0):
                data = record.as_py().encode()
                for at in range(0, len(data), member - 1):
                    members.append(gzip.compress(data[at : at + member - 1], 6, mtime=0))
                    size += len(members[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["value"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["value"])

    return batches


KEY = ("page_id", "url", "digest")


def _with_payload(pages: DataFrame, known: DataFrame, least_bytes: int) -> DataFrame:
    """``(page_id, url, digest, html, record_id)`` of the responses: all rows but those that are revisits."""
    known = known.filter("of_digest is not null").select(*KEY, "is_first", "copies")
    full = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).withColumn("digest", payload_digest("html"))
    small = F.coalesce(F.octet_length("html"), F.lit(0)) < least_bytes
    firsts = chosen_rows(full.filter(~small), KEY, known.filter("is_first"), known.filter("not is_first"), "warc")
    numbered = lambda rows, number: rows.withColumn("record_id", record_id(F.col("page_id"), F.col("url"), F.col("digest"), number))
    if not least_bytes:
        return numbered(firsts, F.lit(0))
    return numbered(firsts, F.lit(0)).unionByName(numbered(full.filter(small), F.monotonically_increasing_id()))


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of each record of an uncompressed archive, read as a stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):  # line ends between records
            continue
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")) and b": " in line:
            name, value = line.decode("utf-8", "replace").split(": ", 1)
            head[name.lower()] = value
        yield head, stream.read(int(head["content-length"]))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, record_type, page_id, url, digest, payload_bytes, refers_to_record)`` of every record below ``path``.

    A response's digest and size are counted again from its payload; a revisit record has what its header says, and no size.
    """
    schema = "record_id string, record_type string, page_id long, url string, digest string, payload_bytes long, refers_to_record string"

    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def row(head: dict[str, str], block: bytes) -> tuple:
        kind, page = head["warc-type"], head.get("page-id")
        digest, size = head.get("warc-payload-digest", "").removeprefix("sha1:"), None
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        return head["warc-record-id"], kind, int(page) if page else None, head.get("warc-target-uri"), digest, size, head.get("warc-refers-to")

    def batches(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            for content in batch.column(0):
                data = io.BytesIO(content.as_py())
                records = parse(gzip.open(data) if data.getbuffer()[:2] == b"\x1f\x8b" else data)
                while rows := [row(*record) for record in islice(records, ROWS)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(batches, schema)


def resolve(records: DataFrame) -> DataFrame:
    """The records, revisits with the ``payload_bytes`` of the response they refer to and its page_id as ``refers_to``.

    A revisit whose response isn't among the records has neither; an empty table gives an empty one.
    """
    responses = records.filter("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("page_id").alias("first"), F.col("payload_bytes").alias("full_bytes"))
    # What refers to nothing has a key of its own, so that these rows aren't all one task's.
    of = F.coalesce("refers_to_record", F.concat(F.lit("none of "), "record_id")).alias("of")
    joined = spread_join(records.select("*", of), responses, "of", "left", label="warc-resolved")
    return joined.select(
        "page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("first").alias("refers_to")
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    return resolve(cut(read_archives(spark, path), "warc-records"))


#: The query's result in SQL: base32 is made of five hexadecimal digits at a time.
ORACLE = """WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS hex, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + ((CAST('0x' || substr(hex, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to FROM f"""
