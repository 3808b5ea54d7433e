"""WARC archives of pages: written with revisit records for repeated payloads, read back by a reader that salvages.

Archives are written by Spark's text writer, so they can be in any store that Spark writes; each is one WARC file, and
the writer's line end is the last byte of a record. Records are written by size classes, each with so many records in a
file that files stay near ``ARCHIVE_BYTES``, as a reading task holds one whole. The reader takes plain records and
gzip members. A record that fails a check (version line, lengths, end mark, block digest) is quarantined: the reader
searches for the next version line or gzip member that does hold a valid record, goes on there, and logs the gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, text_or_empty

ARCHIVE_BYTES = 1 << 26
#: Payload bytes up to which records are of one size class; larger ones have an archive each.
CLASSES = (1 << 14, 1 << 18, 1 << 22)
#: A header that doesn't end within so many bytes is taken as damaged.
HEADER_MOST = 1 << 20
PIECE = 1 << 16
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2026-01-01T00:00:00Z"
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_END = b"\r\n\r\n"

RECORD_SCHEMA = (
    "archive string, start long, end long, problem string, record_type string, page_id string, url string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def sha1_base32(binary: Column) -> Column:
    """SHA-1 as 32 characters of base32: five hex digits are four of them."""
    digits = F.sha1(binary)
    groups = [F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    mark = lambda g, shift: F.substr(F.lit(BASE32), F.shiftright(g, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[mark(g, shift) for g in groups for shift in (15, 10, 5, 0)])


def with_record_types(pages: DataFrame, id_col: str, url_col: str, payload_col: str, revisit_least: int) -> DataFrame:
    """``page_id, url, payload, n, digest, content, revisit, again, refers_to``: the last only for revisits.

    Payloads that occur more than once are joined back, each as one row of a count by payload and id, so a payload with
    a third of all pages is no large group. Where the first id of a payload is repeated itself, one of those rows is the
    response, and which one is decided on a stored table of them.
    """
    payload = text_or_empty(F.col(payload_col))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.regexp_replace(text_or_empty(F.col(url_col)), "[\r\n]", "%0A").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n"),
        sha1_base32(payload.cast("binary")).alias("digest"),
        F.sha2(payload.cast("binary"), 256).alias("content"),
    )
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "same")
    counted = rows.where(F.col("n") >= revisit_least).groupBy("content", "page_id").agg(F.count("*").alias("same"))
    again = counted.groupBy("content").agg(F.min(order).alias("first"), F.sum("same").alias("c")).where("c > 1")
    # written first, so that its real size decides whether the pages have to be shuffled for the join
    again = cut(again.select("content", F.col("first.page_id").alias("first_id"), (F.col("first.same") > 1).alias("tied")), "repeated")
    joined = rows.join(again, "content", "left").withColumn("again", F.col("tied").isNotNull())
    first = F.col("page_id").eqNullSafe(F.col("first_id"))
    names = ["page_id", "url", "payload", "n", "digest", "content", "revisit", "again", F.when(F.col("revisit"), F.col("first_id")).alias("refers_to")]
    if again.where("tied").isEmpty():
        return joined.withColumn("revisit", F.col("again") & ~first).select(*names)
    open_rows, rid = numbered(joined.where(F.col("tied") & first))
    response = open_rows.groupBy("content").agg(F.min(rid).alias("response"))
    decided = open_rows.join(response, "content").withColumn("revisit", F.col(rid) != F.col("response"))
    rest = joined.where(~F.coalesce(F.col("tied") & first, F.lit(False))).withColumn("revisit", F.col("again") & ~first)
    return rest.select(*names).unionByName(decided.select(*names))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_least: int = 0
) -> None:
    """Write one record for each row of ``pages`` under ``path``.

    Of rows with equal payloads of at least ``revisit_least`` bytes, that with the smallest id (null: last; of one id, any
    one) is the response and the others are revisits of it. A null payload or URL counts as empty. Ids stand in the
    header as URL-encoded text, so line breaks and spaces in them stay. No rows give no records.
    """
    rows = with_record_types(pages, id_col, url_col, payload_col, revisit_least)
    crlf = "\r\n"

    def response_id(content: Column) -> Column:
        digits = F.md5(F.concat_ws(" ", F.lit("response"), content))
        parts = [F.substring(digits, a + 1, b - a) for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    # only responses with revisits are named elsewhere, and there is one for each content
    record_id = F.when(F.col("again") & ~F.col("revisit"), response_id(F.col("content"))).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("n").cast("string"), F.lit(crlf * 2))
    rows = rows.withColumn("block", F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload"))))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(crlf))
    maybe = lambda name, value: F.coalesce(field(name, value), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}"),
        field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(crlf)),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), sha1_base32(F.col("block").cast("binary")), F.lit(crlf)),
        maybe("WARC-Page-Id", F.url_encode(F.col("page_id").cast("string"))),
        maybe("WARC-Refers-To", F.when(F.col("revisit"), response_id(F.col("content")))),
        maybe("WARC-Refers-To-Page-Id", F.url_encode(F.col("refers_to").cast("string"))),
        F.when(F.col("revisit"), f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}").otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{crlf}"),
        field("Content-Length", F.octet_length("block")),
        F.lit(crlf),
    )
    value = F.concat(head, F.col("block"), F.lit("\r\n\r"))
    # a class that holds all rows needs no filter
    longest = pages.agg(F.max(F.octet_length(F.col(payload_col).cast("string")))).first()[0] or 0
    for low, high in zip((-1, *CLASSES), (*CLASSES, None)):
        if low < longest:
            some = rows if low < 0 else rows.where(F.col("n") > low)
            some = some if high is None or high >= longest else some.where(F.col("n") <= high)
            per_file = 1 if high is None else ARCHIVE_BYTES // high
            some.select(value.alias("value")).write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member at a place holds, and its end; it is fed piece by piece, so what stands behind isn't copied."""
    unzip, parts, view = zlib.decompressobj(31), [], memoryview(data)
    while not unzip.eof:
        if at >= len(data):
            raise ValueError("gzip member cut off")
        try:
            parts.append(unzip.decompress(view[at : at + PIECE]))
        except zlib.error as problem:
            raise ValueError("gzip check") from problem
        at = min(at + PIECE, len(data))
    return b"".join(parts), at - len(unzip.unused_data)


def parse_record(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """End, fields (names in lower case) and block of the record at a place; ValueError if a check fails."""
    if data[at : at + 3] == b"\x1f\x8b\x08":
        inner, end = _member(data, at)
        stop, fields, block = parse_record(inner, 0)
        if stop != len(inner):
            raise ValueError("gzip member holds more than a record")
        return end, fields, block
    line = _START.match(data, at)
    if not line:
        raise ValueError("no version line")
    stop = data.find(_END, at, at + HEADER_MOST)
    if stop < 0:
        raise ValueError("header not ended")
    fields = {}
    for x in data[line.end() : stop].split(b"\r\n"):
        name, colon, value = x.partition(b":")
        if not colon:
            raise ValueError("field without colon")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch("[0-9]+", length := fields.get("content-length", "")):
        raise ValueError("no length")
    begin = stop + len(_END)
    end = begin + int(length)
    if data[end : end + 4] != _END:
        raise ValueError("no end mark at the length")
    block = data[begin:end]
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
        raise ValueError("block digest")
    return end + len(_END), fields, block


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(start, end, problem, fields, block) of each record and of each quarantined gap, in order; together they cover the bytes."""
    at = 0
    while at < len(data):
        try:
            end, fields, block = parse_record(data, at)
            yield at, end, None, fields, block
            at = end
        except ValueError as problem:
            start, found = at, None
            for mark in _START.finditer(data, at + 1):
                try:
                    parse_record(data, mark.start())
                    found = mark.start()
                    break
                except ValueError:
                    continue
            at = len(data) if found is None else found
            yield start, at, str(problem), {}, b""


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record and each gap, ``RECORD_SCHEMA``. Gaps have a problem and no fields; ``end`` is exclusive.

    ``payload_bytes`` and ``payload_digest`` are of the full payload, for revisits as their record states them. An empty
    file has no rows. A task holds a file whole; one above Spark's limit for binary files (2 GB) is an error there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"]):
                rows = []
                for start, end, problem, fields, block in salvage(data):
                    head, _, body = block.partition(_END)
                    revisit = fields.get("warc-type") == "revisit"
                    if revisit:
                        size = re.search(rb"(?im)^content-length: *([0-9]+)", head)
                        n, digest = int(size[1]) if size else None, fields.get("warc-payload-digest", "").rpartition(":")[2]
                    else:
                        n, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    if problem:
                        n = digest = None
                    ids = [None if (x := fields.get(f)) is None else unquote_plus(x) for f in ("warc-page-id", "warc-refers-to-page-id")]
                    rows.append((archive, start, end, problem, fields.get("warc-type"), ids[0], fields.get("warc-target-uri"),
                                 ids[1], n, digest, body if payload and not revisit and not problem else None))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, RECORD_SCHEMA)


def quarantined(records: DataFrame) -> DataFrame:
    """The log of gaps: ``archive, start, end, problem``."""
    return records.where("problem is not null").select("archive", "start", "end", "problem")
