"""WARC revisit resolution.

Headers (record id, digest and length of the payload) are shuffled by payload digest, which finds for every digest the
original response; archives are then written whose headers are made afresh: one ``response`` per payload and a ``revisit``
(identical-payload-digest) for every other record of it.  Content is not shuffled: revisits have none, and a response is
written where its content was read, by a Bloom filter of the revisits.  Only the few responses that the filter takes for
revisits are joined with their content.

Archives are WARC/1.1, each of about ``ARCHIVE_BYTES`` at most, or of one larger record.  A row is an archive for Spark's text
sink, with a file for each row, so its commit protocol makes the write atomic and repeatable in any file system.  The sink
ends a row with a line separator.  With ``compression="none"`` that is the end of the last record.  With ``"gzip"`` every
record is a member of its own, and a member's last byte is nought for records under 16 MiB, so that byte is the separator;
a larger record is followed by an empty member.

Defined cases: a null html is the empty payload, a null url an empty target; records with equal payload and equal
smallest id are all responses; a record without an id never is the original while one with an id exists, and where all
lack one, each is a response; payloads of any length are read whole; an empty table gives no archive; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.llm.base import delete, discard, fresh_path, materialize, maybe_in, tidy

CRLF = "\r\n"
ARCHIVE_BYTES = 32 << 20  # of an archive before compression: one is read back as a whole
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: four runs of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]), _BASE32_DIGITS, _BASE32)


def record_urn(page_id: Column) -> Column:
    """A custom-format UUID (version 8) that holds the 64 bits of the id; variant digit 9 stands for no id."""
    h = F.lpad(F.lower(F.hex(page_id)), 16, "0")
    some = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8000-8000-00000000"), F.substring(h, 13, 4), F.lit(">"))
    return F.coalesce(some, F.lit("<urn:uuid:00000000-0000-8000-9000-000000000000>"))


def urn_id(urn: str) -> int | None:
    """The id in a :func:`record_urn`."""
    first, second, _, variant, last = urn.removeprefix("<urn:uuid:").removesuffix(">").split("-")
    if variant[0] == "9":
        return None
    n = int(first + second + last[-4:], 16)
    return n - (1 << 64) if n >> 63 else n


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes and payload_digest of every row, and ``key``, a hash of a record's id and payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.col("html").cast("binary"))})
    return rows.withColumn("key", F.xxhash64("page_id", "payload_digest", "payload_bytes"))


def originals(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The smallest page_id of every payload of at least ``least_bytes`` that several records have.

    A count and a minimum are combined before the shuffle, so a payload of a third of all records costs one row a task.
    The result is stored: the join that follows then has plain scans on both sides and splits hot digests at run time.
    """
    # records are told apart by digest and length
    many = heads.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    return materialize(many.where("n > 1 and original is not null").drop("n"), "warc-originals")


def records(pages: DataFrame, least_bytes: int = 0, date: str | None = None, spent: list | None = None) -> DataFrame:
    """One column, ``value``: the text of each record without its two closing line ends.  ``date``: when the archives are made;
    ``spent`` gets the stored tables that can go when the records are written."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = headers(pages)
    # what has no content is read many times: it is stored, and content is read twice in all, here and where it is written
    light = materialize(heads.drop("html"), "warc-headers")
    known = originals(light, least_bytes)
    # what has no content is small, so a hot digest's rows are split at run time like any skewed join
    again = light.join(known, ["payload_digest", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("original")))
    again = materialize(again.select("key", "page_id", "url", "payload_bytes", "payload_digest", "original"), "warc-revisits")
    discard(known)
    whole = ["page_id", "url", "html", "payload_bytes", "payload_digest"]
    sure = maybe_in(heads, "key", again.select("key"), keep=False).select(*whole)
    doubtful = maybe_in(light, "key", again.select("key"))
    wrong = materialize(doubtful.join(again.select("key").distinct(), "key", "left_anti").select("key").distinct(), "warc-wrong")
    discard(light)
    if spent is not None:
        spent += [again, wrong]
    rest = maybe_in(heads, "key", wrong).join(wrong, "key", "left_semi").select(*whole)
    rows = sure.union(rest).withColumn("original", F.lit(None).cast("long")).unionByName(again.drop("key").withColumn("html", F.lit(None).cast("string")))

    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    http = F.concat_ws(CRLF, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("payload_bytes")), F.lit(""), F.lit(""))
    revisit = F.col("html").isNull()
    warc = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), record_urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_urn(F.col("original")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("http") + F.coalesce(F.octet_length("html"), F.lit(0))),
        F.lit(""),
        F.lit(""),
    )
    return rows.withColumn("http", http).select(F.concat(warc, F.col("http"), F.coalesce("html", F.lit(""))).alias("value"))


_EMPTY = gzip.compress(b"", mtime=0)


def _archives(compress: bool, most: int):
    """Rows of records to rows of archives without the byte or bytes that the sink's separator adds."""
    end = CRLF.encode() * 2

    def packed(held: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(held)
        if compress:
            whole = (whole if whole.endswith(b"\0") else whole + _EMPTY).removesuffix(b"\0")
        return pa.RecordBatch.from_arrays([pa.array([whole if compress else whole.removesuffix(end)], pa.large_binary()).cast(pa.binary())], names=["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for value in b.column(0):
                record = value.as_buffer().to_pybytes() + end
                if held and size + len(record) > most:
                    yield packed(held)
                    held, size = [], 0
                held.append(gzip.compress(record, 6, mtime=0) if compress else record)
                size += len(record)
        if held:
            yield packed(held)

    return run


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", archive_bytes: int = ARCHIVE_BYTES, **options) -> None:
    """Write the resolved records of ``pages`` as archives under ``path``."""
    compress = {"gzip": True, "none": False}[compression]
    spent: list[DataFrame] = []
    made = records(pages, spent=spent, **options).mapInArrow(tidy(_archives(compress, archive_bytes)), "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", "\0" if compress else CRLF * 2).option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    discard(*spent)


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def parse(stream) -> Iterator[Record]:
    """The records of one archive, one at a time."""
    while line := stream.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        found: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) and line:
            name, _, value = line.decode().partition(":")
            found[name.lower()] = value.strip()
        length = int(found["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {found.get('warc-record-id')} is cut short")
        yield Record(found, block)


def _read(record: Record) -> tuple:
    head, _, payload = record.block.partition(b"\r\n\r\n")
    declared = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = record.headers["warc-payload-digest"].removeprefix("sha1:")
    kind = record.headers["warc-type"]
    if kind == "response" and (len(payload) != declared or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {record.headers['warc-record-id']} does not match its digest")
    refers = record.headers.get("warc-refers-to")
    return urn_id(record.headers["warc-record-id"]), declared, digest, kind, refers and urn_id(refers), record.headers["warc-target-uri"]


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def read_archives(spark, path: str) -> DataFrame:
    """One row per record of the archives under ``path``; every response's payload is checked against its digest."""

    types, names = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()], [x.split()[0] for x in _READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                raw = io.BytesIO(content.as_buffer())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b" else raw
                rows = []
                for record in parse(stream):
                    rows.append(_read(record))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(tidy(run), _READ)


def resolve(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the archives of ``pages`` (to ``path``, else to the shared folder, from where they go again) and read them back."""
    spark = pages.sparkSession
    at = path or fresh_path(spark, "warc")
    write_archives(pages, at, **options)
    if path:
        return read_archives(spark, at)
    got = materialize(read_archives(spark, at), "warc-read")
    delete(spark, at)
    return got
