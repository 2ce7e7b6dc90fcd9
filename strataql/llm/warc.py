"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

A record is one row, and the text sink puts rows into files, so archives reach any store that Spark
writes. A compressed record is a gzip member of its own, so that damage ends at the next record; the
sink's separator of rows is then an empty member, which readers of gzip pass over. A file holds at
most ``FILE_ROWS`` records and about ``FILE_BYTES`` bytes of payload, or one record that is larger. Of
equal payloads of ``least_revisit`` bytes or more, the row with the smallest id is a response and the
others refer to it; no other row is a revisit. What refers to what is found among digests alone:
payloads are not shuffled while the repeated digests are few enough to broadcast, else once by id.

Reading checks each gzip member and each record: version line, header lines, Content-Length, the
blank lines after the block, and the payload digest. Where a check fails, the reader searches for
the next gzip member or version line that passes, goes on there, and logs the bytes between as a
quarantined gap. Records that came before a damaged place in a member are kept: what deflate gives
up to the damage is taken byte by byte.

Defined cases: a null payload is empty; a null id is never referred to and always a response; rows
that repeat the smallest id are responses each; null URLs are left out of the record; line feeds
in URLs are percent-encoded; a file without any record is one gap; empty files have none; a payload
of 2 GB or more is no row of Spark's and can't occur; headers that don't end within ``HEAD_BYTES``
are broken; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, small_batches

VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
EMPTY_MEMBER = zlib.compress(b"", wbits=31)
FILE_ROWS, FILE_BYTES = 2000, 256 << 20
HEAD_BYTES = 1 << 16
#: repeated digests that are broadcast at most (about 100 bytes each)
FEW = 500_000
LEAST_REVISIT = 100
ROW_SCHEMA = "file string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, gap_bytes long, reason string"


# --- writing ------------------------------------------------------------------------------------


def references(pages: DataFrame, ws: Workspace, id_col: str = "page_id", payload_col: str = "html", least_revisit: int = LEAST_REVISIT) -> tuple[DataFrame, int, int]:
    """(digest, first): payloads that several rows have and the smallest id; their number, and the largest payload."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    marks = pages.select(F.col(id_col).alias("id"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"))
    by_digest = marks.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max("size").alias("size"))
    found = ws.write(by_digest.filter((F.col("n") > 1) | (F.col("size") > FILE_BYTES // FILE_ROWS)), "digests")
    firsts = found.filter((F.col("n") > 1) & (F.col("size") >= least_revisit)).select("digest", "first")
    largest = found.agg(F.max("size")).first()[0] or 0
    return firsts, firsts.count(), largest


def records(pages: DataFrame, ws: Workspace, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = LEAST_REVISIT, few: int = FEW) -> tuple[DataFrame, int]:
    """One row for each record of pages: ``value``, its bytes but for the last line feed, and the payload's ``size``; the largest size."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    firsts, n, largest = references(pages, ws, id_col, payload_col, least_revisit)
    if n <= few:
        rows = rows.join(F.broadcast(firsts), "digest", "left")
    else:
        told = rows.filter((F.col("size") >= least_revisit) & F.col("id").isNotNull()).select("id", "digest").join(firsts, "digest").filter(F.col("id") != F.col("first"))
        rows = rows.join(told.distinct(), ["id", "digest"], "left")
    revisit = F.col("first").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.trim("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"), F.coalesce(line("WARC-Target-URI", url), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", urn(F.col("first"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block, F.lit("\r\n\r")).alias("value"), "size"), largest


def write(pages: DataFrame, path: str, compress: bool = True, file_rows: int = FILE_ROWS, file_bytes: int = FILE_BYTES, **columns) -> None:
    """Archives of at most ``file_rows`` records in folder path; large payloads have files of fewer."""
    rows, largest = records(pages, Workspace(pages.sparkSession, "warc_write"), **columns)
    usual = max(1, file_bytes // file_rows)
    _write(rows if largest <= usual else rows.filter(F.col("size") <= usual), path, compress, file_rows)
    if largest > usual:
        _write(rows.filter(F.col("size") > usual), path, compress, max(1, file_bytes // largest))


def _write(rows: DataFrame, path: str, compress: bool, file_rows: int) -> None:
    rows, separator = rows.select("value"), "\n"
    if compress:
        small_batches(rows.sparkSession)
        rows, separator = rows.mapInArrow(_compressed, "value binary").select(F.col("value").cast("string")), EMPTY_MEMBER.decode("latin-1")
    writer = rows.write.mode("append").option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", file_rows)
    writer.option("compression", "none").text(path)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record, with its last line feed, as a gzip member."""
    for batch in batches:
        out = [zlib.compress(v.as_py().encode() + b"\n", wbits=31) for v in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


# --- salvage ------------------------------------------------------------------------------------


@dataclass
class Record:
    offset: int  # in the file, or in the member's content
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    size: int
    reason: str


_NEXT = re.compile(rb"WARC/1\.\d\r?\n")


def _payload(record: Record) -> tuple[bytes, int]:
    """The payload and its full length; a revisit has only the length that its HTTP header tells."""
    if "application/http" not in record.headers.get("content-type", ""):
        return record.block, len(record.block)
    head, _, body = record.block.partition(b"\r\n\r\n")
    if record.headers.get("warc-type") == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        return b"", int(told[1]) if told else 0
    return body, len(body)


def _record(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record at a place and where the next one begins, or why there is none."""
    if not _NEXT.match(data, at):
        return None, at, "no version line"
    end = data.find(b"\r\n\r\n", at, at + HEAD_BYTES)
    if end < 0:
        return None, at, "headers don't end"
    headers: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "broken header line"
        name = name.decode("latin-1").strip().lower()
        if name in headers and name in ("content-length", "warc-type", "warc-record-id"):
            return None, at, "a header twice"  # two records have run together
        headers[name] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdecimal():
        return None, at, "no content length"
    begin = end + 4
    stop = begin + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, at, "block doesn't end as its length says"
    record = Record(at, headers, data[begin:stop])
    kind, _, want = headers.get("warc-payload-digest", "").partition(":")
    if kind == "sha256" and headers.get("warc-type") != "revisit" and hashlib.sha256(_payload(record)[0]).hexdigest() != want:
        return None, at, "payload digest differs"
    return record, stop + 4, ""


def salvage_plain(data: bytes, base: int = 0, reason: str = "") -> Iterator[Record | Gap]:
    """Records of uncompressed content and gaps between; base is added to their places."""
    at = 0
    while at < len(data):
        record, after, why = _record(data, at)
        if record is not None:
            record.offset += base
            yield record
            at = after
            continue
        start = at
        while True:  # the next version line whose record passes
            found = _NEXT.search(data, at + 1)
            if not found:
                yield Gap(base + start, len(data) - start, reason or why)
                return
            at = found.start()
            if _record(data, at)[0] is not None:
                yield Gap(base + start, at - start, why)
                break


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Content of the gzip member at a place, where it ends, and what is wrong with it."""
    out, inflater, place = [], zlib.decompressobj(31), at
    try:
        while place < len(data) and not inflater.eof:
            part = data[place : place + 65536]
            out.append(inflater.decompress(part))
            place += len(part)
    except zlib.error as e:
        # what comes out before the damage is kept; the end is unknown
        return b"".join(out) + _before_damage(data, at, place), -1, f"gzip: {e}"
    if not inflater.eof:
        return b"".join(out), -1, "gzip: the file ends inside a member"
    return b"".join(out), place - len(inflater.unused_data), ""


def _before_damage(data: bytes, at: int, place: int) -> bytes:
    """Content between a place in the member, up to which all is well, and the damage in the part that begins there.

    A call of zlib that fails gives nothing, so the part is read in ever smaller steps, at last a byte
    at a time for input and output. Only one byte can be missing: that whose code ends in the byte in
    which the damage begins.
    """
    inflater, out = zlib.decompressobj(31), []
    inflater.decompress(data[at:place])
    for step in (1024, 32, 1):
        while place < len(data):
            before = inflater.copy()
            try:
                out.append(inflater.decompress(data[place : place + step]))
            except zlib.error:
                inflater = before
                break
            place += step
    rest = data[place : place + 1]
    try:
        while part := inflater.decompress(rest, 1):
            out.append(part)
            rest = inflater.unconsumed_tail
    except zlib.error:
        pass
    # a record's block is checked by length and digest; the line feed behind it tells nothing more
    found = b"".join(out)
    return found + b"\n" if found.endswith(b"\r\n\r") else found


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and quarantined gaps of an archive, plain or of gzip members, or both in turn.

    A record in a member has the member's place. A damaged member gives the records that come out
    before the damage, and is then a gap up to the next member or version line that holds.
    """
    at, n = 0, len(data)
    while at < n:
        if data.startswith(GZIP, at):
            content, end, why = _inflate(data, at)
            for x in salvage_plain(content):
                if isinstance(x, Record):
                    x.offset = at
                    yield x
                elif not why:
                    yield Gap(at, end - at, x.reason)
            if not why:
                at = end
                continue
        elif _NEXT.match(data, at):
            stop = next((m for m in _members(data, at + 1)), n)  # plain records up to the next member
            yield from salvage_plain(data[at:stop], at)
            at = stop
            continue
        else:
            why = "neither a gzip member nor a version line"
        start = at
        at = min((x for x in (_resume(data, at + 1),) if x is not None), default=n)
        yield Gap(start, at - start, why)


def _members(data: bytes, at: int) -> Iterator[int]:
    """Places of gzip members that begin with a record."""
    while (at := data.find(GZIP, at)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(data[at : at + 4096], 64).startswith(VERSION):
                yield at
        except zlib.error:
            pass
        at += 1


def _resume(data: bytes, at: int) -> int | None:
    member = next(_members(data, at), None)
    for m in _NEXT.finditer(data, at):
        if member is not None and m.start() > member:
            break
        if _record(data, m.start())[0] is not None:
            return m.start()
    return member


def _urn(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in a folder, and one (record_type ``gap``) for each gap.

    ``payloads``: with the payload's bytes. An archive is read whole by a task, so archives should be of bounded size.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f.name for f in spark.createDataFrame([], ROW_SCHEMA).schema]
    arrow = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("gap_bytes", pa.int64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for x in salvage(content.as_py() or b""):
                    if isinstance(x, Gap):
                        rows.append((file, x.offset, "gap", None, None, None, None, None, None, x.size, x.reason))
                        continue
                    h = x.headers
                    body, size = _payload(x)
                    kind = h.get("warc-type")
                    digest = h.get("warc-payload-digest", "").partition(":")[2] if kind == "revisit" else hashlib.sha256(body).hexdigest()
                    rows.append((file, x.offset, kind, _urn(h.get("warc-record-id")), h.get("warc-target-uri"), size, digest, _urn(h.get("warc-refers-to")), body if payloads else None, None, None))
                    held += len(body) if payloads else 100
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], arrow)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], arrow)

    return files.mapInArrow(run, ROW_SCHEMA)
