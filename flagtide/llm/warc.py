"""Web archives: legacy ARC files, their conversion to WARC, and reading back.

ARC files start with a version block whose second line names the version;
version 1 and version 2 have different record header lines, and both declare
the length of the record that follows, which is the only way to find the
next one. ``convert`` reads such archives, and synthesises for every record a
WARC identifier, timestamp, type and digests; of records with equal payloads
one is the response, the others revisit it.

Archives are written and read by Spark's own text source (gzip), so they can lie
in any store Spark reaches. The writer starts a new file, with a header block of
its own, after as many records as make ``FILE_BYTES`` on average. Reading inflates
as a stream: a file comes in pieces, and a task holds one record of it at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flagtide.llm.common import shared_folder, written
from flagtide.session import ship_package

#: Bytes of a file's records on average, and most records of one.
FILE_BYTES, RECORDS_PER_FILE = 64 << 20, 5_000
#: What parts the pieces that a file is read in; it may stand anywhere in it.
PIECE = "\r\n\r\n"

# The two record header layouts of the ARC format.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
          "Filename", "Archive-length"],
}
# WARC names.
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _write_text(records: DataFrame, path: str, separator: str, per_file: int) -> None:
    (records.select("value").write.option("lineSep", separator).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path))


def _first_of_file(per_file: int) -> Column:
    """True for the rows of a partition at which the writer opens a file."""
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return in_partition % per_file == 0


def records_per_file(mean_bytes: float | None) -> int:
    """Records that make FILE_BYTES, headers included, on average."""
    return max(1, min(RECORDS_PER_FILE, int(FILE_BYTES / ((mean_bytes or 0) + 500))))


# ---------------------------------------------------------------- ARC writing

def http_block(page_id: Column, html: Column) -> Column:
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\nX-Page-Id: "),
                    F.coalesce(page_id.cast("string"), F.lit("")), F.lit("\r\n\r\n"), body)


def write_arc(pages: DataFrame, path: str, version: str | Column = "1", date: str = "20240101000000") -> None:
    """One ARC record per row of (page_id, url, html); the HTTP response
    around the html names the page. White space in a url is escaped; a null or
    empty url becomes ``about:blank``. ``version`` may be a column of "1" and "2"
    that does not change inside a partition."""
    v = F.lit(version) if isinstance(version, str) else version
    per_file = records_per_file(pages.agg(F.avg(F.octet_length("html"))).first()[0])
    url = F.regexp_replace(F.col("url"), r"\s", "%20")
    rows = pages.select(F.when(F.length(url) > 0, url).otherwise(F.lit("about:blank")).alias("url"),
                        http_block(F.col("page_id"), F.col("html")).alias("block"), v.alias("v"),
                        _first_of_file(per_file).alias("opens"))
    n = F.octet_length("block").cast("string")
    second = F.concat(F.lit(" 0.0.0.0 "), F.lit(date), F.lit(" text/html"))
    header = F.concat("url", second, F.when(F.col("v") == "2", " 200 - - 0 converted.arc ").otherwise(" "), n)
    versions = None
    for name, fields in ARC_FIELDS.items():
        body = f"{name} 0 flagtide\n{' '.join(fields)}\n\n"
        extra = " 200 - - 0 converted.arc" if name == "2" else ""
        block = f"filedesc://converted.arc 0.0.0.0 {date} text/plain{extra} {len(body)}\n{body}\n"
        versions = (F.when if versions is None else versions.when)(F.col("v") == name, F.lit(block))
    record = F.concat(header, F.lit("\n"), F.col("block"))
    _write_text(rows.select(F.when(F.col("opens"), F.concat(versions, record)).otherwise(record).alias("value")),
                path, "\n", per_file)


# ---------------------------------------------------------------- ARC reading

class _Source:
    """Bytes that come in pieces; what has been taken is let go."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def blank_lines(self) -> bool:
        """Skips line ends; false at the end of the bytes."""
        while True:
            n = len(self.held) - len(self.held.lstrip(b"\r\n"))
            self.take(n)
            if self.held:
                return True
            if not self._more():
                return False

    def until(self, mark: bytes) -> bytes:
        """The bytes before ``mark``, which is taken as well."""
        start = 0
        while (end := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                raise ValueError(f"no end of a header at {self.at}")
        out = self.take(end)
        self.take(len(mark))
        return out

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += len(out)
        return out


def arc_records(pieces: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, content) of an ARC file that comes in pieces."""
    source, fields = _Source(iter(pieces)), ARC_FIELDS["1"]
    while source.blank_lines():
        at = source.at
        line = source.until(b"\n").decode("utf-8", "replace").rstrip("\r")
        # the declared length is the last field of either version
        length = int(line.rpartition(" ")[2])
        content = source.take(length)
        if len(content) < length:
            raise ValueError(f"ARC record at {at} declares {length} bytes, {len(content)} are there")
        if line.startswith("filedesc://"):
            fields = ARC_FIELDS[content.split(b" ", 1)[0].decode("ascii")]
        else:
            values = line.split(" ")
            if len(values) != len(fields):
                raise ValueError(f"ARC record at {at} has {len(values)} header fields, not {len(fields)}")
            yield at, dict(zip(fields, values)), content


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, found, payload = block.partition(b"\r\n\r\n")
    return (head + found, payload) if found else (b"", block)


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return m[1].decode("utf-8", "replace") if m and m[1] else None


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def warc_date(arc_date: str) -> str:
    """14-digit ARC dates (shorter ones are padded) as WARC timestamps."""
    d = (arc_date + "00000101000000"[len(arc_date):])[:14] if len(arc_date) < 14 else arc_date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


PARSED = {"record_id": pa.string(), "page_id": pa.int64(), "uri": pa.string(), "date": pa.string(),
          "payload_bytes": pa.int64(), "payload_digest": pa.string(), "block_digest": pa.string(),
          "head_digest": pa.string(), "head": pa.binary(), "payload": pa.binary()}


def _ddl(types: dict[str, pa.DataType], names: list[str]) -> str:
    ddl = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{n} {ddl[types[n]]}" for n in names)


def _batches(types: dict[str, pa.DataType], names: list[str], rows: Iterator[dict], weigh, limit: int = 8 << 20):
    """Record batches of about ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + weigh(row)
        if size >= limit:
            yield _batch(types, names, held)
            held, size = [], 0
    if held:
        yield _batch(types, names, held)


def _batch(types, names, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, piece: the files below ``path`` cut at every PIECE, inflated as they are
    read; a file is one task's, and its pieces come in order."""
    ship_package(spark)
    return spark.read.option("lineSep", PIECE).option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.gz").text(path).select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("piece"))


def _files(batches) -> Iterator[tuple[str, Iterator[bytes]]]:
    """Files by name, each with its bytes in pieces. The last PIECE of a file does not
    tell whether it was there: it always comes, and is a blank line to the parsers
    where no record needs it."""
    rows = (row for b in batches for row in zip(b.column("file").to_pylist(), b.column("piece").to_pylist()))
    mark = PIECE.encode()
    for file, own in groupby(rows, key=lambda row: row[0]):
        yield file, (part for _, piece in own for part in (piece, mark))


def read_arc(spark: SparkSession, path: str, with_content: bool) -> DataFrame:
    """The records of the ARC files below ``path`` with what a WARC record of
    each needs. ``record_id`` follows from file name, offset, url and date."""
    names = [n for n in PARSED if with_content or n not in ("head", "payload")]

    def rows(batches) -> Iterator[dict]:
        for file, pieces in _files(batches):
            name = file.rpartition("/")[2]
            for offset, fields, block in arc_records(pieces):
                head, payload = split_http(block)
                page = http_field(head, "X-Page-Id")
                key = f"{name} {offset} {fields['URL']} {fields['Archive-date']}"
                yield {"record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}",
                       "page_id": int(page) if page else None, "uri": fields["URL"],
                       "date": warc_date(fields["Archive-date"]), "payload_bytes": len(payload),
                       "payload_digest": base32_sha1(payload), "block_digest": base32_sha1(block),
                       "head_digest": base32_sha1(head), "head": head, "payload": payload}

    def run(batches):
        yield from _batches(PARSED, names, rows(batches), lambda r: len(r["payload"]) if with_content else 0)

    return _pieces(spark, path).mapInArrow(run, _ddl(PARSED, names))


# ------------------------------------------------------------------ conversion

def record_types(records: DataFrame, least: int = 0) -> DataFrame:
    """record_id, record_type, refers_to_id: of records with equal payloads of
    at least ``least`` bytes, the one with the largest (page_id, record_id) is
    the response, the others revisit it."""
    key = ["payload_digest", "payload_bytes"]
    first = records.where(F.col("payload_bytes") >= least).groupBy(*key).agg(
        F.max(F.struct("page_id", "record_id")).alias("first"))
    revisits = F.col("first.record_id") != F.col("record_id")
    return records.select("record_id", "page_id", *key).join(first, key, "left").select(
        "record_id", F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first.record_id")).alias("refers_to_id"))


def warc_value(records: DataFrame) -> Column:
    """The text of a WARC record (without the blank lines that end it).

    A revisit holds the HTTP header only; its Content-Length still tells the
    length of the full payload, and the payload digest is that of the full
    payload."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    return F.concat(
        F.lit(f"{WARC_VERSION}\r\n"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("uri")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(REVISIT_PROFILE)),
            line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_id"), F.lit(">"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.col("head_digest")).otherwise(
            F.col("block_digest")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block.cast("string"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """ARC files to WARC files, one WARC record per ARC record.

    Record types are decided on digests alone (a small table); contents are
    read a second time, joined to their decision and written."""
    found = written(read_arc(spark, arc_path, False))
    per_file = records_per_file(found.agg(F.avg("payload_bytes")).first()[0])
    decided = written(record_types(found, least))
    records = read_arc(spark, arc_path, True).join(decided, "record_id")
    rows = records.select(warc_value(records).alias("record"), _first_of_file(per_file).alias("opens"))
    body = "software: flagtide\r\nformat: WARC file version 1.1\r\n"
    info = (f"{WARC_VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
            f"WARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\n"
            f"Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n")
    _write_text(rows.select(F.when(F.col("opens"), F.concat(F.lit(info), "record")).otherwise(
        F.col("record")).alias("value")), warc_path, "\r\n\r\n", per_file)


# ---------------------------------------------------------------- WARC reading

def warc_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of a WARC file that comes in pieces."""
    source = _Source(iter(pieces))
    while source.blank_lines():
        at = source.at
        version, *lines = source.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
        block = source.take(length)
        if len(block) < length:
            raise ValueError(f"WARC record at {at} declares {length} bytes, {len(block)} are there")
        yield fields, block


READ = {"record_id": pa.string(), "record_type": pa.string(), "refers_to_id": pa.string(), "page_id": pa.int64(),
        "uri": pa.string(), "date": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
        "payload": pa.binary()}


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Response and revisit records of the WARC files below ``path``. Digests
    are checked against the blocks; a record whose block was altered fails."""
    names = [n for n in READ if with_payload or n != "payload"]
    bare = lambda v: v.strip("<>") if v else None

    def rows(batches) -> Iterator[dict]:
        for file, pieces in _files(batches):
            for fields, block in warc_records(pieces):
                kind = fields["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                head, payload = split_http(block)
                digest = fields["warc-payload-digest"].partition(":")[2]
                whole = kind == "response"
                if fields["warc-block-digest"].partition(":")[2] != base32_sha1(block) or (
                        whole and digest != base32_sha1(payload)):
                    raise ValueError(f"digest mismatch in {file}: {fields['warc-record-id']}")
                page = http_field(head, "X-Page-Id")
                yield {"record_id": bare(fields["warc-record-id"]), "record_type": kind,
                       "refers_to_id": bare(fields.get("warc-refers-to")), "page_id": int(page) if page else None,
                       "uri": fields.get("warc-target-uri"), "date": fields["warc-date"],
                       "payload_bytes": len(payload) if whole else int(http_field(head, "Content-Length") or 0),
                       "payload_digest": digest, "payload": payload if whole else None}

    def run(batches):
        yield from _batches(READ, names, rows(batches), lambda r: len(r["payload"] or b"") if with_payload else 0)

    return _pieces(spark, path).mapInArrow(run, _ddl(READ, names))


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages through both formats and back: page_id, payload_bytes,
    payload_digest, record_type, refers_to (the response's page_id).

    Null html is an empty payload (empty payloads are equal payloads); a null
    page_id sorts below all others; rows that repeat a page are records of
    their own, so one of them is the response; an empty table gives no rows;
    only page_id, url and html are looked at.
    """
    spark = pages.sparkSession
    base = shared_folder(spark, "warc")
    version = F.when(F.spark_partition_id() % 2 == 0, "1").otherwise("2")
    write_arc(pages.select(F.col("page_id").cast("long"), "url", "html"), f"{base}/arc", version)
    convert(spark, f"{base}/arc", f"{base}/warc", least)
    records = written(read_warc(spark, f"{base}/warc", with_payload=False))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses, revisits = (records.where(F.col("record_type") == t) for t in ("response", "revisit"))
    target = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return responses.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.join(target, "refers_to_id").select(*columns, "refers_to"))
