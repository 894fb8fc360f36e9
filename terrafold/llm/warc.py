"""WARC 1.1 archives: a deduplicating writer and a salvaging reader.

Archives are written by Spark's text sink, so every store that Spark writes to will do, and a lost task is
simply run again. A row of the sink is a whole archive, of about ARCHIVE_BYTES or one larger record; each record
is a gzip member of its own, so damage costs the records that it meets and no others. In plain archives the
sink's line separator is the pair of line ends that closes a record. The reader also takes members of several
records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

VERSION = "WARC/1.1"
NL = "\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Bytes of an archive, about: the reader takes an archive at a time. One record is never cut.
ARCHIVE_BYTES = 32 << 20
#: A fixed date: rewriting the same pages gives the same archives.
DATE = "2024-01-01T00:00:00Z"
#: Stands for URLs that are no URIs; they follow it, encoded.
URI = "https://pages.invalid/?url="


def base32(hexed: Column) -> Column:
    """RFC 4648 base32 of a SHA-1 in hex: five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every row.

    Of equal payloads of ``least`` bytes or more, the smallest page_id holds the response. A payload may be
    on a third of all pages: its first page is found with partial aggregates and joined back, a join whose
    large partitions Spark splits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), base32(F.sha1(payload)).alias("payload_digest"),
    )
    first = (
        rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"))
    )
    later = F.col("first") < F.col("page_id")
    return rows.join(first, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(later, "revisit").otherwise("response").alias("record_type"),
        F.when(later, F.col("first")).alias("refers_to"),
    )


def record_id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page "), page.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def plain_url(url: Column) -> Column:
    return url.rlike(r"^[\x21-\x7e]+$") & ~url.startswith(URI)


def url_of(uri: Column) -> Column:
    """The URL that a record was written for; a page without one has an empty one."""
    return F.when(uri.startswith(URI), F.url_decode(F.substr(uri, F.lit(len(URI) + 1)))).otherwise(uri)


def record_bytes(rows: DataFrame) -> Column:
    """A whole record but for the line ends that close it. A revisit has no block; its digest is the full payload's."""
    revisit = F.col("record_type") == "revisit"
    uri = F.when(plain_url(F.col("url")), F.col("url")).otherwise(F.concat(F.lit(URI), F.url_encode("url")))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    head = F.concat(F.concat_ws(NL, *lines), F.lit(NL + NL))
    return F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))


def deflate(record: bytes) -> bytes:
    """A gzip member without its last byte, which is zero: the sink's line separator.

    The last byte is the highest of the length; a record of 16 MB or more is followed by a member of no bytes.
    """
    z = zlib.compressobj(wbits=31)
    member = z.compress(record) + z.flush()
    if member[-1]:
        member += zlib.compress(b"", wbits=31)
    return member[:-1]


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES, compression: str = "gzip") -> None:
    """Write a record for every row of pages to archives below path: a gzip member a record, or plain ("none")."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in batch.column(0):
                part = deflate(r.as_py() + end) + b"\0" if compression == "gzip" else r.as_py() + end
                held.append(part)
                size += len(part)
                if size >= ARCHIVE_BYTES:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    def made(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[: -len(last)]], pa.binary())], ["value"])

    if compression not in ("gzip", "none"):
        raise ValueError(f"compression {compression!r} is neither gzip nor none")
    end = (NL * 2).encode()
    last = b"\0" if compression == "gzip" else end  # the sink puts it down after the row
    rows = plan_records(pages, least)
    whole = rows.select(record_bytes(rows).cast("binary").alias("value")).mapInArrow(archives, "value binary").select(F.col("value").cast("string").alias("value"))
    whole.write.option("lineSep", last.decode()).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Salvage:
    """Records of an archive, and the byte gaps (from, to, reason) that gave none."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


START = re.compile(rb"WARC/1\.[01]\r\n")


def parse_at(data: bytes, at: int) -> tuple[Record, int] | str:
    """The record at an offset and the offset after it, or what is wrong with it."""
    if not START.match(data, at):
        return "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "headers not closed"
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            return "malformed header"
        headers[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        return "no content length"
    start, stop = end + 4, end + 4 + int(size)
    if stop > len(data):
        return "block cut off"
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "no end of record where the length says"
    block, digest = data[start:stop], headers.get("warc-payload-digest", headers.get("warc-block-digest", ""))
    if headers.get("warc-type") != "revisit" and digest.startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != digest[5:]:
            return "digest differs"
    return Record(at, headers, block), stop + 4


def salvage_plain(data: bytes) -> Salvage:
    """All valid records of uncompressed data. After a failed check, search for the next version line."""
    found, at, bad, why = Salvage(), 0, None, ""
    while at < len(data):
        got = parse_at(data, at)
        if isinstance(got, str):
            if bad is None:
                bad, why = at, got
            m = START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if bad is not None:
            found.gaps.append((bad, at, why))
            bad = None
        found.records.append(got[0])
        at = got[1]
    if bad is not None:
        found.gaps.append((bad, len(data), why))
    return found


MAGIC = b"\x1f\x8b\x08"


CHUNK = 1 << 16
CHECKSUM, CUT_OFF = "member fails its checksum", "member cut off"


def inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """(bytes of the member at an offset, the offset after it or None if it is broken, what is wrong)."""
    z, parts, k = zlib.decompressobj(31), [], at
    try:
        while k < len(data) and not z.eof:
            parts.append(z.decompress(data[k : k + CHUNK]))
            k += CHUNK
    except zlib.error as e:
        return b"".join(parts) + up_to_error(data, at, k), None, CHECKSUM if "check" in str(e) else "member is damaged"
    if not z.eof:
        return b"".join(parts), None, CUT_OFF
    return b"".join(parts), min(k, len(data)) - len(z.unused_data), ""


def up_to_error(data: bytes, at: int, k: int) -> bytes:
    """What the member at an offset gives of the chunk at k, in which it breaks."""
    z, parts = zlib.decompressobj(31), []
    for j in range(at, k, CHUNK):
        z.decompress(data[j : j + CHUNK])
    try:
        for j in range(k, min(k + CHUNK, len(data))):
            parts.append(z.decompress(data[j : j + 1]))
    except zlib.error:
        pass
    return b"".join(parts)


def before_break(got: Salvage, reason: str) -> list[Record]:
    """Records of a broken member that are sound.

    A block is checked by its digest, headers by nothing: if the checksum fails but all records look whole, the
    damage is in some header and none is kept. A revisit has no block: it is kept if the member was only cut
    off, as its bytes are right as far as they go, or else if no gap comes before it and a record whose digest
    holds comes after it.
    """
    if reason == CHECKSUM and not got.gaps:
        return []
    sound = {r.offset for r in got.records if r.headers.get("warc-payload-digest") and r.headers.get("warc-type") != "revisit"}
    until = min([max(sound, default=-1), *(a for a, _, _ in got.gaps)])
    kept = lambda r: r.offset in sound or r.headers.get("warc-type") == "revisit" and (reason == CUT_OFF or r.offset < until)
    return [r for r in got.records if kept(r)]


Gap = tuple[int, int, str]


def scan(data: bytes) -> Iterator[Record | Gap]:
    """Valid records of an archive and its gaps, plain or of gzip members, a member at a time.

    Offsets are those of the file; in a member of several records, of the inflated data after the member's
    start. A member that doesn't end or fails its checksum gives its sound records (before_break); the rest of
    it, up to the next magic bytes that begin a member, is a gap.
    """
    if not data.startswith(MAGIC) and (data.find(MAGIC) < 0 or START.search(data, 0, 1 << 16)):
        got = salvage_plain(data)
        yield from got.records
        yield from got.gaps
        return
    at, bad, why = 0, None, ""
    while at < len(data):
        inner, end, reason = inflate(data, at) if data.startswith(MAGIC, at) else (b"", None, "no member")
        got = salvage_plain(inner)
        records = got.records if end is not None else before_break(got, reason)
        if end is None:
            if bad is None:
                bad, why = at, reason
            nxt = data.find(MAGIC, at + 1)
            end = nxt if nxt >= 0 else len(data)
        else:
            if bad is not None:
                yield bad, at, why
                bad = None
            yield from ((at, end, w) for _, _, w in got.gaps)
        yield from (Record(at + r.offset * (len(got.records) > 1), r.headers, r.block) for r in records)
        at = end
    if bad is not None:
        yield bad, len(data), why


def salvage(data: bytes) -> Salvage:
    """All that scan finds in an archive."""
    found = Salvage()
    for x in scan(data):
        (found.records if isinstance(x, Record) else found.gaps).append(x)
    return found


ROWS = "archive string, offset long, gap_end long, reason string, headers map<string,string>, block binary, block_bytes long, block_digest string"
#: Bytes of blocks of a batch that the reader gives, about.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Rows of ROWS of all archives below path: a record each, or a quarantined gap (reason not null).

    An archive is read by one task as a whole, as its members can't be found but in turn; the writer above
    bounds archives by bytes. Empty archives give no rows. Without blocks, only their sizes and digests are given.
    """
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string())
    names = ["archive", "offset", "gap_end", "reason", "headers", "block", "block_bytes", "block_digest"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for x in scan(data.as_py()):
                    if isinstance(x, Record):
                        digest = base64.b32encode(hashlib.sha1(x.block).digest()).decode()
                        rows.append((name, x.offset, None, None, list(x.headers.items()), x.block if blocks else None, len(x.block), digest))
                        size += len(x.block) * blocks + 500
                    else:
                        rows.append((name, *x, None, None, None, None))
                        size += 500
                    if size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parse, ROWS)


def archive(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: a row per page, from its record.

    Null and empty pages are payloads of no bytes; repeated rows have a record each; of a page_id on rows with
    equal payloads none refers to itself, all are responses; an empty table gives no rows; columns besides
    page_id, url and html aren't read. What was read is written to a table of the shared folder; a quarantined
    gap in archives just written is an error that names that table.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    found = materialize(read(spark, path, blocks=False).drop("block"), "warc-rows")
    if gaps := found.where("reason IS NOT NULL").count():
        raise RuntimeError(f"{gaps} quarantined gaps in {path}, logged in {found.inputFiles()[0].rpartition('/')[0]}")
    h = F.col("headers")
    revisit = h["warc-type"] == "revisit"
    return found.select(
        h["warc-page-id"].cast("long").alias("page_id"),
        F.when(revisit, h["warc-payload-length"].cast("long")).otherwise(F.col("block_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(h["warc-payload-digest"], ":", -1)).otherwise(F.col("block_digest")).alias("payload_digest"),
        h["warc-type"].alias("record_type"),
        F.when(revisit, h["warc-refers-to-page"].cast("long")).alias("refers_to"),
        url_of(h["warc-target-uri"]).alias("url"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).drop("url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS f FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f < page_id THEN f END AS refers_to FROM d
"""
