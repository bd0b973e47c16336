"""WARC archives: a writer of a gzip member a record, and a salvaging reader.

Writing: a record is a string (headers, blank line, UTF-8 payload). Python compresses
it to a gzip member of its own (several for a very long one) and joins members to files
of about ``FILE_BYTES``; Spark's text sink writes a file a row, so any store it knows
will do. The sink ends a row with a separator: it is a zero byte, which is the last
byte of the last member (the high byte of a length under 2**24).

Reading: whole files come through Spark's binary source. The parser accepts plain
files, one gzip member for all, or a member a record; time is linear in the file.
When a check fails (member, version line, headers, length, record end or digest) it
searches for the next member or version line, goes on from there, and logs the gap
of bytes it left behind as a row of kind ``gap``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapper, scratch_root

LEAST_REVISIT = 1000
END = b"\r\n\r\n"
_VERSION = b"WARC/1."
_GZIP = b"\x1f\x8b\x08"
FILE_BYTES = 32 << 20
MEMBER_BYTES = 8 << 20
HEADER_BYTES = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _inflate(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the member at ``at`` holds, where it ends, and whether it is whole. Reads growing slices, not the rest of the file."""
    machine, out, step, pos = zlib.decompressobj(31), [], 1 << 13, at
    try:
        while pos < len(data):
            part = data[pos : pos + step]
            out.append(machine.decompress(part))
            pos += len(part)
            if machine.eof:
                return b"".join(out), pos - len(machine.unused_data), True
            step = min(2 * step, 1 << 20)
    except zlib.error:
        pass
    return b"".join(out), at, False


def _members(data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """Yield ("data", start, end, bytes) of plain or inflated stretches, ("cut", start, start, bytes) of what a damaged
    member gave, and ("gap", start, end, b"")."""
    if not data.startswith(_GZIP) and (_VERSION in data or _GZIP not in data):
        yield "data", 0, len(data), data
        return
    at, lost = 0, 0  # data[lost:at] belongs to no whole member

    def left(end: int) -> Iterator[tuple[str, int, int, bytes]]:
        if data[lost:end].strip(b"\0\r\n"):
            plain = data[lost:end]
            yield ("data", lost, end, plain) if _VERSION in plain else ("gap", lost, end, b"")

    while at < len(data):
        if data.startswith(_GZIP, at):
            part, end, whole = _inflate(data, at)
            if whole:
                yield from left(at)
                yield "data", at, end, part
                at = lost = end
                continue
            if _VERSION in part:
                yield from left(at)
                yield "cut", at, at, part
                lost = at
        nxt = data.find(_GZIP, at + 1)
        at = len(data) if nxt < 0 else nxt
    yield from left(len(data))


class ShortBlock(ValueError):
    """The data ends within a record's block."""


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record that begins at ``at``: headers by lower-case name, block, and where it ends. ValueError if a check fails."""
    stop = data.find(END, at, at + HEADER_BYTES)
    if stop < 0 or not data.startswith(_VERSION, at):
        raise ValueError("no version line or header end")
    head = data[at:stop].decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in head[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise ValueError("content-length or warc-type is missing")
    start = stop + 4
    end = start + int(fields["content-length"])
    block = data[start:end]
    if len(block) < end - start:
        raise ShortBlock("the block is cut short")
    if data[end : end + 4] != END and (len(data) - end > 4 or data[end:].strip(b"\r\n")):
        raise ValueError("no record end after the block")
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest[5:]:
        raise ValueError("the block's digest differs")
    end += 4 if data.startswith(END, end) else 0
    return fields, block, end


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
    """Yield (kind, start, end, headers, block, reason) of records and quarantined gaps.

    Offsets of records count in the inflated stretch, those of gaps between members
    in the file. Every byte belongs to a record, to white space, or to a gap. A record
    may go on in the next member.
    """
    held = b""  # the end of the last stretch: a record that is not complete yet
    for kind, a, b, part in _members(data):
        if kind == "gap":
            yield from _records(held, last=True)
            held = b""
            yield "gap", a, b, {}, b"", "no valid member"
            continue
        if held and part.startswith(_VERSION):
            yield from _records(held, last=True)
            held = b""
        whole, held = held + part, b""
        for found in _records(whole, last=kind == "cut"):
            if found[0] == "rest":
                held = found[4]
            else:
                yield found
    yield from _records(held, last=True)


def _records(part: bytes, last: bool) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
    """Records and gaps of a stretch. Unless it is the last, an incomplete record at its end comes as ("rest", ..., its bytes, "")."""
    at = 0
    while at < len(part):
        try:
            fields, block, end = parse_record(part, at)
        except ShortBlock as e:
            if not last:
                yield "rest", at, len(part), {}, part[at:], ""
                return
            why = str(e)
        except ValueError as e:
            why = str(e)
        else:
            yield "record", at, end, fields, block, ""
            at = end
            continue
        nxt = part.find(_VERSION, at + 1)
        end = len(part) if nxt < 0 else nxt
        if part[at:end].strip(b"\r\n"):
            yield "gap", at, end, {}, b"", why
        at = end


def with_revisits(pages: DataFrame, id_col: str, payload: Column) -> DataFrame:
    """Add size, SHA-1, and the page that a repeated payload of enough bytes revisits (null: a response).

    The largest id with a payload is its response (rows that repeat that very id all
    are). Digests are aggregated before they are shuffled; a hot payload is a skewed
    join, which Spark splits.
    """
    full = pages.withColumn("__kgspark_html", payload)
    full = full.withColumns({"__kgspark_size": F.octet_length("__kgspark_html").cast("bigint"), "__kgspark_sha": F.sha1(F.encode("__kgspark_html", "UTF-8"))})
    first = (
        full.where(F.col("__kgspark_size") >= LEAST_REVISIT)
        .groupBy(F.col("__kgspark_sha").alias("__kgspark_key"))
        .agg(F.max(id_col).alias("__kgspark_first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = full.join(first, full["__kgspark_sha"] == first["__kgspark_key"], "left")
    return joined.withColumn("__kgspark_refers", F.when((F.col("__kgspark_size") >= LEAST_REVISIT) & ~F.col("__kgspark_first").eqNullSafe(F.col(id_col)), F.col("__kgspark_first")))


def record_strings(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """One ``value`` string a row: a response with its payload, or a revisit without one. All have the time of the call as date."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def clean(c: Column) -> Column:
        return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\r\n]", " ")

    size, refers = F.col("__kgspark_size"), F.col("__kgspark_refers")
    revisit = refers.isNotNull()
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:kgspark:page:"), ident, F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean(F.col(url_col))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha1-hex:"), F.col("__kgspark_sha")),
        F.concat(F.lit("WARC-Payload-Length: "), size.cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:kgspark:page:"), refers.cast("string"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
    ]
    return df.select(F.concat(F.array_join(F.array_compact(F.array(*lines)), "\r\n"), F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("__kgspark_html"))).alias("value"))


def members(record: bytes) -> bytes:
    """A record as one gzip member; a longer one as several, each of under 2**24 bytes."""
    out = []
    for at in range(0, max(len(record), 1), MEMBER_BYTES):
        machine = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(machine.compress(record[at : at + MEMBER_BYTES]) + machine.flush())
    return b"".join(out)


def write_archive(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the ``value`` strings as archives of about ``file_bytes`` (one longer record makes a longer file)."""

    def run(batches):
        held, size = [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])  # the sink adds the last byte

        for batch in batches:
            for value in batch.column(0):
                part = members(value.as_py().encode("utf-8", "surrogatepass") + END)
                held.append(part)
                size += len(part)
                if size >= file_bytes:
                    yield file()
                    held, size = [], 0
        if held:
            yield file()

    raw = records.select("value").mapInArrow(mapper(run), "value binary").select(F.col("value").cast("string").alias("value"))
    raw.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).mode("errorifexists").text(path)


def read_archive(spark, path: str) -> DataFrame:
    """Rows (kind, file, start, end, type, id, refers_to, length, digest, reason) of every record and gap."""
    schema = "kind string, file string, start bigint, end bigint, type string, id string, refers_to string, length bigint, digest string, reason string"

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for kind, a, b, fields, block, why in salvage(content.as_py()):
                    digest, size = hashlib.sha1(block).hexdigest(), len(block)
                    if kind == "record":
                        told = fields.get("warc-payload-digest", "")
                        if fields["warc-type"] == "revisit":
                            digest, size = told.removeprefix("sha1-hex:"), int(fields.get("warc-payload-length", 0))
                        elif told.startswith("sha1-hex:") and told[9:] != digest:
                            kind, why = "gap", "the payload's digest differs"
                    if kind == "record":
                        rows.append((kind, name, a, b, fields["warc-type"], _ident(fields.get("warc-record-id")), _ident(fields.get("warc-refers-to")), size, digest, ""))
                    else:
                        rows.append((kind, name, a, b, None, None, None, None, None, why))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
                text, num = pa.string(), pa.int64()
                kinds = [text, text, num, num, text, text, text, num, text, text]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "file", "start", "end", "type", "id", "refers_to", "length", "digest", "reason"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(mapper(run), schema)


def _ident(urn: str | None) -> str | None:
    return urn.strip("<>").rpartition(":")[2] if urn else None


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row into archives on shared storage and read them back; one row per record.

    Null html is an empty payload, a null id comes back as null, an empty table gives no rows.
    Bytes that fail a check on the way back end the query with an error that names them.
    """
    spark = pages.sparkSession
    slim = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    path = f"{scratch_root(spark)}/kgspark/{uuid.uuid4().hex}-warc"
    marked = with_revisits(slim, "page_id", F.coalesce("html", F.lit("")))
    write_archive(record_strings(marked, "page_id", "url"), path)
    back = read_archive(spark, path)
    lost = F.raise_error(F.concat(F.lit("unreadable bytes in "), "file", F.lit(" at "), F.col("start").cast("string"), F.lit(": "), "reason"))
    return back.select(
        F.when(F.col("kind") == "record", F.col("id").try_cast("bigint")).otherwise(lost.cast("bigint")).alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").try_cast("bigint").alias("refers_to"),
    )


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM r
"""
