"""WARC archives: a writer with revisit records, and a salvage reader.

Archives are plain WARC/1.1 files that Spark's own writers put in the shared folder (a record ends with CRLF CRLF, which is the
line separator of the writer), in tiers of record sizes with a number of records to a file for each, so that files are bounded by bytes. The reader takes plain files and files of gzip members.
It checks every record (version line, header, Content-Length, end mark, digests); after a failed check it searches for the next
gzip member or version line that passes, goes on from there, and logs the bytes between as a quarantined gap.

Cases: a null html is an empty payload, a null url leaves the header out, a null page_id stays null. Of rows with equal payloads
of at least ``least`` bytes, those with the largest page_id are responses and the others revisit it; if all their ids are null all
are responses; repeated rows give repeated records. A very long page is a file of its own. Control characters in a url are percent-encoded. An empty table gives no
records. Only ``page_id``, ``url`` and ``html`` are read."""

from __future__ import annotations

import hashlib
import logging
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.session import forget, new_path, stored

END = "\r\n\r\n"
_log = logging.getLogger(__name__)
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_DATE = "2024-01-01T00:00:00Z"


def revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, digest, refers_to of every row whose payload a row with a larger page_id has too."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.length(payload).alias("n"))
    rows = rows.where(F.col("n") >= least).groupBy("digest", "page_id").agg(F.lit(1).alias("one"))
    kept = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("ids")).where("ids > 1 AND refers_to IS NOT NULL")
    return rows.join(kept, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def _records(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """One column: each row's record without its end mark."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    rows = rows.alias("p").join(seen.alias("s"), (F.col("p.digest") == F.col("s.digest")) & F.col("p.page_id").eqNullSafe(F.col("s.page_id")), "left")
    again = F.col("s.refers_to").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(again, head).otherwise(F.concat(head, F.col("payload")))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit\r\n")).otherwise(F.lit("response\r\n")),
            line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("p.page_id").cast("string"), F.lit("none")), F.lit(">"))),
            F.lit(f"WARC-Date: {_DATE}\r\n"), line("WARC-Target-URI", uri), line("WARC-Page-ID", F.col("p.page_id").cast("string")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("p.digest"))),
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("s.refers_to").cast("string"), F.lit(">"))),
            F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
            F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"), block,
        ).alias("value")
    )


#: (bytes of a record at most, records to a file): no file of smaller records is larger than 64 MB, and those that are larger stand alone.
TIERS = ((1 << 14, 4096), (1 << 18, 256), (1 << 22, 16), (None, 1))


def write_warc(pages: DataFrame, path: str, least: int = 1000, tiers: tuple[tuple[int | None, int], ...] = TIERS) -> None:
    """Write one record per row of ``pages`` below ``path``, in a folder for each tier of record sizes, so that files are bounded by bytes."""
    seen, kept = stored(revisits(pages, least), "revisits")  # its size is known then: broadcast if it is small, else joined by digest
    records, over = _records(pages, seen), F.lit(True)
    size = F.octet_length("value")
    for i, (most, per_file) in enumerate(tiers):
        fits = size <= most if most else F.lit(True)
        records.where(over & fits).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(f"{path}/{i}")
        over = size > most if most else over
    forget(pages.sparkSession, kept)


class Damaged(ValueError):
    pass


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower-case names), block and end of the record that begins at ``at``; every check raises ``Damaged``."""
    m = _VERSION.match(data, at)
    if not m:
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", m.end() - 2)
    if stop < 0:
        raise Damaged("header without end")
    fields = {}
    for text in data[m.end() : stop].decode("utf-8", "replace").split("\r\n") if stop > m.end() else []:
        name, colon, value = text.partition(":")
        if not colon:
            raise Damaged("header line without a name")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise Damaged("no content length")
    lo, hi = stop + 4, stop + 4 + int(size)
    if data[hi : hi + 4] != b"\r\n\r\n":
        raise Damaged("no end mark after the block")
    block = data[lo:hi]
    _check(fields, block)
    return fields, block, hi + 4


def http_payload(block: bytes) -> tuple[str, bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return head.decode("utf-8", "replace"), body


def _check(fields: dict[str, str], block: bytes) -> None:
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and hashlib.sha1(block).hexdigest() != want[5:].lower():
        raise Damaged("block digest differs")
    want = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "response" and want.startswith("sha1:"):
        body = http_payload(block)[1] if fields.get("content-type", "").startswith("application/http") else block
        if hashlib.sha1(body).hexdigest() != want[5:].lower():
            raise Damaged("payload digest differs")


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What comes out of the gzip member at ``at``, the end of what was read, and why the member is damaged, if it is."""
    z, out, step = zlib.decompressobj(31), [], 1 << 16
    while at < len(data) and not z.eof:
        before = z.copy() if step > 1 else z
        try:
            out.append(z.decompress(data[at : at + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), at, f"bad member: {e}"
            z, step = before, 1  # again byte by byte, up to the error
            continue
        at = min(at + step, len(data))
    return b"".join(out), at - len(z.unused_data), "" if z.eof else "member without end"


def _inside(member: bytes, vouched: bool) -> tuple[list[tuple[dict[str, str], bytes]], list[str]]:
    """The records of a member's bytes, and what lies between them. If ``vouched``, only records that a digest vouches for."""
    found, gaps, at, gap, why = [], [], 0, None, ""
    while at < len(member):
        try:
            fields, block, end = parse_record(member, at)
            if vouched and not (fields.get("warc-block-digest", "").startswith("sha1:") or fields.get("warc-type") == "response" and fields.get("warc-payload-digest", "").startswith("sha1:")):
                raise Damaged("no digest in a bad member")
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            m = _VERSION.search(member, at + 1)
            at = m.start() if m else len(member)
            continue
        if gap is not None:
            gaps.append(f"bytes {gap} to {at} of the member: {why}")
            gap = None
        found.append((fields, block))
        at = end
    if gap is not None:
        gaps.append(f"bytes {gap} to {len(member)} of the member: {why}")
    return found, gaps


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str] | str, bytes]]:
    """("record", start, end, fields, block) and ("gap", start, end, reason, b"") in file order; together they cover the file.

    Records of one member share its range, and so do gaps inside it. A member that cannot be read to its end is a gap, after the
    records that came out of it."""
    at, gap, why, plain = 0, None, "", 0
    while at < len(data):
        bad, gaps = "", []
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                member, end, bad = _inflated(data, at)
                found, gaps = _inside(member, bad.startswith("bad"))
                if not found and (bad or gaps):
                    raise Damaged(bad or gaps[0])
            else:
                fields, block, end = parse_record(data, at)
                found = [(fields, block)]
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            at = _next_start(data, at + 1, plain)
            continue
        if gap is not None:
            yield "gap", gap, at, why, b""
            gap = None
        for fields, block in found:
            yield "record", at, end, fields, block
        for reason in gaps:
            yield "gap", at, end, reason, b""
        if bad:  # the next member can begin before the error shows; stored bytes of this one are not read again as plain records
            gap, why, plain = at, bad, end
            at = _next_start(data, at + 1, plain)
        else:
            at = end
    if gap is not None:
        yield "gap", gap, len(data), why, b""


def _next_start(data: bytes, at: int, plain: int) -> int:
    """The next place from ``at`` on where a member can begin, or a plain record if it is not before ``plain``."""
    return next((m.start() for m in _START.finditer(data, at) if m.start() >= plain or m[0][:1] == b"\x1f"), len(data))


_SCHEMA = "kind string, path string, start long, stop long, reason string, page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of kind ``record`` (with the payload of responses if ``payloads``) and of kind ``gap``: quarantined byte ranges."""
    number = re.compile(r"(-?\d+)>?$")

    def one(path: str, kind: str, start: int, stop: int, what, block: bytes) -> dict:
        if kind == "gap":
            return {"kind": kind, "path": path, "start": start, "stop": stop, "reason": what}
        head, body = http_payload(block)
        kept = what.get("warc-type") == "response"
        said = re.search(r"(?im)^content-length:\s*(\d+)", head)
        own, other = number.search(what.get("warc-page-id", "")), number.search(what.get("warc-refers-to", ""))
        return {
            "kind": kind, "path": path, "start": start, "stop": stop, "uri": what.get("warc-target-uri"), "record_type": what.get("warc-type"),
            "page_id": int(own[1]) if own else None, "refers_to": int(other[1]) if other else None,
            "payload_bytes": len(body) if kept or not said else int(said[1]),
            "payload_digest": hashlib.sha1(body).hexdigest() if kept else what.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "payload": body if kept else None,
        }

    schema = pa.schema([("kind", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                rows, size = [], 0
                for x in salvage(content.as_py() or b""):
                    rows.append(one(name.as_py(), *x))
                    size += len(x[4])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, _SCHEMA + ", payload binary" * payloads)


def quarantine(read: DataFrame) -> DataFrame:
    """The gaps of ``read_warc``: path, start, stop, reason. What they come to goes to the log."""
    gaps = read.where("kind = 'gap'").select("path", "start", "stop", "reason")
    n = gaps.agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"), F.sum(F.col("stop") - F.col("start")).alias("bytes")).first()
    if n.n:
        _log.warning("%d gaps in %d archives, %d bytes quarantined", n.n, n.files, n.bytes)
    return gaps


def archive_round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, log what could not be read, and say what each record holds."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, least)
    back, _ = stored(read_warc(spark, path, payloads=False), "records")
    forget(spark, path)
    quarantine(back)
    return back.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
