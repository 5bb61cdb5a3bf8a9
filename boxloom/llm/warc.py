"""WARC writing with revisits, and a reader that salvages damaged archives.

Writing: one record a page, each its own gzip member, gathered into archives
of about `archive_bytes`. Archives are files that any WARC tool opens, written
complete and then renamed, and are read by Spark's binaryFile source, so archives
from anywhere read alike.

Reading: each member is inflated and checked (gzip checksum, version line,
Content-Length, block end, payload digest). After a failed check the reader
searches for the next gzip magic that starts a valid member, or the next
version line, in the archive and in the inflated bytes of a member alike; what
lies between is logged as a quarantined gap (archive, start, end, reason), and
all other records come through. Of a damaged or cut member what inflates before
the damage is searched as well. A gap inside a member has the member's bytes,
and its place among the inflated ones in the reason. Numbers in headers that
are none are read as missing. An archive, and what a member of it inflates to,
is held by one task.

Defined cases: a null html is an empty payload; pages with a null id are
written and read back with a null id, after all others when equal payloads
compete for the response; ids are any longs, and numbers beyond them are read as
missing; repeated rows give one record each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.sources.keyed import write_keyed

from .store import materialise, scratch_root, small_batches

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
_SALTS = 16


def digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, sha: str, refers_to=None, size: int | None = None) -> bytes:
    """One uncompressed record; with refers_to a revisit without payload."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("X-Payload-Length", str(len(payload) if size is None else size)),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(body))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + body + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _parse(raw: bytes, at: int = 0) -> tuple[dict, int] | str:
    """The record at `at` and where it ends, or what is wrong."""
    if not raw.startswith(b"WARC/1.", at):
        return "no version line"
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        return "header not ended"
    head = {}
    for line in raw[at:end].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return "bad header line"
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    said = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,19}", said):
        return "no content length"
    stop = end + 4 + int(said)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        return "block not ended"
    payload = raw[end + 4 : stop]
    said = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and said and said != f"sha1:{digest(payload)}":
        return "digest differs"
    return head | {"payload": payload}, stop + 4


def _inflate(content: bytes, at: int, window: int = 65536) -> tuple[bytes, int, str]:
    """What the member at `at` inflates to, where it ends (-1 if it is damaged or cut) and what is wrong with it."""
    z, out, view = zlib.decompressobj(31), bytearray(), memoryview(content)
    # Fed in windows, so that what follows is not copied each time; a window that fails is fed again byte by byte.
    while not z.eof and at < len(content):
        before = z.copy()
        try:
            out += z.decompress(view[at : at + window])
        except zlib.error:
            try:
                for i in range(at, min(at + window, len(content))):
                    out += before.decompress(view[i : i + 1])
            except zlib.error:
                pass
            return bytes(out), -1, "bad member"
        at = min(at + window, len(content))
    return (bytes(out), at - len(z.unused_data), "") if z.eof else (bytes(out), -1, "member cut off")


def _records(raw: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """The valid records of inflated bytes, and the gaps between them."""
    found: list[dict] = []
    gaps: list[tuple[int, int, str]] = []
    at, bad, why = 0, -1, ""
    while at < len(raw):
        one = _parse(raw, at)
        if isinstance(one, str):
            bad, why = (at, one) if bad < 0 else (bad, why)
            ahead = raw.find(b"WARC/1.", at + 1)
            at = len(raw) if ahead < 0 else ahead
            continue
        if bad >= 0:
            gaps.append((bad, at, why))
            bad = -1
        found.append(one[0])
        at = one[1]
    return found, gaps + ([(bad, len(raw), why)] if bad >= 0 else [])


def salvage(content: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """All valid records, and the gaps (start, end, reason) between them."""
    records: list[dict] = []
    gaps: list[tuple[int, int, str]] = []
    at, bad, why = 0, -1, ""

    def fail(reason: str) -> None:
        nonlocal at, bad, why
        bad, why = (at, reason) if bad < 0 else (bad, why)
        ahead = [x for x in (content.find(MAGIC, at + 1), content.find(b"WARC/1.", at + 1)) if x >= 0]
        at = min(ahead, default=len(content))

    def close() -> None:
        nonlocal bad
        if bad >= 0:
            gaps.append((bad, at, why))
            bad = -1

    while at < len(content):
        if not content.startswith(MAGIC, at):
            one = _parse(content, at)
            if isinstance(one, str):
                fail(one)
                continue
            close()
            records.append(one[0])
            at = one[1]
            continue
        raw, end, reason = _inflate(content, at)
        found, holes = _records(raw)
        if end < 0:
            records += found
            fail(reason)
            continue
        if not found and raw:
            fail(holes[0][2])
            continue
        close()
        records += found
        gaps += [(at, end, f"{what} at {s}-{e} of the inflated bytes") for s, e, what in holes]
        at = end
    close()
    return records, gaps


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, sha, refers_to): which record each page becomes."""
    body = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    body = body.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    # Pages whose payload is large enough and stored once are found by counting; only their digests move.
    firsts = body.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("sha", "top")
    firsts = materialise(firsts, "responses").withColumn("s", F.explode(F.array(*map(F.lit, range(_SALTS)))))
    salted = body.withColumn("s", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int"))
    return salted.join(firsts, ["sha", "s"], "left").select("page_id", "url", "html", "sha", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write_archives(planned: DataFrame, archive_bytes: int = 8 << 20) -> DataFrame:
    """Archives as .warc.gz files in the shared folder, read as rows (path, content)."""
    small_batches(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, bytearray()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:05d}.warc.gz"]), pa.array([bytes(held)], pa.binary())], names=["path", "content"])

        for b in batches:
            for page_id, url, html, sha, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                own = base64.b32encode(bytes.fromhex(sha)).decode()
                held += member(record(page_id, url, payload, own, to))
                if len(held) >= archive_bytes:
                    yield flush()
                    n += 1
                    held = bytearray()
        if held:
            yield flush()

    spark, path = planned.sparkSession, f"{scratch_root(planned.sparkSession)}/archives-{uuid.uuid4().hex}"
    archives = planned.select("page_id", "url", "html", "sha", "refers_to").mapInArrow(run, "path string, content binary")
    write_keyed(archives, path, "path", F.col("content"), suffix="", distinct=True)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content")


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(archives: DataFrame, gaps: bool = False) -> DataFrame:
    """The records of archives (path, content); with gaps=True the quarantined byte ranges instead."""

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", urn or "")
        return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None

    def length(r: dict) -> int:
        said = r.get("x-payload-length", "")
        return int(said) if re.fullmatch("[0-9]{1,18}", said) else len(r["payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                records, bad = salvage(content or b"")
                if gaps:
                    rows = [{"path": path, "start": s, "end": e, "reason": why} for s, e, why in bad]
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string())]))
                    continue
                for at in range(0, len(records), 500):
                    rows = [
                        {
                            "page_id": number(r.get("warc-record-id")),
                            "url": r.get("warc-target-uri"),
                            "payload": r["payload"],
                            "payload_bytes": length(r),
                            "payload_digest": r.get("warc-payload-digest", "").removeprefix("sha1:"),
                            "record_type": r.get("warc-type"),
                            "refers_to": number(r.get("warc-refers-to")),
                        }
                        for r in records[at : at + 500]
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    schema = "path string, start bigint, end bigint, reason string" if gaps else "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return archives.select("path", "content").mapInArrow(run, schema)
