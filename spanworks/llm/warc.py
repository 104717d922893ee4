"""Web archives: pages to WARC files and back, transactions assembled from their records.

Writing: every page becomes three records, a request, a capture (response or revisit) and a
metadata record with the page's id; request and metadata name the capture as concurrent. Of
captures with equal payloads of at least ``REVISIT_BYTES`` bytes one is the response and the
others revisit it. The files hold plain records, one after another, in one gzip stream per
file (or none); Spark writes them, so they may lie in any store that Spark reaches.

Reading: Spark's text source cuts the files at the ends of records, so files without
compression are read by many tasks, and each record is parsed by its own header, whatever the
case and order of its fields. ``transactions`` then joins request, capture and metadata records
through their concurrent-to identifiers, stated by either side, and over one record between
(a metadata record that names the request), into one nested row per capture.

A payload that holds the start of a record is written in chunks cut inside of it, so that no
payload looks like the end of its record. A record of other writers with a block in which a line
begins like a record ends there, and is marked as not ``intact``, as are cut records and payloads that differ from
their stated digest.

Cases: null html is an empty payload. Without url a record has no target; control characters
and spaces of a url are percent-encoded. Null page ids count as the least and come back as null.
Repeated rows are captures of their own; of equal payloads with equal page ids one, by the
place of its row, is the response. Empty tables give files without records. Records that no
capture is concurrent with, and warcinfo records, are in ``read`` but in no transaction. A
capture that is read twice is two rows; request or metadata records read twice count once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanworks.llm.words import prepare
from spanworks.workdir import materialize, work_dir

#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_END, _START = b"\r\n\r\n", b"WARC/1."
#: What cuts the files. Its first byte is not in its rest: Hadoop's line reader misses separators that
#: overlap themselves, as two line ends before a record would, where they cross its buffer's end.
_SEPARATOR = b"\n" + _START
CAPTURES, ATTACHED = ("response", "revisit", "resource"), ("request", "metadata")


# -- writing ------------------------------------------------------------------------------------

def record_id(archive: str, row: int | str, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{archive}/{row}/{kind}'.encode()).digest())}>"


def record(kind: str, own_id: str, date: str, content_type: str, block: bytes, *fields: tuple[str, str | None]) -> bytes:
    """One record without the two line ends after it; fields without a value are left out."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date), *fields,
            ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    lines = "\r\n".join(f"{name}: {value}" for name, value in head if value is not None)
    return b"WARC/1.1\r\n" + lines.encode() + _END + block


def http_response(payload: bytes, with_body: bool = True) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    if not with_body or _START not in payload:
        return head + b"Content-Length: %d" % len(payload) + _END + payload * with_body
    name, _, rest = _START.partition(b"/")
    parts = [p for p in re.split(b"(?<=%s)(?=/%s)" % (name, re.escape(rest)), payload) if p]
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts)
    return head + b"Transfer-Encoding: chunked" + _END + chunks + b"0" + _END


def clean_url(url: str | None) -> str | None:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None


def http_request(url: str | None) -> bytes:
    try:
        parts = urlsplit(url or "")
        host, path = parts.netloc, (parts.path or "/") + ("?" + parts.query if parts.query else "")
    except ValueError:  # no url that can be parsed
        host, path = "", "/"
    return f"GET {path} HTTP/1.1\r\n{f'Host: {host}' if host else 'Accept: */*'}".encode() + _END


def stated_digest(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _records(archive: str, date: str):
    """The records of rows (row, page_id, url, html, digest, original), ``original`` being the row that a revisit refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = True
        for batch in batches:
            out: list[bytes] = []
            if info and batch.num_rows:
                about = f"software: spanworks\r\nformat: WARC File Format 1.1\r\nisPartOf: {archive}\r\n".encode()
                own = record_id(archive, f"file-{TaskContext.get().partitionId()}", "warcinfo")
                out.append(record("warcinfo", own, date, "application/warc-fields", about))
                info = False
            for row, page, url, html, digest, original in zip(*(c.to_pylist() for c in batch.columns)):
                url, payload = clean_url(url), (html or "").encode()
                kind = "response" if original is None else "revisit"
                capture, target = record_id(archive, row, "capture"), ("WARC-Target-URI", url)
                about = b"" if page is None else b"page-id: %d\r\n" % page
                fields = [target, ("WARC-Payload-Digest", stated_digest(digest))]
                if kind == "revisit":
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(archive, original, "capture"))]
                out += [
                    record("request", record_id(archive, row, "request"), date, "application/http; msgtype=request",
                           http_request(url), target, ("WARC-Concurrent-To", capture)),
                    record(kind, capture, date, "application/http; msgtype=response", http_response(payload, kind == "response"), *fields),
                    record("metadata", record_id(archive, row, "metadata"), date, "application/warc-fields", about,
                           target, ("WARC-Concurrent-To", capture)),
                ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write(pages: DataFrame, path: str, compression: str | None = "gzip", revisit_bytes: int = REVISIT_BYTES, date: str | None = None) -> None:
    """Writes the records of (page_id, url, html) below ``path``, one file per task.

    The rows are numbered and digested once and kept until the archive is written; which captures
    are revisits is found on numbers and digests alone. ``date`` is that of all records (now).
    """
    spark = pages.sparkSession
    prepare(spark)
    html = F.coalesce("html", F.lit(""))
    numbered = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    kept = work_dir(spark, "pages")
    numbered.write.option("compression", "zstd").parquet(kept)
    numbered = spark.read.schema(numbered.schema).parquet(kept)
    long = numbered.where(F.col("bytes") >= revisit_bytes).select("row", "page_id", "digest")
    groups = long.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("last"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1").select("digest", F.col("last.row").alias("original")), "groups")
    revisits = long.join(groups, "digest").where("row <> original").select("row", "original")
    rows = numbered.join(revisits, "row", "left").select("row", "page_id", "url", "html", "digest", "original")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    values = rows.mapInArrow(_records(uuid.uuid4().hex, date), "value binary").select(F.col("value").cast("string"))
    values.write.option("lineSep", _END.decode()).option("compression", compression or "none").text(path)


# -- reading ------------------------------------------------------------------------------------

_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_RECORD = {
    "record_id": pa.string(), "kind": pa.string(), "target_uri": pa.string(), "date": pa.string(),
    "concurrent_to": pa.list_(pa.string()), "refers_to": pa.string(), "content_type": pa.string(), "start": pa.string(),
    "fields": _FIELDS, "payload_bytes": pa.int64(), "payload_digest": pa.string(), "intact": pa.bool_(), "payload": pa.binary(),
}
SCHEMA = """record_id string, kind string, target_uri string, date string, concurrent_to array<string>, refers_to string,
    content_type string, start string, fields array<struct<name: string, value: string>>, payload_bytes long,
    payload_digest string, intact boolean, payload binary"""


def fields_of(block: bytes) -> list[tuple[str, str]]:
    """(lower-case name, value) of each field; a line that starts with white space goes on from the last."""
    out: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """The payload of a body in chunks, and whether it came to its end."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"[0-9A-Fa-f]+", body[at:end] if end >= 0 else b"")
        if not size:
            return b"".join(out), False
        n = int(size[0], 16)
        if not n:
            return b"".join(out), True
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def hex_digest(stated: str | None) -> str | None:
    """A stated SHA-1 as bare lower-case hex; None for others."""
    name, _, value = (stated or "").partition(":")
    if name.lower() != "sha1":
        return None
    if len(value) == 40:
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def parse(piece: bytes) -> dict | None:
    """One record from the text between two starts of records; None if it has no type."""
    piece = piece[len(_START) :] if piece.startswith(_START) else piece
    head, _, rest = piece.partition(_END)
    fields = fields_of(head.partition(b"\r\n")[2])
    first = dict(reversed(fields))
    if "warc-type" not in first:
        return None
    size = first.get("content-length", "")
    length = int(size) if size.isdigit() else len(rest)
    block, kind = rest[:length], first["warc-type"].lower()
    out = {
        "record_id": first.get("warc-record-id"), "kind": kind, "target_uri": first.get("warc-target-uri"),
        "date": first.get("warc-date"), "concurrent_to": [v for n, v in fields if n == "warc-concurrent-to"],
        "refers_to": first.get("warc-refers-to"), "content_type": first.get("content-type"), "start": None, "fields": None,
        "payload_bytes": None, "payload_digest": None, "intact": len(block) == length, "payload": None,
    }
    payload, done, http = block, True, {}
    if (out["content_type"] or "").lower().startswith("application/http"):
        message, _, payload = block.partition(_END)
        start, _, lines = message.partition(b"\r\n")
        own = fields_of(lines)
        out |= {"start": start.decode("utf-8", "replace"), "fields": own}
        http = dict(reversed(own))
        if kind == "response" and "chunked" in http.get("transfer-encoding", "").lower():
            payload, done = unchunked(payload)
    elif (out["content_type"] or "").lower().startswith("application/warc-fields"):
        out["fields"] = fields_of(block)
    stated = hex_digest(first.get("warc-payload-digest"))
    if kind == "revisit":  # the payload is that of the record it refers to
        size = http.get("content-length", "")
        out |= {"payload_bytes": int(size) if size.isdigit() else None, "payload_digest": stated}
    elif kind in CAPTURES:
        digest = hashlib.sha1(payload).hexdigest()
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}
        out["intact"] = out["intact"] and done and stated in (None, digest)
    return out


def _parse(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for piece in batch.column(0).to_pylist() if piece and (r := parse(piece))]
            for r in rows if not payloads else ():
                r["payload"] = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] if n != "fields" or r[n] is None else [{"name": k, "value": v} for k, v in r[n]] for r in rows], t)
                 for n, t in _RECORD.items()], names=list(_RECORD))

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files (versions 1.0 and 1.1, plain or gzip), with the payloads of responses if wanted."""
    prepare(spark)
    pieces = spark.read.option("lineSep", _SEPARATOR.decode()).text(path)
    return pieces.select(F.col("value").cast("binary")).mapInArrow(_parse(payloads), SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: its record, and arrays of the request and the metadata records concurrent with it.

    ``records`` is read several times. Concurrent-to may be stated by either record, or lead over
    one record between. A row holds all records of its capture, however many name it.
    """
    captures = records.where(F.col("kind").isin(*CAPTURES))
    attached = records.where(F.col("kind").isin(*ATTACHED)).drop("payload", "payload_bytes", "payload_digest", "refers_to")
    stated = attached.select("record_id", F.explode("concurrent_to").alias("other"))
    either = stated.unionAll(stated.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    direct = stated.join(captures.select(F.col("record_id").alias("capture")), F.col("other") == F.col("capture")).select("record_id", "capture")
    direct = direct.unionAll(captures.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture")))
    onward = either.join(direct.select(F.col("record_id").alias("other"), "capture"), "other").select("record_id", "capture")
    links = direct.unionAll(onward).distinct()
    fields = F.struct(*[c for c in attached.columns if c != "kind"])

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, fields)))

    own = links.join(attached, "record_id").groupBy("capture").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    return captures.join(own, F.col("record_id") == F.col("capture"), "left").select(
        F.struct(*captures.columns).alias("capture"), "requests", "metadata")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages written to an archive and read back."""
    spark = pages.sparkSession
    path = path or work_dir(spark, "warc")
    write(pages, path)
    needed = ["record_id", "kind", "concurrent_to", "refers_to", "fields", "payload_bytes", "payload_digest"]
    records = materialize(read(spark, path, payloads=False).select(needed), "records")
    named = F.filter(F.flatten(F.transform("metadata", lambda m: m["fields"])), lambda f: f["name"] == "page-id")
    rows = transactions(records).select(
        F.get(named, F.lit(0))["value"].cast("long").alias("page_id"), "capture.payload_bytes", "capture.payload_digest",
        F.col("capture.kind").alias("record_type"), "capture.record_id", F.col("capture.refers_to").alias("to"))
    rows = materialize(rows, "captures")
    firsts = rows.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = rows.where("to is not null").join(firsts, "to", "left").select(columns)
    return rows.where("to is null").withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionAll(revisits)
