"""Operator 9: WARC archives, written with revisit records and read by splittable byte ranges.

Writing: each task writes archives of gzip members, a member a record with its HTTP block, under attempt-unique names that are
renamed when complete; the list of finished files is the table the job returns, so lost attempts leave
no half archives behind. Equal payloads of at least ``MIN_REVISIT_BYTES`` become one response (largest
page_id) and revisits to it.

Reading: files are cut into byte ranges, and a task that owns ``[start, end)`` seeks there, scans for the gzip magic,
and tries each candidate: a member is real if it inflates to a WARC version line and a header block.
It owns all records whose member starts inside its range and follows the last one past the end. Member
starts are found by content, so any split size gives the same records.

Archives are opened by URI: local or mounted shared folders with plain files, other stores through
``pyarrow.fs``.

Defined cases: null html = empty payload; null url = an empty target; null page_id rows are written with an empty id and
read back as null, never the target of a revisit unless no other row has the payload; repeated page_ids give one record a row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.util import lean, materialize, new_path, open_uri, rename_uri, small_batches

MIN_REVISIT_BYTES = 1000
SPLIT_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"  # fixed: reruns give the same bytes
FIELDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def encode(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: an HTTP response with its payload. A revisit has the HTTP head alone, which tells the length, and keeps the digest of the full payload."""
    revisit = refers_to is not None
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(pages: DataFrame, uri: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, payload, payload_bytes, payload_digest, refers_to) to archives under ``uri``; returns path, size.

    A task begins another archive when one has reached ``archive_bytes``.
    """
    small_batches(pages.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        def closed() -> pa.RecordBatch:
            out.close()
            rename_uri(name + ".open", name + ".warc.gz")
            return pa.RecordBatch.from_pydict({"path": [name + ".warc.gz"], "size": [size]})

        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"{uri}/{uuid4().hex}", 0
                    out = open_uri(name + ".open", "wb")
                size += out.write(encode(row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"], row["refers_to"]))
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return pages.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(lean(run), "path string, size long")


class _Window:
    """Random reads of one file through a buffer that only moves forward."""

    def __init__(self, file, start: int, size: int) -> None:
        self.file, self.base, self.buf, self.size = file, start, b"", size

    def fill(self, at: int, n: int) -> None:
        """Hold [at, at + n), as far as the file goes."""
        if at > self.base:
            drop = min(at - self.base, len(self.buf))
            self.buf, self.base = self.buf[drop:], self.base + drop
            if not self.buf:
                self.base = at
        while len(self.buf) < n and self.base + len(self.buf) < self.size:
            self.file.seek(self.base + len(self.buf))
            more = self.file.read(max(READ, n - len(self.buf)))
            if not more:
                break
            self.buf += more


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The record that starts at ``at`` and where its member ends; None if no WARC record starts there."""
    z = zlib.decompressobj(31)
    data, pos, checked = [], at, False
    try:
        while not z.eof:
            window.fill(pos, 1)
            piece = window.buf[: READ if checked else 4096]
            if not piece:
                return None
            data.append(z.decompress(piece))
            pos += len(piece) - len(z.unused_data)
            if not checked and sum(map(len, data)) >= 8:
                if not b"".join(data).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    record = b"".join(data)
    return (record, pos) if record.startswith(b"WARC/1.") and b"\r\n\r\n" in record else None


def parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    number = lambda x: int(d) if (d := x.strip("<>").rpartition(":")[2]) else None
    payload, full = rest[: int(fields.get("content-length", "0"))], 0
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        full = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    kind = fields.get("warc-type", "")
    claimed = fields.get("warc-payload-digest", "").partition(":")[2]
    revisit = kind == "revisit"
    return {
        "page_id": number(fields.get("warc-record-id", "")),
        "url": fields.get("warc-target-uri", ""),
        "record_type": kind,
        # of a response both are taken from the payload that was read, not from what the header claims
        "payload_digest": claimed if revisit else hashlib.sha1(payload).hexdigest(),
        "payload_bytes": full if revisit else len(payload),
        "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload": payload,
    }


def read_range(uri: str, start: int, end: int, size: int) -> Iterator[dict]:
    """All records whose member starts in [start, end)."""
    with open_uri(uri, "rb") as file:
        window, at = _Window(file, start, size), start
        while at < end:
            window.fill(at, READ)
            k = window.buf.find(MAGIC)
            if k < 0:
                if at + len(window.buf) >= size:
                    return
                at += max(1, len(window.buf) - len(MAGIC) + 1)
                continue
            at += k
            if at >= end:
                return
            window.fill(at, READ)
            found = _member(window, at)
            if found is None:
                # the window may have moved on: start again behind the false magic
                window = _Window(file, at + 1, size)
                at += 1
                continue
            yield parse(found[0])
            at = found[1]
            if at < window.base:
                window = _Window(file, at, size)


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives in ``files`` (path, size), read by ranges of ``split_bytes``."""
    spark = files.sparkSession
    n = max(1, int(files.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1))
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(min(n, 10_000))
    small_batches(spark, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for part in batch.to_pylist():
                held, total = [], 0
                for record in read_range(part["path"], part["start"], min(part["start"] + split_bytes, part["size"]), part["size"]):
                    held.append(record)
                    total += len(record["payload"])
                    if len(held) >= 256 or total > READ * 4:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, total = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return ranges.mapInArrow(lean(run), FIELDS)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Payload, its length and digest, and for every repeated long payload the page_id of its response.

    Rows that agree in payload and in the largest page_id are one page that stands twice: each is the response. Groups of copies are found on digests alone, by a partial maximum, and only digests that repeat are written. Payloads meet
    them where they are as long as that table is small enough for a broadcast by its written size; beyond, in a plain join, which adaptive execution can split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"), "check": F.unhex(F.sha2("payload", 256))})
    keys = base.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("check").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where(F.col("copies") > 1).select("check", "response")
    keys = materialize(keys, "repeated-payloads")
    return base.join(keys, "check", "left").withColumn("refers_to", F.when((F.col("page_id") != F.col("response")) | (F.col("page_id").isNull() & F.col("response").isNotNull()), F.col("response"))).drop("check", "response")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives to the shared folder and read every record back."""
    spark: SparkSession = pages.sparkSession
    files = materialize(write_archives(with_revisits(pages), new_path(spark, "warc")), "warc-files")
    return read_archives(files)


def op9(pages: DataFrame) -> DataFrame:
    return round_trip(pages.select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, CASE WHEN n >= {MIN_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN top IS NOT NULL AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS NOT NULL AND top <> page_id THEN top END AS refers_to
FROM g
"""
