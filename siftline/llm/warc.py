"""WARC archives: deduplicating writer and splittable reader.

The writer makes one gzip member a record (so that a reader may begin at any member), in files on any file system that
Arrow opens. Tasks return their files' names and sizes; only these count, so what a lost or repeated task left behind is
never read. The reader deals byte ranges to tasks. A task scans its range for the gzip magic, takes a candidate for a
member only if its first bytes decode to a WARC version line, and owns the records that begin inside its range, reading
past its end to finish the last one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import land, qualified, shared_path, table, text_of

MAGIC = b"\x1f\x8b\x08"
#: Payloads shorter than this are written again, never as a revisit.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, bytes long, records long"
RECORD = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, path string, position long"
SALTS = 16
#: Type of the row that stands for a record which can't be read.
DAMAGED = "damaged"
_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def record_id(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(column):
    """The page_id in a record id, or null."""
    digits = F.regexp_extract(column, r"^<urn:x-page:(-?\d+)>$", 1)
    return F.when(digits != "", digits.cast("long"))


def make_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, size: int | None = None, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _opened(uri: str):
    """Arrow's file system of a URI as Hadoop writes it, and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + colon + rest if colon else uri)


def _write(folder: str, most: int):
    def run(batches):
        system, base = _opened(folder)
        system.create_dir(base, recursive=True)
        out, done, size, count = None, [], 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                data = make_record(row["page_id"], row["url"], row["payload"], row["digest"], row["keep"], row["revisit"], row["size"])
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= most:
                    out.close()
                    done.append((f"{folder}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "bytes", "records"])

    return run


def write_warc(pages: DataFrame, folder: str, most: int = 1 << 30) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html; other columns are ignored) and return the archives' paths,
    bytes and records.

    Of rows with equal payloads of at least REVISIT_BYTES bytes, those with the largest page_id are responses (repeated
    rows may tie), others revisits of it. A null html is an empty payload; a null page_id is never the largest unless all
    are null. The groups are counted in part before the shuffle, and salted for the join, so that a payload that a third
    of all pages share is no task's burden; short payloads, which are never revisits, are dealt by page. Revisits carry no
    payload. A folder without a scheme is one of Hadoop's default file system. An empty table makes no archive.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.to_binary(text_of("html"), F.lit("utf-8")).alias("payload"))
    x = x.withColumn("digest", F.sha1("payload")).withColumn("long", F.octet_length("payload") >= REVISIT_BYTES).withColumn("salt", F.when(F.col("long"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).otherwise(SALTS + F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.lit(1 << 30))).cast("int"))
    groups = x.where("long").groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = x.join(groups, ["digest", "salt"], "left").withColumn("revisit", F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")))
    rows = marked.select("page_id", "url", "digest", F.when(F.col("revisit"), F.col("keep")).alias("keep"), "revisit", F.octet_length("payload").alias("size"), F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"))
    return land(rows.mapInArrow(_write(folder, most), FILES), "warc-files")


class _Window:
    """Bytes of a file, read a large block at a time."""

    def __init__(self, file, size: int, block: int = 1 << 20):
        self.file, self.size, self.block, self.at, self.data = file, size, block, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(max(0, min(max(n, self.block), self.size - at)), at)
        return self.data[at - self.at : at - self.at + n]


def next_member(w: _Window, at: int, end: int) -> int | None:
    """Where the first WARC member begins in [at, end)."""
    while at < end:
        data = w.get(at, min(1 << 16, end - at + 2, w.size - at))
        k = data.find(MAGIC)
        if k < 0 or at + k >= end:
            at += max(1, len(data) - 2)
            continue
        at += k
        try:
            if zlib.decompressobj(31).decompress(w.get(at, min(512, w.size - at)), 8).startswith(b"WARC/"):
                return at
        except zlib.error:
            pass
        at += 1
    return None


def members(w: _Window, start: int, end: int):
    """Position and content of each member that begins in [start, end); the content of one that doesn't decode to its end is
    None, and the search goes on behind its first byte."""
    at = next_member(w, start, end)
    while at is not None:
        unpack, off, parts = zlib.decompressobj(31), at, []
        try:
            while not unpack.eof and off < w.size:
                data = w.get(off, min(1 << 16, w.size - off))
                parts.append(unpack.decompress(data))
                off += len(data)
            good = unpack.eof
        except zlib.error:
            good = False
        yield at, b"".join(parts) if good else None
        at = next_member(w, off - len(unpack.unused_data) if good else at + 1, end)


def parse(record: bytes) -> dict:
    """The fields of RECORD from one record; a digest or length that the header lacks comes from the payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {m[1].strip().lower().decode("latin-1"): m[2].strip().decode("utf-8", "replace") for m in _FIELD.finditer(head)}
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, split, payload = block.partition(b"\r\n\r\n") if "http" in fields.get("content-type", "") else (b"", b"", block)
    kind = fields.get("warc-type", "")
    out = {"record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload": payload}
    if kind == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http + b"\r\n")
        return out | {"payload_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None, "payload_bytes": int(length[1]) if length else None, "payload": None}
    return out | {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)}


def _read(with_payload: bool):
    def run(batches):
        names = [x.split()[0] for x in RECORD.split(", ")]
        schema = pa.schema([(n, pa.int64() if n in ("payload_bytes", "position") else pa.binary() if n == "payload" else pa.string()) for n in names])
        for batch in batches:
            for split in batch.to_pylist():
                system, path = _opened(split["path"])
                rows, held = [], 0
                with system.open_input_file(path) as f:
                    for at, data in members(_Window(f, split["bytes"]), split["start"], split["end"]):
                        row = (parse(data) if data is not None else {"record_type": DAMAGED}) | {"path": split["path"], "position": at}
                        if not with_payload:
                            row.pop("payload", None)
                        rows.append(row)
                        held += len(data or b"") if with_payload else 1 << 10
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_warc(files: DataFrame, split_bytes: int = 16 << 20, with_payload: bool = True) -> DataFrame:
    """The records (RECORD) of the archives in files (path, bytes), by byte ranges of split_bytes; any WARC with a member a
    record will do. A member that begins as a record but doesn't decode is a row of type DAMAGED with its path and position
    only, so that a damaged archive doesn't look whole. An empty list of files gives no rows."""
    total = files.agg(F.sum("bytes")).first()[0] or 0
    splits = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    return splits.repartition(max(1, -(-total // split_bytes), min(200, files.count())), "path", "start").mapInArrow(_read(with_payload), RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as records and read back."""
    records = read_warc(write_warc(table(spark, sf_dir, "pages"), shared_path(spark, "warc")), with_payload=False)
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keep FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM k
"""
