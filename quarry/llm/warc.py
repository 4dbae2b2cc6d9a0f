"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own.  A writing task puts its records
into one archive under a name of its own attempt; the manifest (written by
Spark, so it names the archives of successful attempts only) lists path and
length.  Archives left by lost attempts are never read.

Reading tasks get byte ranges.  A task looks for the gzip magic inside its
range, validates each candidate by decoding the member's head up to a WARC
header, and owns the records that start in its range, reading past the end
to finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import join_by_key, shuffle_partitions, written
from quarry.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
CHUNK = 1 << 16


def filesystem(path: str):
    """(file system, path in it) of a URI (``qualified``)."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path[:7] != "file://" and path[:6] == "file:/" else path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark resolves it on, so that executors
    write where the driver and all others read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to, number: str) -> bytes:
    """One record: a response with its payload, or a revisit of another page."""
    body = b"" if refers_to is not None else payload
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{number}>"), ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("Page-ID", page_id), ("Payload-Length", size), ("Refers-To-Page-ID", refers_to),
            ("Content-Type", "text/html"), ("Content-Length", len(body))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {str(v).translate(_ONE_LINE)}\r\n" for k, v in head if v is not None) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


_ONE_LINE = {10: "%0A", 13: "%0D"}


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row into archives under ``path``; returns the
    manifest ``(file, length, records)``.

    The payload is the html as UTF-8 (null: empty).  Of equal payloads those
    of the smallest key are responses, all others revisit it; a null key
    revisits unless all of its payload's keys are null.
    """
    path = qualified(pages.sparkSession, path)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    # only payloads that occur twice are joined; the digest column alone is scanned for them
    first = written(rows.groupBy("sha1").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")), "warc-digests")
    rows = join_by_key(rows, first, "sha1", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, count, name = None, 0, f"{path}/{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            ids, urls, least, body, sha = (b.column(c).to_pylist() for c in ("page_id", "url", "least", "payload", "sha1"))
            for i, u, m, p, s in zip(ids, urls, least, body, sha):
                if out is None:
                    where, local = filesystem(name)
                    where.create_dir(local.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(local, compression=None)      # members are compressed here
                digest = base64.b32encode(bytes.fromhex(s)).decode()
                revisit = None if i == m else m
                out.write(member(record(i, u, p, digest, len(p), revisit, str(uuid.uuid4()))))
                count += 1
        if out is not None:
            length = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([length]), pa.array([count])], ["file", "length", "records"])

    return written(rows.mapInArrow(run, "file string, length bigint, records bigint"), "warc-manifest")


class _Window:
    """Reads of a file by absolute position."""

    def __init__(self, file, length: int):
        self.file, self.length = file, length

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.length - at)), at) if at < self.length else b""


def _decode(w: _Window, at: int, whole: bool) -> tuple[bytes, int] | None:
    """The member at ``at``: decoded bytes (up to the end of the WARC header
    unless ``whole``) and the position after it; None if it is none."""
    z, out, pos = zlib.decompressobj(31), [], at
    size = CHUNK if whole else 512
    seen = b""
    try:
        while not z.eof:
            data = w.read(pos, size)
            if not data:
                return None
            pos += len(data)
            size = CHUNK
            out.append(z.decompress(data))
            if len(seen) < 5:
                seen += out[-1][:5]
                if not b"WARC/".startswith(seen[:5]):
                    return None
            if not whole and (len(seen) >= 5 and b"\r\n\r\n" in b"".join(out)):
                return b"".join(out), -1
    except zlib.error:
        return None
    text = b"".join(out)
    return (text, pos - len(z.unused_data)) if text.startswith(b"WARC/") and b"\r\n\r\n" in text else None


def records_in_range(file, length: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, decoded record)`` of the records that start in
    [start, end).  Magic bytes inside compressed data are told apart by
    decoding; after a valid record the search goes on behind it."""
    w = _Window(file, length)
    at = start
    while at < end:
        chunk = w.read(at, CHUNK + len(MAGIC) - 1)
        hit = chunk.find(MAGIC)
        if hit < 0 or at + hit >= end:
            at += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        at += hit
        # the header alone is decoded first: most false candidates end here
        got = _decode(w, at, whole=False) and _decode(w, at, whole=True)
        if got is None:
            at += 1
        else:
            yield at, got[0]
            at = got[1]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the archives of ``manifest (file, length)``: ``page_id, url,
    record_type, refers_to, payload_digest, payload_bytes, payload`` (null for
    a revisit).  Digest and length of a response are those of the payload
    read; a stated digest that differs is an error.  Empty archives: no rows."""
    ranges = (manifest.where("length > 0")
              .select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
              .repartition(shuffle_partitions(manifest.sparkSession)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for path, length, start in zip(*(b.column(c).to_pylist() for c in ("file", "length", "start"))):
                where, local = filesystem(path)
                rows: list[tuple] = []
                held = 0
                with where.open_input_file(local) as file:
                    for _, data in records_in_range(file, length, start, min(start + range_bytes, length)):
                        head, body = parse(data)
                        page, refers = (None if head.get(k) is None else int(head[k]) for k in ("Page-ID", "Refers-To-Page-ID"))
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["Payload-Length"])
                        if head["WARC-Type"] == "response" and (payload_digest(body) != digest or len(body) != size):
                            raise ValueError(f"{path}: payload of page {page} differs from its digest")
                        full = head["WARC-Type"] == "response"
                        rows.append((page, head.get("WARC-Target-URI"), head["WARC-Type"], refers, digest, size, body if full else None))
                        held += len(body)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return ranges.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
                                  "payload_bytes bigint, payload binary")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared scratch folder, read back."""
    path = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, path))
