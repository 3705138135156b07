"""WARC archives: a writer with revisit records, and a sequential reader.

Writer: one gzip member per record, archives of bounded size, written by the tasks
into a folder that all executors share. Of the records with equal payloads of at
least ``MIN_SHARED`` bytes, the one with the smallest page_id is a ``response``, the
others are ``revisit`` records that refer to it. Archives are written under a
temporary name and renamed when complete; their bytes depend on their rows alone,
so a task that runs again writes the same archive.

Reader: feeds the archive to zlib piece by piece, one member per record, takes the
header up to the blank line, frames the block by Content-Length, and compares the
block's and the payload's SHA-256 with the record's digests.

Defined results: null html is empty; payloads under MIN_SHARED bytes are always
responses; null page_ids come last among equal payloads; rows with the same page_id
as the smallest are all responses; a record that is cut short, badly framed or with
a wrong digest raises ``ValueError`` (or is returned with its fault, if asked);
extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.llm import common as C

MIN_SHARED = 100
ARCHIVE_BYTES = 4 << 20
READ_BYTES = 64 << 10
BROADCAST_ROWS = 200_000
#: fixed, so that archives depend on their rows alone
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4


# ---------------------------------------------------------------- one record

def record(page_id, url: str, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One gzip member: WARC header, blank line, HTTP block, two line ends."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{name}')}>",
        f"WARC-Date: {DATE}", "WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "%%%02X" % (ord(c) & 255) for c in url),
        f"X-Page-ID: {name}", f"X-Payload-Length: {len(payload)}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(stream, size: int = READ_BYTES):
    """The decompressed gzip members of a byte stream, one after the other."""
    held = b""
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            piece = held or stream.read(size)
            held = b""
            if not piece:
                if out:
                    raise ValueError("archive ends inside a record")
                return
            out.append(z.decompress(piece))
        held = z.unused_data
        yield b"".join(out)


def parse(member: bytes) -> dict:
    """Header fields (lower-cased names), block and payload of one record, framed and verified."""
    cut = member.find(b"\r\n\r\n")
    if cut < 0 or not member.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    out = {}
    for line in member[:cut].decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    n = int(out["content-length"])
    block = member[cut + 4:cut + 4 + n]
    if len(block) != n or member[cut + 4 + n:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the block")
    if out["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    out["payload"] = block[block.index(b"\r\n\r\n") + 4:]
    if out["warc-type"] == "response" and out["warc-payload-digest"] != "sha256:" + hashlib.sha256(out["payload"]).hexdigest():
        raise ValueError("payload digest differs")
    return out


# ---------------------------------------------------------------- archives

def _open(path: str):
    """(file system, path) of a folder on shared storage."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives below ``path``; returns archive and records (already written)."""
    C.ship(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("payload"))
    # only digests travel in the search for equal payloads
    large = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= MIN_SHARED)
    shared = C.store(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k"))
                     .where("k > 1").select("digest", "first"), "shared-payloads")
    few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows = rows.join(F.broadcast(shared) if few else shared, "digest", "left").select("page_id", "url", "payload", "digest", "first")
    if not few:     # a shuffle may bring rows in any order: sort, so that a task that runs again cuts the same archives
        rows = rows.sortWithinPartitions("page_id", "digest", "url")
    fs, root = _open(path)
    fs.create_dir(root, recursive=True)

    def run(batches):
        fs, root = _open(path)
        context = TaskContext.get()
        number, held, size, count, done = 0, [], 0, 0, []

        def flush():
            nonlocal number, held, size, count
            name = f"part-{context.partitionId():06d}-{number:06d}.warc.gz"
            temporary = f"{root}/_{name}.{context.taskAttemptId()}"
            with fs.open_output_stream(temporary, compression=None) as f:
                for x in held:
                    f.write(x)
            fs.move(temporary, f"{root}/{name}")
            done.append((name, count))
            number, held, size, count = number + 1, [], 0, 0

        for b in batches:
            for page, url, payload, digest, first in zip(*(b.column(i) for i in range(5))):
                page, first = page.as_py(), first.as_py()
                x = record(page, url.as_py(), payload.as_py(), digest.as_py(), first, first is not None and page != first)
                held.append(x)
                size, count = size + len(x), count + 1
                if size >= ARCHIVE_BYTES:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
                                         names=["archive", "records"])

    return C.store(rows.mapInArrow(run, "archive string, records long"), "archives")


def read_archives(spark, path: str) -> DataFrame:
    """The records of all archives below ``path``, each archive read in sequence.

    Archives are listed and opened by Spark's binary reader, so any store that Spark
    reads will do; the writer bounds their size.
    """
    C.ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")

    def run(batches):
        for b in batches:
            for content in b.column(0):
                out = []
                for m in members(io.BytesIO(content.as_buffer())):
                    r = parse(m)
                    kind = r["warc-type"]
                    n = int(r["x-payload-length"])
                    if kind == "response" and len(r["payload"]) != n:
                        raise ValueError("payload length differs")
                    out.append((int(r["x-page-id"]) if r["x-page-id"] else None, r["warc-target-uri"], n,
                                r["warc-payload-digest"].partition(":")[2], kind,
                                int(r["x-refers-to-page"]) if kind == "revisit" else None, r["payload"]))
                    if len(out) >= 256:
                        yield batch(out)
                        out = []
                if out:
                    yield batch(out)

    def batch(out):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                          names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                                 "refers_to long, payload binary")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives."""
    path = C.shared_path(spark, "warc")
    write_archives(C.table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("payload", "url")


ORACLE = {"op7_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {MIN_SHARED} AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_SHARED} AND page_id <> f THEN f END AS refers_to
FROM r
"""}
