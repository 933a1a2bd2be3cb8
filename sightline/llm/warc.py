"""WARC archives with revisit records in place of repeated payloads.

A first pass puts payloads into files of the shared folder, compressed, and
keeps of each page a header: id, digest, size, file and place in it.  Only
headers are shuffled, by payload digest to find each payload's original and by
file to meet the payloads again, so no payload ever is.  Every task then copies
the payloads of its files' responses into archives of its own with fresh
headers, one gzip member a record; a revisit's payload is not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, make_dir, partitions_for, read_bytes, salted_join, tidy, write_bytes

ARCHIVE_BYTES = 64 << 20
#: Compressed payload bytes after which a file of payloads is closed; a larger payload still has one file.
STORE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("5b6f4e6e-3c1d-4c58-9d2e-7f0c8d5a1b42")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    return " ".join(value.split())


def build_record(page_id: int | None, uri: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, refers_uri: str | None, date: str) -> bytes:
    """One gzip member; a revisit (``refers_to`` set) carries the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if uri is not None and _clean(uri):
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
        if refers_uri is not None and _clean(refers_uri):
            head.append(f"WARC-Refers-To-Target-URI: {_clean(refers_uri)}")
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += [f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(2, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_archive(data: bytes):
    """Yield (headers, block) of every record of a gzipped archive."""
    view = memoryview(data)
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        parts, pos = [], at
        while not z.eof:
            chunk = view[pos : pos + 65536]
            if not len(chunk):
                raise ValueError("archive ends inside a record")
            parts.append(z.decompress(chunk))
            pos += len(chunk)
        at = pos - len(z.unused_data)
        raw = b"".join(parts)
        cut = raw.index(b"\r\n\r\n")
        lines = raw[:cut].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield head, raw[cut + 4 : cut + 4 + n]


HEADER = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("sha1", pa.string()), ("size", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("stored", pa.int64())])


def store_payloads(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Put payloads into files below ``folder``; one header row a page (lazily: write it once).

    Files are named anew by every attempt; only headers of attempts that
    succeeded are kept, so retries leave no wrong file behind them.
    """
    raw = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))

    @tidy
    def run(batches):
        rows, made, size = [], [], 0
        path = f"{folder}/{uuid.uuid4().hex}"
        for b in batches:
            for page_id, uri, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                z = zlib.compress(payload, 1)
                rows.append((page_id, uri, hashlib.sha1(payload).hexdigest(), len(payload), path, size, len(z)))
                made.append(z)
                size += len(z)
                if size >= STORE_BYTES:
                    write_bytes(path, b"".join(made))
                    yield _batch(rows)
                    rows, made, size, path = [], [], 0, f"{folder}/{uuid.uuid4().hex}"
        if rows:
            write_bytes(path, b"".join(made))
            yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), HEADER, strict=True)], schema=HEADER)

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), raw.alias("payload"))
    return src.mapInArrow(run, "page_id long, uri string, sha1 string, size long, file string, at long, stored long")


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers with refers_to and refers_uri, null for responses.

    Among equal payloads of at least ``min_bytes`` the smallest id is the
    original, the others refer to it.  The rows of a digest, of whatever
    number, are dealt over many tasks.
    """
    known = heads.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull())
    first = known.groupBy("sha1").agg(F.min(F.struct("page_id", "uri")).alias("o")).select("sha1", F.col("o.page_id").alias("first"), F.col("o.uri").alias("first_uri"))
    # digests without an id of their own have no original
    lone = heads.select("sha1").distinct().join(first, "sha1", "left")
    met = salted_join(heads, lone, "sha1", F.xxhash64("file", "at"))
    again = (F.col("size") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select(*heads.columns, F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_uri")).alias("refers_uri"))


def write_archives(heads: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write resolved headers and their payloads to archives below ``folder``; returns path, records, bytes of each (lazily: write it once)."""
    names = ("file", "at", "stored", "page_id", "uri", "sha1", "size", "refers_to", "refers_uri")
    dealt = heads.select(*names).repartition(partitions_for(heads.sparkSession), "file").sortWithinPartitions("file", "at")

    @tidy
    def run(batches):
        made, n, size, held, data = [], 0, 0, None, b""

        def close():
            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            write_bytes(path, b"".join(made))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for b in batches:
            for file, at, stored, page_id, uri, sha, length, refers, refers_uri in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = None
                if refers is None:
                    if held != file:
                        held, data = file, memoryview(read_bytes(file))
                    payload = zlib.decompress(data[at : at + stored])
                rec = build_record(page_id, uri, payload, base64.b32encode(bytes.fromhex(sha)).decode(), length, refers, refers_uri, date)
                made.append(rec)
                n, size = n + 1, size + len(rec)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    made, n, size = [], 0, 0
        if made:
            yield close()

    return dealt.mapInArrow(run, "path string, records long, bytes long")


def read_archives(paths: DataFrame) -> DataFrame:
    """Records of archives (column ``path``): page_id, uri, record_type, payload_bytes, payload_digest, refers_to, payload.

    A response's size and digest are computed from its payload and must agree
    with its headers; a revisit has a null payload and its original's figures.
    """
    schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    @tidy
    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                out, held = [], 0
                for head, block in parse_archive(read_bytes(path)):
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    body = None
                    if head["WARC-Type"] == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        if len(body) != size or digest32(body) != digest:
                            raise ValueError(f"{path}: {head['WARC-Record-ID']} differs from its digest")
                    page, refers = head.get("X-Page"), head.get("X-Refers-To-Page")
                    out.append({"page_id": page and int(page), "uri": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": refers and int(refers), "payload": body})
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return paths.select("path").mapInArrow(run, "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archive(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder and read them back.

    Null payloads are empty ones; payloads of any length are whole.  Equal rows
    (same id, same payload) that are the original are responses all; a null id
    is never the original where an id exists, else its record is a response.
    White space in URIs becomes single blanks, null or empty URIs have no
    header.  Other columns are not read.  An empty table gives no archive.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    payloads, folder = ws.path("payloads"), ws.path("archives")
    make_dir(payloads)
    make_dir(folder)
    heads = ws.stage(store_payloads(pages, payloads, id_col, uri_col, payload_col), "headers")
    done = ws.stage(write_archives(resolve(heads, min_bytes), folder), "manifest")
    return read_archives(done.repartition(partitions_for(spark)))
