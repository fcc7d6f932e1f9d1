"""WARC archives: writing, normalising whole-file gzip streams, and reading by index.

``write_archives`` writes a record per page, deduplicated by payload digest:
of equal payloads of at least ``MIN_REVISIT`` bytes that with the smallest id
is a response and the others are revisits of it. A task writes its pages as
archives that are each one gzip stream from end to end. ``normalise`` inflates
such a stream once, piece by piece, rewrites every record as a gzip member of
its own and writes a sidecar index of (offset, length) beside it.
``read_archives`` opens the sidecars and reads the members that they list.

Files lie under a uri that pyarrow's file systems can open on every machine.
A file is written under a name of its own and then renamed, and the tables of
finished files are written before anything is deleted, so tasks can be retried.

Payloads that many pages share do not meet in one task: digests that hold at
least a thousandth of all pages (a thousand at most) are broadcast, the rest is
joined by digest, and only digests that occur twice are joined at all.

Defined results: null html is an empty payload, a null url has no target
header, a null id none either and never is what others refer to. Rows that
repeat the smallest id of a payload are all responses. No pages give no
archives and no rows. A stream that ends early, or whose payload does not match
its digest, raises.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table, written

MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
_PIECE = 1 << 18
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One uncompressed WARC record."""
    block = _HTTP if revisit else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> tuple[dict[str, str], int]:
    """(fields by lower-cased name, where the block begins) of a record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}, end + 4


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a byte stream, holding no more than one record and a piece."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while (end := held.find(b"\r\n\r\n")) >= 0:
            fields, start = headers(bytes(held[: end + 4]))
            size = start + int(fields["content-length"]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
    if held:
        raise ValueError("the stream ends inside a record")


def inflated(stream) -> Iterator[bytes]:
    """Pieces of a gzip stream of one or more members."""
    member, fed = zlib.decompressobj(31), False
    while raw := stream.read(_PIECE):
        while raw:
            fed = True
            if out := member.decompress(raw):
                yield out
            raw = b""
            if member.eof:
                raw, member, fed = member.unused_data, zlib.decompressobj(31), False
    if fed:
        raise ValueError("the gzip stream is cut short")


def _finish(fs: pafs.FileSystem, part: str, path: str) -> None:
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(part, path)


#: Repeated payloads whose digests are broadcast at most, some 100 bytes each; more are joined by shuffle.
BROADCAST_DIGESTS = 250_000


def _roles(pages: DataFrame, id_col: str, html_col: str, url_col: str) -> DataFrame:
    """Pages with payload, digest and, for payloads that occur more than once, the id of the response."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    ids = p.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    twice = written(ids.filter((F.col("n") > 1) & F.col("first").isNotNull()), "payloads")
    least = max(2, -(-pages.count() // 1000))
    hot = F.broadcast(twice.filter(F.col("n") >= least).select(F.col("digest").alias("hot_digest"), F.col("first").alias("hot_first")))
    cold = twice.filter(F.col("n") < least).select(F.col("digest").alias("key"), F.col("first").alias("cold_first"))
    if cold.count() <= BROADCAST_DIGESTS:  # then no payload is shuffled
        cold = F.broadcast(cold)
    p = p.join(hot, p["digest"] == hot["hot_digest"], "left")
    p = p.withColumn("key", F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.concat(F.lit("!"), F.xxhash64("page_id", "url").cast("string"))))
    return p.join(cold, "key", "left").select("page_id", "url", "payload", "digest", F.coalesce("hot_first", "cold_first").alias("first"))


def write_archives(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages as archives of one gzip stream each under ``base``: a written table (path, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, done, size, n, k = None, [], 0, 0, 0
        name = part = ""

        def close():
            nonlocal out, size, n
            out.write(gz.flush())
            out.close()
            _finish(fs, part, name)
            done.append((name, n))
            out, size, n = None, 0, 0

        for b in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = posixpath.join(root, f"pages-{task.partitionId():05d}-{k:04d}.warc.gz")
                    part = f"{name}.{task.taskAttemptId()}.part"
                    out, gz, k = fs.open_output_stream(part, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), k + 1
                raw = record(page_id, url, payload, digest, first, first is not None and first != page_id)
                out.write(gz.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "n_records"])

    return written(_roles(pages, id_col, html_col, url_col).mapInArrow(run, "path string, n_records long"), "archives")


def _spread(files: DataFrame) -> DataFrame:
    """A file to a task, as far as a round robin does it."""
    return files.repartition(max(1, files.count()))


def normalise_stream(stream, out) -> Iterator[dict]:
    """Copy the records of a gzip stream to ``out``, a member each; yields their index entries."""
    offset = 0
    for raw in records(inflated(stream)):
        fields, _ = headers(raw)
        gz = zlib.compressobj(5, zlib.DEFLATED, 31)
        member = gz.compress(raw) + gz.flush()
        out.write(member)
        yield {"offset": offset, "length": len(member), "type": fields["warc-type"], "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri")}
        offset += len(member)


def normalise(files: DataFrame, base: str, path_col: str = "path") -> DataFrame:
    """Rewrite archives record by record under ``base``: a written table (path, index_path, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for source in b.column(0).to_pylist():
                name = posixpath.join(root, posixpath.basename(source))
                index, n = f"{name}.idx", 0
                with fs.open_input_stream(source, compression=None) as src, fs.open_output_stream(f"{name}.{attempt}.part", compression=None) as out, fs.open_output_stream(f"{index}.{attempt}.part", compression=None) as side:
                    for entry in normalise_stream(src, out):
                        side.write(json.dumps(entry).encode() + b"\n")
                        n += 1
                _finish(fs, f"{name}.{attempt}.part", name)
                _finish(fs, f"{index}.{attempt}.part", index)
                yield pa.record_batch([pa.array([name]), pa.array([index]), pa.array([n], pa.int64())], names=["path", "index_path", "n_records"])

    return written(_spread(files.select(path_col)).mapInArrow(run, "path string, index_path string, n_records long"), "normalised")


def read_archives(files: DataFrame, base: str) -> DataFrame:
    """Records that the sidecar indexes list: (page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to)."""
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(base)
        number = lambda x: None if x is None else int(x)

        def rows(path: str, index: str):
            with fs.open_input_stream(index, compression=None) as side:
                entries = [json.loads(x) for x in side.read().splitlines()]
            with fs.open_input_file(path) as f:
                for e in entries:
                    raw = zlib.decompress(f.read_at(e["length"], e["offset"]), 31)
                    fields, start = headers(raw)
                    block = raw[start : start + int(fields["content-length"])]
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"payload and digest differ at {e['offset']} of {path}")
                    yield number(fields.get("x-page-id")), fields.get("warc-target-uri"), kind, payload if kind == "response" else None, size, digest, number(fields.get("x-refers-to-page-id"))

        def batch(got: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=[x.split(" ")[0] for x in schema.split(", ")])

        for b in batches:
            for path, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got, size = [], 0
                for row in rows(path, index):
                    got.append(row)
                    size += len(row[3] or b"")
                    if size > (4 << 20):
                        yield batch(got)
                        got, size = [], 0
                if got:
                    yield batch(got)

    return _spread(files.select("path", "index_path")).mapInArrow(run, schema)


def _delete(files: DataFrame, base: str) -> None:
    """Remove archives that have been rewritten; the names come from their folder, not from a collected table."""
    fs, root = pafs.FileSystem.from_uri(base)
    if files.count() and fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fresh_path(spark, "warc")
    streams = write_archives(table(spark, sf_dir, "pages"), f"{base}/streams")
    members = normalise(streams, f"{base}/members")
    _delete(streams, f"{base}/streams")
    return read_archives(members, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to FROM f
"""
}
