"""WARC archives: written as one gzip stream a file, normalised to one member a record with an offset index, read back.

Writing: each task writes one file, a single gzip stream, which can only be read from its start. The normaliser inflates
such a stream once, rewrites every record as a gzip member of its own and writes beside it a sidecar index of offset,
length and record id; a reader then seeks to any record. Files are named by a random part, and only the names in the
manifest table count, so a retried or lost task leaves nothing that is read.

Of records with equal payloads of at least `min_bytes`, the one with the largest page id is a response, the others are
revisits that refer to it and hold the HTTP head without the payload.

Defined cases: null html is an empty payload; a null url has no target line; control signs in a url are percent-encoded;
null page ids sort lowest, and several rows of one page id and payload are all responses if that id is the largest; an
empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

GZIP, CHUNK = 31, 1 << 20
MANIFEST = "archive string, n_records long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
INDEX = "archive string, offset long, length long, page_id long"


def open_fs(uri: str):
    """A file system that executors reach, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to. The largest page of each payload is found by an aggregate
    that sends one row for each payload and task; the join that brings it to the rows can be split by Spark where one
    payload is very common, as nothing after it needs a payload's rows together."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.unhex(F.sha1("payload")))
    best = p.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("best"))
    joined = p.join(best, "digest", "left")
    revisit = (F.length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("best"))
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to")
    )


def _record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, kind: str, refers_to: int | None) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of with_record_types() to archives in folder; returns the manifest table."""
    spark = records.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, gz, name = None, 0, None, f"{uuid.uuid4().hex}.mono.warc.gz"
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                if out is None:
                    fs, path = open_fs(folder)
                    fs.create_dir(path, recursive=True)
                    out, gz = fs.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP)
                out.write(gz.compress(_record(*r)))
                n += 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n]})

    records.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/_manifest.parquet")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest.parquet")


def stream_records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of each record of an inflated stream, holding one record at a time."""
    buf = bytearray()

    def need(n: int) -> bool:
        while len(buf) < n:
            more = next(chunks, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while True:
        at, seen = -1, 0
        while (at := buf.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buf)
            if not need(len(buf) + 1):
                if bytes(buf).strip():
                    raise ValueError("an archive ends within a record")
                return
        head = bytes(buf[:at])
        size = int(_headers(head)["content-length"])
        if not need(at + 4 + size):
            raise ValueError("an archive ends within a record")
        block = bytes(buf[at + 4 : at + 4 + size])
        need(at + 8 + size)
        del buf[: at + 8 + size]
        yield head, block


def _inflated(source) -> Iterator[bytes]:
    z = zlib.decompressobj(GZIP)
    while data := source.read(CHUNK):
        while data:
            if out := z.decompress(data):
                yield out
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(GZIP)
            elif data:
                break


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites every archive of the manifest with one member a record, and a sidecar index beside it; returns the
    index as a table."""
    spark = manifest.sparkSession

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("archive").to_pylist():
                fs, path = open_fs(folder)
                new = f"{name.removesuffix('.mono.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                at, rows, held = 0, [], {"archive": [], "offset": [], "length": [], "page_id": []}
                with fs.open_input_stream(f"{path}/{name}", compression=None) as source, fs.open_output_stream(f"{path}/{new}", compression=None) as out, fs.open_output_stream(f"{path}/{new}.idx", compression=None) as idx:
                    for head, block in stream_records(_inflated(source)):
                        z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = z.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()
                        page = _page(_headers(head).get("warc-record-id"))
                        out.write(member)
                        idx.write(f"{at}\t{len(member)}\t{'' if page is None else page}\n".encode())
                        for k, v in zip(held, (new, at, len(member), page), strict=True):
                            held[k].append(v)
                        at += len(member)
                        if len(held["offset"]) == 10_000:
                            rows.append(held)
                            held = {k: [] for k in held}
                for x in [*rows, held]:
                    yield pa.RecordBatch.from_arrays([pa.array(x["archive"], pa.string()), *(pa.array(x[k], pa.int64()) for k in ("offset", "length", "page_id"))], names=list(x))

    manifest.select("archive").mapInArrow(rewrite, INDEX).write.parquet(f"{folder}/_index.parquet")
    return spark.read.schema(INDEX).parquet(f"{folder}/_index.parquet")


def read_record(member: bytes) -> tuple:
    """The row of RECORD for one member. Payload figures of a response are taken from its payload, those of a revisit,
    which holds none, from its heads."""
    data = zlib.decompress(member, GZIP)
    head, _, rest = data.partition(b"\r\n\r\n")
    h = _headers(head)
    http, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
    if h["warc-type"] == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        size, digest = int(_headers(http)["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
    return _page(h["warc-record-id"]), size, digest, h["warc-type"], _page(h.get("warc-refers-to"))


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the index, read from its member of the archive."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        name, source = None, None
        for b in batches:
            rows = []
            for archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, fs.open_input_file(f"{path}/{archive}")
                source.seek(offset)
                rows.append(read_record(source.read(length)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if source is not None:
            source.close()

    return index.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes pages to archives, normalises them, and reads every record back."""
    spark: SparkSession = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    manifest = write_monolithic(with_record_types(pages, min_bytes), folder)
    return read_back(normalise(manifest, folder), folder)
