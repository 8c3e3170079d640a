"""WARC: a normaliser of monolithic gzip archives, with sidecar offset indexes.

``write_monolithic`` writes WARC records the way simple crawlers do: one gzip
stream over a whole file. ``normalise`` inflates each such stream once, in
chunks, rewrites every record as a gzip member of its own, and writes a
sidecar index with each member's offset and length, so that single records
can be read without the ones before them. A record whose payload is already
held by a record of a smaller page_id is rewritten as a revisit that refers
to it. ``read_records`` reads the rewritten archives back through their
indexes.

Payloads never pass a shuffle: only (file, ordinal, page_id, digest) rows
do. Files get their names from the task's partition or the file they come
from, are written under a temporary name and then moved, and hold the same
bytes when a task runs again; so a lost executor costs a rerun of its tasks
and nothing else. Archives live in the shared folder of the session.

Defined results: a null html is an empty payload; a null url is an empty
target; null page_ids come last in their group and are revisits of the
smallest page_id, or responses if the group has none; rows that repeat the
smallest page_id are responses; an empty table gives no files and no rows;
further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_folder, table

#: Fixed values of the format.
VERSION, BREAK = b"WARC/1.1", b"\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Level of the whole-file streams and of the members.
STREAM_LEVEL, MEMBER_LEVEL = 1, 6
CHUNK = 1 << 20
#: Read-back rows per Arrow batch.
ROWS = 512


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None = None) -> bytes:
    """One WARC record; size and digest are of the full payload, also where a revisit leaves it out."""
    target = "".join(c if 32 < ord(c) != 127 else f"%{ord(c):02X}" for c in url or "")
    head = [("WARC-Type", kind), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return BREAK.join([VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", payload, b"", b""])


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payloads of an inflated stream; holds one record and one chunk at a time."""
    buffer, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        del buffer[:at]
        at = 0
        chunk = next(chunks, None)
        buffer.extend(chunk or b"")
        return chunk is not None

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if bytes(buffer[at:]).strip():
                    raise ValueError("the stream ends inside a record's head")
                return
        lines = bytes(buffer[at:end]).split(BREAK)
        if lines[0] != VERSION:
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        head = dict(line.decode().split(": ", 1) for line in lines[1:])
        size, at = int(head["Content-Length"]), end + 4
        while len(buffer) - at < size + 4:
            if not more():
                raise ValueError("the stream ends inside a record's payload")
        payload = bytes(buffer[at : at + size])
        at += size + 4
        yield head, payload


def inflate(source) -> Iterator[bytes]:
    """A gzip file's bytes in chunks, of one member or several."""
    z = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            if z.eof:
                z = zlib.decompressobj(31)
            out = z.decompress(data, 4 * CHUNK)
            if out:
                yield out
            data = z.unconsumed_tail or z.unused_data
    while out := z.decompress(z.unconsumed_tail, 4 * CHUNK):
        yield out
    if not z.eof:
        raise EOFError("the gzip stream is cut off")


def gzip_member(data: bytes, level: int = MEMBER_LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Output:
    """A file in the shared folder that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.stream = self.files.open_output_stream(self.temporary)

    def __enter__(self):
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.files.move(self.temporary, self.path)


def opened(uri: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Writes each partition's pages (page_id, url, html) as one whole-file gzip stream.

    Returns, as a written table, a row per record: file, ordinal, page_id,
    payload_bytes, payload_digest.
    """
    schema = "file string, ordinal long, page_id long, payload_bytes long, payload_digest string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with Output(f"{folder}/stream/{name}.warc.gz") as out:
            z, ordinal = zlib.compressobj(STREAM_LEVEL, zlib.DEFLATED, 31), 0
            while first is not None:
                rows = []
                for page_id, url, html in zip(*(c.to_pylist() for c in first.columns)):
                    payload = (html or "").encode()
                    digest = digest_of(payload)
                    out.write(z.compress(record("response", page_id, url, payload, digest, len(payload))))
                    rows.append((name, ordinal, page_id, len(payload), digest))
                    ordinal += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["file", "ordinal", "page_id", "payload_bytes", "payload_digest"])
                first = next(batches, None)
            out.write(z.flush())

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialise(plain.mapInArrow(write, schema))


def revisits(written: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Per file, the ordinals to rewrite as revisits and the page_ids they refer to: file, decisions."""
    first = written.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    again = written.where(F.col("payload_bytes") >= min_bytes).join(first, "payload_digest").where("page_id is null and first is not null or page_id > first")
    listed = again.groupBy("file").agg(F.collect_list(F.struct("ordinal", "first")).alias("decisions"))
    return written.select("file").distinct().join(listed, "file", "left")


def rewrite(source, out, index, refers_to: Callable[[int], int | None]) -> int:
    """Inflates one stream and writes its records as members of their own, with an index line each; returns their number."""
    offset = n = 0
    for head, payload in records(inflate(source)):
        page_id, first = head.get("X-Page-ID"), refers_to(n)
        kind = "response" if first is None else "revisit"
        size = int(head["X-Payload-Length"]) if "X-Payload-Length" in head else len(payload)
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        member = gzip_member(record(kind, None if page_id is None else int(page_id), head["WARC-Target-URI"], payload if first is None else b"", digest, size, first))
        out.write(member)
        index.write(json.dumps({"offset": offset, "length": len(member), "page_id": None if page_id is None else int(page_id), "type": kind}).encode() + b"\n")
        offset, n = offset + len(member), n + 1
    return n


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """files: (file, decisions). Rewrites each archive and its index; returns file, n_records as a written table."""
    count = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, decisions in zip(*(c.to_pylist() for c in batch.columns)):
                first = {d["ordinal"]: d["first"] for d in decisions or ()}
                with opened(f"{folder}/stream/{name}.warc.gz") as source, Output(f"{folder}/members/{name}.warc.gz") as out, Output(f"{folder}/members/{name}.idx") as index:
                    n = rewrite(source, out, index, first.get)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])

    return materialise(files.select("file", "decisions").repartitionByRange(max(1, count), "file").mapInArrow(run, "file string, n_records long"))


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """The rewritten archives' records, each read at its offset of the index and checked against its digest."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (name,) in zip(batch.column(0).to_pylist()):
                rows: list[tuple] = []
                with opened(f"{folder}/members/{name}.idx") as index, opened(f"{folder}/members/{name}.warc.gz") as archive:
                    for line in io.BufferedReader(index, CHUNK):
                        entry = json.loads(line)
                        archive.seek(entry["offset"])
                        (head, payload), = records(inflate(io.BytesIO(archive.read(entry["length"]))))
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if kind == "response" and digest_of(payload) != digest:
                            raise ValueError(f"{name} at {entry['offset']}: the payload's digest differs")
                        page_id, first = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                        size = len(payload) if kind == "response" else int(head["X-Payload-Length"])
                        rows.append((page_id and int(page_id), size, digest, kind, first and int(first), head["WARC-Target-URI"]))
                        if len(rows) >= ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])

    return files.select("file").repartitionByRange(max(1, files.count()), "file").mapInArrow(run, schema)


def write_and_normalise(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Both archives of the pages; returns file, n_records."""
    return normalise(revisits(write_monolithic(pages, folder), min_bytes), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every page through both archives, read back."""
    folder = shared_folder(spark)
    files = write_and_normalise(table(spark, sf_dir, "pages"), folder)
    return read_records(files, folder).drop("url")


SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), d as (
  select page_id, octet_length(encode(html)) as payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::int >> (5 * (3 - i % 4))::int) & 31))::int, 1)), '') as payload_digest
  from p
)
select page_id, payload_bytes, payload_digest,
  case when page_id = min(page_id) over (partition by payload_digest) then 'response' else 'revisit' end as record_type,
  case when page_id > min(page_id) over (partition by payload_digest) then min(page_id) over (partition by payload_digest) end as refers_to
from d
"""
