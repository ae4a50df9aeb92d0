"""WARC archives: a writer with one gzip member for each record, and a splittable reader.

A read task is given a range of bytes of one archive. It looks for gzip magic in the range, accepts a candidate when the
member's first bytes decode to a WARC header, and then goes from member to member; it owns the records that start inside
its range and reads on beyond the end to finish the last. Members written here also carry their own offset in the gzip
header, so an archive stored inside a payload is not taken for records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.session import materialize, scratch_path
from llm.common import shuffle_partitions

MAGIC = b"\x1f\x8b\x08"
LEAST_SHARED = 100  # payloads of fewer bytes are always stored
SPLIT = 8 << 20
LOOK = 64 << 10
# A table of shared payloads with no more rows than this (it is counted) is broadcast: about 100 bytes a row.
FEW = 50_000
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def member(data: bytes, offset: int) -> bytes:
    """A gzip member that holds its own offset in the extra field "PO"."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    head = MAGIC + b"\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHQ", 12, b"PO", 8, offset)
    return head + deflate.compress(data) + deflate.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, kind: str, refers_to: int | None) -> bytes:
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Bytes: {size}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, kind and refers_to of every page.

    Null html is an empty payload. Of equal payloads of at least 100 bytes the smallest page_id is the response (all its
    rows, if it is repeated) and the others revisit it; where no row of the payload has an id, all are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    shared = rows.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = materialize(shared.where("n > 1").select("digest", "first"), "shared-payloads")
    few = shared.count() <= FEW
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(F.broadcast(shared) if few else shared, "digest", "left").select(
        "page_id", "url", "payload", "digest", "size", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns the manifest (path, size, records), a stored table.

    Every attempt of a task writes a file of its own; only files of attempts that succeeded get into the manifest, so a
    lost executor leaves no half-written archive behind that a reader would see.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        path = f"{base}/part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}.warc.gz"
        at = count = 0
        with store.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, payload, digest, size, kind, refers_to = (c[i].as_py() for c in batch.columns)
                    data = member(record(page_id, url, payload.encode(), digest, size, kind, refers_to), at)
                    out.write(data)
                    at, count = at + len(data), count + 1
        if count:
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [at], "records": [count]})
        else:
            store.delete_file(path)

    return materialize(marked(pages).mapInArrow(run, "path string, size bigint, records bigint"), "warc-manifest")


class _Window:
    """Bytes of a file by absolute position."""

    def __init__(self, file, start: int, stop: int) -> None:
        self.file, self.at = file, start
        file.seek(start)
        self.data = file.read(stop - start)

    def get(self, start: int, size: int) -> bytes:
        inside = start - self.at
        if inside + size > len(self.data):
            self.file.seek(self.at + len(self.data))
            self.data += self.file.read(max(inside + size - len(self.data), LOOK))
        return self.data[inside : inside + size]


def _is_record(window: _Window, at: int) -> bool:
    """Whether a member starts here whose first bytes are a WARC header (and whose own offset, if given, is this one)."""
    raw = window.get(at, LOOK)
    if not raw.startswith(MAGIC):
        return False
    if len(raw) >= 24 and raw[3] & 4 and raw[12:14] == b"PO" and struct.unpack_from("<Q", raw, 16)[0] != at:
        return False
    try:
        return zlib.decompressobj(31).decompress(raw, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(window: _Window, at: int) -> tuple[bytes, int]:
    """The whole content of the member at a place, and where it ends."""
    decoder, parts, place = zlib.decompressobj(31), [], at
    while not decoder.eof:
        raw = window.get(place, LOOK)
        if not raw:
            raise ValueError(f"archive ends inside the record at {at}")
        parts.append(decoder.decompress(raw))
        place += len(raw)
    return b"".join(parts), place - len(decoder.unused_data)


def parse(content: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A row of ``SCHEMA`` from a record; a stored payload must have the digest that its header names."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda name: int(fields[name][10:-1]) if fields.get(name, "")[10:-1] else None
    size, digest = int(fields["X-Payload-Bytes"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return number("WARC-Record-ID"), size, digest, fields["WARC-Type"], number("WARC-Refers-To")


def records(window: _Window, start: int, stop: int) -> Iterator[bytes]:
    """Contents of the records that start in [start, stop)."""
    at = start
    while at < stop:
        if _is_record(window, at):
            content, at = _member(window, at)
            yield content
            continue
        found = window.data.find(MAGIC, at + 1 - window.at, stop + len(MAGIC) - 1 - window.at)
        if found < 0:
            return
        at = window.at + found


def read(manifest: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """One row for every record of the manifest's archives. An archive is read by as many tasks as it has splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(path) as file:
                    rows = [parse(c) for c in records(_Window(file, start, stop + len(MAGIC) - 1), start, stop)]
                columns = zip(*rows) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long")))
    ranges = manifest.select("path", "size", starts.alias("start")).select("path", "start", F.least(F.col("start") + split, F.col("size")).alias("stop"))
    return ranges.repartition(shuffle_partitions(manifest.sparkSession), "path", "start").mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, split: int = SPLIT) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder, split)
