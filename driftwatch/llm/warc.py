"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes``; a record is never
split, and a record that is longer has a frame to itself. After the frames each file has a seek table
(sizes of all frames) in a skippable frame at its end, as the Zstandard seekable format lays down, so
a reader finds any frame without reading the others. The index returned by ``write`` maps each record to file,
frame, and place and length within the decompressed frame.

Files are written by the tasks to a folder that all machines share, under a name of their attempt;
readers go by the index, so what a lost attempt left is never read. Tasks hold one frame or record.

Records with equal payloads of at least ``revisit_bytes`` bytes: that with the largest page id is a
response, others are revisits of it. Smaller ones are all responses.

Edge cases: a null payload is empty; a null url leaves out the target header; a null page id leaves
out the page header and loses to any id. Rows repeated with the largest id are responses each. An
empty table gives no file. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from driftwatch.session import pin

# Fixed values of the seekable format: magic numbers of skippable frames and of the seek table's end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SPACE = uuid.UUID("7f1d8d0e-6d0b-5a55-9a0f-0f6d4b1c2a3e")
LEVEL = 3

INDEX = StructType(
    [
        StructField("page_id", LongType()),
        StructField("record_id", StringType()),
        StructField("file", StringType()),
        StructField("frame", IntegerType()),
        StructField("offset", LongType()),
        StructField("length", LongType()),
    ]
)
RECORD = StructType(
    [
        StructField("page_id", LongType()),
        StructField("record_id", StringType()),
        StructField("url", StringType()),
        StructField("record_type", StringType()),
        StructField("payload_bytes", LongType()),
        StructField("payload_digest", StringType()),
        StructField("refers_to", LongType()),
        StructField("payload", StringType()),
        StructField("intact", StringType()),
    ]
)


def plan_records(pages: DataFrame, page_id: str, url: str, payload: str, revisit_bytes: int) -> DataFrame:
    """Type, digest and referred page of each record; revisits carry no payload."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body.cast("binary")).alias("payload_digest"),
        F.unhex(F.sha2(body, 256)).alias("key"),
    )
    groups = rows.filter(F.col("payload_bytes") >= revisit_bytes).groupBy("key")
    groups = groups.agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    other = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return rows.join(groups, "key", "left").select(
        "page_id",
        "url",
        F.when(~other, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(other, F.lit("revisit")).otherwise("response").alias("record_type"),
        F.when(other, F.col("keep")).alias("refers_to"),
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}"


def record_bytes(row: dict, date: str) -> tuple[str, bytes]:
    """Record id and bytes of a WARC record."""
    own = record_id(row["page_id"], row["payload_digest"])
    sha1 = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + (row["payload"] or "").encode("utf-8", "surrogatepass")
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        clean = "".join(f"%{ord(c):02X}" if c < " " else c for c in row["url"])
        head.append(f"WARC-Target-URI: {clean}")
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{record_id(row['refers_to'], row['payload_digest'])}>")
        if row["refers_to"] is not None:
            head.append(f"X-Refers-To-Page: {row['refers_to']}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return own, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of a decompressed frame, each with place and length in it."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")))
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        response = head["WARC-Type"] == "response"
        same = length == len(payload) and hashlib.sha1(payload).hexdigest() == digest
        yield {
            "page_id": int(head["X-Page-Id"]) if "X-Page-Id" in head else None,
            "record_id": head["WARC-Record-ID"].strip("<>"),
            "url": head.get("WARC-Target-URI"),
            "record_type": head["WARC-Type"],
            "payload_bytes": length,
            "payload_digest": digest,
            "refers_to": int(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None,
            "payload": payload.decode("utf-8", "surrogatepass") if response else None,
            "intact": "yes" if same or not response else "no",
            "offset": at,
        }
        at = end + 4 + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame with compressed and decompressed sizes of all frames."""
    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of each frame of an open file."""
    total = source.size()
    source.seek(total - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    source.seek(total - 9 - 8 * n)
    table, out, at = source.read(8 * n), [], 0
    for c, d in struct.iter_unpack("<II", table):
        out.append((at, c, d))
        at += c
    return out


def write(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    revisit_bytes: int = 1000,
    frame_bytes: int = 512 << 10,
    bundle_bytes: int = 1 << 30,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes ``pages`` as archives below ``folder`` and returns the index of records."""
    names = [f.name for f in INDEX.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        store.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        out, sizes, path, bundles = None, [], "", 0
        held: list[bytes] = []
        held_bytes = 0
        rows: list[tuple] = []

        def close() -> None:
            nonlocal out, sizes
            if out is not None:
                out.write(seek_table(sizes))
                out.close()
            out, sizes = None, []

        def flush() -> None:
            nonlocal out, path, bundles, held, held_bytes
            if not held:
                return
            if out is None:
                path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{bundles}.warc.zst"
                out, bundles = store.open_output_stream(path, compression=None), bundles + 1
            frame = packer.compress(b"".join(held))
            out.write(frame)
            sizes.append((len(frame), held_bytes))
            held, held_bytes = [], 0
            if sum(c for c, _ in sizes) >= bundle_bytes:
                close()

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                own, data = record_bytes(row, date)
                if held and held_bytes + len(data) > frame_bytes:
                    flush()
                file = path if out is not None else f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{bundles}.warc.zst"
                rows.append((row["page_id"], own, file, len(sizes), held_bytes, len(data)))
                held.append(data)
                held_bytes += len(data)
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_INDEX_ARROW)
                rows = []
        flush()
        close()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_INDEX_ARROW)

    return pin(plan_records(pages, page_id, url, payload, revisit_bytes).mapInArrow(run, INDEX))


_INDEX_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_id", pa.string()),
        ("file", pa.string()),
        ("frame", pa.int32()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)
_RECORD_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_id", pa.string()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.string()),
        ("intact", pa.string()),
    ]
)


def read(index: DataFrame, folder: str, columns: list[str] | None = None) -> DataFrame:
    """All records of the files that ``index`` names, frame by frame by their seek tables.

    ``columns``: the columns of ``RECORD`` wanted; payloads need not be returned to be checked.
    """
    wanted = columns or [f.name for f in RECORD.fields]
    schema = StructType([f for f in RECORD.fields if f.name in wanted])
    arrow = pa.schema([_RECORD_ARROW.field(f.name) for f in schema.fields])
    frames = StructType([StructField("file", StringType()), *(StructField(n, LongType()) for n in ("place", "packed", "plain"))])

    def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_file(file) as source:
                    rows = [(file, *t) for t in read_seek_table(source)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [f.name for f in frames.fields])

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["file"]) as source:
                    source.seek(row["place"])
                    data = unpacker.decompress(source.read(row["packed"]), max_output_size=row["plain"])
                found = [{n: r[n] for n in arrow.names} for r in parse_records(data)]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = index.select("file").distinct().mapInArrow(tables, frames)
    return listed.repartition(n, "file", "place").mapInArrow(records, schema)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """Payloads of the records in ``index`` (a selection of an index): only their frames are read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            found, last, data = [], None, b""
            for row in batch.to_pylist():
                if (row["file"], row["frame"]) != last:
                    last = (row["file"], row["frame"])
                    with store.open_input_file(row["file"]) as source:
                        place, packed, plain = read_seek_table(source)[row["frame"]]
                        source.seek(place)
                        data = unpacker.decompress(source.read(packed), max_output_size=plain)
                record = next(parse_records(data[row["offset"] : row["offset"] + row["length"]]))
                found.append({n: record[n] for n in _RECORD_ARROW.names})
            yield pa.RecordBatch.from_pylist(found, schema=_RECORD_ARROW)

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.repartition(n, "file", "frame").sortWithinPartitions("file", "frame", "offset")
    return rows.mapInArrow(run, RECORD)
