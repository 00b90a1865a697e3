"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some records, and ends with a skippable
frame: the seek table with the compressed and the plain size of every frame.  A record is found by its
bundle, frame and offset in the plain frame; readers fetch the footer and single frames, never a whole file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import numbered, table
from siftline.session import shared_folder, stored

#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

#: Fixed values of WARC 1.1.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Plain bytes after which a frame is closed, and stored bytes after which a bundle is.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
#: Frames that a task reads, about 128 MB of records.
FRAMES_A_TASK = 128
#: Date of records, for pages have none.
DATE = "1970-01-01T00:00:00Z"

INDEX = "bundle string, frame int, offset bigint, length bigint, record_id string"
RECORD = (
    "bundle string, frame int, offset bigint, record_id string, record_type string, refers_to_id string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(
    record_id: str, kind: str, payload: bytes, url: str | None = None, refers_to: str | None = None, date: str = DATE,
) -> bytes:
    """One record; a revisit has the digest and the size of the payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [
        VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        fields.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if kind == "revisit":
        fields += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record that begins at ``at``."""
    head = data.index(b"\r\n\r\n", at)
    lines = data[at:head].decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"no WARC record at offset {at}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    end = head + 4 + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at offset {at} has no end")
    return fields, data[head + 4 : end], end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle; frames are (compressed size, plain size)."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of every frame of an open bundle."""
    size = file.seek(0, 2)
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the file has no seek table")
    file.seek(size - 9 - 8 * count)
    sizes = list(struct.iter_unpack("<II", file.read(8 * count)))
    out, start = [], 0
    for compressed, plain in sizes:
        out.append((start, compressed, plain))
        start += compressed
    return out


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as executors need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes (record_id, kind, payload, url, refers_to) below ``folder``; the index, one row per record.

    Every attempt of a task writes files of its own name, and the index names only those of attempts that
    ended well, so a lost executor or a second attempt leaves unused files but no wrong entry.  A task holds
    one frame; a record longer than ``frame_bytes`` is a frame of its own.  The files are written by Arrow's
    file systems, so ``folder`` can be in any store that those know and all executors reach.
    """
    spark = records.sparkSession
    uri = _qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)
        task = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=3)
        out, name, frames, plain, entries, size = None, "", [], bytearray(), [], 0

        def close_frame() -> None:
            nonlocal out, name, frames, size
            if not plain:
                return
            if out is None:
                name = f"bundle-{task:05d}-{uuid.uuid4().hex}.warc.zst"
                out, frames, size = store.open_output_stream(f"{path}/{name}", compression=None), [], 0
            data = pack.compress(bytes(plain))
            out.write(data)
            frames.append((len(data), len(plain)))
            size += len(data)
            plain.clear()

        def close_bundle() -> None:
            nonlocal out
            if out is not None:
                out.write(seek_table(frames))
                out.close()
                out = None

        def indexed() -> pa.RecordBatch:
            columns = list(zip(*entries, strict=True)) or [()] * 4
            done = pa.RecordBatch.from_arrays(
                [pa.array([name] * len(entries), pa.string()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
                ["bundle", "frame", "offset", "length", "record_id"],
            )
            entries.clear()
            return done

        for batch in batches:
            for at in range(batch.num_rows):
                row = {column: batch.column(column)[at].as_py() for column in ("record_id", "kind", "payload", "url", "refers_to")}
                data = record_bytes(row["record_id"], row["kind"], row["payload"] or b"", row["url"], row["refers_to"])
                if plain and len(plain) + len(data) > frame_bytes:
                    close_frame()
                    if size >= bundle_bytes:
                        close_bundle()
                        yield indexed()
                entries.append((len(frames) if out is not None else 0, len(plain), len(data), row["record_id"]))
                plain += data
        close_frame()
        close_bundle()
        if entries:
            yield indexed()

    return stored(records.select("record_id", "kind", "payload", "url", "refers_to").mapInArrow(write, INDEX))


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` names, read frame by frame through the seek tables.

    ``index`` may be any choice of rows of the index; only their frames are read.  Digest and size of a
    response are taken from its payload as read, those of a revisit from its header.  The number of tasks
    comes from the number of frames, for the index itself is small.
    """
    spark = index.sparkSession
    uri = _qualified(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(uri)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for wanted in batch.to_pylist():
                rows = []
                with store.open_input_file(f"{path}/{wanted['bundle']}") as file:
                    start, size, plain = read_seek_table(file)[wanted["frame"]]
                    file.seek(start)
                    data = unpack.decompress(file.read(size), max_output_size=plain)
                for offset in sorted(wanted["offsets"]):
                    fields, block, _ = parse_record(data, offset)
                    head, _, body = block.partition(b"\r\n\r\n")
                    seen = fields["WARC-Type"] == "response"
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    digest = digest_of(body) if seen else said
                    if digest != said:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
                    length = len(body) if seen else int(head.rpartition(b"Content-Length: ")[2])
                    rows.append((
                        wanted["bundle"], wanted["frame"], offset, fields["WARC-Record-ID"][1:-1], fields["WARC-Type"],
                        fields["WARC-Refers-To"][1:-1] if "WARC-Refers-To" in fields else None, digest, length,
                        body if seen and payloads else None,
                    ))
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
                names = [part.split()[0] for part in RECORD.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    many = index.select("bundle", "frame").distinct().count()
    tasks = max(1, -(-many // FRAMES_A_TASK), min(many, spark.sparkContext.defaultParallelism))
    frames = index.repartition(tasks, "bundle", "frame").groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"))
    return frames.mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes every page as a record below ``folder``; the index of the records.

    Of pages with equal payloads the one with the largest id (of equal ids the last row) is a response, the
    others revisit it.  Only one row per payload and task is shuffled to find it, and the join that tells
    the pages is one that Spark splits where a payload is frequent.  A null html is an empty payload, a null
    id counts as the smallest.  Record ids are ``urn:page:<page id>:<row>``, the id empty where it is null.
    """
    rows = numbered(pages, page_id=page_id, url=url, html=html).withColumn(
        "payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8"),
    ).withColumn("digest", F.sha2("payload", 256)).withColumn("place", F.struct("page_id", "uid"))
    named = F.concat(F.lit("urn:page:"), F.coalesce(F.col("place.page_id").cast("string"), F.lit("")), F.lit(":"), F.col("place.uid"))
    last = rows.groupBy("digest").agg(F.max("place").alias("place")).select(
        F.col("digest").alias("same"), F.col("place.uid").alias("first_uid"), named.alias("first_id"),
    )
    whole = rows.join(last, F.col("digest") == F.col("same"))
    seen = F.col("uid") == F.col("first_uid")
    return write_bundles(whole.select(
        named.alias("record_id"), F.when(seen, "response").otherwise("revisit").alias("kind"), "payload", "url",
        F.when(~seen, F.col("first_id")).alias("refers_to"),
    ), folder)


def page_of(record_id: str, kind: str = "bigint"):
    """The page id in a record id column."""
    return F.expr(f"try_cast(nullif(split_part({record_id}, ':', 3), '') AS {kind})")


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as records, and what the archives read back say of them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    records = read_bundles(archive_pages(pages, folder), folder)
    return records.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to_id").alias("refers_to"),
    )
