"""WARC archives as seekable Zstandard bundles, written and read by tasks in the shared folder."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, ship_package, stored
from corpusmill.session import fits_broadcast, scratch_folder

#: Record bytes after which a frame is closed, and bundle bytes after which a file is.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
#: Record bytes a task reads back.
READ_BYTES = 1 << 23
#: Payloads from this size on are stored once.
REVISIT_BYTES = 100

# Fixed values of the seekable format: skippable frame, footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")

# Fixed values of the archive format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"
RECORD_NAME = "urn:corpusmill:page:"
INDEX = "page_id long, file string, frame int, frame_start long, offset long, bytes long"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit of ``refers_to`` without the payload, whose size is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_NAME}{page_id}>",
        f"WARC-Date: {RECORD_DATE}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_NAME}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of every record in uncompressed data."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        yield at, headers, data[end + 4 : end + 4 + size]
        at = end + 8 + size


class BundleWriter:
    """Writes records to one bundle: independent frames, then the seek table in a skippable frame."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES) -> None:
        self.stream, self.frame_bytes = stream, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.entries: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.written = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame number, the frame's place in the file, the record's place in the frame."""
        if self.held and self.held + len(data) > self.frame_bytes:
            self.end_frame()
        place = (len(self.entries), self.written, self.held)
        self.parts.append(data)
        self.held += len(data)
        return place

    def end_frame(self) -> None:
        if self.held:
            packed = self.compressor.compress(b"".join(self.parts))
            self.stream.write(packed)
            self.entries.append((len(packed), self.held))
            self.written += len(packed)
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(ENTRY.pack(*entry) for entry in self.entries) + FOOTER.pack(len(self.entries), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """Place, compressed and uncompressed size of every frame, from the file's end."""
    size = file.size()
    file.seek(size - FOOTER.size)
    count, flags, magic = FOOTER.unpack(file.read(FOOTER.size))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    file.seek(size - FOOTER.size - count * ENTRY.size)
    table, at = [], 0
    for packed, plain in ENTRY.iter_unpack(file.read(count * ENTRY.size)):
        table.append((at, packed, plain))
        at += packed
    return table


def read_frame(file, place: int, packed: int, plain: int) -> bytes:
    """One frame's records, without reading any other."""
    file.seek(place)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)


def read_record(path: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record that the index places there."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        data = read_frame(file, *seek_table(file)[frame])
    _, headers, block = next(parse_records(data[offset:]))
    return headers, block


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size and refers_to (null for a response).

    Of pages with equal payloads of at least REVISIT_BYTES bytes the smallest page_id is stored. Its repeated rows are responses
    too, and a group with null ids only has responses only; other rows with a null id are revisits. Columns other than
    page_id, url and html are not read, an empty table gives no rows. html is null for a revisit.

    Ids, digests and sizes alone decide. As long as the repeated digests are few enough to be sent to all tasks, payloads stay in the task
    that reads them; beyond that they are spread by page_id and digest, so that no task gets all rows of one payload.
    """
    content = F.coalesce("html", F.lit(""))
    given = pages.select("page_id", "url", content.alias("html"), F.sha2(content.cast("binary"), 256).alias("digest"))
    sizes = given.select("page_id", "digest", F.octet_length("html").alias("_bytes")).filter(F.col("_bytes") >= REVISIT_BYTES)
    groups = stored(sizes.groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_rows")).filter(
        "_rows > 1 AND _first IS NOT NULL").select("digest", "_first"), "warc-repeats")
    if fits_broadcast(groups):
        joined = given.join(F.broadcast(groups), "digest", "left")  # payloads stay where they are read
    else:
        decided = sizes.select("page_id", "digest").distinct().join(groups, "digest")
        joined = given.join(decided, (given["page_id"].eqNullSafe(decided["page_id"])) & (given["digest"] == decided["digest"]), "left").select(
            given["*"], "_first")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", F.when(~F.coalesce(revisit, F.lit(False)), F.col("html")).alias("html"), "digest",
                         F.octet_length("html").cast("long").alias("size"), F.when(revisit, F.col("_first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Writes bundles below ``folder``; gives the index: page_id, file, frame, frame_start, offset, bytes.

    Every task writes files of its own with the attempt in their name and reports its records' places. The index is written to the
    shared folder by Spark's committer, so it names the files of the attempts that counted, and only these are read. A task
    holds one frame.
    """
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        writer, name, files = None, "", 0
        rows: dict[str, list] = {}

        def batch_out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                ("page_id", pa.int64()), ("file", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()),
                ("offset", pa.int64()), ("bytes", pa.int64()),
            ]))

        for batch in batches:
            rows = {key: [] for key in ("page_id", "file", "frame", "frame_start", "offset", "bytes")}
            for at in range(batch.num_rows):
                page_id, url, html, digest, size, refers_to = (batch.column(c)[at].as_py() for c in range(6))
                data = record(page_id, url, (html or "").encode(), size, digest, refers_to)
                if writer is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{files:04d}.warc.zst"
                    writer, files = BundleWriter(store.open_output_stream(f"{base}/{name}", compression=None)), files + 1
                frame, start, offset = writer.add(data)
                for key, value in zip(rows, (page_id, name, frame, start, offset, len(data))):
                    rows[key].append(value)
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            yield batch_out()
        if writer is not None:
            writer.close()

    return stored(pages.select("page_id", "url", "html", "digest", "size", "refers_to").mapInArrow(run, INDEX), "warc-index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the indexed files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Frames are dealt to tasks in the order of files and frames, about READ_BYTES of records to each, and found by the seek tables,
    which a task reads once per file. A response's digest is computed from its payload and must be the one in its
    header; a revisit gives the size and digest its headers have and a null payload.
    """
    ship_package(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def number(name: str | None) -> int | None:
            return None if name is None or name == f"<{RECORD_NAME}None>" else int(name[len(RECORD_NAME) + 1 : -1])

        opened, file, table = None, None, []
        for batch in batches:
            for name, frame in zip(batch.column("file").to_pylist(), batch.column("frame").to_pylist()):
                if name != opened:
                    if file is not None:
                        file.close()
                    opened, file = name, store.open_input_file(f"{base}/{name}")
                    table = seek_table(file)
                data = read_frame(file, *table[frame])
                rows = []
                for _, headers, block in parse_records(data):
                    head, payload = block.split(b"\r\n\r\n", 1)
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
                    response = headers["WARC-Type"] == "response"
                    if response and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"damaged record in {name}")
                    rows.append((
                        number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"],
                        number(headers.get("WARC-Refers-To")), payload if response else None,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        if file is not None:
            file.close()

    frames = stored(index.groupBy("file", "frame").agg(F.sum("bytes").alias("bytes")), "warc-frames")
    tasks = -(-(frames.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES)
    dealt = frames.repartitionByRange(max(tasks, 1), "file", "frame").sortWithinPartitions("file", "frame")
    return dealt.select("file", "frame").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def op7_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Writes all pages to bundles, reads the bundles back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    target = scratch_folder(spark, "warc")
    index = write_bundles(with_revisits(read(spark, folder, "pages")), target)
    return read_bundles(index, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
grouped AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM grouped"""
