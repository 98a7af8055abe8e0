"""Seekable Zstandard bundles of WARC records.

Records are grouped into frames that are compressed independently. A bundle ends with a seek table in a
skippable frame (the layout of Zstandard's seekable format: compressed and decompressed size of each frame,
then the number of frames, a descriptor byte and a magic number), so that any Zstandard tool can read it as
a whole and a reader can fetch one frame. An index maps each record to (bundle, frame, offset in the frame,
length).

Tasks write whole bundles of bounded size under names of their own and return index rows. The index is a table
that Spark commits: it names only bundles of attempts that succeeded, and records are read by it alone, so what a
lost or repeated attempt leaves behind is never seen. Records with equal
payloads of LEAST_REVISIT bytes or more are stored once: the one with the smallest page id is the response,
the others are revisits with its identifier.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans import scratch

LEAST_REVISIT = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 25
LEVEL = 3
# Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame int, offset int, length int"


def _store(uri: str):
    """(file system, path) for Python: local paths, or what pyarrow can open."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, no: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{no}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, no: str) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, no)}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class Bundle:
    """Frames of one bundle in memory, up to BUNDLE_BYTES."""

    def __init__(self):
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open, self.entries, self.bytes = bytearray(), [], 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > FRAME_BYTES:
            self.close_frame()
        self.entries.append((page_id, len(self.frames), len(self.open), len(data)))
        self.open += data

    def close_frame(self) -> None:
        import zstandard

        packed = zstandard.ZstdCompressor(level=LEVEL).compress(bytes(self.open))
        self.frames.append(packed)
        self.sizes.append((len(packed), len(self.open)))
        self.bytes += len(packed)
        self.open = bytearray()

    def data(self) -> bytes:
        if self.open:
            self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def frame_table(tail: bytes) -> list[tuple[int, int]]:
    """(compressed, decompressed) sizes from the end of a bundle; ``tail`` holds the whole table."""
    count, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    at = len(tail) - 9 - 8 * count
    return [struct.unpack_from("<II", tail, at + 8 * i) for i in range(count)]


class Reader:
    """Reads frames of one bundle by its seek table."""

    def __init__(self, uri: str):
        self.uri = uri
        store, path = _store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        count = struct.unpack("<I", self.file.read(4))[0]
        self.file.seek(size - 9 - 8 * count)
        self.table = frame_table(self.file.read(8 * count + 9))
        self.starts = [0, *accumulate(c for c, _ in self.table)]

    def frame(self, no: int) -> bytes:
        import zstandard

        packed, size = self.table[no]
        self.file.seek(self.starts[no])
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)


def read_record(uri: str, frame: int, offset: int, length: int) -> bytes:
    """One record of a bundle: reads the seek table and one frame only."""
    return Reader(uri).frame(frame)[offset : offset + length]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, path = _store(folder)
        made, bundle = 0, Bundle()

        def flush() -> pa.RecordBatch:
            nonlocal made, bundle
            name = f"part-{task.partitionId():06d}-{made:05d}-{uuid.uuid4().hex}.warc.zst"
            data = bundle.data()
            with store.open_output_stream(f"{path}/{name}", compression=None) as f:  # by its name pyarrow would compress again
                f.write(data)
            rows = bundle.entries
            made, bundle = made + 1, Bundle()
            ids, frames, offsets, lengths = (list(x) for x in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([f"{folder}/{name}"] * len(ids)), *(pa.array(x, pa.int32()) for x in (frames, offsets, lengths))],
                names=["page_id", "bundle", "frame", "offset", "length"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, first, revisit = (c[i].as_py() for c in batch.columns)
                payload = (html or "").encode()
                no = f"{task.partitionId()}:{made}:{len(bundle.entries)}" if page_id is None else ""
                bundle.add(page_id, record(page_id, url, payload, digest, first, bool(revisit), no))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield flush()
        if bundle.entries:
            yield flush()

    return run


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write bundles below ``folder`` (seen by driver and executors) and return their index.

    Index rows: page_id, bundle, frame, offset, length. Null payloads are empty. Rows with a null id are
    written as responses; of repeated ids with equal payloads one row is the response and the rest revisit
    it. An empty input writes nothing.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    # Copies, without payloads: the smallest id of each digest, by blocks of ids and then over all.
    keys = rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= LEAST_REVISIT)).select(
        "page_id", F.unhex("digest").alias("d"), F.shiftright("page_id", 8).alias("block")
    )
    keys = scratch.write(keys, "digests")
    blocks = keys.groupBy("d", "block").agg(F.min("page_id").alias("low"), F.count("*").alias("n"))
    firsts = blocks.groupBy("d").agg(F.min("low").alias("first"), F.sum("n").alias("n")).where("n > 1")
    copies = keys.join(blocks.join(firsts.select("d", "first"), "d").select("d", "block", "first"), ["d", "block"])
    # Rows of one id and payload beyond the first are told apart by their number.
    several = scratch.write(
        copies.groupBy("page_id", "d", "first").agg(F.count("*").alias("times")).where("page_id != first or times > 1"), "copies"
    )
    joined = rows.join(
        several.select("page_id", F.lower(F.hex("d")).alias("digest"), "first", "times"), ["page_id", "digest"], "left"
    )
    again = joined.where("times > 1")
    single = joined.where("times is null or times = 1").withColumn("revisit", F.col("first").isNotNull() & (F.col("first") != F.col("page_id")))
    if not several.where("times > 1").isEmpty():
        from pyspark.sql.window import Window

        no = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
        again = again.withColumn("revisit", (F.col("first") != F.col("page_id")) | (no > 1))
        single = single.unionByName(again)
    chosen = single.select("page_id", "url", "html", "digest", "first", "revisit")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return scratch.write(chosen.mapInArrow(_write(folder), INDEX), "index")


def _rows(data: bytes) -> tuple:
    headers, payload = parse(data)
    full = headers["WARC-Type"] == "response"
    ref, page = headers.get("X-Refers-To-Page"), headers.get("X-Page-ID")
    return (
        None if page is None else int(page),
        headers.get("WARC-Target-URI", ""),
        headers["WARC-Type"],
        len(payload) if full else int(headers["X-Payload-Length"]),
        hashlib.sha256(payload).hexdigest() if full else headers["WARC-Payload-Digest"].removeprefix("sha256:"),
        None if ref is None else int(ref),
        payload if full else None,
    )


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_bundles(index: DataFrame) -> DataFrame:
    """The records of an index: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Records are found by bundle, frame and offset; a frame is read once for all its records. A response's length
    and digest are those of the payload that was read; a revisit's are its headers'. An empty index gives an empty
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        reader = None
        for batch in batches:
            for uri, no, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if reader is None or reader.uri != uri:
                    reader = Reader(uri)
                raw = reader.frame(no)
                out = [_rows(raw[p["offset"] : p["offset"] + p["length"]]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    scratch.bound_arrow(index.sparkSession)
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "length")).alias("places"))  # a frame is bounded
    return frames.sortWithinPartitions("bundle", "frame").mapInArrow(run, RECORD)
