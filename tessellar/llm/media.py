"""Media columns: content-addressed payloads in tar shards, read back by byte ranges.

A payload is stored as a greyscale PNG of 8-bit samples, ``WIDTH`` to a row (lossless), and named by the SHA-256 of its
samples. Payloads never pass through a shuffle: each task writes its rows' payloads to tar shards of its own, a digest
once, and returns (doc_id, digest, shard, offset, length), which is written as a table. The index keeps one place a
digest; where several tasks met the same payload the other places are spare, and no row points to them. Size columns
come from a range read of the PNG header alone, features from a range read of the payload.

A shard's name holds a number drawn for the task attempt, so a task that is run again writes another file and the table
names the one that counts; what a lost attempt left is never referenced.

Results in the odd cases: a null or empty text is one row of blanks; rows that repeat share one payload; a null doc_id
is carried; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, cut, scratch, small_batches, texts

WIDTH = 192
LEVEL = 4
#: Signature, chunk length and type, and the header's 13 bytes with their checksum.
HEADER = 33
ROWS = "doc_id bigint, n_bytes bigint, digest string, shard string, offset bigint, length bigint"
#: Digests that a task remembers before it forgets them; a copy met later is stored again.
SEEN = 500_000
#: A shard is closed beyond this many bytes.
SHARD_BYTES = 1 << 30


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes) -> bytes:
    """PNG: greyscale, 8 bits, WIDTH samples a row, every row unfiltered."""
    import numpy as np

    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER bytes."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits


def decode(data: bytes) -> bytes:
    import numpy as np

    width, height, _ = header(data)
    at, body = 8, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += n + 12
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return raw[:, 1:].tobytes()


def open_store(url: str):
    """(file system, path) of a folder or file that all machines share, by its URL."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url.removeprefix("file:"))


class Shards:
    """Tar files in a folder, one open at a time."""

    def __init__(self, folder: str):
        self.folder, self.out, self.name, self.at = folder, None, "", 0

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        """(shard, offset, length) of the data."""
        if self.out is None:
            self.name, self.at = f"{self.folder}/{uuid.uuid4().hex}.tar", 0
            disk, path = open_store(self.name)
            disk.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.out = disk.open_output_stream(path)
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        place = (self.name, self.at + len(head), len(data))
        self.at += len(head) + len(data) + -len(data) % 512
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads of docs to tar shards in `folder`; (doc_id, n_bytes, digest, shard, offset, length) of every
    row, as a written table."""
    small_batches(docs.sparkSession)

    def store(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shards, seen = Shards(folder), {}
        for b in batches:
            out = []
            for x in texts(b):
                samples = payload(x)
                digest = hashlib.sha256(samples).hexdigest()
                if digest not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[digest] = shards.add(digest, encode(samples))
                out.append((len(x), digest, *seen[digest]))
            if out:
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=[c.split()[0] for c in ROWS.split(", ")])
        shards.close()

    return cut(columns(docs, "doc_id", "text").mapInArrow(store, ROWS), "media-rows")


def index_of(rows: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): one place a digest, in the order of the shards."""
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    return rows.groupBy("digest").agg(place).select("digest", "place.*").sortWithinPartitions("shard", "offset")


def _ranges(b, length: int | None) -> Iterator[bytes]:
    """The bytes (the first `length`, or all) of each of an index batch's entries, a shard opened once a run."""
    opened, name = None, None
    try:
        for shard, offset, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
            if shard != name:
                if opened:
                    opened.close()
                disk, path = open_store(shard)
                opened, name = disk.open_input_file(path), shard
            yield bytes(opened.read_at(n if length is None else min(n, length), offset))
    finally:
        if opened:
            opened.close()


def with_headers(index: DataFrame) -> DataFrame:
    """index with width, height and bits, from header ranges alone."""
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    fields = index.schema.fields

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                w, h, bits = zip(*(header(x) for x in _ranges(b, HEADER)), strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.int64()), pa.array(h, pa.int64()), pa.array(bits, pa.int32())], names=[f.name for f in fields] + ["width", "height", "bits"])

    return index.mapInArrow(run, StructType([*fields, StructField("width", LongType()), StructField("height", LongType()), StructField("bits", IntegerType())]))


def with_features(index: DataFrame) -> DataFrame:
    """Of each payload, read back: (digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    The feature lists the mean of the samples in eight equal stretches and the number of distinct samples.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for digest, data in zip(b.column("digest").to_pylist(), _ranges(b, None), strict=True):
                x = decode(data)
                a = np.frombuffer(x, np.uint8)
                means = a.reshape(8, -1).sum(axis=1, dtype=np.int64) * 8000 // len(a)
                feature = ",".join(map(str, [*means, int(np.count_nonzero(np.bincount(a, minlength=256)))]))
                rows.append((digest, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return index.mapInArrow(run, "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with doc_id, n_bytes, digest and their place; the index with width, height and bits)."""
    rows = write_shards(docs, folder or scratch(docs.sparkSession, "media"))
    index = cut(with_headers(index_of(rows)), "media-index")
    return rows, index


def op8_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, index = media_columns(docs)
    full = with_features(index).join(index.select("digest", "width", "height", "offset", "length"), "digest")
    out = rows.select("doc_id", "n_bytes", "digest").join(full, "digest")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "digest")
