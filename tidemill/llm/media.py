"""Payloads as media files in archives, read back through a data source of byte ranges.

``store`` writes each payload as a grey 8-bit PNG of width 64 (zlib-packed, lossless) into ZIP
archives, members uncompressed, through a data source writer: each task writes archives of its own
under names no other attempt uses, and the driver commits the list of finished ones in a file of its
own, so a lost or repeated task leaves nothing that a reader sees and a further ``store`` adds to what is
there (mode overwrite replaces it).

``MediaSource`` reads such a folder. The driver only lists the committed archives and plans byte
ranges over them; a task reads the archive's directory (its last bytes), takes the members whose
offsets fall into its range, and reads each member by offset on its own: a failed or damaged read is
tried again from that offset, ``retries`` times, without touching the others; a member that stays
unreadable gives a row with its error and no payload, so that one bad member costs neither the
partition nor the job. A directory is tried as often; one that stays unreadable gives a row without id for
each range of its archive. Batches of ``batch_bytes`` leave through Arrow.

Files are reached through pyarrow file systems by URI, so the folder may be any that executors and
driver share. Ids of any type that casts to text and back are kept as text. Defined results: a null text
is an empty payload, which is padded to one row of 64 zero bytes; a null id stays null; an empty table
writes no archive and reads back no rows; equal rows are members of their own.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidemill.llm import kernel

WIDTH = 64
ARCHIVE_BYTES, SPLIT_BYTES, BATCH_BYTES, RETRIES = 64 << 20, 8 << 20, 8 << 20, 3
#: Each commit leaves one such file; a reader takes all of them.
MANIFEST = "_committed-"
SCHEMA = "id string, n_bytes long, media binary, error string"

PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(payload: bytes) -> bytes:
    short = -len(payload) % WIDTH if payload else WIDTH
    return payload + bytes(short)


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """A grey 8-bit image of width 64; the payload's length is a positive multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a file that encode_png made; ValueError if it is damaged."""
    if not media.startswith(PNG):
        raise ValueError("not a PNG file")
    at, data, size = len(PNG), [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])
    return pafs.LocalFileSystem(), uri


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


class MediaWriter(DataSourceArrowWriter):
    """Rows (id string, n_bytes long, media binary) into ZIP archives."""

    def __init__(self, options: dict[str, str], overwrite: bool = False) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.limit = int(options.get("archive_bytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        name, sink, z, size, n = "", None, None, 0, 0

        def finish() -> None:
            z.close()
            total = sink.tell()
            sink.close()
            done.append((name, total))

        for b in iterator:
            for key, n_bytes, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if z is None:
                    name, size, n = f"{uuid.uuid4().hex}.zip", 0, 0
                    sink = fs.open_output_stream(f"{root}/{name}")
                    z = zipfile.ZipFile(_Stream(sink), "w", zipfile.ZIP_STORED, allowZip64=True)
                info = zipfile.ZipInfo(f"{n:09d}.png", (1980, 1, 1, 0, 0, 0))
                info.comment = json.dumps({"id": key, "n": n_bytes}).encode()
                z.writestr(info, media)
                size, n = size + len(media), n + 1
                if size >= self.limit:
                    finish()
                    z = None
        if z is not None:
            finish()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        old = manifests(fs, root) if self.overwrite else []
        found = sorted(x for m in messages if m is not None for x in m.archives)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{root}/_part-{name}") as f:
            f.write(json.dumps(found).encode())
        fs.move(f"{root}/_part-{name}", f"{root}/{MANIFEST}{name}.json")
        for path in old:
            gone = _listed(fs, path)
            fs.delete_file(path)
            for archive, _ in gone:
                fs.delete_file(f"{root}/{archive}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for name, _ in m.archives if m is not None else ():
                fs.delete_file(f"{root}/{name}")


def manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    """The paths of all commits."""
    return sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file and x.base_name.startswith(MANIFEST))


def _listed(fs: pafs.FileSystem, path: str) -> list[tuple[str, int]]:
    with fs.open_input_stream(path) as f:
        return [tuple(x) for x in json.loads(f.read())]


class _Stream(io.RawIOBase):
    """What zipfile needs of a sink that can't seek."""

    def __init__(self, sink: pa.NativeFile) -> None:
        self.sink = sink

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:  # noqa: ANN001
        self.sink.write(bytes(data))
        return len(data)


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.batch = int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[Range]:
        fs, root = open_fs(self.path)
        archives = [x for path in manifests(fs, root) for x in _listed(fs, path)]
        ranges = [Range(name, at, min(size, at + self.split)) for name, size in archives for at in range(0, size, self.split)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = open_fs(self.path)
        path = f"{root}/{partition.archive}"
        try:
            members = [x for x in self.directory(fs, path) if partition.start <= x.header_offset < partition.end]
        except (OSError, ValueError, zipfile.BadZipFile) as e:
            yield self._rows([(None, None, None, f"{partition.archive} from {partition.start}: {type(e).__name__}: {e}")])
            return
        rows: list[tuple] = []
        held = 0
        for x in members:
            about = json.loads(x.comment)
            media, error = self.member(fs, path, x)
            rows.append((about["id"], about["n"], media, error))
            held += len(media or b"")
            if held >= self.batch:
                yield self._rows(rows)
                rows, held = [], 0
        if rows:
            yield self._rows(rows)

    def directory(self, fs: pafs.FileSystem, path: str) -> list[zipfile.ZipInfo]:
        """The members of an archive, read anew after each failure."""
        for attempt in range(self.retries):
            try:
                with fs.open_input_file(path) as f:
                    return zipfile.ZipFile(f).infolist()
            except (OSError, ValueError, zipfile.BadZipFile):
                if attempt == self.retries - 1:
                    raise
                time.sleep(0.05 * 2**attempt)
        return []

    def member(self, fs: pafs.FileSystem, path: str, x: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """The bytes at one member's offset, read anew after each failure."""
        error = ""
        for attempt in range(self.retries):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(x.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError("no member at this offset")
                    name, extra = struct.unpack("<HH", head[26:30])
                    f.seek(x.header_offset + 30 + name + extra)
                    media = f.read(x.compress_size)
                if len(media) != x.compress_size or zlib.crc32(media) != x.CRC:
                    raise ValueError("member is damaged")
                return media, None
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * 2**attempt)
        return None, f"{x.filename} at {x.header_offset}: {error}"

    @staticmethod
    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n_bytes", "media", "error"])


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:  # noqa: ANN001
        return MediaReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> MediaWriter:  # noqa: ANN001
        return MediaWriter(dict(self.options), overwrite)


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "append") -> None:
    """Writes every text of docs as a member of archives at path, beside (append) or instead of (overwrite) what is there."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = kernel.buffers(b.column("t"))
            for i, j in kernel.spans(off, 4 << 20):
                texts = [raw[off[r] : off[r + 1]].tobytes() for r in range(i, j)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_png(padded(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"]
                )

    docs.sparkSession.dataSource.register(MediaSource)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).mapInArrow(pack, "id string, n_bytes long, media binary")
    rows.write.format("tidemill_media").mode(mode).save(path)


def read_media(spark, path: str, id_type: str = "long", **options) -> DataFrame:  # noqa: ANN001
    """``(id, n_bytes, media, error)`` of all members under path."""
    spark.dataSource.register(MediaSource)
    found = spark.read.format("tidemill_media").options(**options).load(path)
    return found.withColumn("id", F.col("id").cast(id_type))


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples, entropy in bits, and the shares of four bands."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    bands = ",".join(f"{v:.4f}" for v in n.reshape(4, 64).sum(axis=1) / len(x))
    return f"mean={x.mean():.3f};std={x.std():.3f};entropy={abs(-(p * np.log2(p)).sum()):.4f};bands={bands}"


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored media, from the bytes that were read back.

    A member that can't be read or decoded keeps its row, with its error and null digests.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for stored, error in zip(b.column("media").to_pylist(), b.column("error").to_pylist(), strict=True):
                try:
                    if stored is None:
                        raise ValueError(error)
                    payload = decode_png(stored)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload), None))
                except (ValueError, zlib.error, struct.error) as e:
                    rows.append((None, None, None, None, None, None, str(e)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=NAMES)

    kinds = f"id {media.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("id", "n_bytes", "media", "error").mapInArrow(scan, kinds)


NAMES = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
