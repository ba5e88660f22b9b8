"""Media columns: payloads stored as images in archive directories, and a data
source that reads them back.

``write`` stores each payload as an 8-bit greyscale PNG, 64 samples wide, in
archives (zip files whose members are stored as they are) below one directory.
Spark tasks write them through the data source's writer; the archives of tasks
that were repeated or lost are left out, as only committed ones are in the
manifest. ``read`` plans partitions as byte ranges of the archives. A task reads
the archive's member directory, reads the members that start in its range one
after the other, and streams them on in Arrow batches of bounded size. A member
that can't be read or fails its checksum is retried by its own offset, alone;
if that keeps failing, its row has a null payload and says why in ``error``. Of an
archive whose directory is damaged the members are found by their own headers.

Defined results: a null text is an empty payload; the empty payload is 64 zero
bytes; equal texts give equal values in every column; repeated rows are stored
and returned as often as they occur; a very long text is one image, and batches are
cut by their bytes; an empty table gives an empty table.
Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sievelake.llm.batches import slices

WIDTH = 64
READ_SCHEMA = "doc_id long, media binary, error string"
PNG_START = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """A greyscale image whose samples are the payload; the length without padding goes into a text chunk."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    note = b"length\0%d" % n_bytes
    return PNG_START + _chunk(b"IHDR", head) + _chunk(b"tEXt", note) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples and the length without padding; ValueError if the image is damaged."""
    if media[:8] != PNG_START:
        raise ValueError("not a PNG")
    at, rows, data, n_bytes = 8, 0, [], None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            _, rows = struct.unpack_from(">II", body)
        elif kind == b"tEXt":
            n_bytes = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, WIDTH + 1)
    return lines[:, 1:].tobytes(), n_bytes


def features(payload: bytes) -> str:
    """Mean, root mean square deviation and mean absolute step of the samples, and
    an 8 x 8 average hash of the image."""
    samples = np.frombuffer(payload, np.uint8)
    mean = float(samples.mean())
    deviation = float(samples.std())
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    rows = len(samples) // WIDTH
    image = samples.reshape(rows, 8, 8).mean(axis=2)
    bands = np.add.reduceat(image, np.linspace(0, rows, 8, endpoint=False).astype(int), axis=0) if rows >= 8 else np.resize(image, (8, 8))
    bits = np.packbits(bands > bands.mean(axis=0)).tobytes().hex()
    return f"{mean:.6f};{deviation:.6f};{step:.6f};{bits}"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Committed(WriterCommitMessage):
    archives: list


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (doc_id, n_bytes, media) into archives of about ``archive_bytes`` each."""

    def __init__(self, path: str, archive_bytes: int):
        self.path, self.archive_bytes = path, archive_bytes

    def write(self, iterator) -> Committed:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        done, archive, sink = [], None, None

        def close():
            if archive is not None:
                archive.close()
                done[-1]["bytes"] = sink.tell()
                sink.close()

        for batch in iterator:
            for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None or sink.tell() >= self.archive_bytes:
                    close()
                    name = f"part-{uuid.uuid4().hex}.zip"
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                    archive = zipfile.ZipFile(_Counted(sink), "w", zipfile.ZIP_STORED)
                    done.append({"name": name, "members": 0})
                info = zipfile.ZipInfo(f"{done[-1]['members']}_{'' if doc_id is None else doc_id}.png")
                archive.writestr(info, media)
                done[-1]["members"] += 1
        close()
        return Committed(done)

    def commit(self, messages) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages) -> None:
        """Archives without a manifest are not read."""


class _Counted(io.RawIOBase):
    """An append-only stream as zipfile wants it."""

    def __init__(self, sink):
        self.sink = sink

    def writable(self):
        return True

    def write(self, data):
        self.sink.write(data)
        return len(data)

    def tell(self):
        return self.sink.tell()

    def flush(self):
        pass


class Range(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, batch_bytes: int, attempts: int):
        self.path, self.range_bytes, self.batch_bytes, self.attempts = path, range_bytes, batch_bytes, attempts

    def partitions(self):
        store, root = _open(self.path)
        archives = []
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("manifest-"):
                with store.open_input_stream(info.path) as f:
                    archives += json.loads(f.read())
        ranges = [Range(a["name"], at, at + self.range_bytes) for a in archives for at in range(0, a["bytes"], self.range_bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range):
        schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
        if not partition.name:
            return
        store, root = _open(self.path)
        with store.open_input_file(f"{root}/{partition.name}") as source:
            members = [m for m in self.directory(source) if partition.start <= m.header_offset < partition.end]
            members.sort(key=lambda m: m.header_offset)
            rows, size = [], 0
            for m in members:
                rows.append((m, *self.member(source, m)))
                size += m.file_size
                if size >= self.batch_bytes:
                    yield self.batch(rows, schema)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows, schema)

    def directory(self, source) -> list[zipfile.ZipInfo]:
        """The archive's members; if its directory can't be read, those whose headers
        follow each other from the start, as far as they do."""
        for _ in range(self.attempts):
            try:
                with zipfile.ZipFile(source) as directory:
                    return directory.infolist()
            except (OSError, zipfile.BadZipFile):
                source.seek(0)
        members, at, end = [], 0, source.size()
        while at + 30 <= end:
            source.seek(at)
            head = source.read(30)
            if head[:4] != b"PK\x03\x04":
                break
            name, extra = struct.unpack_from("<HH", head, 26)
            m = zipfile.ZipInfo(source.read(name).decode())
            # archives are streams, so sizes stand behind the members: an image's own chunks say where it ends
            start, kind = at + 30 + name + extra, b""
            to = start + len(PNG_START)
            while kind != b"IEND" and to + 8 <= end:
                source.seek(to)
                size, kind = struct.unpack(">I4s", source.read(8))
                to += size + 12
            source.seek(to)
            tail = source.read(16)
            if len(tail) < 16 or tail[:4] != b"PK\x07\x08":
                break
            m.header_offset, m.file_size, m.CRC = at, to - start, struct.unpack_from("<I", tail, 4)[0]
            members.append(m)
            at = to + 16
        return members

    def member(self, source, m: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """The stored bytes of one member, read by its offset as often as need be."""
        why = ""
        for _ in range(self.attempts):
            try:
                source.seek(m.header_offset)
                head = source.read(30)
                name, extra = struct.unpack_from("<HH", head, 26)
                source.seek(m.header_offset + 30 + name + extra)
                data = source.read(m.file_size)
                if head[:4] == b"PK\x03\x04" and len(data) == m.file_size and zlib.crc32(data) == m.CRC:
                    return data, None
                why = "checksum"
            except (OSError, struct.error) as e:
                why = str(e)
        return None, f"{m.filename} at {m.header_offset}: {why}"

    @staticmethod
    def batch(rows, schema) -> pa.RecordBatch:
        ids = [int(i) if (i := m.filename[:-4].partition("_")[2]) else None for m, _, _ in rows]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([d for _, d, _ in rows], pa.binary()), pa.array([e for _, _, e in rows], pa.string())], schema=schema)


class MediaArchive(DataSource):
    """Format ``media_archive``: options path, archive_bytes, range_bytes, batch_bytes, attempts."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return READ_SCHEMA

    def _option(self, key: str, default: int) -> int:
        return int(self.options.get(key, default))

    def reader(self, schema):
        return ArchiveReader(self.options["path"], self._option("range_bytes", 16 << 20), self._option("batch_bytes", 8 << 20), self._option("attempts", 3))

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options["path"], self._option("archive_bytes", 64 << 20))


def store(docs: DataFrame, path: str) -> None:
    """Stores each text of ``docs`` (doc_id, text) as an image below ``path``."""

    def images(batches):
        for batch in slices(batches, 1, 8 << 20):
            media = []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                media.append(to_png(padded(data), len(data)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(images, "doc_id long, media binary").write.format("media_archive").mode("append").save(path)


def load(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The stored members: doc_id, media, error."""
    spark.dataSource.register(MediaArchive)
    reader = spark.read.format("media_archive")
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load(path)


def describe(media: DataFrame) -> DataFrame:
    """Decodes each member and computes its digests and features. A member that
    could not be read or decoded has nulls, with the reason in ``error``."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        sha = hashlib.sha256
        for batch in batches:
            out = []
            for doc_id, blob, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (doc_id, *[None] * 7, error)
                if blob is not None:
                    try:
                        payload, n_bytes = from_png(blob)
                        row = (doc_id, n_bytes, len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), sha(blob).hexdigest(), features(payload), None)
                    except (ValueError, zlib.error, struct.error) as e:
                        row = (doc_id, *[None] * 7, str(e))
                out.append(row)
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.string() if n.endswith(("256", "feature", "error")) else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return media.select("doc_id", "media", "error").mapInArrow(run, fields)
