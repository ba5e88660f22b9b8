"""A data source for FASTQ files in any layout.

A record is a header line with '@', lines of sequence up to one with '+', and lines of
quality of the same length in all. Empty lines count for nothing, lines end with or
without a carriage return, and records without a sequence are left out. So where a record begins can't be told from single lines:
quality lines begin with '@' and '+' as well. A range of bytes takes the records that
begin in it. It looks for the first '@' line from which two records (or the rest of
the file) can be read strictly, and reads on from there, past its end if need be. Gzip
files are one range.

A broken record (no quality, or one of another length; text between records) is an
error, or with ``keep_bad`` a row with what it is in the column ``bad``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = "source string, name string, seq string, qual string, bad string"
LETTERS = re.compile(rb"[A-Za-z*.\-]*")
CHUNK = 1 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def lines_from(source, at: int) -> Iterator[tuple[int, bytes]]:
    """Where each line begins, and the line without its end."""
    parts: list[bytes] = []
    while chunk := source.read(CHUNK):
        if b"\n" not in chunk:
            parts.append(chunk)
            continue
        whole = b"".join([*parts, chunk]).split(b"\n")
        parts = [whole.pop()]
        for line in whole:
            yield at, line.rstrip(b"\r")
            at += len(line) + 1
    if rest := b"".join(parts):
        yield at, rest.rstrip(b"\r")


def records(lines: Iterator[tuple[int, bytes]], strict: bool = False) -> Iterator[tuple]:
    """(start, header, sequence, quality, None), or (start, None, None, None, what is broken)."""
    start, head, seq, qual, need, got = 0, None, [], None, 0, 0
    skipping = False
    for at, line in lines:
        if head is None:
            if line.startswith(b"@"):
                start, head, seq, qual, skipping = at, line, [], None, False
            elif line and not skipping:
                skipping = True  # up to the next header it is one broken piece
                yield at, None, None, None, b"no header: " + line[:200]
        elif qual is None:
            if line.startswith(b"+"):
                qual, need, got = [], sum(map(len, seq)), 0
                if strict and (not need or line[1:] and not head[1:].startswith(line[1:])):
                    yield start, None, None, None, b"rather a line of quality: " + head[:200]
                    head = None
                elif not need:  # nothing to tell of
                    head = None
            elif line.startswith(b"@") or (strict and not LETTERS.fullmatch(line)):
                yield start, None, None, None, b"no quality: " + head[:200]
                start, head, seq = (at, line, []) if line.startswith(b"@") else (at, None, [])
            else:
                seq.append(line)
        else:
            qual.append(line)
            got += len(line)
            if got >= need:
                yield (start, head, b"".join(seq), b"".join(qual), None) if got == need else (start, None, None, None, b"quality of another length: " + head[:200])
                skipping, head = got > need, None
    if head is not None:
        yield start, None, None, None, (b"no quality: " if qual is None else b"quality of another length: ") + head[:200]


def resynchronised(lines: Iterator[tuple[int, bytes]], end: int) -> Iterator[tuple[int, bytes]]:
    """The lines from the first record on that begins in them, and before ``end``."""
    held: list[tuple[int, bytes]] = []

    def ahead(i: int) -> Iterator[tuple[int, bytes]]:
        for k in itertools.count(i):
            if k == len(held):
                if (line := next(lines, None)) is None:
                    return
                held.append(line)
            yield held[k]

    for i, (at, line) in enumerate(ahead(0)):
        if at >= end:
            return iter(())
        if line.startswith(b"@"):
            found = list(itertools.islice(records(ahead(i), strict=True), 2))
            if found and all(r[-1] is None for r in found):
                return itertools.chain(held[i:], lines)
    return iter(())


@dataclass
class Range(InputPartition):
    name: str
    start: int
    end: int | None


class ReadsReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block, self.keep_bad = options["path"], int(options.get("block_bytes", 64 << 20)), options.get("keep_bad", "false") == "true"

    def partitions(self):
        store, root = _open(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        out: list[InputPartition] = []
        for f in files:
            if f.base_name.endswith(".gz"):
                out.append(Range(f.path, 0, None))
            else:
                out += [Range(f.path, at, min(at + self.block, f.size)) for at in range(0, f.size, self.block)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range):
        if not partition.name:
            return
        store, _ = _open(self.path)
        name = partition.name.rpartition("/")[2]
        with store.open_input_stream(partition.name, compression="gzip") if partition.end is None else store.open_input_file(partition.name) as source:
            end = float("inf") if partition.end is None else partition.end
            if partition.start:
                source.seek(partition.start - 1)
                lines = lines_from(source, partition.start - 1)
                next(lines, None)  # the line that the range before begins, or its end alone
                lines = resynchronised(lines, end)
            else:
                lines = lines_from(source, 0)
            rows, size = [], 0
            for start, head, seq, qual, bad in records(lines):
                if start >= end:
                    break
                if bad is not None and not self.keep_bad:
                    raise ValueError(f"{name}, byte {start}: {bad.decode(errors='replace')}")
                first = None if head is None else (head[1:].split(maxsplit=1) or [b""])[0]
                rows.append([name, *(None if x is None else x.decode(errors="replace") for x in (first, seq, qual, bad))])
                size += len(seq or b"") * 2 + 100
                if size >= CHUNK:
                    yield self.batch(rows)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], [f.split()[0] for f in FIELDS.split(", ")])


class Reads(DataSource):
    @classmethod
    def name(cls):
        return "sievelake_reads"

    def schema(self):
        return FIELDS

    def reader(self, schema):
        return ReadsReader(self.options)


def read(spark: SparkSession, path: str, block_bytes: int = 64 << 20, keep_bad: bool = False) -> DataFrame:
    """source (file), name (first word of the header), seq, qual, bad of the records in a file or folder."""
    spark.dataSource.register(Reads)
    return spark.read.format("sievelake_reads").options(path=path, block_bytes=str(block_bytes), keep_bad=str(keep_bad).lower()).load()
