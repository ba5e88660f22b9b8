"""WARC archives: written with an index of every record, read back by it.

``write`` stores one gzip member per record in ``.warc.gz`` files below a
directory, a task one or more files, and returns the index as a table: file,
offset, length, URL, digest. ``read`` takes index rows (all, or a selection),
sorts them by file and offset within ranges, and reads neighbouring records with
one request as far as a gap and a size bound allow.

Records with equal payloads of at least ``revisit_bytes`` bytes are stored once:
the one with the largest page_id is the response, the others are revisit records
that carry the payload's length and digest and refer to it. Of repeated rows
with that page_id one is the response; rows whose page_id is null come last. A
null html is an empty payload; null and empty URLs are written as an empty target
and come back as null; records of repeated rows have the same record id, and are
told apart by their places; very long payloads are one record each; an empty table has
an empty index; other columns are not looked at.

Payloads are never shuffled: digests and numbers of rows are, and which rows are
revisits goes back by input split to the tasks that write. The pages must give the
same rows in the same order each time they are computed (files do); a digest that has
changed since is an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.batches import slices
from sievelake.llm.hot import with_groups
from sievelake.llm.splits import of_split, write_by_split
from sievelake.workspace import scratch, written

INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string, refers_to long"
WARC_DATE = "2020-01-01T00:00:00Z"
CRLF = b"\r\n"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _digest(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id, url, html: bytes, sha1_hex: str, kind: str, refers_to) -> bytes:
    """One gzip member with a response or revisit record."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    if kind == "response":
        body += html
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", WARC_DATE),
        ("WARC-Target-URI", "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", _digest(sha1_hex)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(lines + CRLF + body + CRLF + CRLF) + packer.flush()


def parse(member: bytes) -> tuple:
    """(page_id, url, payload or None, payload bytes, sha1 hex, record type, refers to) of a gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(CRLF + CRLF)
    fields = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    size = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
    number = lambda s: int(s) if (s := s[len("<urn:page:") : -1]) else None
    kind = fields["WARC-Type"]
    sha1_hex = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1_hex):
        raise ValueError(f"damaged payload of page {fields['WARC-Record-ID']}")
    refers = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"] or None, payload if kind == "response" else None, size, sha1_hex, kind, refers


class Plan(NamedTuple):
    """Pages and, by input split, which of their rows are revisits."""

    pages: DataFrame
    revisits: str


def plan(pages: DataFrame, revisit_bytes: int = 1000) -> Plan:
    """Finds the rows that revisit others."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    # of small payloads many are equal; they meet nothing
    long_ones = pages.withColumn("row", F.monotonically_increasing_id()).where(F.octet_length("html") >= revisit_bytes)
    keys = written(long_ones.select("page_id", "row", F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("sha1")), "warc-digests")
    # nulls are the smallest in a struct's order; copies of a row differ in their number
    groups = keys.groupBy("sha1").agg(F.max(F.struct("page_id", "row")).alias("kept"), F.count(F.lit(1)).alias("copies"))
    groups = written(groups.where("copies > 1").select("sha1", F.col("kept.page_id").alias("to"), F.col("kept.row").alias("kept_row"), "copies"), "warc-copies")
    again = with_groups(keys, groups, "sha1", "copies", keys.count()).where("row != kept_row")
    path = scratch(spark, "warc-revisits")
    in_split = F.col("row") - F.shiftleft(F.shiftright("row", 33), 33)
    write_by_split(again.select(F.shiftright("row", 33).cast("int").alias("split"), in_split.alias("row"), "to", "sha1"), path, "row")
    return Plan(pages, path)


def write(planned: Plan, path: str, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes the archives; returns their index, itself written to the shared folder."""
    decisions = planned.revisits

    def run(batches):
        store, root = _open(path)
        store.create_dir(root, recursive=True)
        again = of_split(decisions, TaskContext.get().partitionId(), "row")
        numbers = again.column("row").to_numpy() if again is not None else np.empty(0, np.int64)
        sink = name = None
        row = next_one = 0
        for batch in slices(batches, 2, 16 << 20):
            rows = []
            for page_id, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None or sink.tell() >= file_bytes:
                    if sink is not None:
                        sink.close()
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                html = text.encode()
                sha1, kind, refers_to = hashlib.sha1(html), "response", None
                if next_one < len(numbers) and numbers[next_one] == row:
                    kind, refers_to = "revisit", again.column("to")[next_one].as_py()
                    if again.column("sha1")[next_one].as_py() != sha1.digest():
                        raise ValueError(f"the pages have changed while they were written (page {page_id})")
                    next_one += 1
                member = record(page_id, url, html, sha1.hexdigest(), kind, refers_to)
                rows.append((page_id, url, name, sink.tell(), len(member), sha1.hexdigest(), kind, refers_to))
                sink.write(member)
                row += 1
            yield _table(rows, INDEX)
        if next_one < len(numbers):
            raise ValueError("the pages have changed while they were written: fewer rows than planned")
        if sink is not None:
            sink.close()

    return written(planned.pages.mapInArrow(run, INDEX), "warc-index")


def _table(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def read(index: DataFrame, path: str, payloads: bool = True, gap: int = 64 << 10, request: int = 8 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """The records of the index rows: page_id, url, payload (null for revisits;
    absent unless ``payloads``), payload_bytes, payload_digest, record_type, refers_to."""
    fields = "page_id long, url string, " + "payload binary, " * payloads + "payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        store, root = _open(path)
        name = source = None
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at, rows, held = 0, [], 0
            while at < len(places):
                file, start, length = places[at]
                end, upto = start + length, at + 1
                while upto < len(places) and places[upto][0] == file and places[upto][1] <= end + gap and places[upto][1] + places[upto][2] - start <= request:
                    end, upto = max(end, places[upto][1] + places[upto][2]), upto + 1
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                source.seek(start)
                data = source.read(end - start)
                for _, offset, size in places[at:upto]:
                    row = parse(data[offset - start : offset - start + size])
                    held += row[3]
                    rows.append(row if payloads else row[:2] + row[3:])
                at = upto
                if held > request:
                    yield _table(rows, fields)
                    rows, held = [], 0
            if rows:
                yield _table(rows, fields)
        if source is not None:
            source.close()

    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    # by the bytes that a task reads; a few megabytes still go over all cores
    least = min(index.sparkSession.sparkContext.defaultParallelism, -(-size[0] // (1 << 20)))
    tasks = max(1, least, -(-size[0] // task_bytes))
    places = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(run, fields)
