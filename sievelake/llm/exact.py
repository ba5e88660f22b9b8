"""Exact duplicates: sorted digest runs, merged along a tree of partitions.

Texts are equal if they are the same after each run of ASCII white space has become
one space. A row stands for its text by the SHA-256 of that and its length.

A leaf is a partition of the table. Its rows become a run: entries sorted by digest,
one for each digest, with the smallest identifier and the number of rows. Runs then
meet in rounds, as in a binomial tree: with 2^b leaves below it, each node of a round
stands for a block of 2^b leaves and, as every node would otherwise end at one root
with all digests, for one of 2^b equal ranges of digests (recursive halving). In a
round 2^FAN_BITS blocks become one, and a range so many smaller ones, that is
FAN_BITS binomial rounds at once; every node takes its range of its children's runs.
A node merges them block by block as they come: blocks arrive in the order of their
first digests, so what lies before the next one's is final and goes on, and no more
than some blocks of each child are held. At every level, entries of one digest become
one, their whole digests and lengths compared, and the smallest identifier stays.

So a text with a third of all rows is one entry per run, at every level, and no task
sees more entries of it than it has children. The decisions go back to the rows as
``hot.with_groups`` describes.

Defined results: a null text is an empty one, equal to other empty ones; white space
is replaced, not trimmed. Of equal texts the row with the smallest doc_id stays; rows
without an id come last; of repeated rows, or rows that share the id, the one read
first stays, so just one row of a group does. Texts may be of any length: they are
digested where they are read. An empty table has no groups. Other columns are not
looked at (``deduplicated`` hands them on as they are, whatever their names). The
table must give the same rows in the same order each time it is computed (files do).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.hot import with_groups
from sievelake.workspace import written

FAN_BITS = 4
BLOCK = 1 << 13
HELD = 1 << 18
ENTRY = np.dtype([("digest", "S32"), ("bytes", "<i8"), ("none", "u1"), ("id", "<i8"), ("uid", "<i8"), ("size", "<i8")])
RUNS = "node int, first binary, run binary"
FOUND = "digest binary, keep_none boolean, keep_id long, keep_uid long, group_size long"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, uid (place in the table), leaf (partition), digest and bytes of each row's text."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("uid"), F.spark_partition_id().alias("leaf"), text.alias("text"))
    return rows.select("doc_id", "uid", "leaf", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def levels(leaves: int, fan_bits: int = FAN_BITS) -> list[int]:
    """How many leaves a node stands for after each round."""
    bits = max(1, (leaves - 1).bit_length())
    rounds = -(-bits // fan_bits)
    return [1 << (bits * (r + 1) // rounds) for r in range(rounds)]


def ranges(entries: np.ndarray, n: int) -> np.ndarray:
    """The one of ``n`` equal ranges of digests that each entry is in."""
    head = np.ascontiguousarray(entries["digest"]).view("u1").reshape(len(entries), 32)[:, :4]
    return np.ascontiguousarray(head).view(">u4").ravel().astype(np.int64) * n >> 32


def before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each of a's identifiers is smaller than b's."""
    out = a["uid"] < b["uid"]
    for field in ("id", "none"):
        out = np.where(a[field] == b[field], out, a[field] < b[field])
    return out


def run_of(entries: np.ndarray) -> np.ndarray:
    """Entries in any order as a run."""
    e = entries[np.lexsort((entries["uid"], entries["id"], entries["none"], entries["digest"]))]
    start = np.flatnonzero(np.append(True, e["digest"][1:] != e["digest"][:-1])) if len(e) else np.zeros(0, np.int64)
    if len(e) and (np.minimum.reduceat(e["bytes"], start) != np.maximum.reduceat(e["bytes"], start)).any():
        raise ValueError("texts of different length share a digest")
    out = e[start]
    out["size"] = np.add.reduceat(e["size"], start) if len(e) else 0
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two runs as one."""
    place = np.searchsorted(a["digest"], b["digest"], side="right") + np.arange(len(b))
    e = np.empty(len(a) + len(b), ENTRY)
    own = np.ones(len(e), bool)
    own[place] = False
    e[own], e[place] = a, b
    twice = np.flatnonzero(e["digest"][1:] == e["digest"][:-1])  # an entry of a, and then one of b
    if (e["bytes"][twice] != e["bytes"][twice + 1]).any():
        raise ValueError("texts of different length share a digest")
    sizes = e["size"][twice] + e["size"][twice + 1]
    second = twice[before(e[twice + 1], e[twice])]
    e[second] = e[second + 1]
    e["size"][twice] = sizes
    return np.delete(e, twice + 1)


def all_merged(runs: list[np.ndarray]) -> np.ndarray:
    """Any number of runs as one, in pairs."""
    while len(runs) > 1:
        runs = [merged(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0] if runs else np.empty(0, ENTRY)


def _key(entry: np.ndarray) -> bytes:
    return bytes(entry["digest"]).ljust(32, b"\0")  # numpy cuts zeros off


def _sent(run: np.ndarray, block: int, leaves: int, level: int) -> Iterator[pa.RecordBatch]:
    """A run of the block of leaves with that number, cut for the nodes of a level."""
    if not len(run):
        return
    of = ranges(run, level)
    cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    node, first, data = [], [], []
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(run)], strict=True):
        for at in range(lo, hi, BLOCK):
            node.append(block * level + int(of[at]))
            first.append(_key(run[at]))
            data.append(run[at : min(at + BLOCK, hi)].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(first, pa.binary()), pa.array(data, pa.binary())], ["node", "first", "run"])


def _result(run: np.ndarray) -> pa.RecordBatch:
    digest = pa.Array.from_buffers(pa.binary(32), len(run), [None, pa.py_buffer(np.ascontiguousarray(run["digest"]).tobytes())])
    none = run["none"].astype(bool)
    columns = [digest.cast(pa.binary()), pa.array(none), pa.array(run["id"], mask=none), pa.array(run["uid"]), pa.array(run["size"])]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FOUND.split(", ")])


def leaf_runs(rows: DataFrame, leaves: int, level: int) -> DataFrame:
    """The runs of all leaves, for the nodes of the first level."""

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def out():
            for leaf, parts in held.items():
                yield from _sent(run_of(np.concatenate(parts)), leaf // level, leaves, level)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            e = np.zeros(batch.num_rows, ENTRY)
            digest = batch.column(3).cast(pa.binary(32))
            e["digest"] = np.frombuffer(digest.buffers()[1], "S32", len(digest), 32 * digest.offset)
            e["none"] = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            e["id"], e["uid"], e["bytes"], e["size"] = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).to_numpy(), 1
            of = batch.column(2).to_numpy()
            for leaf in np.unique(of).tolist():
                held.setdefault(leaf, []).append(e[of == leaf])
            size += len(e)
            if size >= HELD:
                yield from out()
                size = 0
        yield from out()

    return rows.select("doc_id", "uid", "leaf", "digest", "bytes").mapInArrow(run, RUNS)


def merge_round(runs: DataFrame, leaves: int, level: int, above: int | None) -> DataFrame:
    """The nodes of a level merge what was sent to them, and send it to the level above (or give it out)."""

    def run(batches):
        node, held, size = None, [], 0

        def out(done):
            if not len(done):
                return
            if above is None:
                for at in range(0, len(done), BLOCK):
                    yield _result(done[at : at + BLOCK])
            else:
                yield from _sent(done, node // level * level // above, leaves, above)

        for batch in batches:
            for to, first, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if to != node:
                    yield from out(all_merged(held))
                    node, held, size = to, [], 0
                elif size >= HELD:  # all before the first of this block is here
                    whole = all_merged(held)
                    cut = int(np.searchsorted(whole["digest"], np.array(first.as_py(), "S32")))
                    yield from out(whole[:cut])
                    held, size = [whole[cut:]], len(whole) - cut
                held.append(np.frombuffer(data.as_buffer(), ENTRY))
                size += len(held[-1])
        yield from out(all_merged(held))

    nodes = -(-leaves // level) * level
    placed = runs.repartitionById(nodes, F.col("node")).sortWithinPartitions("node", "first")
    return placed.mapInArrow(run, RUNS if above else FOUND)


def found(rows: DataFrame, leaves: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """The groups of ``rows`` (as ``digests`` gives them): digest, keep_none, keep_id, keep_uid, group_size."""
    steps = levels(leaves, fan_bits)
    runs = leaf_runs(rows, leaves, steps[0])
    for level, above in zip(steps, [*steps[1:], None], strict=True):
        runs = merge_round(runs, leaves, level, above)
    return runs


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, uid, keep_id, group_size, kept, digest of each row."""
    rows = written(digests(docs), "exact")
    n, last = rows.agg(F.count(F.lit(1)), F.max("leaf")).first()
    kept = written(found(rows, (last or 0) + 1), "exact-groups")
    joined = with_groups(rows, kept, "digest", "group_size", n)
    return joined.select("doc_id", "uid", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "digest")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    packed = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    dropped = groups(docs).where("NOT kept").select("uid")
    return packed.join(dropped, "uid", "left_anti").select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row."""
    return groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def sql() -> str:
    return r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)"""
