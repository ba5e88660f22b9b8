"""Removal of repeated passages: every byte covered by a ``WINDOW`` = 100-byte
string that also starts earlier, in a smaller document or before in the same one.

Sorting all suffixes would move a hundred times the text. Suffixes that matter are
found first, then a distributed merge sort that knows common prefixes sorts those:

1. Of the 32-byte strings in a 100-byte window the one with the smallest hash is
   its anchor, so equal windows have equal anchors at the same place. About three
   positions in a hundred are anchors. An anchor's context is the 68 bytes before
   it and the 100 bytes from it on: all windows that it can stand for.
2. Anchors are grouped by the hash of their 32 bytes. One alone is no repeat. Of
   anchors with the same whole context, all but the first are repeats with all of
   it. Only the first of each context is left, if its group has other contexts.
3. Those suffixes are sorted. A task sorts its suffixes into runs, front-codes
   them (length of the prefix shared with the one before, then the rest) and sends
   them to the bucket of their first 32 bytes. A bucket merges its runs with a
   loser tree that keeps, for each waiting suffix, the prefix it shares with the
   last one put out, and never compares those bytes again. The merge gives the
   longest common prefixes within each group, the bytes before the anchors give
   the common extension to the left, and both give what each suffix repeats.
4. Hot groups (a common line in many surroundings; more than ``GROUP`` contexts and
   more than a ``HOT``-th of all anchors) are split by further bytes: each window
   that their anchors stand for is a suffix of its own, which goes to the bucket of
   all its 100 bytes. A run has one suffix of each window, the first; the same merge
   brings equal ones together, and all but the first are repeats.
5. Each task reads back what was found for its own documents and removes it.

A first pass finds the hot groups, at most ``HOT`` by their definition, so they are
known to all tasks. Any other group has at most that many contexts, and one more for
each batch in which it has no second; a bucket of windows gets a window once a run.

What steps 3 and 4 remove was compared byte by byte. Equal whole contexts (step 2) are
told by two hashes of 64 bits together. Rows that would gather under one key are
reduced where they arise: of equal contexts, or equal windows, in a batch only the
first goes on under its key. The steps pass their results on as Parquet in the shared
folder, by input split, so texts are never shuffled. The table must give the same rows
in the same order each time it is computed (files do).

Defined results: null texts are empty; texts under 100 bytes lose nothing; rows
without an id come first in the order; repeated rows are ordered as they are
read; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.llm.batches import slices
from sievelake.llm.splits import of_split, write_by_split
from sievelake.workspace import scratch, written

WINDOW, ANCHOR = 100, 32
BEFORE = WINDOW - ANCHOR
GROUP, HOT = 16_384, 100_000
PAIRWISE = 64
PIECE, MARGIN = 1 << 20, 512
NO_ID = -(1 << 63)
BASE = np.uint64(0x9E3779B97F4A7C15)
CODES = np.random.default_rng(100).integers(1, 1 << 63, 256, np.uint64)
FULL, SORT, DENSE = 1, 2, 3

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for i, b in enumerate((BASE, inverse)):
            steps = np.full(n + n // 4, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


class Hashes:
    """Hashes of all substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(CODES[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of so many values."""
    done, out = 1, values
    while 2 * done <= width:
        out, done = pick(out[:-done], out[done:]), 2 * done
    if done < width:
        out = pick(out[: len(out) - (width - done)], out[width - done :])
    return out


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, Hashes]:
    """Positions and group hashes of the anchors in documents laid end to end (of
    WINDOW bytes at least), and the hashes of all substrings; ends: where each
    position's document ends."""
    n = len(data)
    hashes = Hashes(data)
    at = np.arange(n - ANCHOR + 1)
    h = hashes.of(at, at + ANCHOR) | np.uint64(1)
    low = _sliding(h, BEFORE + 1, np.minimum)
    whole = at[: len(low)] + WINDOW <= ends[: len(low)]
    low = np.where(whole, low, np.uint64(0))
    # an anchor is the smallest of some window: the largest of its windows' smallest
    padded = np.concatenate([np.zeros(BEFORE, np.uint64), low, np.zeros(BEFORE, np.uint64)])
    found = np.flatnonzero(_sliding(padded, BEFORE + 1, np.maximum) == h)
    return found, h[found], hashes


def pieces(batch: pa.RecordBatch, first: int) -> Iterator[tuple]:
    """(data, starts, ends, rows, shift, keep) of a batch of (doc_id, text): documents
    laid end to end, or parts of a long one with a margin; rows count from ``first``."""
    texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
    if len(texts) == 1 and len(texts[0]) > 2 * PIECE:
        text = texts[0]
        for lo in range(0, len(text), PIECE):
            hi, low = min(lo + PIECE, len(text)), max(0, lo - MARGIN)
            yield text[low : hi + MARGIN], [0], [first], low, (lo, hi)
        return
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    yield b"".join(texts), starts, np.arange(first, first + len(texts)), 0, None


def _contexts(batches) -> Iterator[dict]:
    """g, c, id, row, pos of all anchors, in pieces."""
    row = 0
    for batch in slices(batches, 1, PIECE):
        ids = batch.column(0).fill_null(NO_ID).to_numpy()
        for text, starts, rows, shift, keep in pieces(batch, row):
            data = np.frombuffer(text, np.uint8)
            if len(data) < WINDOW:
                continue
            starts = np.asarray(starts)
            doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(data))))
            limit = np.append(starts[1:], len(data))[doc]
            with np.errstate(over="ignore"):
                pos, g, hashes = anchors(data, limit)
                lo, hi = np.maximum(pos - BEFORE, starts[doc[pos]]), np.minimum(pos + WINDOW, limit[pos])
                c = hashes.of(lo, hi) ^ ((pos - lo).astype(np.uint64) * BASE)
            own = doc[pos]
            out = {"g": g.view(np.int64), "c": c.view(np.int64), "id": ids[np.asarray(rows)[own] - row], "row": np.asarray(rows)[own], "pos": pos - starts[own] + shift}
            if keep:
                inside = (out["pos"] >= keep[0]) & (out["pos"] < keep[1])
                out = {k: v[inside] for k, v in out.items()}
            yield out
        row += batch.num_rows


def _joined(parts: list[dict]) -> dict:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _batch(columns: dict, fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[t]) for n, t in zip(names, types, strict=True)], list(names))


def _sorted_anchors(batches) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Anchors in the order of group, context and place, a bounded number at a time, and
    where a group and where a context begins."""

    def out(parts):
        a = _joined(parts)
        by = np.lexsort((a["pos"], a["row"], a["id"], a["c"], a["g"]))
        a = {k: v[by] for k, v in a.items()}
        new_g = np.diff(a["g"], prepend=a["g"][0] ^ 1) != 0
        return a, new_g, new_g | (np.diff(a["c"], prepend=a["c"][0] ^ 1) != 0)

    held, size = [], 0
    for part in _contexts(batches):
        held.append(part)
        size += len(part["g"])
        if size > 400_000:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


def _hot_groups(docs: DataFrame, group: int) -> np.ndarray:
    """The groups with more than ``group`` contexts and more than a HOT-th of all
    anchors, so fewer than HOT. Contexts are counted where two of a group meet in a task."""

    def run(batches):
        for a, new_g, first in _sorted_anchors(batches):
            at = np.flatnonzero(new_g)
            contexts = np.add.reduceat(first.astype(np.int64), at)
            several = contexts > 1
            g, n = a["g"][at][several], contexts[several]
            yield _batch({"g": [None], "n": [len(first)]}, "g long, n long")
            for lo in range(0, len(g), 100_000):
                yield _batch({"g": g[lo : lo + 100_000], "n": n[lo : lo + 100_000]}, "g long, n long")

    counts = written(docs.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")), "suffix-groups")
    anchors = counts.where("g IS NULL").first()
    least = max(group, anchors["n"] // HOT) if anchors else group
    return np.sort(np.array([r["g"] for r in counts.where(F.col("g").isNotNull() & (F.col("n") > least)).select("g").collect()], np.int64))


def _classes(docs: DataFrame, path: str, group: int) -> None:
    """Step 1 and 2; writes (split, row, pos, kind) by split."""
    fields = "key long, g long, c long, id long, split int, row long, pos long, kind int"
    hot = docs.sparkSession.sparkContext.broadcast(_hot_groups(docs, group))

    def run(batches):
        split = TaskContext.get().partitionId()
        for a, _, first in _sorted_anchors(batches):
            n = len(first)
            a["kind"] = np.where(first, np.where(np.isin(a["g"], hot.value), DENSE, 0), FULL).astype(np.int32)
            with np.errstate(over="ignore"):
                own = ((a["row"].astype(np.uint64) << np.uint64(20)) + a["pos"].astype(np.uint64) + np.uint64(split)) * BASE
            a["key"] = np.where(a["kind"] == 0, a["g"], own.view(np.int64))
            a["split"] = np.full(n, split, np.int32)
            for at in range(0, n, 100_000):
                yield _batch({k: v[at : at + 100_000] for k, v in a.items()}, fields)

    rows = docs.mapInArrow(run, fields).repartition("key")
    rank = F.row_number().over(W.partitionBy("key", "c").orderBy("id", "split", "row", "pos"))
    rows = rows.withColumn("rank", rank)
    lead = (F.col("kind") == 0) & (F.col("rank") == 1)
    rows = rows.withColumn("classes", F.sum(lead.cast("long")).over(W.partitionBy("key")))
    kind = F.when(F.col("kind") != 0, F.col("kind")).when(F.col("rank") > 1, FULL).when(F.col("classes") > 1, SORT)
    write_by_split(rows.select("split", "row", "pos", kind.alias("kind")).where("kind IS NOT NULL"), path, "row", "pos")


def _places(path: str, kind: int) -> dict[int, list[int]]:
    """row -> positions of the given kind in this task's split."""
    table, out = of_split(path, TaskContext.get().partitionId(), "row", "pos"), {}
    if table is not None:
        mask = np.asarray(table.column("kind")) == kind
        rows, at = np.asarray(table.column("row"))[mask], np.asarray(table.column("pos"))[mask]
        change = [*np.flatnonzero(np.diff(rows, prepend=-1)).tolist(), len(rows)]
        for lo, hi in zip(change, change[1:], strict=False):
            out[int(rows[lo])] = at[lo:hi].tolist()
    return out


# ---- runs of sorted, front-coded suffixes -------------------------------


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 8
    while a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    while step > 1:
        step //= 2
        if a[known : known + step] == b[known : known + step]:
            known += step
    return known


def pack(entries: list[tuple]) -> bytes:
    """A run: sorted (suffix, reversed bytes before it, id, split, row, pos), front-coded."""
    common, rests, last = [], [], b""
    for e in entries:
        n = shared(last, e[0])
        common.append(n)
        rests.append(e[0][n:])
        last = e[0]
    n = len(entries)
    numbers = np.array([e[2:] for e in entries], np.int64)
    return b"".join([
        struct.pack("<I", n), np.array(common, np.uint8).tobytes(), np.array([len(r) for r in rests], np.uint8).tobytes(), np.array([len(e[1]) for e in entries], np.uint8).tobytes(),
        numbers.tobytes(), *rests, *[e[1] for e in entries],
    ])


def unpack(run: bytes) -> Iterator[tuple]:
    """(prefix shared with the suffix before, entry) of each entry of a run."""
    (n,) = struct.unpack_from("<I", run)
    common, rests, lefts = (list(run[4 + i * n : 4 + (i + 1) * n]) for i in range(3))
    at = 4 + 3 * n
    numbers = np.frombuffer(run, np.int64, 4 * n, at).reshape(n, 4).tolist()
    at += 32 * n
    left_at, last = at + sum(rests), b""
    for i in range(n):
        last = last[: common[i]] + run[at : at + rests[i]]
        at += rests[i]
        yield common[i], (last, run[left_at : left_at + lefts[i]], *numbers[i])
        left_at += lefts[i]


def merge(runs: list[bytes]) -> Iterator[tuple]:
    """(prefix shared with the one before, entry) of all runs in the suffixes' order.

    A loser tree over the runs. Each waiting suffix has the length of the prefix it
    shares with the last winner. Of two of them the one with the longer such prefix
    is smaller; only if both are equal are bytes compared, and from there on."""
    streams = [unpack(r) for r in runs]
    size = 1
    while size < len(streams):
        size *= 2
    heads: list = [next(s, None) for s in streams] + [None] * (size - len(streams))
    known = [0] * size  # prefix shared with the last winner
    current = [h[1] if h else None for h in heads]

    def beats(a: int, b: int) -> bool:
        """Whether stream a's suffix comes first; the loser's shared prefix is then that with the winner."""
        x, y = current[a], current[b]
        if x is None or y is None:
            return y is None
        if known[a] != known[b]:
            return known[a] > known[b]
        n = shared(x[0], y[0], known[a])
        first = x[0][n : n + 1] < y[0][n : n + 1] or (len(x[0]) == len(y[0]) == n and a < b)
        known[b if first else a] = n
        return first

    tree = [0] * size
    winners = [0] * (2 * size)
    for i in range(size):
        winners[size + i] = i
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if size > 1 else 0
    while current[top] is not None:
        yield known[top], current[top]
        head = next(streams[top], None)
        if head is None:
            current[top] = None
        else:
            known[top], current[top] = head  # the run's own prefix is that with the winner just put out
        node = (size + top) // 2
        while node:
            other = tree[node]
            if not beats(top, other):
                tree[node], top = top, other
            node //= 2


def repeats(members: list[tuple], common: list[int]) -> Iterator[tuple]:
    """(split, row, start, end) of what each member of a group repeats; common:
    shared prefix with the member before."""
    n = len(members)
    order = [(m[2], m[3], m[4], m[5]) for m in members]
    if n == 2:
        right, left = common[1], shared(members[0][1], members[1][1])
        if left + right >= WINDOW:
            m = members[0] if order[0] > order[1] else members[1]
            yield m[3], m[4], m[5] - left, m[5] + right
        return
    before = np.full((n, BEFORE), -1, np.int16)
    for i, m in enumerate(members):
        before[i, : len(m[1])] = np.frombuffer(m[1], np.uint8)
    by_place = np.array(sorted(range(n), key=order.__getitem__))
    if n > PAIRWISE:
        yield from _repeats_of_many(members, np.array(common, np.int16), before, by_place)
        return
    right = np.zeros((n, n), np.int16)
    lcp = np.array(common, np.int16)
    for i in range(n - 1):
        right[i, i + 1 :] = np.minimum.accumulate(lcp[i + 1 :])
    right = right + right.T
    place = np.empty(n, np.int64)
    place[by_place] = np.arange(n)
    for i in range(n):
        same = (before == before[i]) & (before[i] >= 0)
        left = np.where(same.all(axis=1), BEFORE, np.argmin(same, axis=1))
        good = (place < place[i]) & (left + right[i] >= WINDOW)
        if good.any():
            m = members[i]
            yield m[3], m[4], m[5] - int(left[good].max()), m[5] + int(right[i][good].max())


def _repeats_of_many(members: list[tuple], common: np.ndarray, before: np.ndarray, by_place: np.ndarray) -> Iterator[tuple]:
    """What ``repeats`` gives, without meeting all pairs: for each length of the part before
    the anchor, members that share it and the rest of the window are a class, in which
    all but the first are repeats."""
    n = len(members)
    by_left = np.array(sorted(range(n), key=lambda i: members[i][1]))
    same = (before[by_left][1:] == before[by_left][:-1]) & (before[by_left][1:] >= 0)
    left = np.zeros(n, np.int64)
    left[1:] = np.where(same.all(axis=1), BEFORE, np.argmin(same, axis=1))
    low, high = np.full(n, WINDOW), np.full(n, -1)
    left_class = np.empty(n, np.int64)
    for k in range(BEFORE + 1):
        left_class[by_left] = np.cumsum(left < k)
        classes = (np.cumsum(common < WINDOW - k) * (n + 1) + left_class)[by_place]
        again = np.ones(n, bool)
        again[np.unique(classes, return_index=True)[1]] = False
        found = by_place[again]
        low[found] = np.minimum(low[found], k)
        high[found] = k
    for i in np.flatnonzero(high >= 0).tolist():
        m = members[i]
        yield m[3], m[4], m[5] - int(high[i]), m[5] - int(low[i]) + WINDOW


def first_of_windows(entries: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The first entry of each window, and (row, pos) of the others; entries are sorted."""
    kept, again, last = [], [], None
    for e in entries:
        if e[0] == last:
            again.append(e[4:])
        else:
            kept.append(e)
            last = e[0]
    return kept, again


def _bucket(key: bytes, buckets: int) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big") % buckets


def _sorted_repeats(docs: DataFrame, classes: str, path: str, buckets: int, window_buckets: int) -> None:
    """Step 3 and 4; writes (split, row, pos, until) by split: what is repeated.

    Buckets from ``buckets`` on are those of windows. Windows that a task has seen before
    are under a number of the task's own, below zero."""
    fields = "split int, row long, pos long, until long"

    def runs(batches):
        split, row = TaskContext.get().partitionId(), 0
        wanted, hot = _places(classes, SORT), _places(classes, DENSE)
        held, windows = [], []

        def out():
            by, numbers, packed = {}, [], []
            for e in held:
                by.setdefault(_bucket(e[0][:ANCHOR], buckets), []).append(e)
            first, again = first_of_windows(sorted(windows))
            for e in first:
                by.setdefault(buckets + _bucket(e[0], window_buckets), []).append(e)
            held.clear()
            windows.clear()
            for b, es in by.items():
                numbers.append(b)
                packed.append(pack(sorted(es)))
            if again:
                numbers.append(-1 - split)
                packed.append(np.array(again, np.int64).tobytes())
            return _batch({"bucket": numbers, "run": packed}, "bucket int, run binary")

        if not wanted and not hot:
            return
        for batch in slices(batches, 1, PIECE):
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                at = row + i
                if at not in wanted and at not in hot:
                    continue
                text = (batch.column(1)[i].as_py() or "").encode()
                key = NO_ID if doc_id is None else doc_id
                held += [(text[x : x + WINDOW], text[max(0, x - BEFORE) : x][::-1], key, split, at, x) for x in wanted.get(at, ())]
                if at in hot:
                    starts = np.unique(np.array(hot[at])[:, None] - np.arange(BEFORE + 1))
                    starts = starts[(starts >= 0) & (starts + WINDOW <= len(text))]
                    for lo in range(0, len(starts), 100_000):
                        windows += [(text[x : x + WINDOW], b"", key, split, at, x) for x in starts[lo : lo + 100_000].tolist()]
                        if len(windows) > 100_000:
                            yield out()
                if len(held) > 50_000:
                    yield out()
            row += batch.num_rows
        if held or windows:
            yield out()

    def resolve(bucket, held):
        if bucket < 0:
            return [(-1 - bucket, r, x, x + WINDOW) for run in held for r, x in np.frombuffer(run, np.int64).reshape(-1, 2).tolist()]
        rows, members, common = [], [], []
        least, found = (ANCHOR, repeats) if bucket < buckets else (WINDOW, _repeated_windows)
        for n, entry in merge(held):
            if n < least and members:
                rows += found(members, common)
                members, common = [], []
            members.append(entry)
            common.append(n)
        return rows + list(found(members, common))

    def merged(batches):
        bucket, held = None, []
        for batch in batches:
            rows = []
            for b, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and held:
                    rows += resolve(bucket, held)
                    held = []
                bucket = b
                held.append(run)
            if rows:
                yield _batch(dict(zip(("split", "row", "pos", "until"), zip(*rows, strict=True), strict=True)), fields)
        rows = resolve(bucket, held) if held else []
        if rows:
            yield _batch(dict(zip(("split", "row", "pos", "until"), zip(*rows, strict=True), strict=True)), fields)

    sent = docs.mapInArrow(runs, "bucket int, run binary").repartition("bucket").sortWithinPartitions("bucket")
    write_by_split(sent.mapInArrow(merged, fields), path, "row", "pos")


def _repeated_windows(members: list[tuple], common: list[int]) -> Iterator[tuple]:
    """(split, row, start, end) of all but the first of equal windows."""
    first = min(m[2:] for m in members)
    for m in members:
        if m[2:] != first:
            yield m[3], m[4], m[5], m[5] + WINDOW


def _remove(docs: DataFrame, classes: str, found: str | None, with_text: bool) -> DataFrame:
    """Step 5."""
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches):
        split = TaskContext.get().partitionId()
        full = _places(classes, FULL)
        spans: dict[int, list] = {}
        table = of_split(found, split, "row", "pos") if found else None
        if table is not None:
            for r, lo, hi in zip(*(np.asarray(table.column(c)).tolist() for c in ("row", "pos", "until")), strict=True):
                spans.setdefault(r, []).append((lo, hi))
        row = 0
        for batch in slices(batches, 1, PIECE):
            out = []
            for i, (doc_id, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                text = (t or "").encode()
                parts = spans.get(row + i, []) + [(max(0, x - BEFORE), min(len(text), x + WINDOW)) for x in full.get(row + i, ())]
                runs: list[list[int]] = []
                for lo, hi in sorted(parts):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                at, kept = 0, []
                for lo, hi in runs:
                    kept.append(text[at:lo])
                    at = hi
                kept = b"".join([*kept, text[at:]])
                out.append((doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)[: 5 + with_text])
            row += batch.num_rows
            yield _batch(dict(zip([f.split()[0] for f in fields.split(", ")], zip(*out, strict=True), strict=True)), fields)

    return docs.mapInArrow(run, fields)


def dedup(docs: DataFrame, with_text: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``
    (with_text: the kept bytes too, which may cut characters)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    folder = scratch(spark, "suffixes")
    classes, found = f"{folder}/classes", f"{folder}/repeats"
    _classes(docs, classes, group)
    rows = spark.read.schema("row long, pos long, kind int, split int").parquet(classes)
    counts = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    if not counts.get(SORT) and not counts.get(DENSE):
        return _remove(docs, classes, None, with_text)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-counts.get(SORT, 0) // 10_000))
    # an anchor stands for BEFORE + 1 windows
    _sorted_repeats(docs, classes, found, buckets, max(least, -(-counts.get(DENSE, 0) * (BEFORE + 1) // 20_000)))
    return _remove(docs, classes, found, with_text)
