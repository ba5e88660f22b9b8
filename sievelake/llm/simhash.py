"""Near-duplicate groups by SimHash and a generalised pigeonhole search.

A text's fingerprint has a bit for each bit of the hash of its word shingles that
is set in over half of them. The search for fingerprints that differ in few bits
follows the generalised pigeonhole principle. The bits are grouped into m
partitions, correlated bits together. If two fingerprints differ in at most
``reach`` bits, and thresholds t1..tm (from -1, "don't look") add up to
reach - m + 1, then some partition has them differ in at most its threshold. Each
fingerprint gets thresholds of its own, by dynamic programming over the
partitions, to minimise the estimated number of candidates: the histogram of the
partition's values in all fingerprints, summed over the values within the
threshold. A threshold may be one above the average, so that a partition can stay
unprobed while another takes its share. So a fingerprint looks past values that many fingerprints share if it can. The
fingerprint then probes an index of all fingerprints by partition value, and
each candidate is verified.

Number and width of the partitions follow from the number of fingerprints: few
wide ones, with thresholds up to 2, need more probes and have fewer candidates
each (``whole_plan``, ``likely_plan``).

Everything the driver sees is bounded: a correlation matrix of the bits and a
histogram of at most 65,536 cells per partition (wider values fall into cells by
hash, and what a cell holds above the average counts for each of its values). The
index and the probes of a value that many fingerprints share are dealt over a
grid of cells by hash, each of some ``cell`` x ``cell`` fingerprints, every index
part meeting every probe part. A task verifies the candidates of its cells and
gives back links that connect what it found connected, the closest ones first,
never all pairs: at most one per fingerprint of a batch of cells. Equal texts
share one fingerprint, and only distinct ones are searched.

``near_duplicates`` links fingerprints of 64 bits over 3-word shingles at 3 or
fewer differing bits; no such link is missed. ``first_of_each_group`` finds texts
whose sets of 5-word shingles are similar (Jaccard) to 0.8 or more: at that
similarity some 15 in 100 bits differ, so its fingerprints have 192 bits and its
partitions are chosen for the chance that such a pair is found, 0.9 at 0.8 and
more above. Candidates are verified before they are thinned: the first search only
tells which fingerprints have candidates at all; those meet again, by the same
partitions and thresholds, with sketches of their shingle sets (the sets themselves up
to ``SKETCH`` shingles, else a sample by hash), and only links that the sketches bear
out connect anything. Links that a sample leaves in doubt don't stand in for others.
What is kept is verified on the whole sets. What fingerprints can miss is then looked for
exactly (``unconnected``): sets that similar ones can't be without sharing one of their
rarest shingles meet by these, as far as they aren't connected yet. Where these stand among
a set's shingles, and parity bits, a few at first and then as many as a set's size asks for
(``narrowed``), leave out pairs that can't be similar; the rest is verified on the whole
sets too. So no link at 0.8 or more is left out.

Defined results: null and empty texts have fingerprint zero and are linked like
any others; texts with fewer words than a shingle hash their whole word sequence;
in ``first_of_each_group`` texts are equal if their sets of shingles are;
a null doc_id gives a null component_id only to a group without any other id;
repeated rows stay (``first_of_each_group`` keeps one). Very long texts are hashed
in pieces. Other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.batches import slices
from sievelake.llm.hot import HOT, with_groups
from sievelake.operators.graphs import components
from sievelake.workspace import written

BITS, RADIUS = 64, 3
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """How to search: partitions of ``bits``, what their thresholds add up to, and
    how many differing bits make a link."""

    bits: int
    parts: int
    sum: int
    radius: int

    @property
    def words(self) -> int:
        return self.bits // 64

    def widths(self) -> list[int]:
        return [self.bits // self.parts + (p < self.bits % self.parts) for p in range(self.parts)]


def _probes(width: int, threshold: int) -> int:
    return sum(math.comb(width, i) for i in range(threshold + 1))


def whole_plan(n: int, bits: int = BITS, radius: int = RADIUS) -> Plan:
    """The cheapest partitions that miss no pair within ``radius``; moving an entry
    costs as much as some 50 comparisons."""

    def cost(parts: int) -> float:
        width, total = bits / parts, radius - parts + 1
        each = [total // parts + (p < total % parts) for p in range(parts)]
        return sum(_probes(round(width), t) * (50 + n / 2**width) for t in each if t >= 0)

    return min((Plan(bits, m, radius - m + 1, radius) for m in range(2, radius + 2)), key=lambda plan: cost(plan.parts))


def likely_plan(n: int, bits: int, differing: float, radius: int, chance: float) -> Plan:
    """The cheapest partitions that find a pair whose bits each differ with
    probability ``differing`` with the given chance."""
    found = []
    for width in (12, 14, 16, 20, 24):
        for t in (0, 1, 2):
            p = sum(math.comb(width, i) * differing**i * (1 - differing) ** (width - i) for i in range(t + 1))
            parts = bits // width
            found.append((1 - (1 - p) ** parts, parts * _probes(width, t) * (50 + n / 2**width), Plan(bits, parts, parts * t, radius)))
    return min((c for c in found if c[0] >= chance), key=lambda c: c[1])[2]


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = text.encode().lower().split()  # bytes: A-Z alone change, the six ASCII white-space bytes separate
    if not words:
        return 0
    joined, size = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return size(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    totals, step = np.zeros(BITS, np.int64), 1 << 15
    for at in range(0, len(starts), step):
        hashes = np.array([size(joined[s:e], seed) for s, e in zip(starts[at : at + step], ends[at : at + step], strict=True)], np.uint64)
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * totals > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp0 (the 64 bits as a signed long) of each row."""

    def run(batches):
        for batch in slices(batches, 1):
            fps = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp0"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp0 long")


def _columns(words: int) -> list[str]:
    return [f"fp{i}" for i in range(words)]


def _matrix(batch: pa.RecordBatch, words: int) -> np.ndarray:
    """The first columns of a batch as fingerprints, a row each."""
    return np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(words)], axis=1)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")


def correlations(fps: DataFrame, bits: int) -> np.ndarray:
    """Correlation matrix of the bits over all rows of ``fps``."""
    words = bits // 64

    def run(batches):
        sums, n = np.zeros((bits, bits), np.int64), 0
        for batch in batches:
            own = _bits(_matrix(batch, words)).astype(np.float32)
            sums += (own.T @ own).astype(np.int64)
            n += len(own)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(bits * bits + 1, dtype=np.int32)), "n": pa.array(np.append(sums.ravel(), n))})

    rows = fps.select(*_columns(words)).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(bits * bits + 1)
    flat[np.asarray(rows.column(0))] = np.asarray(rows.column(1))
    both = flat[:-1].reshape(bits, bits) / max(flat[-1], 1)
    ones = np.diag(both)
    sd = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    return (both - np.outer(ones, ones)) / np.outer(sd, sd)


def group_bits(correlation: np.ndarray, widths: list[int]) -> list[np.ndarray]:
    """Bit numbers of each partition: it starts with the free bit that correlates most
    with the other free ones and takes in, one by one, the bit that correlates most
    with those it has."""
    strength, free, groups = np.abs(correlation), list(range(len(correlation))), []
    for width in widths:
        first = max(free, key=lambda b: (strength[b, free].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < width:
            best = max(free, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(np.array(sorted(group)))
    return groups


def part_values(fps: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """The value of each partition of each fingerprint."""
    out = np.zeros((len(fps), len(groups)), np.int64)
    for p, group in enumerate(groups):
        for i, bit in enumerate(group.tolist()):
            out[:, p] |= ((fps[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(np.int64) << i
    return out


def flips(width: int, threshold: int) -> np.ndarray:
    """What to xor a value with to get those that differ in just ``threshold`` bits."""
    one = 1 << np.arange(width)
    if threshold < 2:
        return one if threshold else np.zeros(1, np.int64)
    return np.array([a | b for i, a in enumerate(one.tolist()) for b in one[i + 1 :].tolist()])


@dataclass
class Index:
    """What a task needs to know: the partitions and, by value, how many fingerprints
    have it, as far as the histogram's cells tell."""

    plan: Plan
    groups: list[np.ndarray]
    counts: np.ndarray  # by partition and cell
    n: int
    cell: int

    def known(self, p: int, values: np.ndarray) -> np.ndarray:
        """How many fingerprints have each value: counted, or the average and what
        the value's cell has above it."""
        width = len(self.groups[p])
        if 1 << width <= self.counts.shape[1]:
            return self.counts[p, values]
        cells = self.counts.shape[1]
        extra = self.counts[p, hashed(values, cells)] - self.n / cells
        return np.maximum(1, np.ceil(self.n / 2.0**width + np.maximum(0, extra - 4 * math.sqrt(self.n / cells)))).astype(np.int64)

    def near(self, p: int, values: np.ndarray, threshold: int) -> np.ndarray:
        """How many have a value that differs in at most so many bits."""
        return sum(self.known(p, values ^ f) for t in range(threshold + 1) for f in flips(len(self.groups[p]), t).tolist())

    @property
    def top(self) -> int:
        """The largest threshold: one above the average, 2 at most."""
        return min(2, max(1, self.plan.sum // self.plan.parts + 1))

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """-1 to ``top`` for each partition of each fingerprint, adding up to the plan's
        sum, with the fewest estimated candidates: a dynamic programme over the
        partitions and the sum so far."""
        n, parts, top = len(values), self.plan.parts, self.top
        sums = parts * (top + 1) + 1  # of the thresholds, each counted from -1
        best = np.full((n, sums), np.inf)
        best[:, 0] = 0
        choice = np.zeros((parts, n, sums), np.int8)
        for p in range(parts):
            width = len(self.groups[p])
            costs = [np.zeros(n)] + [50.0 * _probes(width, t) + self.near(p, values[:, p], t) for t in range(top + 1)]
            new = np.full((n, sums), np.inf)
            for t, cost in enumerate(costs):
                shifted = np.full((n, sums), np.inf)
                shifted[:, t:] = best[:, : sums - t] + cost[:, None]
                better = shifted < new
                new = np.where(better, shifted, new)
                choice[p][better] = t
            best = new
        out = np.zeros((n, parts), np.int8)
        at = np.full(n, self.plan.sum + parts)
        for p in reversed(range(parts)):
            taken = choice[p, np.arange(n), at]
            out[:, p], at = taken - 1, at - taken
        return out


def hashed(values: np.ndarray, cells: int) -> np.ndarray:
    return ((values.astype(np.uint64) * MIX) >> np.uint64(64 - int(math.log2(cells)))).astype(np.int64)


def _entries(fps: np.ndarray, index: Index):
    """partition << 32 | value, cell, side (0 index, 1 probe), number of the fingerprint, for all entries."""
    values = part_values(fps, index.groups)
    thresholds = index.thresholds(values)
    mixed = fps[:, 0] * MIX
    for i in range(1, fps.shape[1]):
        mixed = (mixed ^ fps[:, i]) * MIX
    spread = (mixed >> np.uint64(33)).astype(np.int64)

    def dealt(side, p, value, who):
        # index parts of a value, and parts of its probes: as many as could look at it
        rows = np.maximum(1, -(-index.known(p, value) // index.cell))
        columns = np.maximum(1, -(-index.near(p, value, index.top) // index.cell))
        own, other = (rows, columns) if side == 0 else (columns, rows)
        each = np.repeat(np.arange(len(value)), other)
        copy = np.arange(len(each)) - np.repeat(np.cumsum(other) - other, other)
        mine = (spread[who] % own)[each]
        cell = mine * columns[each] + copy if side == 0 else copy * columns[each] + mine
        return value[each] | p << 32, cell, np.full(len(each), side, np.int8), who[each]

    everyone = np.arange(len(fps))
    for p, group in enumerate(index.groups):
        yield dealt(0, p, values[:, p], everyone)
        for t in range(index.top + 1):
            who = np.flatnonzero(thresholds[:, p] >= t)
            if len(who):
                around = flips(len(group), t)
                yield dealt(1, p, (values[who, p, None] ^ around).ravel(), np.repeat(who, len(around)))


def connect(pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Which pairs (n x 2 numbers) make a forest of the lightest ones that connects what
    all of them connect: each component takes its lightest pair, round by round."""
    ends = np.unique(pairs, return_inverse=True)[1].reshape(-1, 2)
    label, kept = np.arange(int(ends.max()) + 1 if len(ends) else 0), []
    order = np.lexsort((np.arange(len(ends)), weights))
    ends = ends[order]
    while True:
        a, b = label[ends[:, 0]], label[ends[:, 1]]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return order[np.unique(np.concatenate(kept))] if kept else np.zeros(0, np.int64)
        first = np.full(len(label), len(ends))
        np.minimum.at(first, a[open_], open_)
        np.minimum.at(first, b[open_], open_)
        taken = np.unique(first[first < len(ends)])
        kept.append(taken)
        a, b = label[ends[taken, 0]], label[ends[taken, 1]]
        while len(a):  # what is taken now is one component
            low = np.minimum(a, b)
            to = np.arange(len(label))
            np.minimum.at(to, a, low)
            np.minimum.at(to, b, low)
            to = to[to]
            label = to[label]
            a, b = to[a], to[b]
            still = a != b
            a, b = a[still], b[still]


def verified(keys: np.ndarray, sides: np.ndarray, fps: np.ndarray, radius: int, step: int = 1 << 20):
    """Numbers of rows that share a key and differ in at most ``radius`` bits, index (side
    0) against probe (side 1), and in how many; keys are sorted, index first."""
    change = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(change[1:], len(keys))
    group = np.repeat(np.arange(len(change)), ends - change)
    inside = np.bincount(group, sides == 0, len(change)).astype(np.int64)
    probes = np.flatnonzero(sides == 1)
    counts = inside[group[probes]]
    first = change[group[probes]]
    sums = np.cumsum(counts)
    at = 0
    while at < len(probes):
        base = int(sums[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(sums, base + step, side="right")))
        n = counts[at:upto]
        left = np.repeat(probes[at:upto], n)
        right = np.repeat(first[at:upto] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        apart = np.bitwise_count(fps[left] ^ fps[right]).sum(axis=1, dtype=np.int64)
        near = (apart <= radius) & (fps[left] != fps[right]).any(axis=1)
        if near.any():
            yield left[near], right[near], apart[near]
        at = upto


def indexed(fps: DataFrame, plan: Plan, n: int, cell: int = 4096) -> Index:
    """The partitions and histograms of distinct fingerprints ``fps`` (fp0, fp1, ...)."""
    columns, words = _columns(plan.words), plan.words
    groups = group_bits(correlations(fps, plan.bits), plan.widths())
    cells = 1 << min(16, max(plan.widths()))

    def histogram(batches):
        counts = np.zeros((plan.parts, cells), np.int64)
        for batch in batches:
            values = part_values(_matrix(batch, words), groups)
            for p, group in enumerate(groups):
                counts[p] += np.bincount(values[:, p] if 1 << len(group) <= cells else hashed(values[:, p], cells), minlength=cells)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"key": pa.array(seen.astype(np.int32)), "n": pa.array(counts.ravel()[seen])})

    rows = fps.select(*columns).mapInArrow(histogram, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(plan.parts * cells, np.int64)
    counts[np.asarray(rows.column(0))] = np.asarray(rows.column(1))
    return Index(plan, groups, counts.reshape(plan.parts, cells), n, cell)


def links(fps: DataFrame, plan: Plan, n: int, cell: int = 4096) -> DataFrame:
    """a, b, apart: links of distinct fingerprints ``fps`` (node and fp0, fp1, ...) that
    connect what chains of the pairs found within the plan's radius connect."""
    return searched(fps, indexed(fps, plan, n, cell))


def searched(fps: DataFrame, index: Index, similarity: float | None = None, ends: bool = False) -> DataFrame:
    """a, b, apart: the links found by an index that connect what all of them connect.
    With ``similarity``, only links that the column ``sketch`` bears out count, and apart
    is in millionths of dissimilarity. With ``ends``, the column node alone: what has a
    link, at most once for a batch of cells."""
    plan = index.plan
    columns, words = _columns(plan.words), plan.words
    known = fps.sparkSession.sparkContext.broadcast(index)
    fields = "key long, cell int, side byte, node long, " + ", ".join(f"{c} long" for c in columns) + ", sketch binary" * (similarity is not None)
    names = [f.split()[0] for f in fields.split(", ")]

    def entries(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own, nodes = _matrix(part, words), part.column(words).to_numpy()
                for key, cells, side, who in _entries(own, known.value):
                    step = len(key) if similarity is None else 4096
                    for lo in range(0, len(key), max(1, step)):
                        k, c, s, w = (x[lo : lo + step] for x in (key, cells, side, who))
                        more = [] if similarity is None else [part.column(words + 1).take(pa.array(w))]
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int32)), pa.array(s), pa.array(nodes[w]), *[pa.array(own[w, i].view(np.int64)) for i in range(words)], *more], names)

    def verify(batches):
        held, found = None, []

        def told(a, b, apart):
            return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([a, b])))], ["node"]) if ends else _pairs(a, b, apart)

        def reduced(parts):
            pairs = np.sort(np.concatenate([np.stack(p[:2], axis=1) for p in parts]), axis=1)
            apart = np.concatenate([p[2] for p in parts])
            # ties by the nodes: tasks that see the same pairs keep the same ones
            by = np.lexsort((pairs[:, 1], pairs[:, 0], apart))
            pairs, apart = pairs[by], apart[by]
            kept = connect(pairs, apart)
            return pairs[kept, 0], pairs[kept, 1], apart[kept]

        def look(columns):
            key = columns[0] * np.int64(0x5851F42D4C957F2D) + columns[1]  # of neighbours in the order: equal just if both parts are
            fps = np.stack([c.view(np.uint64) for c in columns[4 : 4 + words]], axis=1)
            near = verified(key, columns[2], fps, plan.radius)
            if similarity is not None:
                near = borne_out(near, columns[3], columns[-1], similarity)
            for left, right, apart in near:
                found.append((columns[3][left], columns[3][right], apart))

        for batch in batches:
            columns = [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])  # the last cell may go on in the next batch
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last:
                look([c[:last] for c in held])
                held = [c[last:] for c in held]
            if sum(len(f[0]) for f in found) > 1 << 20:
                found = [reduced(found)]
                if len(found[0][0]) > 1 << 18:
                    yield told(*found[0])
                    found = []
        if held is not None:
            look(held)
        if found:
            yield told(*reduced(found))

    keyed = fps.select(*columns, "node", *(["sketch"] if similarity is not None else [])).mapInArrow(entries, fields)
    return keyed.repartition("key", "cell").sortWithinPartitions("key", "cell", "side").mapInArrow(verify, "node long" if ends else "a long, b long, apart int")


def _pairs(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(apart.astype(np.int32))], ["a", "b", "apart"])


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp0, component_id (smallest doc_id of the group) of each row."""
    fps = written(fingerprints(docs), "simhash")
    distinct = written(fps.groupBy("fp0").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    n = distinct.count()
    roots = components(links(distinct.select("fp0", F.col("fp0").alias("node")), whole_plan(n), n))
    lows = roots.join(distinct, roots["node"] == distinct["fp0"]).groupBy("root").agg(F.min("low").alias("component"))
    groups = written(roots.join(lows, "root").select(F.col("node").alias("fp0"), "component"), "simhash-groups")
    # the id of a fingerprint without links is its own smallest one
    of = distinct.join(groups, "fp0", "left").select("fp0", F.coalesce("component", "low").alias("component_id"))
    return fps.join(of, "fp0").select("doc_id", "fp0", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the group) of each row."""
    digits = F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint")
    return grouped(docs).select("doc_id", digits, "component_id")


# ---- texts of similar shingle sets --------------------------------------

WIDE = 192
CODES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(texts: pa.Array, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of all texts, repeats included, and where each
    text's begin (and the end): words as in ``fingerprint``, in Arrow and numpy alone."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "").cast(pa.large_string())))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    values = lists.values.cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)  # A-Z alone change
    ends = ends - ends[0]
    sizes = np.diff(ends)
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - np.repeat(ends[:-1], sizes)
        letters = mixed(CODES[data] + place.astype(np.uint64) * MIX)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters)])
        word = mixed(sums[ends[1:]] - sums[ends[:-1]])
        counts = np.diff(offsets)
        if len(counts):
            first = np.minimum(offsets[:-1], max(0, len(sizes) - 1))
            counts = np.where((counts == 1) & (sizes[first] == 0), 0, counts)  # a text without words is one empty word
        starts = offsets[:-1]
        n = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
        bounds = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(starts - bounds[:-1], n) + np.arange(bounds[-1])
        short = np.repeat(np.where(counts < shingle, counts, shingle), n)
        h = np.zeros(len(at), np.uint64)
        for k in range(shingle):
            inside = k < short
            h = np.where(inside, mixed(h * MIX + word[np.minimum(at + k, max(0, len(word) - 1))] + np.uint64(k + 1)), h) if len(word) else h
    return h, bounds


def wide_fingerprints(h: np.ndarray, bounds: np.ndarray, bits: int = WIDE, step: int = 1 << 16) -> np.ndarray:
    """Fingerprints of so many bits, a row per text; a text's hash gives further bits by mixing."""
    n, words = np.diff(bounds), bits // 64
    totals = np.zeros((len(n), bits), np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(h), step):
        part, who = h[at : at + step], owner[at : at + step]
        change = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        for w in range(words):
            own = _bits((part if not w else mixed(part + np.uint64(w) * MIX)).reshape(-1, 1))
            totals[who[change], 64 * w : 64 * (w + 1)] += np.add.reduceat(own, change, axis=0, dtype=np.int32)
    return np.packbits(2 * totals > n[:, None], axis=1, bitorder="little").view(np.uint64)


SKETCH = 256
#: Two deviations of what a sampled sketch tells of a similarity near 0.8.
DOUBT = 0.07


def sketch(h: np.ndarray) -> bytes:
    """A set of shingles as its distinct 32-bit hashes in order: all of them, or of more
    than SKETCH those that end in so many zero bits, their number in the first byte."""
    own, level = np.unique((mixed(h) >> np.uint64(32)).astype(np.uint32)), 0
    while len(own) > SKETCH:
        level += 1
        own = own[own & np.uint32((1 << level) - 1) == 0]
    return bytes([level]) + own.tobytes()


def likeness(a: bytes, b: bytes) -> tuple[float, bool]:
    """Similarity of two sketched sets, and whether that is exact."""
    level, sets = max(a[0], b[0]), []
    for x in (a, b):
        own = np.frombuffer(x, np.uint32, offset=1)
        sets.append(own if x[0] == level else own[own & np.uint32((1 << level) - 1) == 0])
    n = len(sets[0]) + len(sets[1])
    merged = np.sort(np.concatenate(sets))
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return (both / (n - both) if n else 1.0), not level


def borne_out(near, nodes: np.ndarray, sketches: np.ndarray, similarity: float, step: int = 4096):
    """Of pairs of rows (in pieces, as ``verified`` gives them) those that connect what all
    similar ones connect, the closest fingerprints first. Pairs that sure ones connect
    needn't be looked at. Pairs in doubt connect nothing but further pairs in doubt."""
    of = np.unique(nodes, return_inverse=True)[1]
    sure, likely = (np.arange(int(of.max()) + 1 if len(of) else 0) for _ in range(2))

    def join(label, x, y):
        label[label == max(label[x], label[y])] = min(label[x], label[y])

    for left, right, apart in near:
        order = np.argsort(apart, kind="stable")
        kept, weights = [], []
        for at in range(0, len(order), step):
            part = order[at : at + step]
            for i in part[sure[of[left[part]]] != sure[of[right[part]]]].tolist():
                x, y = of[left[i]], of[right[i]]
                if sure[x] == sure[y]:
                    continue
                like, exact = likeness(sketches[left[i]], sketches[right[i]])
                if like >= similarity - 1e-9 + (0 if exact else DOUBT):
                    join(sure, x, y)
                    join(likely, x, y)
                elif not exact and like >= similarity - DOUBT and likely[x] != likely[y]:
                    join(likely, x, y)
                else:
                    continue
                kept.append(i)
                weights.append(round((1 - like) * 1e6))
        if kept:
            yield left[kept], right[kept], np.array(weights, np.int64)


def distinct_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_hashes`` without repeats: each text's in order."""
    h, bounds = shingle_hashes(texts)
    each = [np.unique(h[lo:hi]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.concatenate([h[:0], *each]), np.cumsum([0, *map(len, each)])


def set_digests(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of each set of shingles, as two numbers: sums of hashes."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ key))]) for key in CODES[:2]]
        return np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], axis=1)


PARITY = 512


def parities(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set, how many of its shingles fall on each of PARITY bits, modulo two, in 64
    bytes: two sets have at least as many different shingles as these have different bits."""
    n = np.diff(bounds)
    with np.errstate(over="ignore"):
        bit = (mixed(h ^ CODES[2]) % np.uint64(PARITY)).astype(np.int64)
    seen = np.bincount(np.repeat(np.arange(len(n)), n) * PARITY + bit, minlength=len(n) * PARITY)
    return np.packbits((seen & 1).astype(bool).reshape(-1, PARITY), axis=1)


def long_parity(own: np.ndarray) -> bytes:
    """As in ``parities`` for one set of shingles, on four to eight times as many bits as it has
    shingles (PARITY at least): those of large sets tell something too."""
    bits = PARITY
    while bits < 4 * len(own):
        bits *= 2
    bit, n = np.unique(mixed(own ^ CODES[2]) % np.uint64(bits), return_counts=True)
    seen = np.zeros(bits, bool)
    seen[bit[n % 2 == 1].astype(np.int64)] = True
    return np.packbits(seen).tobytes()


def parities_apart(a: bytes, b: bytes) -> int:
    """In how many bits two ``long_parity`` differ; the longer one is folded to the other's length."""
    words = min(len(a), len(b)) // 8
    x, y = (np.bitwise_xor.reduce(np.frombuffer(p, np.uint64).reshape(-1, words), axis=0) for p in (a, b))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def first_of_each_group(docs: DataFrame, similarity: float = 0.8, chance: float = 0.9) -> DataFrame:
    """One row of each group of rows with similar texts: that with the smallest doc_id
    (rows without an id come last; of equal ids the first as read)."""
    columns = _columns(WIDE // 64)
    keys = ["set0", "set1", *columns, "size", "parity"]
    packed = docs.select(F.col("text"), F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 0, 2 << 20):
            h, bounds = distinct_shingles(batch.column(0))
            numbers = np.concatenate([set_digests(h, bounds), wide_fingerprints(h, bounds)], axis=1).view(np.int64)
            parity = pa.array([p.tobytes() for p in parities(h, bounds)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *map(pa.array, numbers.T.copy()), pa.array(np.diff(bounds).astype(np.int32)), parity], ["uid", "row", *keys])

    numbers = ", ".join(f"{c} long" for c in keys[:-2])
    rows = written(packed.mapInArrow(run, f"uid long, row {kind}, {numbers}, size int, parity binary"), "simhash-wide")
    rank = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), F.col("uid"))
    # a node is a set of shingles
    distinct = written(rows.groupBy(*keys).agg(F.min("uid").alias("node"), F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")), "simhash-wide-distinct")
    n = distinct.count()
    # sets of this similarity have vectors at this cosine, and bits that differ in proportion to its angle
    apart = lambda j: math.acos(2 * j / (1 + j)) / math.pi
    differing = apart(similarity)
    radius = round(WIDE * differing + 2.6 * math.sqrt(WIDE * differing * (1 - differing)))
    nodes = distinct.select(*columns, "node")
    index = indexed(nodes, likely_plan(n, WIDE, differing, radius, chance), n)
    texts = rows.select(F.col("uid").alias("node"), F.col("row.text").alias("text"))
    ends = searched(nodes, index, ends=True).distinct()
    close = written(shingle_sets(texts, ends), "simhash-wide-sets")
    again = nodes.join(close.select("node", "sketch"), "node")
    near = written(searched(again, index, similarity).distinct(), "simhash-wide-links")
    roots = components(similar(near, close, similarity))
    # what the fingerprints have missed
    known = written(distinct.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "parity"), "simhash-wide-known")
    large = distinct.where(F.col("n") > max(1, rows.count() // HOT)).select("set0", "set1", "node")
    single = rows.join(F.broadcast(large), ["set0", "set1"], "left").where("node IS NULL OR node = uid").select(F.col("uid").alias("node"), F.col("row.text").alias("text"))
    left = narrowed(unconnected(single, known, similarity), texts, similarity)
    sets = shingle_sets(texts, left.select(F.col("a").alias("node")).union(left.select("b")))
    more = similar(left, written(sets.drop("sketch"), "simhash-wide-sets"), similarity)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    group = distinct.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = group.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.uid").alias("uid"))
    kept = written(kept, "simhash-wide-kept")
    gone = flags(rows.select(F.col("uid").alias("node")).join(kept.withColumnRenamed("uid", "node"), "node", "left_anti"))
    # only rows with the flag of one that goes are shuffled
    there, doubted = (rows.select("uid", "row").mapInArrow(_with_flag(gone, v), f"uid long, row {kind}") for v in (False, True))
    return there.select("row.*").union(doubted.join(kept, "uid", "left_semi").select("row.*"))


def common_shingles(texts: DataFrame, chunk: int = 1 << 21, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many texts (node, text) share, and in about how many they are:
    what stands in four texts of a chunk or more, ``most`` of them at most. They only say
    in which order shingles are looked at."""

    def run(batches):
        def counted(held):
            own, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own[n >= 4].view(np.int64)), pa.array(n[n >= 4])], ["shingle", "n"])

        held = []
        for batch in slices(batches, 1, 2 << 20):
            held.append(distinct_shingles(batch.column(1))[0])
            if sum(map(len, held)) > chunk:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    rows = texts.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = rows.orderBy(F.desc("n"), "shingle").limit(most).toArrow()
    hashes, n = found.column(0).to_numpy().astype(np.int64).view(np.uint64), found.column(1).to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def first_shingles(h: np.ndarray, bounds: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set the shingles, rare ones first, without so many that a similar set has one
    less of: if two sets are similar, the first one that they share is among them in both.
    With the number of the set and of the place in this order, which is one for all sets."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    weight = np.zeros(len(h), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        weight = np.where(common[0][at] == h, common[1][at], 0)
    order = np.lexsort((mixed(h), weight, owner))
    shared = np.ceil(similarity * n - 1e-6).astype(np.int64)
    at = np.arange(len(h)) - bounds[owner]
    kept = at <= (n - shared)[owner]
    return h[order[kept]], owner[order[kept]], at[kept]


def repeated(batches):
    """Of rows ordered by their first column those whose first value isn't alone."""
    held, before = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.append(h, c) for h, c in zip(held, columns, strict=True)]
        same = columns[0][1:] == columns[0][:-1]
        keep = np.append(before, same)
        before, held = bool(keep[-1]), [c[-1:] for c in columns]
        keep = keep[:-1] | same
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in columns], batch.schema.names)
        names = batch.schema.names
    if held is not None and before:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)


def unconnected(texts: DataFrame, known: DataFrame, similarity: float, cell: int = 4096) -> DataFrame:
    """a, b, apart: pairs of nodes with different roots among which are all whose sets of
    shingles are similar. ``texts`` has a text (node, text) of each node, and maybe further
    rows; ``known`` has node, root, size and parity.

    Two sets can only be similar if they share one of their first shingles
    (``first_shingles``) and have, from the first one that they share on, as many as they
    must share, are alike in size and differ in few bits of their parities.
    Members of a shingle are dealt over a triangle of cells of some ``cell`` x ``cell``."""
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    def firsts(batches):
        for batch in slices(batches, 1, 2 << 20):
            h, owner, at = first_shingles(*distinct_shingles(batch.column(1)), common.value, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(owner)), pa.array(at.astype(np.int32))], ["shingle", "node", "at"])

    def compare(batches):
        held, found = None, []

        def look(c):
            key = np.flatnonzero(np.append(True, (c["shingle"][1:] != c["shingle"][:-1]) | (c["cell"][1:] != c["cell"][:-1])))
            first = np.repeat(key, np.diff(np.append(key, len(c["node"]))))
            for x, y in _earlier(first):
                good = c["root"][x] != c["root"][y]
                good &= (c["part"][x] != c["part"][y]) | ~c["apart"][x]
                x, y = x[good], y[good]
                sizes = c["size"][x], c["size"][y]
                good = np.minimum(*sizes) >= similarity * np.maximum(*sizes) - 1e-6
                # an earlier one that they share finds them elsewhere
                good &= np.minimum(sizes[0] - c["at"][x], sizes[1] - c["at"][y]) >= similarity / (1 + similarity) * (sizes[0] + sizes[1]) - 1e-6
                x, y = x[good], y[good]
                bits = np.bitwise_count(c["parity"][x] ^ c["parity"][y]).sum(axis=1, dtype=np.int64)
                good = bits <= (1 - similarity) / (1 + similarity) * (c["size"][x] + c["size"][y]) + 1e-6
                if good.any():
                    ends = np.sort(np.stack([c["node"][x[good]], c["node"][y[good]]], axis=1), axis=1)
                    found.append(np.column_stack([ends, bits[good]]))

        for batch in batches:
            if not batch.num_rows:
                continue
            own = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in batch.schema.names if f != "parity"}
            own["size"], own["at"] = own["size"].astype(np.int64), own["at"].astype(np.int64)
            own["parity"] = np.frombuffer(b"".join(batch.column("parity").to_pylist()), np.uint64).reshape(-1, PARITY // 64)
            held = own if held is None else {f: np.concatenate([held[f], x]) for f, x in own.items()}
            new = np.flatnonzero((held["shingle"] != held["shingle"][-1]) | (held["cell"] != held["cell"][-1]))
            last = int(new[-1]) + 1 if len(new) else 0  # the last cell may go on in the next batch
            if last:
                look({f: x[:last] for f, x in held.items()})
                held = {f: x[last:] for f, x in held.items()}
            if sum(map(len, found)) > 1 << 20:
                found = [np.unique(np.concatenate(found), axis=0)]
                if len(found[0]) > 1 << 18:
                    yield _pairs(*found[0].T.copy())
                    found = []
        if held is not None:
            look(held)
        if found:
            yield _pairs(*np.unique(np.concatenate(found), axis=0).T.copy())

    kind = "shingle long, node long, at int"
    met = texts.mapInArrow(firsts, kind).repartition("shingle").sortWithinPartitions("shingle").mapInArrow(repeated, kind)
    met = written(met.join(known.select("node", "root"), "node"), "simhash-wide-met")
    groups = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    groups = written(groups.where("low < high").select("shingle", "n"), "simhash-wide-shingles")
    parts = F.ceil(F.col("n") / cell)
    dealt = with_groups(met, groups, "shingle", "n", met.count()).withColumn("part", F.pmod(F.xxhash64("node"), parts))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    both = F.least("part", "other") * parts + F.greatest("part", "other")
    dealt = dealt.select("shingle", both.alias("cell"), "part", (F.col("part") != F.col("other")).alias("apart"), "node", "at", "root")
    dealt = dealt.join(known.select("node", "size", "parity"), "node")
    pairs = dealt.repartition("shingle", "cell").sortWithinPartitions("shingle", "cell").mapInArrow(compare, "a long, b long, apart int")
    return written(pairs.distinct(), "simhash-wide-left")


def narrowed(near: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b of the links (alike in size) whose texts' sets of shingles can be similar by their
    ``long_parity``, a small part of a set's size; for the others the sets needn't meet."""
    wanted = _with_flag(flags(near.select(F.col("a").alias("node")).union(near.select("b"))), True)

    def run(batches):
        for batch in slices(wanted(batches), 1, 2 << 20):
            h, bounds = distinct_shingles(batch.column(1))
            each = [long_parity(h[lo:hi]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(each, pa.binary())], ["node", "size", "parity"])

    def judge(batches):
        for batch in slices(batches, 3):
            apart = np.fromiter((parities_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(3), batch.column(4), strict=True)), np.int64, batch.num_rows)
            good = apart <= (1 - similarity) / (1 + similarity) * batch.column(2).to_numpy() + 1e-6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    known = written(texts.mapInArrow(run, "node long, size long, parity binary"), "simhash-wide-parities")
    left, right = (known.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("parity").alias(f"{c}_parity")) for c in "ab")
    both = near.select("a", "b").join(left, "a").join(right, "b").select("a", "b", F.col("a_size") + F.col("b_size"), "a_parity", "b_parity")
    return written(both.mapInArrow(judge, "a long, b long"), "simhash-wide-left")


def _earlier(first: np.ndarray, step: int = 1 << 20):
    """Numbers of rows, each with each earlier one from ``first`` (its group's) on, in pieces."""
    counts = np.arange(len(first)) - first
    sums, at = np.cumsum(counts), 0
    while at < len(first):
        upto = max(at + 1, int(np.searchsorted(sums, (int(sums[at - 1]) if at else 0) + step, side="right")))
        n = counts[at:upto]
        yield np.repeat(np.arange(at, upto), n), np.repeat(first[at:upto] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at = upto


FLAGS = 1 << 24


def flags(nodes: DataFrame):
    """FLAGS bits, broadcast: whether any of ``nodes`` (node) has a hash."""

    def flagged(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashed(batch.column(0).to_numpy(), FLAGS) + 1)], ["flag"])

    found = nodes.mapInArrow(flagged, "flag long").groupBy(F.bitmap_bucket_number("flag").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("flag")).alias("bits"))
    bits = np.zeros((FLAGS >> 15, 1 << 12), np.uint8)
    for row in found.toArrow().to_pylist():
        bits[row["bucket"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return nodes.sparkSession.sparkContext.broadcast(bits.ravel())


def _with_flag(known, value: bool):
    """A function that keeps the rows whose first column has a flag, or hasn't."""

    def run(batches):
        for batch in batches:
            at = hashed(batch.column(0).to_numpy(), FLAGS)
            yield batch.filter(pa.array((known.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) == value))

    return run


def shingle_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, sketch and set of 5-word shingles (distinct 64-bit hashes in order) of those of
    (node, text) that are in ``nodes`` (node), and of some others: flags of the nodes go to
    where the texts are."""
    wanted = _with_flag(flags(nodes), True)

    def run(batches):
        for batch in slices(wanted(batches), 1, 2 << 20):
            h, bounds = distinct_shingles(batch.column(1))
            each = [h[lo:hi] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(e) for e in each], pa.binary()), pa.array([e.tobytes() for e in each], pa.binary())], ["node", "sketch", "shingles"])

    return texts.mapInArrow(run, "node long, sketch binary, shingles binary")


def similar(near: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b of the links whose texts' sets of shingles (node, shingles) are similar enough."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")

    def judge(batches):
        for batch in slices(batches, 2):
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return near.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(judge, "a long, b long")
