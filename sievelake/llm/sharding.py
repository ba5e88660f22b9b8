"""A uniform shuffle of a table into shards of exact size.

Every row gets a place in a uniformly random order of the whole table, cut into
shards whose row counts differ by one at most. How many rows each input
partition sends to each shard follows the matrix of a multivariate
hypergeometric law with the partitions' row counts and the shards' exact sizes
as margins. No task or driver holds the matrix: the law is split along a binary
tree over the partitions, each node's draw is seeded by the node, and a task
draws the few nodes on the way to its own row, a number per shard each.

1. Count the rows of each partition.
2. In each partition, draw its row of the matrix, deal its rows out in a random
   order (a permutation seeded by the partition) and give each a random key.
   A shard is cut into buckets by equal ranges of the keys, so that sorting one
   is a small piece of work however many rows a shard has.
3. Count the buckets. What a partition deals out follows from its seed and its
   number of rows, so this reads no data; it gives the first slot of each bucket.
4. Exchange by bucket, a task each.
5. In each bucket, order the rows by their keys; a row's slot is the bucket's
   first slot plus its rank.

The partitions of ``df`` must hold the same rows in the same order each time
they are computed (files, or a table written before), which also makes the
result the same after executors are lost; step 4 fails if a count differs from
step 1.

Any column may be null, texts may be empty or long, rows may repeat (each copy
has its own slot); an empty table gives an empty table. Columns of ``df`` keep
their values; columns of ``df`` named like the two results are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_BUCKET, MAX_BUCKETS = 4_000, 100_000
ROWS_PER_COUNT = 2_000_000


def shard_sizes(total: int, shards: int) -> np.ndarray:
    """Rows of each shard: all the same, and one more in the first ones."""
    return np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)


def split_counts(rng: np.random.Generator, sizes: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` rows drawn without replacement fall in each shard."""
    if take == 0:
        return np.zeros_like(sizes)
    if take == int(sizes.sum()):
        return sizes.copy()
    if sizes.sum() < 900_000_000:
        return rng.multivariate_hypergeometric(sizes, take, method="marginals")
    # numpy's law stops at 1e9 rows: split the shards in halves by the
    # hypergeometric law of their sums, as far as single shards
    out = np.zeros_like(sizes)
    stack = [(0, len(sizes), take)]
    while stack:
        lo, hi, n = stack.pop()
        if hi - lo == 1:
            out[lo] = n
            continue
        mid = (lo + hi) // 2
        left = _hypergeometric(rng, int(sizes[lo:mid].sum()), int(sizes[mid:hi].sum()), n)
        stack += [(lo, mid, left), (mid, hi, n - left)]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """A hypergeometric draw; beyond numpy's range by ratio-of-uniforms rejection."""
    total = good + bad
    if total < 900_000_000:
        return int(rng.hypergeometric(good, bad, take))
    if min(good, bad, take, total - take) == 0:
        return take if bad == 0 else good if take == total else 0
    few, many, sample = min(good, bad), max(good, bad), min(take, total - take)
    share = few / total
    centre = sample * share + 0.5
    spread = math.sqrt(sample * (total - sample) / (total - 1) * share * (1 - share) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    top = min(min(sample, few) + 1, math.floor(centre + 16 * spread))

    def weight(k: int) -> float:
        return math.lgamma(k + 1) + math.lgamma(few - k + 1) + math.lgamma(sample - k + 1) + math.lgamma(many - sample + k + 1)

    peak = weight(math.floor((sample + 1) * (few + 1) / (total + 2)))
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = centre + width * (v - 0.5) / u
        if 0 <= x < top and 2 * math.log(u) <= peak - weight(k := math.floor(x)):
            break
    if good > bad:  # k counts the rows of the smaller margin
        k = sample - k
    return k if sample == take else good - k


def partition_row(counts: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, here = 0, len(counts), sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_counts(np.random.default_rng([seed, lo, hi]), here, int(ends[mid] - ends[lo]))
        if part < mid:
            hi, here = mid, left
        else:
            lo, here = mid, here - left
    return here


def dealt(counts: np.ndarray, shards: int, buckets: int, part: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket (``buckets`` per shard, one shard's after the other's) and the random
    key of each row of partition ``part``, in the partition's order."""
    row = partition_row(counts, shard_sizes(int(counts.sum()), shards), part, seed)
    rng = np.random.default_rng([seed, 1, part])
    shard = np.repeat(np.arange(shards, dtype=np.int32), row)
    rng.shuffle(shard)
    keys = rng.integers(-(1 << 63), 1 << 63, len(shard), dtype=np.int64)
    within = (((keys >> 32) + (1 << 31)) * buckets >> 32).astype(np.int32)
    return shard * np.int32(buckets) + within, keys


def first_slots(sizes: np.ndarray, buckets: int) -> np.ndarray:
    """The slot of each bucket's first row within its shard."""
    of = sizes.reshape(-1, buckets)
    return (np.cumsum(of, axis=1) - of).ravel()


def shuffle(df: DataFrame, shards: int, seed: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df`` with columns shard (int) and slot (long, from 0 in each shard)."""
    df = df.drop("shard", "slot")
    spark, columns = df.sparkSession, df.columns

    def count(batches):
        rows = sum(batch.num_rows for batch in batches)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "rows": pa.array([rows], pa.int64())})

    first = df.select(df.columns[0]) if columns else df
    found = {r["part"]: r["rows"] for r in first.mapInArrow(count, "part int, rows long").collect()}
    counts = np.array([found.get(p, 0) for p in range(max(found, default=-1) + 1)], np.int64)
    total = int(counts.sum())
    # a bucket of more rows, until there are not too many of them
    buckets = max(1, min(-(-total // (shards * rows_per_bucket)), MAX_BUCKETS // shards))
    margins = spark.sparkContext.broadcast(counts)

    def count_buckets(batches):
        sizes = np.zeros(shards * buckets, np.int64)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                sizes += np.bincount(dealt(margins.value, shards, buckets, part, seed)[0], minlength=len(sizes))
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sizes[used])], ["bucket", "rows"])

    # a row per bucket at most, MAX_BUCKETS in all
    tasks = max(1, min(len(counts), -(-total // ROWS_PER_COUNT)))
    parts = spark.range(0, len(counts), 1, tasks).mapInArrow(count_buckets, "bucket int, rows long")
    sizes = np.zeros(shards * buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("rows").alias("rows")).collect():
        sizes[r["bucket"]] = r["rows"]
    known = spark.sparkContext.broadcast(first_slots(sizes, buckets))

    def deal(batches):
        part = TaskContext.get().partitionId()
        rows = int(margins.value[part]) if part < len(margins.value) else 0
        bucket, keys = dealt(margins.value, shards, buckets, part, seed) if rows else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        at = 0
        for batch in batches:
            upto = at + batch.num_rows
            if upto > rows:
                raise RuntimeError(f"partition {part} has more rows than were counted: write the table before sharding it")
            places = pa.array(np.arange(at, upto, dtype=np.int64) | part << 40)
            own = bucket[at:upto]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(known.value[own]), pa.array(keys[at:upto]), places], ["row", "bucket", "start", "key", "place"])
            at = upto
        if at != rows:
            raise RuntimeError(f"partition {part} has fewer rows than were counted: write the table before sharding it")

    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    exchanged = packed.mapInArrow(deal, f"row {kind}, bucket int, start long, key long, place long").repartitionById(shards * buckets, F.col("bucket"))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("key", "place"))
    shard = F.expr(f"bucket div {buckets}").cast("int")
    return exchanged.select("row.*", shard.alias("shard"), (F.col("start") + rank - 1).cast("long").alias("slot"))
