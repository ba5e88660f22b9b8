"""Containment of probe bags in filters: hits, thresholds, ranks.

Probes are (read, pos, n) with repeats added up before the join, so that a
frequent position costs one row per read. Totals are kept apart: reads without
any position still count.

A threshold join (``matches``) doesn't make a row per shared position. Filters of a
position are listed, some ``LIST`` a row, so a read meets lists; a task counts them
for each read and gives out only pairs that can reach the threshold. Positions of
many filters come last: a read that needs h hits may skip positions of less than h
hits in all, as a match has one among the others, and it skips the most frequent
ones. Pairs found among the others are verified on the skipped positions.

Where most positions have many filters, lists would be far more than reads and bits
together: there reads meet blocks of filters (see ``crossing``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.functions import sequences
from sievelake.operators import crossing
from sievelake.workspace import written

LIST = 1024
#: Positions with so many times the filters of the average position may be skipped,
#: and no more than FREQUENT of them, as those of all bits / FREQUENT filters at least.
OFTEN, FREQUENT = 8, 10_000


def bags(rows: DataFrame, read: Column, pos: Column) -> DataFrame:
    return rows.groupBy(read.alias("read"), pos.alias("pos")).agg(F.count(F.lit(1)).alias("n"))


def totals(probes: DataFrame, distinct: bool = False) -> DataFrame:
    return probes.groupBy("read").agg((F.count(F.lit(1)) if distinct else F.sum("n")).alias("total"))


def hits(probes: DataFrame, bits: DataFrame, distinct: bool = False) -> DataFrame:
    """read, filter, hits of pairs with a hit."""
    joined = probes.join(bits, "pos")
    return joined.groupBy("read", "filter").agg((F.count(F.lit(1)) if distinct else F.sum("n")).alias("hits"))


def needed(total: Column, theta: float | Column) -> Column:
    """Hits needed for a share theta; the product is cut to 9 digits before it is rounded up."""
    return F.ceil(F.round(total * theta, 9))


def frequent(bits: DataFrame) -> DataFrame:
    """pos, filters: the positions that many filters have; FREQUENT of them at most."""
    counts = bits.groupBy("pos").agg(F.count(F.lit(1)).alias("filters"))
    limits = counts.agg(F.greatest(F.sum("filters") / FREQUENT, OFTEN * F.avg("filters")).alias("limit"))
    return counts.join(F.broadcast(limits)).where("filters > limit").select("pos", "filters")


def _skipping(probes: DataFrame, hot: DataFrame, need: Column, thresholds: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The probes to look up, and the reads: read, total, need, spare (weight of what is
    skipped), skipped (pos, n). The most frequent positions are skipped, as many as leave
    one hit at least for those that are looked up."""
    marked = probes.join(F.broadcast(hot), "pos", "left")
    of_hot = F.when(F.col("filters").isNotNull(), F.struct((-F.col("filters")).alias("by"), "pos", "n"))
    reads = marked.groupBy("read").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(of_hot)).alias("hot"))
    reads = (reads if thresholds is None else reads.join(thresholds.select("read", "theta"), "read")).withColumn("need", need)
    start = F.struct(F.lit(0).cast("long").alias("spare"), F.lit(0).alias("k"), F.lit(True).alias("go"))

    def step(a, x):
        go = a["go"] & (a["spare"] + x["n"] < F.greatest("need", F.lit(1)))
        return F.struct(F.when(go, a["spare"] + x["n"]).otherwise(a["spare"]).alias("spare"), F.when(go, a["k"] + 1).otherwise(a["k"]).alias("k"), go.alias("go"))

    reads = reads.withColumn("cut", F.aggregate("hot", start, step)).select("read", "total", "need", F.col("cut.spare").alias("spare"), F.slice("hot", 1, F.greatest(F.col("cut.k"), F.lit(0))).alias("skipped"), F.expr("slice(hot, cut.k + 1, size(hot))").alias("rest"))
    reads = written(reads, "reads")
    kept = reads.select("read", F.explode("rest").alias("x")).select("read", "x.pos", "x.n")
    return marked.where("filters IS NULL").select("read", "pos", "n").union(kept), reads.drop("rest")


def overlaps(probes: DataFrame, bits: DataFrame, need: Column, enough: Callable, sizes: DataFrame | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """read, filter, hits, size, total, need of the pairs with hits that ``enough`` accepts: a function of
    arrays (hits at most, total, need, size of the filter or 0). ``need``: a column of
    total (and of theta, by read, with ``thresholds``); no pair with fewer hits may be accepted."""
    bits = bits.select("filter", "pos")
    wanted = written(bits.join(probes.select("pos").distinct(), "pos", "left_semi"), "wanted")
    hot = written(frequent(wanted), "frequent")
    rest, others = (df.join(F.broadcast(hot.select("pos")), "pos", "left_anti") for df in (probes, wanted))
    if crossing.dense(*(met := crossing.meetings(rest, others))):
        return _by_blocks(probes, wanted, met[0], need, enough, sizes, thresholds)
    light, reads = _skipping(probes, hot, need, thresholds)
    listed = wanted if sizes is None else wanted.join(sizes.select("filter", "size"), "filter")
    listed = listed.withColumn("size", F.lit(0).cast("long")) if sizes is None else listed
    # so many lists for the most frequent position; others have as many at most
    pieces = -(-(wanted.groupBy("pos").count().agg(F.max("count")).first()[0] or 1) // LIST)
    piece = F.pmod(F.xxhash64("filter"), F.lit(pieces)).cast("int")
    lists = listed.groupBy("pos", piece.alias("piece")).agg(F.collect_list("filter").alias("filters"), F.collect_list("size").alias("sizes"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    kind, filter_kind = (df.schema[c].dataType.simpleString() for df, c in ((probes, "read"), (bits, "filter")))
    met = light.join(lists, "pos").select("read", "piece", "n", "filters", "sizes", none("total", "long"), none("need", "long"), none("spare", "long"))
    heads = reads.select("read", F.lit(-1).alias("piece"), none("n", "long"), none("filters", f"array<{filter_kind}>"), none("sizes", "array<long>"), F.col("total").cast("long"), F.col("need").cast("long"), F.col("spare").cast("long"))
    stream = met.union(heads).repartition("read").sortWithinPartitions("read", "piece")
    fields = f"read {kind}, filter {filter_kind}, hits long, size long, total long, need long, spare long"

    def run(batches):
        held = None
        for batch in batches:
            for part in _cut(batch):
                table = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                heads, starts = _changes(table)
                # the last group may go on; its read's head goes along
                yield _told(table.slice(0, starts[-1]), heads[: starts[-1]], starts[:-1], enough)
                held = table.take(pa.array(np.unique(np.append(heads[-1], np.arange(starts[-1], table.num_rows)))))
        if held is not None:
            heads, starts = _changes(held)
            yield _told(held, heads, starts, enough)

    found = stream.mapInArrow(run, fields)
    if hot.isEmpty():
        return found.drop("spare")
    found = written(found, "candidates")
    at = found.where("spare > 0").join(reads.where("spare > 0").select("read", F.explode("skipped").alias("x")), "read").select("read", "filter", "x.pos", "x.n")
    more = at.join(wanted.join(F.broadcast(hot.select("pos")), "pos", "left_semi"), ["filter", "pos"]).groupBy("read", "filter").agg(F.sum("n").alias("more"))
    return found.join(more, ["read", "filter"], "left").select("read", "filter", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits"), "size", "total", "need")


def _by_blocks(probes: DataFrame, wanted: DataFrame, met: int, need: Column, enough: Callable, sizes: DataFrame | None, thresholds: DataFrame | None) -> DataFrame:
    """``overlaps`` by blocks of filters, a row per read; no position is skipped."""
    reads = crossing.reads_of(probes, met, F.sum("n").alias("total"))
    reads = reads if thresholds is None else reads.join(thresholds.select("read", "theta"), "read")
    reads = reads.select("read", "pos", "n", F.col("total").cast("long").alias("total"), need.cast("long").alias("need"))
    own = wanted.groupBy("filter").agg(F.count(F.lit(1)).alias("size")) if sizes is None else wanted.select("filter").distinct().join(sizes, "filter")
    found = crossing.crossed(reads, crossing.index(wanted, own), lambda hits, read, size: (hits > 0) & enough(hits, read["total"], read["need"], size))
    return found.select("read", "filter", "hits", "size", "total", "need")


def _cut(batch: pa.RecordBatch, limit: int = 1 << 20):
    """A batch in parts whose lists have some ``limit`` entries, or one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def _changes(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The row of each row's head, and where the rows of each (read, piece) begin."""
    read = np.asarray(pc.dictionary_encode(table.column(0), null_encoding="encode").indices)
    piece = np.asarray(table.column(1))
    heads = np.maximum.accumulate(np.where(piece < 0, np.arange(len(piece)), 0))
    return heads, np.flatnonzero(np.append(True, (read[1:] != read[:-1]) | (piece[1:] != piece[:-1])))


def _told(table: pa.RecordBatch, heads: np.ndarray, starts: np.ndarray, enough: Callable) -> pa.RecordBatch:
    """read, filter, hits and the head's columns of the pairs in a table's groups that are enough."""
    names = ["read", "filter", "hits", "size", "total", "need", "spare"]
    lists = table.column(3)
    long = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    codes = pc.dictionary_encode(lists.flatten())
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    key = np.repeat(group, long) * max(1, len(codes.dictionary)) + np.asarray(codes.indices)
    n = np.repeat(pc.fill_null(table.column(2), 0).to_numpy(zero_copy_only=False), long)
    pairs, first, at = np.unique(key, return_index=True, return_inverse=True)
    hits = np.bincount(at, n, len(pairs)).astype(np.int64)
    sizes = np.asarray(table.column(4).flatten())[first] if len(pairs) else np.zeros(0, np.int64)
    head = heads[starts[pairs // max(1, len(codes.dictionary))]] if len(pairs) else np.zeros(0, np.int64)
    total, need, spare = (pc.fill_null(table.column(i), 0).to_numpy(zero_copy_only=False)[head] for i in (5, 6, 7))
    good = np.flatnonzero(enough(hits + spare, total, need, sizes))
    filters = codes.dictionary.take(pa.array(pairs[good] % max(1, len(codes.dictionary))))
    return pa.RecordBatch.from_arrays([table.column(0).take(pa.array(head[good])), filters, *[pa.array(x[good]) for x in (hits, sizes, total, need, spare)]], names)


def matches(probes: DataFrame, bits: DataFrame, theta: float | Column | DataFrame = 0.7, distinct: bool = False) -> DataFrame:
    """read, filter, hits, total, frac of the pairs that reach the threshold: a number, a
    column over read, or a table (read, theta), as query files have thresholds of their own."""
    probes = written(probes.select("read", "pos", (F.lit(1) if distinct else F.col("n")).cast("long").alias("n")), "probes")
    of_each = theta if isinstance(theta, DataFrame) else None
    need = needed(F.col("total"), F.col("theta") if of_each is not None else theta)
    found = overlaps(probes, bits, need, lambda hits, total, need, size: hits >= need, thresholds=of_each)
    kept = found.where(F.col("hits") >= F.col("need"))
    return kept.select("read", "filter", "hits", "total", sequences.fraction(F.col("hits"), F.col("total")).alias("frac"))


def all_counts(probes: DataFrame, bits: DataFrame, filters: DataFrame, theta: float) -> DataFrame:
    """Every (read, filter) with its hits, reaching the threshold or not: read,
    filter, hits, total, passed. Reads meet blocks of filters: only reads are shuffled."""
    own = filters.select("filter").distinct().join(bits.groupBy("filter").agg(F.count(F.lit(1)).alias("size")), "filter", "left")
    found = crossing.index(bits, own.select("filter", F.coalesce("size", F.lit(0)).alias("size")))
    rows = crossing.reads_of(probes, 0, F.sum("n").cast("long").alias("total"))
    counted = crossing.crossed(rows, found).withColumn("hits", F.when(F.col("read").isNull(), 0).otherwise(F.col("hits")))
    return counted.select("read", "filter", "hits", "total", (F.col("hits") >= needed(F.col("total"), theta)).alias("passed"))


def match_counts(found: DataFrame, probes: DataFrame) -> DataFrame:
    """read, matches: 0 for reads without any."""
    return totals(probes).select("read").join(found.groupBy("read").agg(F.count(F.lit(1)).alias("m")), "read", "left").select("read", F.coalesce("m", F.lit(0)).alias("matches"))


def adjusted(found: DataFrame, sizes: DataFrame, num_bits: int) -> DataFrame:
    """Matches with hits adjusted for the filter's false-positive rate."""
    fp = sequences.false_positive_rate(F.lit(num_bits), F.col("set_size"))
    return found.join(sizes, "filter").select("read", "filter", "hits", "total", sequences.adjusted_hits(F.col("hits"), F.col("total"), fp).alias("adjusted"))


def ranked(found: DataFrame, by: str = "hits") -> DataFrame:
    """Matches with their place in a read: by hits (or adjusted) descending, then filter."""
    order = [F.desc(by), F.asc("filter"), *([F.asc("hits")] if by != "hits" else [])]
    return found.withColumn("place", F.row_number().over(W.partitionBy("read").orderBy(*order)))


def presence(probes: DataFrame, bits: DataFrame, filters: DataFrame | None = None) -> DataFrame:
    """read, filter, pos, state: the present ones, or with ``filters`` all, absent ones too."""
    probes = probes.select("read", "pos").distinct()
    if filters is None:
        return probes.join(bits, "pos").select("read", "filter", "pos", F.lit("present").alias("state"))
    every = filters.select("filter").distinct().agg(F.collect_list("filter").alias("all"))
    pairs = probes.join(F.broadcast(every)).select("read", "pos", F.explode("all").alias("filter"))
    marked = pairs.join(bits.withColumn("state", F.lit("present")), ["filter", "pos"], "left")
    return marked.select("read", "filter", "pos", F.coalesce("state", F.lit("absent")).alias("state"))
