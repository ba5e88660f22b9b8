"""Bit vectors as rows (filter, pos): one row per set bit.

Binary operations take two such tables that hold one vector per ``filter``
each, matched by it. Bitmaps of 32,768 bits per row are the compact form.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 32_768


def of(rows: DataFrame, filter_col: Column, pos: Column) -> DataFrame:
    return rows.select(filter_col.alias("filter"), pos.alias("pos")).distinct()


def and_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["filter", "pos"], "left_semi")


def or_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def mask(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and not b."""
    return a.join(b, ["filter", "pos"], "left_anti")


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("filter", "pos").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def not_(a: DataFrame, filters: DataFrame, num_bits: int) -> DataFrame:
    return unpacked(packed_pair(packed(a), None, filters, num_bits, lambda x, y: ~x))


def eq(a: DataFrame, b: DataFrame, filters: DataFrame, num_bits: int) -> DataFrame:
    return unpacked(packed_pair(packed(a), packed(b), filters, num_bits, lambda x, y: ~(x ^ y)))


def or_not(a: DataFrame, b: DataFrame, filters: DataFrame, num_bits: int) -> DataFrame:
    return unpacked(packed_pair(packed(a), packed(b), filters, num_bits, lambda x, y: x | ~y))


def directory(maps: DataFrame) -> DataFrame:
    """Bitmaps with ``before``: how many bits are set in the filter's buckets before. A row
    per bucket is all that is put in order; inside a bucket the bitmap tells the rest."""
    running = F.sum(F.bitmap_count("bitmap")).over(W.partitionBy("filter").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    return maps.withColumn("before", F.coalesce(running, F.lit(0)))


def minus(x: str, y: str) -> Column:
    """The bits of a bitmap that another one lacks."""

    @F.arrow_udf("binary")
    def of(xs: pa.Array, ys: pa.Array) -> pa.Array:
        pairs = zip(xs.to_pylist(), ys.to_pylist(), strict=True)
        return pa.array([(np.frombuffer(a, np.uint8) & ~np.frombuffer(b, np.uint8)).tobytes() for a, b in pairs], pa.binary())

    return of(x, y)


def ranks(bits: DataFrame) -> DataFrame:
    """filter, pos, rank: set bits before each set bit, by the two-level directory."""
    return _ranked(directory(packed(bits)))


def _ranked(listed: DataFrame) -> DataFrame:
    each = listed.select("filter", "before", "bucket", F.posexplode(set_bits(F.col("bitmap"))).alias("at", "bit"))
    return each.select("filter", ((F.col("bucket") - 1) * BLOCK + F.col("bit")).alias("pos"), (F.col("before") + F.col("at")).cast("long").alias("rank"))


def ranks_in(x: str, y: str) -> Column:
    """Of the set bits of bitmap x that y has, the number of bits of y before each."""

    @F.arrow_udf("array<int>")
    def of(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(xs.to_pylist(), ys.to_pylist(), strict=True):
            a, b = (np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little") for m in (a, b))
            out.append((np.cumsum(b, dtype=np.int32) - 1)[np.flatnonzero(a & b)])
        return pa.array(out, pa.list_(pa.int32()))

    return of(x, y)


def squeeze(bits: DataFrame, spec: DataFrame) -> DataFrame:
    """The bits at the positions of spec, moved together: their ranks in it, found bucket by bucket."""
    marked = directory(packed(spec)).withColumnRenamed("bitmap", "y")
    both = packed(bits).withColumnRenamed("bitmap", "x").join(marked, ["filter", "bucket"])
    return both.select("filter", "before", F.explode(ranks_in("x", "y")).alias("at")).select("filter", (F.col("before") + F.col("at")).cast("long").alias("pos"))


def unsqueeze(bits: DataFrame, spec: DataFrame) -> DataFrame:
    """Inverse of squeeze, zero elsewhere. A bucket of spec holds the ranks from its
    ``before`` on: it takes them from the one or two buckets of bits that have them."""
    marked = directory(packed(spec)).withColumn("n", F.bitmap_count("bitmap")).where("n > 0").withColumnRenamed("bitmap", "y")
    # ranks before .. before + n - 1 lie in these buckets of bits, numbered from 1
    wanted = F.explode(F.sequence(F.floor(F.col("before") / BLOCK) + 1, F.floor((F.col("before") + F.col("n") - 1) / BLOCK) + 1)).alias("from")
    needed = marked.select("filter", "bucket", "before", "y", wanted)
    both = needed.join(packed(bits).select("filter", F.col("bucket").alias("from"), F.col("bitmap").alias("x")), ["filter", "from"])

    @F.arrow_udf("array<int>")
    def placed(xs: pa.Array, ys: pa.Array, shift: pa.Array) -> pa.Array:
        out = []
        for x, y, s in zip(xs.to_pylist(), ys.to_pylist(), shift.to_pylist(), strict=True):
            rank, place = (np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")) for b in (x, y))
            rank = rank + s
            out.append(place[rank[(rank >= 0) & (rank < len(place))]].astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    shift = (F.col("from") - 1) * BLOCK - F.col("before")
    each = both.select("filter", "bucket", F.explode(placed("x", "y", shift.cast("long"))).alias("bit"))
    return each.select("filter", ((F.col("bucket") - 1) * BLOCK + F.col("bit")).alias("pos"))


def select0(bits: DataFrame, filters: DataFrame, num_bits: int) -> DataFrame:
    """filter, i, pos: the i-th clear position, from 0. Buckets are ranked, not positions."""
    clear = packed_pair(packed(bits), None, filters, num_bits, lambda x, y: ~x)
    return _ranked(directory(clear)).select("filter", F.col("rank").alias("i"), "pos")


def density(bits: DataFrame, num_bits: int) -> DataFrame:
    return bits.groupBy("filter").agg(F.count(F.lit(1)).alias("ones"), F.round(F.count(F.lit(1)) / num_bits, 6).alias("density"))


def kinds(bits: DataFrame, filters: DataFrame, num_bits: int) -> DataFrame:
    """filter, simplified: all-zeros, all-ones or none of them."""
    n = filters.select("filter").distinct().join(density(bits, num_bits), "filter", "left")
    ones = F.coalesce("ones", F.lit(0))
    return n.select("filter", F.when(ones == 0, "zeros").when(ones == num_bits, "ones").otherwise("mixed").alias("simplified"))


def integers(bits: DataFrame) -> DataFrame:
    """filter, positions: the set positions in order, as text."""
    return bits.groupBy("filter").agg(F.array_join(F.array_sort(F.collect_list("pos")), ",").alias("positions"))


def pair_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """filter with the sizes of and, mask, or, xor of two vectors; or-not is their complement."""
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["filter", "pos"], "full")
    n = lambda c: F.count_if(c).alias
    has_a, has_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.groupBy("filter").agg(n(has_a & has_b)("n_and"), n(has_a & ~has_b)("n_mask"), F.count(F.lit(1)).alias("n_or"), n(has_a != has_b)("n_xor"))


def packed(bits: DataFrame) -> DataFrame:
    """filter, bucket (from 1), bitmap: 32,768 bits a row. Buckets count from value 1, so positions are moved up by one."""
    value = F.col("pos") + 1
    return bits.groupBy("filter", F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bitmap"))


def packed_or(maps: DataFrame, by: Column) -> DataFrame:
    """Union of the bitmaps of the filters that share ``by``."""
    return maps.groupBy(by.alias("filter"), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def packed_and(maps: DataFrame, by: Column, members: DataFrame) -> DataFrame:
    """Intersection; members (filter, members) says how many filters share ``by``."""
    found = maps.groupBy(by.alias("filter"), "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("n"))
    return found.join(members, "filter").where("n = members").select("filter", "bucket", "bitmap")


def packed_sizes(maps: DataFrame) -> DataFrame:
    return maps.groupBy("filter").agg(F.sum(F.bitmap_count("bitmap")).alias("ones"))


def set_bits(bitmap: Column) -> Column:
    """The set bits of a bitmap, in order."""

    @F.arrow_udf("array<int>")
    def of(maps: pa.Array) -> pa.Array:
        found = [np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little")).astype(np.int32) for m in maps.to_pylist()]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))

    return of(bitmap)


def unpacked(maps: DataFrame) -> DataFrame:
    """filter, pos of bitmaps."""
    return maps.select("filter", "bucket", F.explode(set_bits(F.col("bitmap"))).alias("bit")).select("filter", ((F.col("bucket") - 1) * BLOCK + F.col("bit")).alias("pos"))


def buckets(filters: DataFrame, num_bits: int) -> DataFrame:
    """filter, bucket of each block of each filter."""
    last = -(-num_bits // BLOCK)
    return filters.select("filter").distinct().select("filter", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(last).cast("long"))).alias("bucket"))


def packed_pair(a: DataFrame, b: DataFrame | None, filters: DataFrame, num_bits: int, op) -> DataFrame:
    """Bitmaps of all buckets of the filters, from those of a (and b): ``op`` on arrays
    of bytes. Bits beyond num_bits stay clear."""
    empty = F.lit(bytes(BLOCK // 8))
    both = buckets(filters, num_bits).join(a.withColumnRenamed("bitmap", "x"), ["filter", "bucket"], "left").withColumn("x", F.coalesce("x", empty))
    if b is not None:
        both = both.join(b.withColumnRenamed("bitmap", "y"), ["filter", "bucket"], "left")
    both = both.withColumn("y", F.coalesce("y", empty) if b is not None else empty)

    @F.arrow_udf("binary")
    def of(xs: pa.Array, ys: pa.Array, bucket: pa.Array) -> pa.Array:
        out = []
        for x, y, k in zip(xs.to_pylist(), ys.to_pylist(), bucket.to_pylist(), strict=True):
            made = op(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
            left = num_bits - (k - 1) * BLOCK
            if left < BLOCK:
                made = np.packbits(np.unpackbits(made, bitorder="little") * (np.arange(BLOCK) < left), bitorder="little")
            out.append(made.tobytes())
        return pa.array(out, pa.binary())

    return both.select("filter", "bucket", of("x", "y", "bucket").alias("bitmap"))


def random_bits(filters: DataFrame, num_bits: int, density: float, seed: int = 0) -> DataFrame:
    """Bits set independently with a probability; the same for the same seed. How many of a
    block's bits are set is drawn from the binomial distribution, then which ones, so the
    work is as the bits that are set, not as the positions there are."""
    own = F.xxhash64(F.lit(seed), F.col("filter"), F.col("bucket"))

    @F.arrow_udf("array<int>")
    def drawn(seeds: pa.Array, bucket: pa.Array) -> pa.Array:
        out = []
        for s, b in zip(seeds.to_pylist(), bucket.to_pylist(), strict=True):
            rng, size = np.random.default_rng(s % (1 << 64)), min(BLOCK, num_bits - (b - 1) * BLOCK)
            out.append(np.sort(rng.choice(size, rng.binomial(size, density), replace=False, shuffle=False)).astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    each = buckets(filters, num_bits).select("filter", "bucket", F.explode(drawn(own, "bucket")).alias("bit"))
    return each.select("filter", ((F.col("bucket") - 1) * BLOCK + F.col("bit")).alias("pos"))


def random_exactly(filters: DataFrame, num_bits: int, ones: int, seed: int = 0) -> DataFrame:
    """Exactly so many random bits per filter, all sets alike: how many fall in each
    block is drawn first, then which ones, block by block."""
    sizes = [min(BLOCK, num_bits - at) for at in range(0, num_bits, BLOCK)]
    own = F.xxhash64(F.lit(seed), F.col("filter"))

    @F.arrow_udf("array<int>")
    def shares(seeds: pa.Array) -> pa.Array:
        drawn = [np.random.default_rng(s % (1 << 64)).multivariate_hypergeometric(sizes, ones, method="marginals") for s in seeds.to_pylist()]
        return pa.array([d.tolist() for d in drawn], pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def chosen(seeds: pa.Array, block: pa.Array, take: pa.Array) -> pa.Array:
        rows = zip(seeds.to_pylist(), block.to_pylist(), take.to_pylist(), strict=True)
        return pa.array([np.sort(np.random.default_rng([s % (1 << 64), b]).choice(sizes[b], t, replace=False)).tolist() for s, b, t in rows], pa.list_(pa.int32()))

    split = filters.select("filter").distinct().withColumn("own", own).select("filter", "own", F.posexplode(shares("own")).alias("block", "take"))
    each = split.select("filter", "block", F.explode(chosen("own", "block", "take")).alias("bit"))
    return each.select("filter", (F.col("block").cast("long") * BLOCK + F.col("bit")).alias("pos"))


# Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL, ONES = 0xEDB88320, 0xFFFFFFFF


def _times(a: int, b: int) -> int:
    """Product of two polynomials, reflected, modulo the checksum's."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def zeros_after(n: int) -> int:
    """What a checksum is multiplied with for n bytes of zeros behind it."""
    power, out = 1 << 23, 1 << 31  # x to the 8th, and 1
    while n:
        if n & 1:
            out = _times(out, power)
        power = _times(power, power)
        n >>= 1
    return out


def checksums(maps: DataFrame, num_bits: int) -> DataFrame:
    """filter, crc: the checksum of each filter's bytes, a byte's first position in its
    highest bit. Checksums are linear: each bucket's is moved by the bytes behind it,
    and the buckets' add up; no filter is gathered."""
    total = -(-num_bits // 8)

    @F.arrow_udf("long")
    def moved(bitmap: pa.Array, bucket: pa.Array) -> pa.Array:
        out = []
        for m, k in zip(bitmap.to_pylist(), bucket.to_pylist(), strict=True):
            turned = np.packbits(np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little")).tobytes()[: total - (k - 1) * (BLOCK // 8)]
            # started with zero and not inverted: zlib inverts before and after
            raw = zlib.crc32(turned, ONES) ^ ONES
            out.append(_times(raw, zeros_after(max(0, total - k * (BLOCK // 8)))))
        return pa.array(out, pa.int64())

    return maps.groupBy("filter").agg(F.bit_xor(moved("bitmap", "bucket")).alias("crc"))
