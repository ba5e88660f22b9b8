"""Conversations in order, and the checksum that their queries draw from.

The order within a conversation is by turn (null first), then role, then text (its
first 64 characters, then its hash), so ties have one order. Rows are dealt by ranges
of that order, not by conversation: one with a third of all rows is spread over many
tasks like any others, and so are rows that repeat each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.workspace import written

ROW_BITS = 33


def checksum(text: Column) -> Column:
    """The unsigned CRC-32 of a text."""
    return F.crc32(text.cast("binary"))


def in_order(rows: DataFrame, keep: dict[str, Column], tag: str) -> DataFrame:
    """conv_id, pos and the columns ``keep`` of each row, written: pos grows along
    the conversations and their turns, and pos >> ROW_BITS is the part of the table
    that the row is in."""
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text"), F.col("uid")]
    sorted_rows = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(sorted_rows.select("conv_id", F.monotonically_increasing_id().alias("pos"), *[c.alias(n) for n, c in keep.items()]), tag)


def part(pos: Column) -> Column:
    return F.shiftright(pos, ROW_BITS)


def places(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``in_order``) with ``at``, their place in the conversation from 0, and
    ``turns``, how many it has. A part's rows of a conversation follow one another, so
    places are told from the first one's and the number of those in the parts before."""
    here = rows.withColumn("part", part(F.col("pos")))
    runs = here.groupBy("conv_id", "part").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))
    # a row per part that a conversation is in
    whole = W.partitionBy("conv_id")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select("conv_id", "part", "start", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("turns"))
    return here.join(runs, ["conv_id", "part"]).withColumn("at", F.col("pos") - F.col("start") + F.col("before")).drop("part", "start", "before")


#: CRC-32 in SQL, of the text in place of {}.
CRC_SQL = """xor(CAST(4294967295 AS BIGINT), list_reduce(list_transform(range(1, length({0}) + 1), lambda i: CAST(ord({0}[i:i]) AS BIGINT)),
    lambda c, b: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), CAST(4294967295 AS BIGINT)))"""
