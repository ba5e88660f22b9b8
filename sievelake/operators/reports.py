"""Results as people read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_results(abundances: DataFrame, numbers: DataFrame) -> DataFrame:
    """strain, pct, names: the percentage cut to a whole number; a merged name
    (numbers between underscores) is spelled out, a single name stays as it is."""
    strain = F.col("strain").cast("string")
    merged = F.regexp_like(F.regexp_replace(strain, "_", ""), F.lit("^[0-9]+$"))
    parts = abundances.select(strain.alias("strain"), (F.col("abundance") * 100).cast("int").alias("pct"), F.when(merged, F.filter(F.split(strain, "_"), lambda p: p != "")).alias("parts"))
    each = parts.select("strain", "pct", F.posexplode_outer("parts").alias("at", "number"))
    named = each.join(numbers.select(F.col("number").cast("string").alias("number"), "name"), "number", "left")
    listed = named.groupBy("strain", "pct").agg(F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("at", "name")))).alias("n"))
    return listed.select("strain", "pct", F.when(F.size("n") > 0, F.array_join(F.transform("n", lambda x: x["name"]), " , ")).otherwise(F.col("strain")).alias("names"))


def read_summary(reads: DataFrame, kept: DataFrame, newline: bool = False) -> DataFrame:
    """Numbers and mean lengths (cut) of the reads before and after filtering."""
    extra = int(newline)
    all_of = reads.agg(F.count(F.lit(1)).alias("reads"), F.floor(F.avg(F.char_length("seq") + extra)).alias("mean_length"))
    left = kept.agg(F.count(F.lit(1)).alias("kept"), F.floor(F.avg(F.char_length("seq") + extra)).alias("kept_mean_length"))
    return all_of.join(left)


def sequence_lengths(rows: DataFrame) -> DataFrame:
    """strain, length, n_seq from (strain, seq)."""
    return rows.groupBy("strain").agg(F.sum(F.char_length("seq")).alias("length"), F.count(F.lit(1)).alias("n_seq"))
