"""Filters kept as tables: one row per filter with its parameters, one per set bit.

Bits are partitioned by filter, so reading one filter, or its parameters alone,
touches only its own files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.operators import sketches

PARAMETERS = ["kind", "k", "num_hashes", "seed1", "seed2", "modulus", "num_bits"]
SCHEMA = "filter string, kind string, k int, num_hashes int, seed1 long, seed2 long, modulus long, num_bits long, set_size long"


def save(filters: DataFrame, bits: DataFrame, path: str) -> None:
    """Writes (filter, parameters) and (filter, bv, pos); bv is the number of a node's vector."""
    filters.write.mode("append").parquet(f"{path}/filters")
    bits.withColumn("bv", F.lit(0) if "bv" not in bits.columns else F.col("bv")).repartition("filter").write.mode("append").partitionBy("filter").parquet(f"{path}/bits")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """filters and bits; filters of differing parameters are an error."""
    filters = spark.read.parquet(f"{path}/filters")
    wrong = [r["parameter"] for r in sketches.consistent(filters, PARAMETERS).collect()]
    if wrong:
        raise ValueError(f"filters differ in {', '.join(sorted(wrong))}")
    twice = filters.groupBy("filter").count().where("count > 1").select("filter").limit(1).collect()
    if twice:
        raise ValueError(f"two filters are named {twice[0][0]}")
    return filters, spark.read.schema("pos long, bv int, filter string").parquet(f"{path}/bits")


def like(filters: DataFrame, name: str) -> dict:
    """The parameters of a filter, to make others the same way."""
    row = filters.where(F.col("filter") == name).select(*PARAMETERS).first()
    if row is None:
        raise ValueError(f"no filter {name}")
    return row.asDict()


def save_matrix(matrix: DataFrame, path: str) -> None:
    """Writes lines of numbers (i, row), in the order of i within each file."""
    matrix.repartitionByRange("i").sortWithinPartitions("i").select("row").write.mode("append").text(path)


def parse_matrix(rows: DataFrame) -> DataFrame:
    """i, j, dist from numbered lines (line_no, value) of numbers."""
    cells = rows.select(F.col("line_no").alias("i"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("j", "dist"))
    return cells.select("i", "j", F.col("dist").cast("double").alias("dist"))
