"""Tables, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='sievelake-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, tag: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_dir(spark)}/sievelake/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and
    survives the loss of any executor, and is computed once however often it is read."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str, *order: Column) -> DataFrame:
    """``df`` with the number of each row, from 0 without gaps, in the given order, written.

    Rows are dealt and sorted by ranges of the order; what is added up over all is how many
    rows each range has, a row per partition."""
    own = f"{column}_in_part"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id())
    placed = written(ranged, "numbered").withColumn(f"{own}_of", F.shiftright(own, 33))
    parts = placed.groupBy(f"{own}_of").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(f"{own}_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(f"{own}_of", before.alias(f"{own}_from"))
    number = F.col(own) - F.shiftleft(F.col(f"{own}_of"), 33) + F.col(f"{own}_from")
    return placed.join(F.broadcast(starts), f"{own}_of").withColumn(column, number).select(*df.columns, column)
