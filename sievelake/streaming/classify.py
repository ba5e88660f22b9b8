"""Reads classified as they arrive, against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievelake.operators import containment


def classify(reads: DataFrame, bits: DataFrame, theta: float, sink, checkpoint: str) -> StreamingQuery:
    """Starts a query over a stream of (read, positions array): each micro-batch is a
    containment join with the index, handed to ``sink(matches, batch_id)``. A read
    comes whole in one row, so no state is kept between batches."""

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("read", F.explode("positions").alias("pos"))
        sink(containment.matches(containment.bags(rows, F.col("read"), F.col("pos")), bits, theta), batch_id)

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
