"""Results that go back to the rows they are about without moving these: rows of
``split`` (number of the input partition) and more columns are written by split, and
the task of a split reads its own. The input must give the same rows in the same
order each time it is computed (files do)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame


def write_by_split(rows: DataFrame, path: str, *order: str) -> None:
    rows.repartition("split").sortWithinPartitions("split", *order).write.partitionBy("split").parquet(path)


def of_split(path: str, split: int, *order: str) -> pa.Table | None:
    """What was written for a split, in order; None if nothing was."""
    store, root = fs.FileSystem.from_uri(path)
    folder = f"{root}/split={split}"
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return None
    files = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(store.open_input_file(f)) for f in files]).sort_by([(c, "ascending") for c in order]) if files else None
