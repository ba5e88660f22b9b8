"""Rows meet the decisions on their groups, however many rows a group has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many groups travel to every task at most.
HOT = 10_000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group: ``groups`` has a row per ``key`` and in
    ``size`` how many of the ``total`` rows have it.

    Groups of more than total / HOT rows number HOT at most, whatever the data, and
    are broadcast; the rest joins by key, and no key has more rows than that. Both
    tables are read twice and should be written ones."""
    limit = max(1, total // HOT)
    large, small = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    quick = rows.join(F.broadcast(large), key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key)
    return quick.unionByName(rest)
