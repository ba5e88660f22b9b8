"""Tree topology files: pre-order lines, depth by stars, ``name`` or ``name[file]``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse(rows: DataFrame) -> DataFrame:
    """node, file, depth, preorder, parent, is_leaf from (source, line_no, value).

    A line deeper than its predecessor by more than one is an error. Several
    depth-0 lines are a forest: their parent is null."""
    order = W.partitionBy("source").orderBy("line_no")
    depth = F.char_length(F.regexp_extract("value", r"^(\**)", 1))
    text = F.regexp_replace("value", r"^\**", "")
    named = F.when(F.contains(text, F.lit("[")), F.substring_index(text, "[", 1)).otherwise(F.regexp_replace(text, r"\.bf$", ""))
    file = F.when(F.contains(text, F.lit("[")), F.regexp_extract(text, r"\[(.*)\]", 1)).otherwise(text)
    flat = rows.select("source", "line_no", depth.alias("depth"), named.alias("node"), file.alias("file"))
    before, after = F.lag("depth").over(order), F.lead("depth").over(order)
    checked = F.when(F.col("depth") > F.coalesce(before, F.lit(-1)) + 1, F.raise_error(F.concat(F.lit("depth jump at "), F.col("node")))).otherwise(F.col("depth"))
    flat = flat.select("source", "line_no", checked.alias("depth"), "node", "file", F.coalesce(after <= F.col("depth"), F.lit(True)).alias("is_leaf"))
    # the parent is the last line before that is one star less deep: the last line of each depth goes along
    deepest = flat.agg(F.max("depth")).first()[0] or 0
    last = F.array(*[F.last(F.when(F.col("depth") == d, F.col("node")), ignorenulls=True).over(order) for d in range(deepest + 1)])
    placed = flat.withColumn("last", last)
    return placed.select("source", "node", "file", "depth", F.col("line_no").alias("preorder"), F.when(F.col("depth") > 0, F.get("last", F.col("depth") - 1)).alias("parent"), "is_leaf")


def render(nodes: DataFrame, form: str = "names") -> DataFrame:
    """preorder, line: names, files or name[file]."""
    text = {"names": F.col("node"), "files": F.col("file"), "both": F.concat("node", F.lit("["), "file", F.lit("]"))}[form]
    return nodes.select("preorder", F.concat(F.repeat(F.lit("*"), F.col("depth")), text).alias("line"))


def siblings_packed(nodes: DataFrame) -> DataFrame:
    """parent, members: the files that are stored together, one group per parent."""
    return nodes.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("members"))
