"""Rules that turn file and filter names into the names the tables are joined by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_filter_suffix(name: Column) -> Column:
    """Without .bf, .unity, a codec and a kind of filter, each at most once and in that order from the end."""
    for suffix in (r"\.bf$", r"\.unity$", r"\.(rrr|roar)$", r"\.(allsome|det|detbrief)$"):
        name = F.regexp_replace(name, suffix, "")
    return name


def _before(name: Column, mark: str) -> Column:
    return F.substring_index(name, mark, 1)


def matrix_name(line: Column) -> Column:
    """Strain of a line of query results or of a filter list."""
    head = _before(line, ".bf")
    return (
        F.when(F.contains(line, F.lit(".fna")), _before(head, ".fna"))
        .when(F.contains(line, F.lit(".fasta")), _before(head, ".fasta"))
        .when(F.contains(line, F.lit(".bf")), head)
        .otherwise(_before(line, " "))
    )


def identification_name(name: Column) -> Column:
    head = _before(name, ".bf")
    return F.when(F.contains(head, F.lit(".fasta")), _before(head, ".fasta")).otherwise(_before(head, ".fna"))


def abundance_name(name: Column) -> Column:
    """For genome files: without the last dotted part and one trailing underscore."""
    genome = F.regexp_like(name, F.lit(r"\.fna|\.fasta"))
    return F.when(genome, F.regexp_replace(F.regexp_replace(name, r"(\.[^.]*)$", ""), "_$", "")).otherwise(name)


def without_two_parts(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*\.[^.]*$", "")


def genome_file(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"\.(fasta|fa|fna)$"))


def without_last_part(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def dashed(name: Column) -> Column:
    """The spelling that is tried if a name has no length of its own."""
    return F.translate(name, "_", "-")
