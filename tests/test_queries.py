"""Every query with SQL against DuckDB, the others for rows."""

import glob
import os

import duckdb
import pytest

from sievelake.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(frame):
    columns = sorted(frame.columns)
    for c in columns:  # whole numbers with nulls come as floats or as integers
        if frame[c].isna().any() and frame[c].dtype == float and (frame[c].dropna() % 1 == 0).all():
            frame[c] = frame[c].astype("Int64")
    return frame[columns].astype(str).replace({"None": "nan", "<NA>": "nan"}).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, con):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLES:
        want = con.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got).equals(plain(want))
    else:
        assert len(got) > 0


def test_strands_hash_alike(spark, sf):
    assert [r["same"] for r in registry.QUERIES["strand_symmetric_hashes"](spark, sf).collect()] == [True]


def test_no_false_negatives(spark, sf):
    """A k-mer filter holds every k-mer that went into it."""
    from pyspark.sql import functions as F

    from sievelake.operators import sketches

    counts = sketches.kmer_counts(registry.texts(spark, sf, "benchmark", "item_id"), F.col("seq"), 15)
    bits = sketches.kmer_filter(counts, 15, 1 << 16, 1 << 16, 3)
    assert sketches.contains(counts, bits, 15, 1 << 16, 3).where("NOT present").count() == 0
