import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from texts, with ids from 0 and repartitioned files behind them."""
    from sievelake.workspace import written

    def frame(texts, ids=None, langs=None, extra=False):
        rows = [((ids[i] if ids else i), t, langs[i] if langs else "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("row", "fp", "shard", "slot", "hits", "terms", "digest", "bits", "size", "key"):
                df = df.withColumn(name, F.lit(name))
        return written(df.repartition(3, "doc_id"), "test-docs")

    return frame


@pytest.fixture(scope="session")
def real(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()]
