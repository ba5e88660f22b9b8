import re

import corpus_pipeline
from sievelake.workspace import written

from tests.llm.test_pii import brute
from tests.llm.test_rest import brute_leaks
from tests.llm.test_simhash import sets_of


def test_stages_act_and_keep(spark, sf, real):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict((i, t) for i, t, _ in real)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = written(stage(spark, docs, sf), "stage")
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        kept = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "language_id":
            gone = set(before) - set(kept)
            assert gone >= {i for i, t in before.items() if not re.search(r"[^\W\d_]", t or "")} and len(gone) <= 0.05 * len(before)
        elif name == "simhash_near_dedup":
            group, own = {i: i for i in before}, {i: sets_of(t) for i, t in before.items()}
            for i in sorted(before):
                for j in before:
                    if j < i and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                        low, high = sorted((group[i], group[j]))
                        group = {k: low if g == high else g for k, g in group.items()}
            lowest = set(group.values())
            assert set(kept) >= lowest and len(set(kept) - lowest) <= max(1, 0.1 * (len(before) - len(lowest)))
        elif name == "benchmark_decontamination":
            ids = sorted(before)
            assert set(before) - set(kept) == {ids[d] for d, _ in brute_leaks([before[i] for i in ids], items)}
        else:
            assert set(kept) == set(before) and all(kept[i] == before[i] for i in before if not brute(before[i]))
            assert not any(s.startswith("email") for t in kept.values() for s in brute(t))
        docs = after
    out = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()} <= set(texts)


def test_empty_and_null_documents(spark, sf):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (2, "", "en", None, 0), (3, "the and of that with", "en", "s", 20), (3, "the and of that with", "en", "t", 20), (None, "was for the other one here", "en", "s", 26), (None, "was for the other one here", "en", "s", 26)]):
        docs = spark.createDataFrame(rows, kind)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf), "stage")
        assert sorted(str(r["doc_id"]) for r in docs.collect()) == (["3", "None"] if rows else [])


def test_columns_of_any_name(spark, sf):
    """Columns that are named like those of the operators come out as they went in."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("score", "hits", "own_id", "rejected", "lang_pred", "row", "uid", "fp0", "root", "first", "bits", "size", "each", "digest", "terms", "removed", "s"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    docs = written(docs, "named")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, sf), "stage")
        assert after.schema.simpleString() == docs.schema.simpleString()
        assert after.where(" OR ".join(f"`{c}` IS NULL OR `{c}` <> concat('{c}', doc_id)" for c in docs.columns[5:])).count() == 0
        docs = after


def test_rows_that_share_an_id(spark, sf):
    """Rows of one id with different texts are different documents; copies and near copies aren't."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(2, a), (3, a), (3, b), (4, c), (4, d), (4, d), (4, d.upper()), (5, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, sf).collect()
    assert sorted((r["doc_id"], r["text"].lower()) for r in kept) == [(2, a), (3, b), (4, c), (4, d)]
