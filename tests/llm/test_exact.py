import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import exact


def brute(rows):
    """(doc_id, keep_id, size, kept, digest) of (doc_id, text) rows, in order."""
    texts = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    by = collections.defaultdict(list)
    for i, t in enumerate(texts):
        by[t].append(i)
    order = {t: min(members, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for t, members in by.items()}
    return [(d, rows[order[t]][0], len(by[t]), order[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, ((d, _), t) in enumerate(zip(rows, texts, strict=True))]


def counted(rows):
    return collections.Counter(map(tuple, rows))


def test_edge_cases(make):
    rows = [(4, "a  b"), (2, "a\tb"), (9, "a b "), (1, None), (7, ""), (3, " \n"), (5, "a b"), (5, "a b"), (None, "a b"), (None, "x"), (None, "x"), (8, "é" * 200_000), (6, "é" * 200_000), (-3, "a\x0bb"), (10, "a b")]
    docs = make([t for _, t in rows], ids=[i for i, _ in rows], extra=True)
    assert counted(exact.report(docs).collect()) == counted(brute(rows))
    kept = exact.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r[-1] for r in brute(rows)})
    assert kept.where("doc_id = -3").count() == 1 and kept.where("doc_id = 2").count() == 0


def test_empty_table(make):
    docs = make(["x"]).where("doc_id < 0")
    assert exact.report(docs).collect() == []
    assert exact.deduplicated(docs).collect() == []


@pytest.mark.parametrize("parts", [1, 5, 23])
def test_hot_text_over_many_partitions(spark, parts):
    """A third of all rows is one text."""
    rows = [(i, "hot  text" if i % 3 == 0 else f"t{i % 701}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
    from sievelake.workspace import written

    docs = written(docs, "test-hot")
    assert counted(exact.report(docs).collect()) == counted(brute(rows))


def test_nodes_without_runs(spark):
    """Few texts in many partitions: most nodes of the rounds get nothing."""
    from sievelake.workspace import written

    rows = [(i, f"t{i % 3}") for i in range(40)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id"), "test-few")
    found = exact.found(exact.digests(docs), 40, 2)
    assert sorted(r["group_size"] for r in found.collect()) == [13, 13, 14]


def test_tree_has_bounded_fan_in():
    for leaves in (1, 2, 3, 16, 17, 211, 100_000):
        steps = exact.levels(leaves)
        assert steps[-1] >= leaves
        assert all(b // a <= 16 for a, b in zip([1, *steps], steps, strict=False))


def test_merge_of_runs_and_blocks(spark, monkeypatch):
    """Runs cut into small blocks, held a few at a time, merge to the same groups."""
    monkeypatch.setattr(exact, "BLOCK", 7)
    monkeypatch.setattr(exact, "HELD", 40)
    rng = np.random.default_rng(0)
    e = np.zeros(5000, exact.ENTRY)
    pool = np.array([hashlib.sha256(str(i).encode()).digest() for i in range(700)], "S32")
    e["digest"], e["id"], e["uid"], e["size"] = pool[rng.integers(0, 700, 5000)], rng.integers(0, 50, 5000), np.arange(5000), 1
    whole = exact.run_of(e)
    parts = exact.all_merged([exact.run_of(p) for p in np.array_split(e, 13)])
    assert (whole == parts).all() and whole["size"].sum() == 5000
    got = [b for b in exact._sent(whole, 0, 16, 16)]
    assert sum(len(np.frombuffer(x.as_py(), exact.ENTRY)) for b in got for x in b.column(2)) == len(whole)
    rows = spark.createDataFrame([(i, f"t{i % 97}") for i in range(1000)], "doc_id long, text string").repartition(6, "doc_id")
    from sievelake.workspace import written

    docs = written(rows, "test-blocks")
    assert counted(exact.report(docs).collect()) == counted(brute([(i, f"t{i % 97}") for i in range(1000)]))


def test_digests_that_end_in_zeros():
    e = np.zeros(2, exact.ENTRY)
    e["digest"] = [b"\1" + b"\0" * 31, b"\1\2" + b"\0" * 30]
    assert exact._result(e).column(0).to_pylist() == [b"\1" + b"\0" * 31, b"\1\2" + b"\0" * 30]
    assert exact._key(e[0]) == b"\1" + b"\0" * 31


def test_other_lengths_are_an_error():
    e = np.zeros(2, exact.ENTRY)
    e["digest"], e["bytes"] = b"x", [1, 2]
    with pytest.raises(ValueError):
        exact.run_of(e)
    with pytest.raises(ValueError):
        exact.merged(e[:1], e[1:])


def test_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert counted(exact.report(docs).collect()) == counted(brute(rows))
    assert exact.report(docs).where(~F.col("kept")).count() > 0
