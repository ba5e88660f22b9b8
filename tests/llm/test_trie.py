import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from sievelake.llm import trie
from sievelake.workspace import written

TURNS = "conv_id long, turn long, role string, text string"


def sequences(rows, shared=True):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    plain = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    if not shared:
        return plain
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in plain}
    return {c: plain.get(c - c % 100, [])[: h[c]] + own[h[c] :] for c, own in plain.items()}


def brute(seqs):
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    out = []
    for key, cs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        leaves = sum(children[k] == 0 for k in below)
        saved = sum((len(members[k]) - 1) * (len(k[-1][1]) if k else 0) for k in below)
        ends = ",".join(map(str, sorted(c for c in cs if len(seqs[c]) == len(key))))
        out.append((min(cs), len(key), min(members[key[:-1]]) if key else None, len(cs), children[key], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def noise(seed, n, longest):
    rng = random.Random(seed)
    texts = ["a", "b", None, "", "long text é"]
    ids = rng.sample([*range(0, 400), 1000, 1100, 1101], n)
    return [(c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in ids for t in range(rng.randint(1, longest))] + [(None, 0, "user", "x")]


def frame(spark, rows):
    return written(spark.createDataFrame(rows, TURNS).repartition(4), "test-trie")


@pytest.mark.parametrize("limit", [None, 40, 3])
def test_brute_force(spark, limit):
    """In a task, and by rounds of jobs until components are small, or single nodes."""
    rows = noise(4, 90, 6)
    assert got(trie.report(frame(spark, rows), limit)) == brute(sequences(rows))


def test_own_turns_only(spark):
    rows = noise(8, 60, 5)
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(sequences(rows, shared=False))


def test_hot_conversation_and_deep_chain(spark):
    """A third of all conversations are alike, and one is hundreds of turns deep."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "same" if c % 3 == 0 else f"{c % 5} {t}") for c in range(240) for t in range(4)]
    rows += [(5000, t, "user", str(t)) for t in range(300)]
    assert got(trie.report(frame(spark, rows), 2000)) == brute(sequences(rows))


def test_edges(spark):
    rows = [(7, 0, "user", "x" * 200_000), (8, None, None, None), (8, None, None, None), (2, 3, "user", "late"), (2, 1, "user", "soon")]
    from pyspark.sql import functions as F

    table = frame(spark, rows)
    for name in ("key", "depth", "at", "pos", "uid", "token"):
        table = table.withColumn(name, F.lit("clash"))
    assert got(trie.report(table)) == brute(sequences(rows))
    assert trie.report(table.where("conv_id = 99")).collect() == []


def test_rolled_up_forests():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 500, 3000):
        for deep in (False, False, True):
            parent = np.array([-1 if rng.random() < 0.1 or not i else (i - 1 if deep else rng.integers(max(0, i - 9), i)) for i in range(n)])
            values = rng.integers(0, 100, (n, 2))
            sums, weight = values.copy(), np.ones(n, np.int64)
            for i in range(n - 1, 0, -1):
                if parent[i] >= 0:
                    sums[parent[i]] += sums[i]
                    weight[parent[i]] += weight[i]
            shuffled = rng.permutation(n)
            place = np.argsort(shuffled)
            own = np.where(parent[shuffled] >= 0, place[parent[shuffled]], -1)
            assert (trie.rolled_up(own, weight[shuffled], values[shuffled]) == sums[shuffled]).all()


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    made = trie.report(spark.read.parquet(f"{sf}/conversations.parquet"))
    want = con.sql(trie.sql())
    assert want.columns == made.columns
    assert got(made) == sorted(want.fetchall(), key=str)
