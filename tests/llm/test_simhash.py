import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sievelake.llm import simhash


def brute_fingerprint(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_documents(make, real):
    texts = [t for _, t, _ in real] + [None, "", "one", "Two WORDS", real[0][1], real[0][1] + " tail"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(make(texts, extra=True)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    roots, low = brute_roots(set(fps)), {}
    for i, f in enumerate(fps):
        low.setdefault(roots[f], i)
        assert got[i]["fingerprint"] == f"{f:016x}"
    assert all(got[i]["component_id"] == low[roots[f]] for i, f in enumerate(fps))


def test_dense_cluster_over_many_cells(spark):
    rng, fps = random.Random(1), set()
    base = rng.getrandbits(64)
    while len(fps) < 400:  # a large group around one fingerprint, chains, and strangers
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 6]))))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(f, f) for f in signed], "fp0 long, node long").repartition(3)
    for parts, cell in ((4, 8), (4, 4096), (3, 50), (2, 4096)):
        links = simhash.links(frame, simhash.Plan(64, parts, 3 - parts + 1, 3), len(fps), cell=cell)
        assert links.count() <= 40 * len(fps)
        from sievelake.operators.graphs import components

        found = {r["node"] % (1 << 64): r["root"] for r in components(links).collect()}
        groups, want = {}, {}
        for f, root in brute_roots(fps).items():
            want.setdefault(root, set()).add(f)
            groups.setdefault(found.get(f, ("alone", f)), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_thresholds_add_up_and_avoid_crowds():
    counts = np.ones((4, 1 << 16), np.int64)
    counts[0, 7] = 10**6
    index = simhash.Index(simhash.Plan(64, 4, 0, 3), list(np.arange(64).reshape(4, 16)), counts, 10**6, 4096)
    t = index.thresholds(np.array([[7, 1, 2, 3], [50000, 1, 2, 3]]))
    assert t.sum(axis=1).tolist() == [0, 0] and t[0, 0] == -1 and t[1].tolist() == [0, 0, 0, 0]


def test_plans_follow_the_number():
    parts = [simhash.whole_plan(n).parts for n in (10, 10**6, 10**8, 10**10)]
    assert parts[0] == 4 and parts == sorted(parts, reverse=True) and parts[-1] == 2
    for n in (10, 10**6, 10**9):
        plan = simhash.whole_plan(n)
        assert plan.sum == 3 - plan.parts + 1 and sum(plan.widths()) == 64
        assert simhash.likely_plan(n, 192, 0.1515, 42, 0.9).parts * 12 <= 192


def test_forest_of_the_lightest():
    rng = np.random.default_rng(2)
    pairs, weights = rng.integers(0, 60, (300, 2)), rng.integers(0, 9, 300)
    pairs, weights = pairs[pairs[:, 0] != pairs[:, 1]], weights[pairs[:, 0] != pairs[:, 1]]
    parent, want = list(range(60)), []
    for i in np.lexsort((np.arange(len(pairs)), weights)).tolist():
        x, y = pairs[i].tolist()
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        if x != y:
            parent[x] = y
            want.append(i)
    assert sorted(simhash.connect(pairs, weights).tolist()) == sorted(want)


def sets_of(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_similar_texts(make, real):
    """Copies with a few other words are found, texts below the similarity stay."""
    rng = random.Random(8)
    base = [t for _, t, _ in real if t and 60 <= len(t.split()) <= 400][:60]
    texts, origin = [], []
    for i, t in enumerate(base):
        for edits in (0, 1, 2, 4):
            words = t.split()
            for at in rng.sample(range(len(words)), edits * len(words) // 200 + (edits > 0)):
                words[at] = f"new{rng.random()}"
            texts.append(" ".join(words))
            origin.append(i)
    texts += [None, "", "", "one two", "one two", "ONE  two", "x " * 30000]
    kept = {r["doc_id"] for r in simhash.first_of_each_group(make(texts, extra=True)).collect()}
    own = list(map(sets_of, texts))
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    similar = lambda i, j: jaccard(own[i], own[j]) >= 0.8
    # whoever goes has a chain of similar texts to one that stays
    n, parent = len(texts), list(range(len(texts)))
    for i in range(n):
        for j in range(i):
            if similar(i, j):
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    assert {parent[i] for i in range(n)} == {parent[i] for i in kept}  # no group is lost
    extra = [i for i in kept if parent[i] != i]
    assert len(extra) <= 0.1 * sum(parent[i] != i for i in range(n))
    assert n - 1 in kept and sorted(kept)[-3:] == [n - 7, n - 4, n - 1]


def test_groups_of_copies_at_the_threshold(make):
    """Copies at a similarity of 0.80 to 0.85 to a text, and less to each other, go with
    it: at least 0.9 of them, alone or in groups of 6 and 20."""
    rng = random.Random(21)
    for copies, words, groups in ((1, 200, 60), (5, 200, 20), (19, 200, 8), (19, 900, 5)):
        texts, of = [], []
        for g in range(groups):
            base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
            own = sets_of(" ".join(base))
            texts.append(" ".join(base))
            of.append(g)
            while of.count(g) <= copies:
                changed = list(base)
                for at in rng.sample(range(2, words - 2), round(words * 0.021)):
                    changed[at] = f"n{rng.random()}"
                likeness = len(own & (new := sets_of(" ".join(changed)))) / len(own | new)
                if 0.80 <= likeness <= 0.85:
                    texts.append(" ".join(changed))
                    of.append(g)
        kept = [r["doc_id"] for r in simhash.first_of_each_group(make(texts)).collect()]
        assert {of[i] for i in kept} == set(range(groups))
        gone = len(texts) - len(kept)
        assert gone >= 0.9 * groups * copies, (copies, words, gone / (groups * copies))


def test_sketches():
    rng = np.random.default_rng(4)
    for n, exact in ((0, True), (40, True), (250, True), (3000, False)):
        h = rng.integers(1, 1 << 63, n, np.uint64)
        a, b = simhash.sketch(h), simhash.sketch(np.concatenate([h[: n * 9 // 10], rng.integers(1, 1 << 63, n // 10, np.uint64)]))
        like, sure = simhash.likeness(a, b)
        assert sure == exact and len(a) <= 1 + 4 * simhash.SKETCH
        want = (n * 9 // 10) / (n + n // 10 + (n - n * 9 // 10 - n // 10)) if n else 1.0
        assert abs(like - want) <= (0.02 if exact else 0.1)


def test_thresholds_are_free_in_two_partitions():
    """At 10^9 fingerprints, two partitions and a sum of 2: a value one bit away from a
    crowd doesn't look that far, at the cost of a wider look in the other partition."""
    n = 10**9
    counts = np.full((2, 1 << 16), n >> 16, np.int64)
    crowd = 7
    cell = int(simhash.hashed(np.array([crowd]), 1 << 16)[0])
    counts[0, cell] += 10**8
    index = simhash.Index(simhash.whole_plan(n), list(np.arange(64).reshape(2, 32)), counts, n, 4096)
    assert index.plan.parts == 2 and index.plan.sum == 2 and index.top == 2
    t = index.thresholds(np.array([[crowd ^ 1, 1], [crowd ^ 3, 1], [12345, 1]]))
    assert t.tolist() == [[0, 2], [1, 1], [1, 1]]


def test_word_hashes(make):
    import pyarrow as pa

    texts = ["a b c d e f", "A b\tc  d\ne f ", None, "", " ", "a b", "b a", "é b c d e", "a b c d e"]
    h, bounds = simhash.shingle_hashes(pa.array(texts))
    lists = [h[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert list(map(len, lists)) == [2, 2, 0, 0, 0, 1, 1, 1, 1] and lists[0] == lists[1] and lists[5] != lists[6] and lists[0][0] == lists[8][0] != lists[7][0]
    for i in range(len(texts)):  # whatever the array is a part of
        assert simhash.shingle_hashes(pa.array(texts).slice(i, 1))[0].tolist() == lists[i]
    wide = simhash.wide_fingerprints(h, bounds)
    assert (wide[0] == wide[1]).all() and not wide[2:5].any() and (wide[5] != wide[6]).any()
    for w in range(3):
        own = simhash.mixed(h[:2] + np.uint64(w) * simhash.MIX) if w else h[:2]
        assert int(wide[0, w]) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in own) > 2)


def test_nulls_and_empty(make, spark):
    assert simhash.near_duplicates(make([])).count() == 0
    rows = simhash.near_duplicates(make(["a b c d", "a b c d", "x y z w"], ids=[5, None, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_no_similar_text_is_left(make):
    """Copies of every similarity around the threshold, repeats that hide in a fingerprint
    and texts that share frequent lines: exactly what brute force over all pairs keeps."""
    rng = random.Random(3)
    line = " ".join(f"common{i}" for i in range(12))
    texts = []
    for g in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([9, 40, 120, 300]))] + line.split() * (g % 3 == 0)
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 1, 4])):
            changed = list(base)
            for at in rng.sample(range(len(base)), max(1, round(len(base) * rng.choice([0.015, 0.02, 0.024])))):
                changed[at] = f"n{rng.random()}"
            texts.append(" ".join(changed))
    # one shingle repeated sets all bits of a fingerprint that counts repeats
    texts += ["x " * 500 + f"{a} b c d e f g h i j" for a in "pqr"] + ["x " * 500 + "one two three four five", "x " * 9]
    rng.shuffle(texts)
    own, parent = list(map(sets_of, texts)), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if parent[i] != parent[j] and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    kept = sorted(r["doc_id"] for r in simhash.first_of_each_group(make(texts)).collect())
    assert kept == sorted(set(parent))


def test_unconnected_sets_over_many_cells(make, spark):
    """Shingles of many texts are dealt over cells; pairs of one root don't come back."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([f"n{i}", *words[1:]]) for i in range(30)] + [" ".join([f"n{i}", f"m{i}", *words[:30]]) for i in range(30)]
    docs = make(texts).selectExpr("doc_id AS node", "text")
    import pyarrow as pa

    h, bounds = simhash.distinct_shingles(pa.array(texts))
    parity = [bytearray(p.tobytes()) for p in simhash.parities(h, bounds)]
    known = spark.createDataFrame([(i, i if i % 5 else 0, int(n), p) for i, (n, p) in enumerate(zip(np.diff(bounds), parity))], "node long, root long, size int, parity binary")
    root = [i if i % 5 else 0 for i in range(60)]
    want = {(i, j) for j in range(30) for i in range(j) if root[i] != root[j]}
    for cell in (4, 4096):
        got = [(r["a"], r["b"]) for r in simhash.unconnected(docs, known, 0.8, cell).collect()]
        assert len(got) == len(set(got)) and want <= set(got) and all(root[a] != root[b] for a, b in got)
    own = [set(h[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    for i in range(60):  # parities differ in no more bits than sets in shingles
        apart = sum(bin(x ^ y).count("1") for x, y in zip(parity[0], parity[i]))
        assert apart <= len(own[0] ^ own[i])


def test_rows_of_repeated_values():
    import pyarrow as pa

    rng = random.Random(6)
    for _ in range(50):
        values = sorted(rng.randrange(12) for _ in range(rng.randrange(15)))
        cuts = sorted(rng.randrange(len(values) + 1) for _ in range(4))
        parts = [list(enumerate(values))[a:b] for a, b in zip([0, *cuts], [*cuts, len(values)])]
        batches = [pa.RecordBatch.from_pydict({"v": pa.array([v for _, v in p], pa.int64()), "at": pa.array([i for i, _ in p], pa.int64())}) for p in parts]
        got = [r["at"] for b in simhash.repeated(iter(batches)) for r in b.to_pylist()]
        assert got == [i for i, v in enumerate(values) if values.count(v) > 1]


def test_unlike_long_texts_part_before_sets_meet(make, monkeypatch):
    """Long texts that share a rare line, nothing else, meet; their sets aren't joined for that."""
    rng = random.Random(12)
    lists = [[f"w{rng.randrange(10**9)}" for _ in range(1800)] for _ in range(12)]
    for i in range(12):
        for j in range(i):
            line = [f"l{i}x{j}x{k}" for k in range(40)]
            lists[i] += line
            lists[j] += line
    met, similar = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda near, *rest: (met.append(near.count()), similar(near, *rest))[1])
    kept = sorted(r["doc_id"] for r in simhash.first_of_each_group(make([" ".join(x) for x in lists])).collect())
    assert kept == list(range(12)) and sum(met) == 0, met


def test_long_parities(make, spark):
    """Bits that differ never outnumber the different shingles, and no similar pair is left out."""
    import pyarrow as pa

    rng = random.Random(7)
    base = [f"w{rng.randrange(10**9)}" for _ in range(2600)]
    texts = ["", "a b", *(" ".join(base[: n + 4] + [f"n{n}x{i}" for i in range(more)]) for n in (100, 130, 512, 600, 1020, 1100, 2050, 2500) for more in (0, n // 9, n // 4, n // 3))]
    h, bounds = simhash.distinct_shingles(pa.array(texts))
    own = [h[a:b] for a, b in zip(bounds, bounds[1:])]
    parity, sets = list(map(simhash.long_parity, own)), [set(x.tolist()) for x in own]
    assert all(8 * len(p) >= max(512, 4 * len(x)) for p, x in zip(parity, own))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    assert all(simhash.parities_apart(parity[i], parity[j]) <= len(sets[i] ^ sets[j]) for i, j in pairs)
    pairs = [(i, j) for i, j in pairs if 5 * min(len(own[i]), len(own[j])) >= 4 * max(len(own[i]), len(own[j]))]
    docs, near = make(texts).selectExpr("doc_id AS node", "text"), spark.createDataFrame([(i, j, 0) for i, j in pairs], "a long, b long, apart int")
    got = {tuple(r) for r in simhash.narrowed(near, docs, 0.8).collect()}
    jaccard = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in pairs}
    assert {p for p in pairs if jaccard[p] >= 0.8} <= got and all(jaccard[p] >= 0.7 for p in got)


def test_places_of_first_shingles():
    """From the first shingle that two sets share on, each has all that they share."""
    rng = np.random.default_rng(9)
    common = (np.arange(40, dtype=np.uint64), np.arange(40) % 7 + 4)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 200, rng.integers(1, 60)).astype(np.uint64)) for _ in range(6)]
        h, owner, at = simhash.first_shingles(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), common, 0.3)
        for i in range(6):
            assert at[owner == i].tolist() == list(range((owner == i).sum()))
            for j in range(i):
                both = set(sets[i].tolist()) & set(sets[j].tolist())
                x, y = ({int(s): int(k) for s, k in zip(h[owner == m], at[owner == m])} for m in (i, j))
                if len(both) >= 0.3 * len(set(sets[i].tolist()) | set(sets[j].tolist())):
                    assert any(min(len(sets[i]) - x[s], len(sets[j]) - y[s]) >= len(both) for s in x.keys() & y.keys())
