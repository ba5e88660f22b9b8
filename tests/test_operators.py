import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.operators import bitmaps, containment, crossing, distances, graphs, identify, reports, sketches, trees
from sievelake.sources import sequence_files
from sievelake.streaming import classify


def bits(spark, sets):
    return spark.createDataFrame([(k, p) for k, ps in sets.items() for p in ps], "filter string, pos long")


def as_sets(frame, key="filter"):
    out = {}
    for r in frame.collect():
        out.setdefault(r[key], set()).add(r["pos"])
    return out


A, B, D = {1, 3, 5, 7}, {3, 5, 9}, set(range(16))


def test_bit_algebra(spark):
    a, b = bits(spark, {"x": A}), bits(spark, {"x": B})
    assert as_sets(bitmaps.and_(a, b))["x"] == A & B and as_sets(bitmaps.mask(a, b))["x"] == A - B
    assert as_sets(bitmaps.or_(a, b))["x"] == A | B and as_sets(bitmaps.xor(a, b))["x"] == A ^ B
    assert as_sets(bitmaps.not_(a, a, 16))["x"] == D - A and as_sets(bitmaps.eq(a, b, a, 16))["x"] == D - (A ^ B)
    assert as_sets(bitmaps.or_not(a, b, a, 16))["x"] == A | (D - B)
    squeezed = bitmaps.squeeze(b, a)
    assert as_sets(squeezed)["x"] == {1, 2} and as_sets(bitmaps.unsqueeze(squeezed, a))["x"] == A & B
    assert bitmaps.pair_counts(a, b).first()[1:] == (2, 2, 5, 3)
    assert [r["pos"] for r in bitmaps.select0(a, a, 16).orderBy("i").collect()] == sorted(D - A)
    all_of = bits(spark, {"a": A, "b": B, "d": D})
    kinds = {r[0]: r[1] for r in bitmaps.kinds(all_of, spark.createDataFrame([("a",), ("c",), ("d",)], ["filter"]), 16).collect()}
    assert kinds == {"a": "mixed", "c": "zeros", "d": "ones"}
    assert bitmaps.integers(a).first()["positions"] == "1,3,5,7"
    assert {r["ones"] for r in bitmaps.packed_sizes(bitmaps.packed(bits(spark, {"x": {0, 32767, 32768, 70000}}))).collect()} == {4}
    maps = bitmaps.packed(all_of)
    members = spark.createDataFrame([("g", 3)], "filter string, members long")
    assert bitmaps.packed_sizes(bitmaps.packed_and(maps, F.lit("g"), members)).first()["ones"] == 2
    exact = bitmaps.random_exactly(a, 100, 17, seed=2)
    assert exact.count() == 17 and sorted(exact.collect()) == sorted(bitmaps.random_exactly(a, 100, 17, seed=2).collect())


def test_distances(spark):
    all_of = bits(spark, {"a": A, "b": B, "d": D})
    filters = spark.createDataFrame([(f,) for f in "abcd"], ["filter"])
    pairs = distances.pair_sizes(all_of, filters)
    ham = {(r["i"], r["j"]): r["dist"] for r in distances.hamming(pairs, 16).collect()}
    assert len(ham) == 6 and ham["a", "b"] == 3 / 16 and ham["a", "c"] == 4 / 16
    theta = {(r["i"], r["j"]): r["theta"] for r in distances.theta(pairs).collect()}
    assert theta["a", "b"] == 0.5 and theta["b", "a"] == 0.6667 and theta["c", "a"] is None
    with pytest.raises(ValueError):
        distances.within(all_of, 3, 8)
    hist = distances.histogram(distances.hamming(pairs, 16), filters).collect()
    assert sum(r["n"] for r in hist) == 16


@pytest.mark.parametrize("seed", range(2))
def test_pairs_within_a_distance(spark, seed):
    """Equal to all pairs compared, with frequent positions, empty filters and small ones."""
    rng = random.Random(seed)
    sets = {f"f{i}": {0} | {rng.randrange(1, 400) for _ in range(rng.choice([0, 1, 3, 30]))} for i in range(40)}
    for i in range(40, 60):
        sets[f"f{i}"] = {p for p in sets[f"f{rng.randrange(40)}"] if rng.random() < 0.9}
    frame = bits(spark, sets).repartition(3)
    filters = spark.createDataFrame([(f,) for f in sets], ["filter"])
    apart = {(i, j): len(sets[i] ^ sets[j]) for i, j in itertools.combinations(sorted(sets), 2)}
    for most in (0, 2, 7, 200):
        got = {(r["i"], r["j"]): r["differing"] for r in distances.within_distance(frame, filters, most).collect()}
        assert got == {p: n for p, n in apart.items() if n <= most}
    assert distances.closest(frame, filters) == min(apart.values())


@pytest.mark.parametrize("theta", [0.3, 0.7])
def test_matches_where_most_reads_share_positions(spark, theta, monkeypatch):
    """Position 0 is in every filter and read, 1 to 4 in most: reads skip them where they
    may, and what a task gives out is far less than the shared positions."""
    rng = random.Random(9)
    sets = {f: {0} | {p for p in range(1, 5) if rng.random() < 0.9} | set(rng.sample(range(5, 3000), 20)) for f in range(200)}
    reads = {}
    for r in range(300):
        own = rng.sample(sorted(sets[rng.randrange(200)]), rng.randrange(1, 15)) + rng.sample(range(5, 3000), 3)
        reads[r] = {0: rng.randrange(1, 4), **{p: rng.randrange(1, 3) for p in own}}
    reads[300] = {0: 9}
    probes = spark.createDataFrame([(r, p, n) for r, ps in reads.items() for p, n in ps.items()], "read long, pos long, n long").repartition(4)
    frame = spark.createDataFrame([(f, p) for f, ps in sets.items() for p in ps], "filter long, pos long")
    want = {}
    for r, ps in reads.items():
        total = sum(ps.values())
        for f, own in sets.items():
            hits = sum(n for p, n in ps.items() if p in own)
            if hits and hits >= np.ceil(round(total * theta, 9)):
                want[r, f] = (hits, total)
    got = {(x["read"], x["filter"]): (x["hits"], x["total"]) for x in containment.matches(probes, frame, theta).collect()}
    assert got == want
    hot = {x["pos"] for x in containment.frequent(frame).collect()}
    assert 0 in hot and hot <= set(range(5))
    shared = sum(1 for ps in reads.values() for own in sets.values() for p in ps if p in own)
    found = containment.overlaps(probes, frame, containment.needed(F.col("total"), theta), lambda hits, total, need, size: hits >= need)
    if theta > 0.5:
        assert found.count() * 10 <= shared


def test_threshold_of_each_read(spark):
    probes = spark.createDataFrame([(r, p, 1) for r in (1, 2) for p in range(4)], "read long, pos long, n long")
    frame = bits(spark, {"a": {0, 1}, "b": {0, 1, 2}}).select("filter", "pos")
    theta = F.when(F.col("read") == 1, 0.5).otherwise(0.75)
    assert {(r["read"], r["filter"]) for r in containment.matches(probes, frame, theta).collect()} == {(1, "a"), (1, "b"), (2, "b")}


def test_numbered_rows_and_vector_names(spark):
    from sievelake.workspace import numbered

    rows = spark.createDataFrame([(i * 37 % 1000,) for i in range(1000)], "v long").repartition(7)
    assert {r["v"]: r["at"] for r in numbered(rows, "at", F.col("v")).collect()} == {v: v for v in range(1000)}
    assert numbered(rows.where("v < 0"), "at", F.col("v")).collect() == []
    parse = distances.parse_vector_name
    assert parse("a.bf") == ("a.bf", None, 0, None) and parse("a:rrr:8") == ("a", "rrr", 8, None)
    assert parse("a:raw:8..24") == ("a", "raw", 8, 24) and parse("a:raw:8:16") == ("a", "raw", 8, 24)
    for bad in ("a:rrr:8:16", "a:raw:9..3", "a:raw:x"):
        with pytest.raises(ValueError):
            parse(bad)


def test_matches(spark):
    index = bits(spark, {"p": range(0, 9), "q": range(0, 5), "r": range(20, 30)})
    rows = spark.createDataFrame([("r1", p) for p in range(10)] + [("r2", 100)], "read string, pos long")
    probes = containment.bags(rows, F.col("read"), F.col("pos"))
    found = containment.ranked(containment.matches(probes, index, 0.5))
    assert [(r["filter"], r["hits"], r["frac"]) for r in found.orderBy("place").collect()] == [("p", 9, 0.9), ("q", 5, 0.5)]
    assert {r["read"]: r["matches"] for r in containment.match_counts(found, probes).collect()} == {"r1": 2, "r2": 0}
    text = sequence_files.render_results(found.withColumnRenamed("filter", "leaf"), probes).orderBy("read").collect()
    assert [r["text"] for r in text] == ["*r1 2\np 9/10 0.900000\nq 5/10 0.500000", "*r2 0"]
    assert containment.all_counts(probes, index, index, 0.5).count() == 6
    assert containment.presence(probes, index, index).where("state = 'absent'").count() == 33 - 14


def random_tree(spark, rng, leaves, universe):
    names = [f"l{i}" for i in range(leaves)]
    sets = {n: {p for p in range(universe) if rng.random() < 0.5} for n in names}
    nodes, level = [(n, True) for n in names], list(names)
    parent = {}
    while len(level) > 1:
        size = rng.choice([2, 3])
        new = []
        for i in range(0, len(level), size):
            group = level[i : i + size]
            if len(group) == 1:
                new += group
                continue
            node = f"n{len(parent)}"
            parent |= dict.fromkeys(group, node)
            nodes.append((node, False))
            new.append(node)
        level = new
    depth = lambda n: 0 if n not in parent else 1 + depth(parent[n])
    rows = [(n, parent.get(n), depth(n), leaf) for n, leaf in nodes]
    return spark.createDataFrame(rows, "node string, parent string, depth int, is_leaf boolean"), sets, parent


def test_trees_agree_with_flat_join(spark):
    rng = random.Random(3)
    nodes, sets, parent = random_tree(spark, rng, 7, 40)
    leaf_bits = bits(spark, sets)
    inner = trees.cup_and_cap(nodes, leaf_bits).persist()
    below = {n: {leaf for leaf in sets if n in itertools.chain([leaf], path(leaf, parent))} for n in {*sets, *parent.values()}}
    union = as_sets(trees.build_union(inner), "node")
    common = as_sets(trees.build_intersection(inner), "node")
    det = {(r["node"], r["pos"]): r["how"] for r in trees.build_determined(nodes, inner).collect()}
    for n, leaves in below.items():
        assert union[n] == set.union(*(sets[x] for x in leaves)) and common.get(n, set()) == set.intersection(*(sets[x] for x in leaves))
    # a position read down to a leaf is resolved once on the way, and rightly
    root = next(n for n in below if n not in parent)
    for leaf, own in sets.items():
        for p in union[root]:
            seen = [det[n, p] for n in itertools.chain([leaf], path(leaf, parent)) if (n, p) in det]
            assert seen == [p in own]
    active = trees.squeezed(nodes, inner).groupBy("node").agg(F.max("slot").alias("top"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["top"] + 1 == r["n"] for r in active)
    rows = spark.createDataFrame([(f"r{i}", rng.randrange(60)) for i in range(40) for _ in range(6)], "read string, pos long")
    probes = containment.bags(rows, F.col("read"), F.col("pos"))
    flat = {(r["read"], r["filter"]) for r in containment.matches(probes, leaf_bits, 0.5).collect()}
    visited = trees.query(nodes, inner, probes, 0.5).collect()
    found = {(r["read"], leaf) for r in visited if r["outcome"] == "pass" for leaf in below[r["node"]]}
    assert found == flat and not [r for r in visited if r["outcome"] == "open" and r["node"] in sets]
    stored = trees.build_union(inner).where("NOT (node = 'l0')")
    assert {(r["problem"], r["node"]) for r in trees.violations(nodes, inner, stored).collect()} == {("not the union", "l0")}


def path(node, parent):
    while node in parent:
        node = parent[node]
        yield node


def binary_tree(rng, leaves, deep):
    """node -> parent of a binary tree; deep ones have a leaf at each level."""
    parent, tops = {}, [f"l{i}" for i in range(leaves)]
    for i in range(leaves - 1):
        a = tops.pop() if deep else tops.pop(rng.randrange(len(tops)))
        b = tops.pop(rng.randrange(len(tops)))
        parent[a] = parent[b] = f"n{i}"
        tops.append(f"n{i}")
    return parent | {tops[0]: None}


@pytest.mark.parametrize("deep", [False, True])
def test_deep_trees(spark, deep):
    """Unions, intersections, depths, statistics and both orders of a tree up to 100 levels deep."""
    rng = random.Random(deep)
    parent = binary_tree(rng, 100, deep)
    sets = {v: {p for p in range(60) if rng.random() < 0.8} | {40_000 + int(v[1:])} for v in parent if v[0] == "l"}
    nodes = trees.with_depth(spark.createDataFrame(list(parent.items()), "node string, parent string"))
    paths, kids = {}, {}
    for v in parent:
        paths[v] = [v]
        while parent[paths[v][-1]] is not None:
            paths[v].append(parent[paths[v][-1]])
        kids.setdefault(parent[v], []).append(v)
    assert {r["node"]: (r["depth"], r["is_leaf"]) for r in nodes.collect()} == {v: (len(p) - 1, v[0] == "l") for v, p in paths.items()}
    below = {v: [x for x in sets if v in paths[x]] for v in parent}
    got = {}
    for r in trees.cup_and_cap(nodes, bits(spark, sets)).collect():
        assert r["pos"] not in got.setdefault(r["node"], {})
        got[r["node"]][r["pos"]] = r["in_cap"]
    for v in parent:
        cup, cap = set.union(*(sets[x] for x in below[v])), set.intersection(*(sets[x] for x in below[v]))
        assert got[v] == {p: p in cap for p in cup}
    pre, post, waiting = [], [], [(min(kids[None]), False)]
    while waiting:
        v, left = waiting.pop()
        if left:
            post.append(v)
        else:
            pre.append(v)
            waiting += [(v, True), *((c, False) for c in sorted(kids.get(v, []), reverse=True))]
    found = {r["node"]: (r["preorder"], r["postorder"], r["depth"]) for r in trees.orders(nodes).collect()}
    assert found == {v: (pre.index(v), post.index(v), len(paths[v]) - 1) for v in parent}
    with pytest.raises(Exception, match="only child"):
        trees.without_only_children(spark.createDataFrame([("r", None), ("x", "r")], "node string, parent string")).collect()


def test_culling_of_chains(spark):
    """A chain of nodes that go hands its children up to the nearest that stays."""
    links = [("r", None)] + [(f"n{i}", f"n{i - 1}" if i else "r") for i in range(40)] + [(f"x{i}", f"n{i}") for i in range(40)]
    nodes = spark.createDataFrame([(v, p, 0, v[0] == "x") for v, p in links], "node string, parent string, depth int, is_leaf boolean")
    stays = {"r", "n7", "n30"}
    ratios = nodes.select("node", "is_leaf", F.when(F.col("node").isin(*stays), 1).otherwise(0).alias("det"), F.lit(1).alias("open_above"))
    got = {r["node"]: r["parent"] for r in trees.cull(nodes, ratios, spark.createDataFrame([(0.5,)], "threshold double")).collect()}
    up = lambda i: next((f"n{j}" for j in range(i, -1, -1) if f"n{j}" in stays), "r")
    assert got == {"r": None, "n7": "r", "n30": "n7"} | {f"x{i}": up(i) for i in range(40)}


def test_rank_directory(spark):
    """Rank, select, squeeze and its inverse over several blocks."""
    rng = random.Random(6)
    spec = {f: set(rng.sample(range(200_000), n)) for f, n in (("a", 90_000), ("b", 700), ("c", 1))}
    some = {f: set(rng.sample(sorted(ps), len(ps) // 3 + 1)) | {200_001} for f, ps in spec.items()}
    marked, frame = bits(spark, spec), bits(spark, some)
    order = {f: sorted(ps) for f, ps in spec.items()}
    assert {(r["filter"], r["pos"]): r["rank"] for r in bitmaps.ranks(marked).collect()} == {(f, p): i for f, ps in order.items() for i, p in enumerate(ps)}
    squeezed = bitmaps.squeeze(frame, marked)
    assert as_sets(squeezed) == {f: {i for i, p in enumerate(ps) if p in some[f]} for f, ps in order.items()}
    assert as_sets(bitmaps.unsqueeze(squeezed, marked)) == {f: some[f] & spec[f] for f in spec}


def test_random_bits_are_independent(spark):
    """Counts and places of random bits, by chi-square over places, and the same for the same seed."""
    filters = spark.createDataFrame([(i,) for i in range(40)], "filter long")
    drawn = bitmaps.random_bits(filters, 70_000, 0.02, seed=3)
    rows = [tuple(r) for r in drawn.collect()]
    assert len(set(rows)) == len(rows) and max(p for _, p in rows) < 70_000
    n = len(rows)
    assert abs(n - 40 * 1400) < 5 * (40 * 1400 * 0.98) ** 0.5
    cells = np.bincount([p // 700 for _, p in rows], minlength=100)
    assert ((cells - n / 100) ** 2 / (n / 100)).sum() < 160  # 99 degrees of freedom
    each = np.bincount([f for f, _ in rows], minlength=40)
    assert 15 < ((each - 1400) ** 2 / (1400 * 0.98)).sum() < 80  # 40 degrees of freedom
    assert sorted(rows) == sorted(tuple(r) for r in bitmaps.random_bits(filters.repartition(3), 70_000, 0.02, seed=3).collect())


def test_cluster_is_greedy(spark):
    rows = trees.cluster(bits(spark, {"a": {1, 2, 3}, "b": {1, 2, 4}, "c": {50, 51}, "d": {50, 51, 52}}), first_bits=100).collect()
    up = {r["node"]: r["parent"] for r in rows}
    assert up["c"] == up["d"] and up["a"] == up["b"] and up["c"] != up["a"] and len(rows) == 7
    with pytest.raises(ValueError):
        trees.cluster(bits(spark, {"a": {1}, "b": {2}}), max_filters=1)


def test_graphs(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (7, 8), (8, 7)], "a long, b long")
    groups = graphs.components(links)
    assert {(r["node"], r["root"]) for r in groups.collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (7, 7), (8, 7)}
    assert sorted(r["clique"] for r in graphs.maximal_cliques(links).collect()) == [[0, 1, 2], [2, 3], [7, 8]]
    names = graphs.merged_names(groups)
    assert {r["name"] for r in names.collect()} == {"0_1_2_3_", "7_8_"}
    assert {r["name"] for r in graphs.merged_names(spark.createDataFrame([(n, 3) for n in (3, 17, 50, 66, 52)], "node long, root long")).collect()} == {"17_3_50_52_66_"}
    lengths = spark.createDataFrame([(i, 10 + i) for i in range(9)], "strain long, length long")
    assert {r["name"]: r["length"] for r in graphs.merged_lengths(names, lengths).collect()} == {"0_1_2_3_": 11, "7_8_": 17}
    filters = spark.createDataFrame([(i,) for i in range(9)], "filter long")
    assert {r["filter"] for r in graphs.superseded(filters, names).collect()} == {4, 5, 6}


def test_disjoint_cliques(spark):
    def of(*pairs):
        return sorted(r["clique"] for r in graphs.disjoint_cliques(spark.createDataFrame(pairs, "a long, b long")).collect())

    assert of((0, 1), (1, 2), (2, 0), (2, 3), (7, 8), (8, 7), (9, 9)) == [[0, 1, 2, 3], [7, 8]]
    assert of((1, 0), (0, 2)) == [[0, 1, 2]]  # one common neighbour: as dense as can be
    assert of((0, 1), (1, 2), (2, 3)) == [[0, 1], [2, 3]]  # a chain of four falls apart where it is thin
    assert of((5, 5)) == []
    with pytest.raises(ValueError, match="max_nodes"):
        graphs.disjoint_cliques(spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"), max_nodes=2)


@pytest.mark.parametrize(("n", "m", "both"), [(3, 3, 1), (4, 3, 2), (3, 5, 1), (5, 5, 3), (2, 4, 1), (5, 4, 3)])
def test_smallest_cut(n, m, both):
    """No parting of two overlapping cliques' nodes cuts fewer edges."""
    one, other = set(range(n)), set(range(n - both, n - both + m))
    edges = {frozenset(p) for c in (one, other) for p in itertools.combinations(sorted(c), 2)}
    nodes = sorted(one | other)
    sides = [set(s) for k in range(1, len(nodes)) for s in itertools.combinations(nodes, k)]
    cut = {frozenset(p) for p in graphs.smallest_cut(one, other)}
    assert cut <= edges
    assert len(cut) == min(sum(len(e & s) == 1 for e in edges) for s in sides)
    assert any({e for e in edges if len(e & s) == 1} == cut for s in sides)


def brute_cliques(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    whole = [set(c) for k in range(2, len(near) + 1) for c in itertools.combinations(sorted(near), k) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
    return sorted(sorted(c) for c in whole if not any(all(v in near[u] for u in c) for v in set(near) - c))


@pytest.mark.parametrize("split", [2, 48])
def test_cliques_of_random_graphs(spark, split):
    rng = random.Random(split)
    for share in (0.2, 0.5, 0.9):
        links = [(a, b) for a, b in itertools.combinations(range(11), 2) if rng.random() < share]
        found = graphs.maximal_cliques(spark.createDataFrame(links, "a long, b long"), split).collect()
        assert sorted(r["clique"] for r in found) == brute_cliques(links)


def test_large_cliques_are_quick(spark):
    """60 close nodes, a hub of 2,000 and the complement of a matching."""
    import time

    links = list(itertools.combinations(range(60), 2)) + [(500, 1000 + i) for i in range(2000)]
    links += [(3000 + a, 3000 + b) for a, b in itertools.combinations(range(16), 2) if a // 2 != b // 2]
    began = time.time()
    found = [tuple(r["clique"]) for r in graphs.maximal_cliques(spark.createDataFrame(links, "a long, b long")).collect()]
    assert time.time() - began < 120
    assert len(found) == len(set(found)) == 1 + 2000 + 2**8 and tuple(range(60)) in found


def plain_settled(links, cutoff):
    """The decisions one by one, all cliques listed anew after each."""
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    before, merging = set(), False
    while True:
        edges = [(a, b) for a in near for b in near[a] if a < b]
        cliques = sorted(map(tuple, brute_cliques(edges)), key=lambda c: (-len(c), c))
        overlaps = [(c, d) for c, d in itertools.combinations(cliques, 2) if set(c) & set(d)]
        if not overlaps:
            return sorted(cliques)
        merging = merging or frozenset(edges) in before
        before.add(frozenset(edges))
        c, d = map(set, min(overlaps))
        around = near[min(c - d)] | near[min(d - c)]
        dense = sum(b in near[a] for a, b in itertools.combinations(around, 2))
        if merging or len(around) < 2 or 2 * dense / (len(around) * (len(around) - 1)) >= cutoff:
            for v in c | d:
                near[v] |= (c | d) - {v}
        else:
            for v, u in graphs.smallest_cut(c, d):
                near[v].discard(u)
                near[u].discard(v)


def test_merging_by_final_cliques(spark):
    """A chain of four is one component and two cliques: filters merge by clique."""
    rng = random.Random(2)
    chains = [(0, 1), (1, 2), (2, 3)] + [(10 * g + a, 10 * g + b) for g in range(1, 7) for a, b in itertools.combinations(range(7), 2) if rng.random() < 0.35]
    df = spark.createDataFrame(chains, "a long, b long")
    for cutoff in (0.01, 0.4):
        want = sorted(c for g in range(7) for c in plain_settled([(a, b) for a, b in chains if a // 10 == g], cutoff))
        groups = graphs.clique_groups(graphs.disjoint_cliques(df, cutoff))
        names_of = {r["name"]: r["members"] for r in graphs.merged_names(groups).collect()}
        assert names_of == {"_".join(sorted(map(str, c))) + "_": len(c) for c in want}
    groups = graphs.clique_groups(graphs.disjoint_cliques(df.where("a < 10")))
    sets = {v: {v, 100 + v // 2} for v in range(5)}
    assert as_sets(graphs.merged_bits(bits(spark, sets), groups), "root") == {0: sets[0] | sets[1], 2: sets[2] | sets[3]}
    lengths = spark.createDataFrame([(v, 10 + v * v) for v in range(4)], "strain long, length long")
    assert {(r["name"], r["length"]) for r in graphs.merged_lengths(graphs.merged_names(groups), lengths).collect()} == {("0_1_", 10), ("2_3_", 16)}
    filters = spark.createDataFrame([(v,) for v in range(6)], "filter long")
    assert sorted(r["filter"] for r in graphs.superseded(filters, graphs.merged_names(groups)).collect()) == [4, 5]


def test_random_cliques_end_disjoint(spark):
    rng = random.Random(5)
    links = [(base + a, base + b) for base in range(0, 120, 12) for a, b in itertools.combinations(range(12), 2) if rng.random() < 0.25]
    df = spark.createDataFrame(links, "a long, b long")
    for cutoff in (0.01, 0.4, 2.0):
        found = [r["clique"] for r in graphs.disjoint_cliques(df, cutoff).collect()]
        members = [v for c in found for v in c]
        assert len(members) == len(set(members)) and all(len(c) > 1 and c[0] // 12 == c[-1] // 12 for c in found)
        if cutoff > 1:  # nothing is merged but after a graph that came back
            assert len(found) > 10


def test_ranks(spark):
    found = spark.createDataFrame([("r", s, f) for s, f in (("s1", 0.9), ("s2", 0.8), ("s3", 0.8), ("s4", 0.6))], "read string, strain string, frac double")
    assert identify.rank_weights(found, 50, 3).count() == 0
    assert {r["strain"]: r["weight"] for r in identify.rank_weights(found, 50, 4).collect()} == {"s1": 2, "s2": 1, "s3": 1, "s4": 0}
    assert identify.ambiguous_reads(found, 50, 3).count() == 1


def brute_cover(ranks):
    reads, strains = {}, {}
    for r, s, w in ranks:
        reads.setdefault(r, {})[s] = w
        strains.setdefault(s, {})[r] = w
    n1, n2 = (len(reads) + 50) // 100, (sum(w for _, _, w in ranks) + 25) // 50
    marginal = {s for s, rs in strains.items() if len(rs) <= n1 or sum(rs.values()) <= n2}
    names, best = sorted(set(strains) - marginal), None
    for k in range(1, len(names) + 1):
        for chosen in itertools.combinations(names, k):
            if any(not set(ws) & {*chosen} for ws in reads.values() if not set(ws) & marginal):
                continue
            own = {s: [r for r in strains[s] if len(set(reads[r]) & {*chosen}) == 1] for s in chosen}
            if not all(own.values()):
                continue
            alone = {s: sum(strains[s][r] for r in own[s]) for s in chosen}
            signed = dict(alone)
            for ws in reads.values():
                both = [s for s in chosen if s in ws]
                if len(both) == 2:
                    for s, t in (both, both[::-1]):
                        if ws[s] > 1 and ws[s] > ws[t] and not alone[t]:
                            signed[s] += ws[s]
            support = {s: sum(strains[s].values()) for s in chosen}
            key = (-sum(support.values()), -sum(signed.values()), chosen)
            if best is None or key < best[0]:
                best = (key, {s: (support[s], signed[s]) for s in chosen})
        if best:
            return best[1]
    return {}


@pytest.mark.parametrize("seed", range(4))
def test_cover_is_the_best(spark, seed):
    rng = random.Random(seed)
    rows = [(r, f"s{s}", rng.randrange(4)) for r in range(60) for s in rng.sample(range(6), rng.choice([1, 2, 2, 3]))]
    got = identify.cover(spark.createDataFrame(rows, "read long, strain string, weight int"))
    assert {r["strain"]: (r["support"], r["signed"]) for r in got.collect()} == brute_cover(rows)


def test_cover_of_many_strains(spark):
    """Thirty strains, of which every other one has reads of its own: those cover all."""
    rows = [(r * 20 + i, f"s{s:02d}", 2) for r in range(15) for i in range(20) for s in ((2 * r, 2 * r + 1) if i % 2 else (2 * r,))]
    ranks = spark.createDataFrame(rows, "read long, strain string, weight int")
    assert {(r["strain"], r["support"], r["signed"]) for r in identify.cover(ranks).collect()} == {(f"s{2 * r:02d}", 40, 40) for r in range(15)}
    with pytest.raises(ValueError, match="max_shapes"):
        identify.cover(ranks, max_shapes=3)


def test_best_covers_are_those_of_brute_force(spark):
    from sievelake.operators import covers

    rng = random.Random(11)
    for _ in range(200):
        n = rng.randint(1, 9)
        need = [sorted(rng.sample(range(n), rng.randint(1, min(4, n)))) for _ in range(rng.randint(1, 9))]
        weights = [rng.randint(0, 3) for _ in range(n)]
        sets = [c for k in range(n + 1) for c in itertools.combinations(range(n), k) if all({*c} & {*g} for g in need)]
        size = min(map(len, sets))
        best = max(sum(weights[b] for b in c) for c in sets if len(c) == size)
        want = {c for c in sets if len(c) == size and sum(weights[b] for b in c) == best}
        groups, w = covers.reduced(need, weights)
        first = covers.greedy(groups, w)
        search, waiting = covers.Search(groups, w, len(first), sum(w[b] for b in first), 3), [([], [])]
        while waiting:  # a few steps at a time
            for chosen, banned in waiting:
                search.run(chosen, banned)
            waiting, search.open, search.budget = search.open, [], 3
        assert {tuple(sorted(c)) for c in search.best if len(c) == search.size} == want


def test_cover_of_real_size(spark):
    """79 strains, groups of two to a dozen, and covers of twelve strains: under a minute."""
    import time

    rng = random.Random(79)
    groups = set()
    for s in rng.sample(range(79), 12):  # present ones, each with close relatives
        near = rng.sample([x for x in range(79) if x != s], 25)
        groups |= {tuple(sorted([s, *rng.sample(near, rng.choice([1, 2, 3, 5, 8, 11]))])) for _ in range(60)}
    need = spark.createDataFrame([(list(g),) for g in groups], "mask array<int>")
    number = spark.createDataFrame([(b, f"s{b:02}") for b in range(79)], "bit int, strain string")
    weights = spark.createDataFrame([(b, 100 + rng.randrange(1000)) for b in range(79)], "bit int, weight long")
    began = time.time()
    found = [r["chosen"] for r in identify._best_covers(need, len(groups), number, weights).collect()]
    assert time.time() - began < 60
    assert found and all({*g} & {*c} for c in found for g in groups) and {len(c) for c in found} == {12}


def test_abundance_of_any_block_size(spark):
    rng = random.Random(3)
    sets = [(sorted(rng.sample("ABCDE", k)), rng.randrange(1, 50)) for k in (1, 2, 2, 3, 4, 5, 1, 2, 3)]
    strains = spark.createDataFrame([(s, 5 + i) for i, s in enumerate("ABCDEF")], "strain string, length long")
    frame = spark.createDataFrame(sets, "members array<string>, n long").repartition(3)
    a = dict.fromkeys("ABCDEF", 1 / 6)
    for _ in range(5):
        raw = {s: a[s] * sum(n / sum(a[m] for m in members) for members, n in sets if s in members) / (5 + "ABCDEF".index(s)) for s in a}
        a = {s: x / sum(raw.values()) for s, x in raw.items()}
    for block in (2, 100):
        got = {r["strain"]: r["exact"] for r in identify.abundance(frame.coalesce(1), strains, 5, block).collect()}
        assert got == pytest.approx(a, abs=2e-6)
        with pytest.raises(Exception, match="no length: C"):
            identify.abundance(frame, strains.where("strain <> 'C'"), 2, block).collect()
    with pytest.raises(Exception, match="no proportion: C"):
        identify.log_likelihood(frame, spark.createDataFrame([(s, 0.2) for s in "ABDE"], "strain string, exact double")).collect()


def test_abundance(spark):
    sets = spark.createDataFrame([(["A"], 3), (["B"], 1)], "members array<string>, n long")
    lengths = spark.createDataFrame([("A", 5), ("B", 5)], "strain string, length long")
    assert {r["strain"]: r["abundance"] for r in identify.abundance(sets, lengths, 1).collect()} == {"A": 0.75, "B": 0.25}
    both = spark.createDataFrame([(["A"], 3), (["B"], 1), (["A", "B"], 4)], "members array<string>, n long")
    a = {"A": 0.5, "B": 0.5}
    for _ in range(100):
        n = {"A": 3 + 4 * a["A"], "B": 1 + 4 * a["B"]}
        raw = {"A": n["A"] / 5, "B": n["B"] / 10}
        a = {s: v / sum(raw.values()) for s, v in raw.items()}
    got = identify.abundance(both, spark.createDataFrame([("A", 5), ("B", 10)], "strain string, length long"))
    assert {r["strain"]: r["exact"] for r in got.collect()} == {s: round(v, 6) for s, v in a.items()}
    named = identify.lengths_of(spark.createDataFrame([("x_1",)], ["strain"]), spark.createDataFrame([("x-1", 7)], "strain string, length long"))
    assert named.first()["length"] == 7


def test_unknown_strain_is_an_error(spark):
    found = spark.createDataFrame([("r", "zz", 0.5)], "read string, strain string, frac double")
    with pytest.raises(Exception, match="unknown strain"):
        identify.dense_matrix(found, found, spark.createDataFrame([("a",)], ["strain"])).collect()


def test_reports(spark):
    rows = spark.createDataFrame([("0_2_", 0.29), ("solo", 0.5)], "strain string, abundance double")
    numbers = spark.createDataFrame([(0, "zero"), (2, "two")], "number int, name string")
    assert {tuple(r) for r in reports.clean_results(rows, numbers).collect()} == {("0_2_", 28, "zero , two"), ("solo", 50, "solo")}


def test_filter_sets(spark):
    all_of = bits(spark, {"a": {1, 17, 5}, "b": {1, 5}}).select(F.col("filter").alias("key"), F.col("pos").alias("hash"))
    assert {r["pos"] for r in sketches.union_filter(all_of, 16).collect()} == {1, 5}
    assert {r["pos"] for r in sketches.intersection_filter(all_of, 32).collect()} == {1, 5}
    same = spark.createDataFrame([("a", 15, 1), ("b", 15, 2)], "filter string, k int, seed int")
    assert [r["parameter"] for r in sketches.consistent(same, ["k", "seed"]).collect()] == ["seed"]


def test_packed_bits(spark):
    """Complements over several buckets, the last one cut, and the checksum as the bytes give it."""
    rng, num_bits = np.random.default_rng(4), 70_003
    a = {"x": set(rng.integers(0, num_bits, 900).tolist()), "y": {70_002}, "z": set()}
    b = {"x": set(rng.integers(0, num_bits, 900).tolist()), "y": set(), "z": {0, 5}}
    filters = spark.createDataFrame([(f,) for f in a], "filter string")
    rows = lambda df: {f: {r["pos"] for r in df.where(F.col("filter") == f).collect()} for f in a}
    every = set(range(num_bits))
    assert rows(bitmaps.not_(bits(spark, a), filters, num_bits)) == {f: every - a[f] for f in a}
    assert rows(bitmaps.eq(bits(spark, a), bits(spark, b), filters, num_bits)) == {f: every - (a[f] ^ b[f]) for f in a}
    assert rows(bitmaps.or_not(bits(spark, a), bits(spark, b), filters, num_bits)) == {f: a[f] | (every - b[f]) for f in a}
    clear = bitmaps.select0(bits(spark, a), filters, num_bits).where("filter = 'x'").orderBy("i").collect()
    assert [r["pos"] for r in clear] == sorted(every - a["x"]) and [r["i"] for r in clear] == list(range(len(clear)))
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    for r in bitmaps.checksums(bitmaps.packed(bits(spark, a)), num_bits).collect():
        flags = np.zeros(-(-num_bits // 8) * 8, np.uint8)
        flags[list(a[r["filter"]])] = 1
        crc = 0
        for byte in np.packbits(flags).tolist():
            crc = crc >> 8 ^ table[(crc ^ byte) & 255]
        assert r["crc"] == crc
    drawn = bitmaps.random_exactly(filters, num_bits, 500, seed=1)
    assert all(len(v) == 500 and max(v) < num_bits for v in rows(drawn).values()) and rows(drawn) == rows(bitmaps.random_exactly(filters, num_bits, 500, seed=1))


def test_streaming(spark, tmp_path):
    index = bits(spark, {"p": range(0, 9), "q": range(0, 5)})
    source = tmp_path / "in"
    spark.createDataFrame([("r1", list(range(10))), ("r2", [99])], "read string, positions array<long>").write.parquet(str(source))
    got = []
    stream = spark.readStream.schema("read string, positions array<long>").parquet(str(source))
    query = classify.classify(stream, index, 0.5, lambda found, _: got.extend(map(tuple, found.collect())), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == [("r1", "p", 9, 10, 0.9), ("r1", "q", 5, 10, 0.5)]


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of few filters and bits, little at a time, and everything met by blocks."""
    for name, value in (("FILTERS", 7), ("BITS", 300), ("HELD", 500), ("PASS", 40), ("CELLS", 30), ("ROWS", 50), ("STEPS", 5000), ("MANY", 0)):
        monkeypatch.setattr(crossing, name, value)
    monkeypatch.setattr(crossing, "dense", lambda *_: True)


def _some_sets(rng):
    sets = {f"f{i}": {rng.randrange(400) for _ in range(rng.choice([0, 1, 3, 30, 120]))} for i in range(25)}
    return sets | {f"g{i}": {p for p in sets[f"f{rng.randrange(25)}"] if rng.random() < 0.9} for i in range(8)}


def test_pairs_of_filters_by_blocks(spark, small_blocks):
    """F3, F8 to F16: all pairs and near ones equal those compared one by one, empty filters among them."""
    sets = _some_sets(random.Random(4))
    frame, filters = bits(spark, sets).repartition(3), spark.createDataFrame([(f,) for f in sets], ["filter"])
    want = {(i, j): (len(sets[i]), len(sets[j]), len(sets[i] & sets[j])) for i, j in itertools.combinations(sorted(sets), 2)}
    assert {(r["i"], r["j"]): (r["n_i"], r["n_j"], r["n_both"]) for r in distances.pair_sizes(frame, filters).collect()} == want
    apart = {p: n + m - 2 * both for p, (n, m, both) in want.items()}
    assert {(r["i"], r["j"]): r["differing"] for r in distances.within_distance(frame, filters, 20).collect()} == {p: n for p, n in apart.items() if n <= 20}
    low = min(apart.values())
    assert distances.closest(frame, filters) == low
    full = {f: s for f, s in sets.items() if len(s) > 20}
    apart = {(i, j): len(full[i] ^ full[j]) for i, j in itertools.combinations(sorted(full), 2)}
    near = distances.nearly_closest(bits(spark, full), bits(spark, full), 1.5, 512).collect()
    assert {(r["i"], r["j"]): r["differing"] for r in near} == {p: n for p, n in apart.items() if n <= 1.5 * min(apart.values())}


@pytest.mark.parametrize("theta", [0.05, 0.4])
def test_matches_by_blocks(spark, small_blocks, theta):
    """hits of reads that count positions more than once, and hit some filters or none."""
    rng = random.Random(7)
    sets = _some_sets(rng)
    reads = {r: {rng.randrange(450): rng.choice([1, 1, 1, 2, 5]) for _ in range(rng.choice([1, 2, 5, 60]))} for r in range(60)}
    probes = spark.createDataFrame([(r, p, n) for r, ps in reads.items() for p, n in ps.items()], "read long, pos long, n long").repartition(4)
    frame, filters = bits(spark, sets).repartition(3), spark.createDataFrame([(f,) for f in sets], ["filter"])
    hits = {(r, f): (sum(n for p, n in ps.items() if p in own), sum(ps.values())) for r, ps in reads.items() for f, own in sets.items()}
    passed = {k for k, (h, t) in hits.items() if h >= np.ceil(round(t * theta, 9))}
    got = {(x["read"], x["filter"]): (x["hits"], x["total"]) for x in containment.matches(probes, frame, theta).collect()}
    assert got == {k: hits[k] for k in passed}
    every = containment.all_counts(probes, frame, filters, theta).collect()
    assert {(x["read"], x["filter"]): (x["hits"], x["total"]) for x in every} == hits
    assert {(x["read"], x["filter"]) for x in every if x["passed"]} == passed


def test_matrix_lines_without_pairs(spark, small_blocks):
    """a line per filter, in order, with an empty filter; a tie in the fifth digit goes to the even one, as in SQL."""
    sets = _some_sets(random.Random(2)) | {"tie": set(range(400, 402))}
    frame, filters = bits(spark, sets).repartition(3), spark.createDataFrame([(f,) for f in sets], ["filter"])
    got = {r["i"]: r["row"] for r in distances.matrix_of(frame, filters, 64).collect()}
    assert got == {i: " ".join("%.4f" % (len(sets[i] ^ sets[j]) / 64) for j in sorted(sets)) for i in sets}
