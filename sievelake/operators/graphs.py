"""Graphs of close filters: components, cliques, merged filters."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.workspace import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction: larger neighbours (or, in the small step, smaller ones) go to the smallest node known."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(lowest, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (smallest node) of the nodes in links (a, b), by alternating star
    contractions; each round's links are written, so lineage stays short."""
    links = written(_star(links.where("a <> b").select("a", "b").distinct(), True), "components")
    before = None
    for _ in range(rounds):
        links = written(_star(_star(links, False), True), "components")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            stars = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
            return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def peeled(both: DataFrame, slack: float = 2.2, rounds: int = 200) -> DataFrame:
    """node, level of the nodes in links (a, b; both ways): nodes with at most ``slack``
    times the average degree among those that are left get the next level and leave.

    Some constant share leaves each time, so rounds are as the logarithm of all nodes,
    and none has more neighbours on its own or later levels than slack times the
    average degree of some part of the graph."""
    left, found = written(both.select("a", "b"), "peel"), None
    for level in range(rounds):
        degrees = left.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
        limit = degrees.agg((slack * F.avg("degree")).alias("limit"))
        gone = written(degrees.join(F.broadcast(limit)).where("degree <= limit").select(F.col("a").alias("node"), F.lit(level).alias("level")), "peeled")
        found = gone if found is None else found.union(gone)
        left = left.join(gone, left["a"] == gone["node"], "left_anti").join(gone, left["b"] == gone["node"], "left_anti")
        left = written(left, "peel")
        if left.isEmpty():
            # a node whose last neighbours left without it has no links any more: it comes last
            every = both.select(F.col("a").alias("node")).distinct()
            return written(every.join(found, "node", "left").select("node", F.coalesce("level", F.lit(rounds)).alias("level")), "levels")
    raise RuntimeError(f"nodes left after {rounds} rounds")


def maximal_cliques(links: DataFrame, split: int = 48) -> DataFrame:
    """clique (ordered array of nodes) of every maximal clique of two nodes or more.

    Nodes are put in a near-degeneracy order (``peeled``). A clique belongs to its first
    node, whose row has its later neighbours with the links among them and, for each
    earlier neighbour, those of the later ones that it is linked to: a clique that one of
    these sees whole isn't maximal. Each such row is a problem of its own, solved in a task
    by branching with pivots; one with over ``split`` later neighbours is a row for each of
    them first. Rows hold as much as the order allows, not what the largest degree is."""
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    kind = both.schema["a"].dataType.simpleString()
    levels = peeled(both)
    first, second = (levels.select(F.col("node").alias(c), F.col("level").alias(f"level_{c}")) for c in "ab")
    edges = written(both.join(first, "a").join(second, "b").where("struct(level_a, a) < struct(level_b, b)").select("a", "b"), "ordered-links")
    later = written(edges.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("later")), "later")
    ends = edges.join(later, "a").join(later.select(F.col("a").alias("b"), F.col("later").alias("later_b")), "b", "left")
    ends = written(ends.select("a", "b", F.coalesce(F.array_intersect("later", "later_b"), F.array().cast(f"array<{kind}>")).alias("shared"), F.col("later_b").isNotNull().alias("goes_on")), "links-shared")
    own = ends.select(F.col("a").alias("node"), F.struct(F.col("b").alias("v"), "shared").alias("part"), F.lit(None).cast(f"array<{kind}>").alias("seen"))
    before = ends.where("goes_on AND size(shared) > 0").select(F.col("b").alias("node"), F.lit(None).cast(own.schema["part"].dataType).alias("part"), F.col("shared").alias("seen"))
    problems = own.union(before).groupBy("node").agg(F.collect_list("part").alias("parts"), F.collect_set("seen").alias("seen"))
    branches = F.when(F.size("parts") > split, F.sequence(F.lit(0), F.size("parts") - 1)).otherwise(F.array(F.lit(-1)))
    rows = problems.where("size(parts) > 0").select("node", "parts", "seen", F.explode(branches).alias("branch")).repartition("node", "branch")

    def solve(batches):
        for batch in batches:
            out = []
            for node, parts, seen, branch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members = sorted(p["v"] for p in parts)
                number = {v: i for i, v in enumerate(members)}
                near = [0] * len(members)
                for p in parts:
                    for u in p["shared"]:
                        near[number[p["v"]]] |= 1 << number[u]
                        near[number[u]] |= 1 << number[p["v"]]
                masks = [sum(1 << number[v] for v in s) for s in seen]
                for clique in branching(near, masks, branch):
                    out.append(sorted([node, *(members[i] for i in clique)]))
            yield pa.RecordBatch.from_arrays([pa.array(out, rows_type)], ["clique"])

    rows_type = pa.list_({"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind])
    return rows.mapInArrow(solve, f"clique array<{kind}>")


def branching(near: list[int], seen: list[int], branch: int = -1):
    """The maximal sets of linked nodes 0 .. n - 1 (adjacency in bits) that no node outside
    sees whole; ``seen``: what each of these sees. With ``branch``, those whose lowest node it is.

    Of the nodes that may still be added only those are tried that the pivot, which sees
    most of them, doesn't see."""
    n = len(near)
    if branch < 0:
        waiting = [((), (1 << n) - 1, 0, seen)]
    else:
        low = (1 << branch) - 1
        waiting = [((branch,), near[branch] & ~low, near[branch] & low, [s for s in seen if s >> branch & 1])]
    while waiting:
        clique, may, done, out = waiting.pop()
        if not may:
            if not done and not out:
                yield clique
            continue
        best, sight, rest = -1, 0, may | done
        for s in out:
            if (c := (s & may).bit_count()) > best:
                best, sight = c, s
        while rest and best < may.bit_count():
            v = rest & -rest
            rest ^= v
            if (c := (near[v.bit_length() - 1] & may).bit_count()) > best:
                best, sight = c, near[v.bit_length() - 1]
        tried = may & ~sight
        while tried:
            v = tried & -tried
            tried ^= v
            i = v.bit_length() - 1
            waiting.append(((*clique, i), may & near[i], done & near[i], [s for s in out if s & v]))
            may, done = may ^ v, done | v


def _cliques(near: dict) -> list[tuple]:
    """The members, in order, of every maximal clique of a graph in memory."""
    nodes = sorted(near)
    number = {v: i for i, v in enumerate(nodes)}
    masks = [sum(1 << number[u] for u in near[v]) for v in nodes]
    return [tuple(sorted(nodes[i] for i in c)) for c in branching(masks, [])]


def smallest_cut(one: set, other: set) -> list[tuple]:
    """The edges of a smallest cut of two overlapping cliques.

    None is smaller than cutting a node that only the smaller clique has off from
    the rest of it (the smallest such node). If they share one node, all such nodes
    together cost the same and stay together. Of equal cliques the second is cut."""
    small, large = (one, other) if len(one) < len(other) else (other, one)
    own, both = sorted(small - large), small & large
    if len(both) == 1:
        return [(v, s) for v in own for s in both]
    return [(own[0], v) for v in sorted(small - {own[0]})]


def _settled(near: dict, cutoff: float) -> list[tuple]:
    """Cliques without common nodes, of one component; ``near`` is changed. A decision
    changes links among some nodes, so only cliques with one of these are listed anew."""
    cliques, of = set(), {v: set() for v in near}

    def put(found):
        cliques.update(found)
        for c in found:
            for v in c:
                of[v].add(c)

    def take(nodes):
        """Drops the cliques with any of the nodes."""
        gone = set().union(*(of[v] for v in nodes))
        cliques.difference_update(gone)
        for c in gone:
            for v in c:
                of[v].discard(c)

    def first_overlap():
        rank = lambda c: (-len(c), c)
        for c in sorted(cliques):
            later = [d for d in set().union(*(of[v] for v in c)) if rank(d) > rank(c)]
            if later:
                return c, min(later)
        return None

    put(_cliques(near))
    before, merging = set(), False
    while (pair := first_overlap()) is not None:
        state = frozenset((v, u) for v in near for u in near[v] if v < u)
        merging = merging or state in before
        before.add(state)
        one, other = map(set, pair)
        around = near[min(one - other)] | near[min(other - one)]
        n_links = sum(len(near[v] & around) for v in around) / 2
        changed = one | other
        take(changed)
        if merging or len(around) < 2 or 2 * n_links / (len(around) * (len(around) - 1)) >= cutoff:
            for v in changed:
                near[v] |= changed - {v}
        else:
            for v, u in smallest_cut(one, other):
                near[v].discard(u)
                near[u].discard(v)
        close = changed.union(*(near[v] for v in changed))
        put([c for c in _cliques({v: near[v] & close for v in close}) if not changed.isdisjoint(c)])
    return [c for c in cliques if len(c) > 1]


def disjoint_cliques(links: DataFrame, cutoff: float = 0.01, max_nodes: int = 2_000) -> DataFrame:
    """root, clique (ordered array): maximal cliques of two nodes or more, overlaps resolved.

    While two cliques overlap, the first such pair (larger clique first, then by
    members) is taken, and of each the smallest node that the other lacks. If the
    links among those two nodes' neighbours are at least ``cutoff`` of all possible
    ones, the two cliques become one, else a smallest cut parts them. Once a graph
    comes back that was there before, all further overlaps are merged.

    Each decision depends on those before it, but only within a component: components
    are spread over the tasks, and their size is checked."""
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    groups = written(components(links), "clique-components")
    largest = groups.groupBy("root").count().agg(F.max("count")).first()[0] or 0
    if largest > max_nodes:
        raise ValueError(f"{largest} nodes in a component are more than max_nodes")
    kind = links.schema["a"].dataType.simpleString()

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        found = _settled(near, cutoff)
        return pd.DataFrame({"root": [rows["root"].iloc[0]] * len(found), "clique": [list(c) for c in found]})

    placed = links.join(groups.withColumnRenamed("node", "a"), "a").select("root", "a", "b")
    return placed.groupBy("root").applyInPandas(settle, f"root {kind}, clique array<{kind}>")


def clique_groups(cliques: DataFrame) -> DataFrame:
    """node, root (smallest member) of disjoint cliques: the groups that are merged."""
    return cliques.select(F.explode("clique").alias("node"), F.array_min("clique").alias("root"))


def merged_names(groups: DataFrame) -> DataFrame:
    """node, root with the merged filter's name: members as text, in text order, each followed by _."""
    names = groups.groupBy("root").agg(F.array_sort(F.collect_list(F.col("node").cast("string"))).alias("m"))
    return names.select("root", F.concat(F.array_join("m", "_"), F.lit("_")).alias("name"), F.size("m").cast("long").alias("members"))


def merged_bits(bits: DataFrame, groups: DataFrame) -> DataFrame:
    """root, pos: the union of the members' filters."""
    return bits.join(groups, bits["filter"] == groups["node"]).select("root", "pos").distinct()


def merged_lengths(names: DataFrame, lengths: DataFrame) -> DataFrame:
    """name, length: the mean of the members' lengths, cut; members are read off the merged name."""
    member = F.explode(F.filter(F.split("name", "_"), lambda m: m != "")).alias("member")
    joined = names.select("name", member).join(lengths.select(F.col("strain").cast("string").alias("member"), "length"), "member")
    return joined.groupBy("name").agg(F.floor(F.avg("length")).alias("length"))


def superseded(filters: DataFrame, names: DataFrame) -> DataFrame:
    """The filters that no merged filter replaces."""
    members = names.select(F.explode(F.filter(F.split("name", "_"), lambda m: m != "")).alias("member"))
    return filters.join(members, filters["filter"].cast("string") == members["member"], "left_anti")
