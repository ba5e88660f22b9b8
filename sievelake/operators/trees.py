"""Filter trees. A node stands for the union of its leaves' filters; every kind of
node is a closed form of two sets, the union (cup) and the intersection (cap) of
the leaves below it, so no kind has to be built level by level.

nodes: (node, parent, depth, is_leaf); leaf bits: (filter, pos), filter = leaf node.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.functions import sequences
from sievelake.operators import bitmaps, containment
from sievelake.workspace import written


def ancestors(nodes: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, above, steps: each node of ``start`` (or every one) with itself and all its
    ancestors. Pointers double their reach each round, and each round is written, so
    rounds are as the logarithm of the depth."""
    jump = written(nodes.where("parent IS NOT NULL").select(F.col("node").alias("from"), F.col("parent").alias("to")), "jumps")
    found = written((nodes if start is None else start).select("node", F.col("node").alias("above"), F.lit(0).cast("long").alias("steps")), "ancestors")
    reach = 1
    while not jump.isEmpty():
        further = found.join(jump, found["above"] == jump["from"]).select("node", F.col("to").alias("above"), (F.col("steps") + reach).alias("steps"))
        found = written(found.union(further), "ancestors")
        onward = jump.select(F.col("from").alias("to"), F.col("to").alias("then"))
        jump = written(jump.join(onward, "to").select("from", F.col("then").alias("to")), "jumps")
        reach *= 2
    return found


def ancestry(nodes: DataFrame) -> DataFrame:
    """leaf, node: each leaf with itself and all its ancestors."""
    return ancestors(nodes, nodes.where("is_leaf")).select(F.col("node").alias("leaf"), F.col("above").alias("node"))


def with_depth(links: DataFrame) -> DataFrame:
    """node, parent, depth, is_leaf of the nodes in links (node, parent; null at a root)."""
    links = written(links.select("node", "parent"), "tree-links")
    depth = ancestors(links).groupBy("node").agg(F.max("steps").alias("depth"))
    inner = links.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().withColumn("is_leaf", F.lit(False))
    return links.join(depth, "node").join(inner, "node", "left").select("node", "parent", F.col("depth").cast("int").alias("depth"), F.coalesce("is_leaf", F.lit(True)).alias("is_leaf"))


def without_only_children(nodes: DataFrame) -> DataFrame:
    """``nodes``; a node that is an only child is an error."""
    alone = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("parent", F.lit(True).alias("alone"))
    checked = F.when(F.col("alone"), F.raise_error(F.concat(F.lit("an only child: "), F.col("node").cast("string")))).otherwise(F.col("node"))
    return nodes.join(alone, "parent", "left").withColumn("node", checked).select(*nodes.columns)


def cup_and_cap(nodes: DataFrame, bits: DataFrame, refuse_only_children: bool = False) -> DataFrame:
    """node, pos, in_cap for every position in a node's union. Leaves meet their ancestors
    as bitmaps of 32,768 bits, so a deep tree costs a bitmap, not its positions, a step."""
    nodes = without_only_children(nodes) if refuse_only_children else nodes
    below = written(ancestry(nodes), "ancestry")
    sizes = below.groupBy("node").agg(F.count(F.lit(1)).alias("leaves"))
    maps = bitmaps.packed(bits)
    met = below.join(maps, below["leaf"] == maps["filter"]).groupBy("node", "bucket")
    both = met.agg(F.bitmap_or_agg("bitmap").alias("cup"), F.bitmap_and_agg("bitmap").alias("cap"), F.count(F.lit(1)).alias("n")).join(sizes, "node")
    cap = F.when(F.col("n") == F.col("leaves"), F.col("cap")).otherwise(F.lit(bytes(bitmaps.BLOCK // 8)))  # a leaf without the block shares nothing of it
    # set bits of the union alone, then those of the intersection
    rest = both.select("node", "bucket", F.col("cup"), cap.alias("cap")).select("node", "bucket", F.explode(F.array(F.struct(bitmaps.minus("cup", "cap").alias("bitmap"), F.lit(False).alias("in_cap")), F.struct(F.col("cap").alias("bitmap"), F.lit(True).alias("in_cap")))).alias("x"))
    each = rest.select("node", "bucket", "x.in_cap", F.explode(bitmaps.set_bits(F.col("x.bitmap"))).alias("bit"))
    return each.select("node", ((F.col("bucket") - 1) * bitmaps.BLOCK + F.col("bit")).alias("pos"), "in_cap")


def _with_parent(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """sets with up_cap: whether the position is in the parent's intersection."""
    up = sets.where("in_cap").select(F.col("node").alias("parent"), "pos", F.lit(True).alias("up_cap"))
    return sets.join(nodes.select("node", "parent"), "node").join(up, ["parent", "pos"], "left").withColumn("up_cap", F.coalesce("up_cap", F.lit(False)))


def build_union(sets: DataFrame) -> DataFrame:
    return sets.select("node", "pos")


def build_intersection(sets: DataFrame) -> DataFrame:
    return sets.where("in_cap").select("node", "pos")


def build_allsome(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, bv (0 all, 1 some), pos: what all leaves have and the parent's all lacks; what some have."""
    marked = _with_parent(nodes, sets)
    return marked.where("NOT (in_cap AND up_cap)").select("node", F.when(F.col("in_cap"), 0).otherwise(1).alias("bv"), "pos")


def build_determined(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, pos, how: positions determined here and not above. Present ones have how =
    true. Positions absent from the whole tree are determined absent at the root and
    are left out; below, absent ones are those of the parent's union."""
    marked = _with_parent(nodes, sets)
    present = marked.where("in_cap AND NOT up_cap").select("node", "pos", F.lit(True).alias("how"))
    active = sets.where("NOT in_cap").select(F.col("node").alias("parent"), "pos")
    child = nodes.select("node", "parent").join(active, "parent").select("node", "pos")
    absent = child.join(sets.select("node", "pos"), ["node", "pos"], "left_anti").select("node", "pos", F.lit(False).alias("how"))
    return present.union(absent)


def squeezed(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, slot, det, how of the brief form: a node keeps the positions that its
    parent left open (the root its union), moved together."""
    determined = build_determined(nodes, sets)
    open_above = nodes.select("node", "parent").join(sets.where("NOT in_cap").select(F.col("node").alias("parent"), "pos"), "parent").select("node", "pos")
    root = nodes.where("parent IS NULL").select("node").join(sets, "node").select("node", "pos")
    active = open_above.union(root)
    slot = (F.row_number().over(W.partitionBy("node").orderBy("pos")) - 1).cast("long")
    return active.withColumn("slot", slot).join(determined, ["node", "pos"], "left").select("node", "slot", F.col("how").isNotNull().alias("det"), "how")


def query(nodes: DataFrame, sets: DataFrame, probes: DataFrame, theta: float) -> DataFrame:
    """read, node, present, absent, total, outcome of every node visited, level by level.

    A read goes on to a node's children while its outcome is open: fewer positions
    are surely absent than it takes to fail, fewer surely present than it takes to
    pass. One round of joins per level of the tree."""
    total = containment.totals(probes).withColumn("need", containment.needed(F.col("total"), theta))
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    found = None
    at = nodes.where("parent IS NULL").select("node").join(total)
    for level in range(depth + 1):
        counts = at.select("read", "node").join(probes, "read").join(sets, ["node", "pos"]).groupBy("read", "node")
        counts = counts.agg(F.sum("n").alias("some"), F.sum(F.when(F.col("in_cap"), F.col("n")).otherwise(0)).alias("present"))
        seen = at.join(counts, ["read", "node"], "left").select("read", "node", "total", "need", F.coalesce("present", F.lit(0)).alias("present"), (F.col("total") - F.coalesce("some", F.lit(0))).alias("absent"))
        outcome = F.when(F.col("present") >= F.col("need"), "pass").when(F.col("absent") >= F.col("total") - F.col("need") + 1, "fail").otherwise("open")
        seen = seen.withColumn("outcome", outcome)
        found = seen if found is None else found.union(seen)
        if level < depth:
            child = nodes.select(F.col("node").alias("child"), F.col("parent").alias("node"))
            at = seen.where("outcome = 'open'").join(child, "node").select(F.col("child").alias("node"), "read", "total", "need")
    return found.select("read", "node", "present", "absent", "total", "outcome")


def nodes_examined(visited: DataFrame) -> DataFrame:
    return visited.groupBy("read").agg(F.count(F.lit(1)).alias("examined"))


def query_stats(visited: DataFrame) -> DataFrame:
    """node, examined, passed, failed, open over all reads."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return visited.groupBy("node").agg(F.count(F.lit(1)).alias("examined"), n("pass").alias("passed"), n("fail").alias("failed"), n("open").alias("open"))


def node_stats(nodes: DataFrame, bits: DataFrame, num_bits: int, sizes: DataFrame) -> DataFrame:
    """node, parent, depth, children, siblings, niblings (children of siblings), subtree,
    height, ones, density, items and fp_rate (null where ``sizes`` (node, items) doesn't know the node)."""
    below = ancestors(nodes).groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("subtree"), F.max("steps").alias("height"))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    siblings = nodes.groupBy("parent").agg((F.count(F.lit(1)) - 1).alias("siblings"))
    ones = bits.groupBy("node").agg(F.count(F.lit(1)).alias("ones"))
    joined = nodes.select("node", "parent", "depth").join(below, "node").join(children, "node", "left").join(ones, "node", "left")
    joined = joined.join(siblings.withColumnRenamed("parent", "of"), F.col("parent").eqNullSafe(F.col("of")), "left")
    grand = nodes.join(children, "node").groupBy(F.col("parent").alias("by")).agg(F.sum("children").alias("grand"))
    joined = joined.join(grand, F.col("parent").eqNullSafe(F.col("by")), "left").join(sizes.select("node", "items"), "node", "left")
    niblings = F.coalesce("grand", F.lit(0)) - F.coalesce("children", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("node", "parent", "depth", zero("children"), zero("siblings"), niblings.alias("niblings"), "subtree", "height", zero("ones"), F.round(F.coalesce("ones", F.lit(0)) / num_bits, 6).alias("density"), F.col("items").cast("long").alias("items"), sequences.false_positive_rate(F.lit(num_bits), F.col("items")).alias("fp_rate"))


def bit_stats(determined: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """pos, det_active, how_active, how_one, s_x: at how many nodes a position is open, at how many it is
    determined, at how many of these present, and the last over the first's half (rounded up)."""
    root = nodes.where("parent IS NULL").select("node").join(sets, "node").select("node", "pos")
    open_above = nodes.select("node", "parent").join(sets.where("NOT in_cap").select(F.col("node").alias("parent"), "pos"), "parent").select("node", "pos")
    active = root.union(open_above).groupBy("pos").agg(F.count(F.lit(1)).alias("det_active"))
    decided = determined.groupBy("pos").agg(F.count(F.lit(1)).alias("how_active"), F.count_if("how").alias("how_one"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts = active.join(decided, "pos", "left").select("pos", "det_active", zero("how_active"), zero("how_one"))
    return counts.withColumn("s_x", F.col("how_one") / F.expr("(det_active + 1) div 2"))


def determined_ratio(nodes: DataFrame, sets: DataFrame, num_bits: int) -> DataFrame:
    """node, det, open_above, ratio: of the positions that the parent leaves open, the share determined at a node."""
    n = sets.groupBy("node").agg(F.count(F.lit(1)).alias("cup"), F.count_if("in_cap").alias("cap"))
    sizes = nodes.join(n, "node", "left").select("node", "parent", "is_leaf", (F.coalesce("cup", F.lit(0)) - F.coalesce("cap", F.lit(0))).alias("open"))
    up = sizes.select(F.col("node").alias("parent"), F.col("open").alias("open_above"))
    joined = sizes.join(up, "parent", "left").withColumn("open_above", F.coalesce("open_above", F.lit(num_bits)))
    det = F.col("open_above") - F.when(F.col("is_leaf"), 0).otherwise(F.col("open"))
    return joined.select("node", "is_leaf", det.alias("det"), "open_above", F.when(F.col("open_above") > 0, det / F.col("open_above")).alias("ratio"))


def culling_threshold(ratios: DataFrame, z: float = 2.0) -> DataFrame:
    """mean, sd, threshold (mean less z deviations, within 0 and 1) over internal nodes."""
    inner = ratios.where("NOT is_leaf AND open_above > 0").agg(F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("sd"))
    threshold = F.least(F.greatest(F.col("mean") - z * F.col("sd"), F.lit(0.0)), F.lit(1.0))
    return inner.select("mean", "sd", threshold.alias("threshold"))


def cull(nodes: DataFrame, ratios: DataFrame, threshold: DataFrame) -> DataFrame:
    """node, parent without the internal nodes below the threshold; their children move
    up to the nearest node that stays. The root always stays."""
    gone = ratios.where("NOT is_leaf").join(F.broadcast(threshold)).where(F.col("det") < F.col("open_above") * F.col("threshold")).select("node")
    keep = nodes.join(gone, "node", "left_semi").where("parent IS NOT NULL").select(F.col("node").alias("out"), F.col("parent").alias("up"))
    # pointers of the nodes that go double their reach until they end at ones that stay
    while True:
        keep = written(keep, "culled")
        onward = keep.select(F.col("out").alias("up"), F.col("up").alias("then"))
        if keep.join(onward, "up", "left_semi").isEmpty():
            break
        keep = keep.join(onward, "up", "left").select("out", F.coalesce("then", "up").alias("up"))
    at = nodes.select("node", "parent").join(keep, F.col("parent") == keep["out"], "left").select("node", F.coalesce("up", "parent").alias("parent"))
    return at.join(keep, at["node"] == keep["out"], "left_anti")


def orders(links: DataFrame) -> DataFrame:
    """node, parent, depth, preorder, postorder (from 0) of a tree or forest (node, parent),
    siblings by name: an Euler tour. A node comes after its parent and the subtrees of
    its earlier siblings, so its place is a sum along its path; with d nodes above it
    and s in its subtree it is left s - 1 - d places later."""
    links = written(links.select("node", "parent"), "tour-links")
    above = written(ancestors(links), "tour")
    sizes = above.groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    earlier = F.sum("size").over(W.partitionBy("parent").orderBy("node").rowsBetween(W.unboundedPreceding, -1))
    steps = links.join(sizes, "node").select("node", "parent", "size", (F.coalesce(earlier, F.lit(0)) + F.col("parent").isNotNull().cast("long")).alias("step"))
    steps = written(steps, "tour-steps")
    placed = above.join(steps.select(F.col("node").alias("above"), "step"), "above").groupBy("node").agg(F.sum("step").alias("preorder"), F.max("steps").alias("depth"))
    return steps.join(placed, "node").select("node", "parent", "depth", "preorder", (F.col("preorder") + F.col("size") - 1 - F.col("depth")).alias("postorder"))


def numbered(nodes: DataFrame, template: str = "node{number}", start: int = 1) -> DataFrame:
    """Internal nodes with names by a template, numbered level by level from ``start``:
    within each level, after the nodes of the levels above."""
    inner = nodes.where("NOT is_leaf").select("depth", "node")
    levels = inner.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    above = levels.join(levels.select(F.col("depth").alias("up"), F.col("n").alias("before")), F.col("up") < F.col("depth"), "left").groupBy("depth").agg(F.coalesce(F.sum("before"), F.lit(0)).alias("before"))
    number = F.row_number().over(W.partitionBy("depth").orderBy("node")) + F.col("before") + (start - 1)
    return inner.join(above, "depth").select("node", F.replace(F.lit(template), F.lit("{number}"), number.cast("string")).alias("name"))


def violations(nodes: DataFrame, sets: DataFrame, stored: DataFrame) -> DataFrame:
    """problem, node: repeated names, only children, stored (node, pos) that differ from the union of the leaves."""
    twice = nodes.groupBy("node").count().where("count > 1").select(F.lit("duplicate name").alias("problem"), "node")
    only = nodes.where("parent IS NOT NULL").groupBy("parent").count().where("count = 1").select(F.lit("only child").alias("problem"), F.col("parent").alias("node"))
    wrong = stored.select("node", "pos", F.lit(1).alias("s")).join(sets.select("node", "pos", F.lit(1).alias("u")), ["node", "pos"], "full").where("s IS NULL OR u IS NULL")
    return twice.union(only).union(wrong.select(F.lit("not the union").alias("problem"), "node").distinct())


def cluster(bits: DataFrame, first_bits: int = 100_000, max_filters: int = 4_000) -> DataFrame:
    """node, parent, height, left, right: greedy agglomeration of filters by Hamming distance.

    The closest pair, ties by height, then by number, becomes a node with the union
    of both. That is a chain of decisions over a few filters, made on the driver:
    what comes there is bounded, max_filters bitmaps of first_bits bits at most."""
    n_filters = bits.select("filter").distinct().count()
    if n_filters > max_filters:
        raise ValueError(f"{n_filters} filters are more than max_filters")
    rows = bitmaps.packed(bits.where(F.col("pos") < first_bits)).collect()
    names = sorted({r["filter"] for r in rows} | {r[0] for r in bits.select("filter").distinct().collect()})
    width = -(-first_bits // 32768) * 4096
    maps = np.zeros((2 * len(names), width), np.uint8)
    for r in rows:
        maps[names.index(r["filter"]), (r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bitmap"], np.uint8)
    maps = maps.view(np.uint64)
    n = len(names)
    height, alive, heap = [0] * (2 * n), list(range(n)), []

    def pair(v: int, others: list[int]) -> None:
        if others:
            dist = np.bitwise_count(maps[others] ^ maps[v]).sum(axis=1)
            for u, d in zip(others, dist.tolist(), strict=True):
                heapq.heappush(heap, (d, max(height[u], height[v]) + 1, u, v))

    for v in range(n):
        pair(v, list(range(v)))
    children, gone = {}, set()
    for new in range(n, 2 * n - 1):
        while True:
            _, h, u, v = heapq.heappop(heap)
            if u not in gone and v not in gone:
                break
        maps[new], height[new], children[new] = maps[u] | maps[v], h, (u, v)
        gone |= {u, v}
        alive = [a for a in alive if a not in (u, v)]
        pair(new, alive)
        alive.append(new)
    parent = {c: p for p, both in children.items() for c in both}
    label = lambda i: None if i is None else str(names[i]) if i < n else f"node{i - n}"
    out = [(label(i), label(parent.get(i)), height[i], label(children[i][0]) if i in children else None, label(children[i][1]) if i in children else None) for i in range(max(0, 2 * n - 1))]
    return bits.sparkSession.createDataFrame(out, "node string, parent string, height int, left string, right string")
