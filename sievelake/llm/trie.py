"""The prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns; the root is the empty one. A turn counts
as the digest of its role and text and the number of its characters, so texts leave the
work where they are read. The prefixes of a conversation are a chain of digests; equal
digests are one node, named by its smallest member and its depth. Rows per node are
added up before they meet, so a first turn that all share is one row a task.

Sums over subtrees (leaves, saved characters) come from a centroid decomposition of the
forest of parent edges. Each node has a weight: the nodes below it, each as often as it
has members, which is a plain sum over its members' remaining turns. In a component, the
nodes with over half of the weight are a path from its top down to its centroid. Then

* the totals of what hangs on the centroid, itself included, are added to all nodes of
  that path: what they add up to is part of the subtrees of just these;
* the centroid leaves, and its children's parts and what lies above it are components of
  their own, of at most half the weight; the weights of the path go down by its weight.

So after as many rounds as the logarithm of all weight, however deep or bushy the trie,
each node has met all that lies below it. Components heavier than ``limit`` take their
rounds as Spark jobs, all components at once and each round written: there are at most
(weight / limit) of them, which is checked, so their centroids are broadcast. The
others, some 65,536 nodes at most at small sizes, take theirs in a task, in arrays.

Defined results: turns are ordered by turn (null first), role, text; null roles and
texts are empty; rows without a conv_id take no part; repeated rows are turns of their
own; texts may be of any length; without conversations there are no nodes. Other columns
are not looked at. A conversation's chain passes through one task, 32 bytes a turn, and
nothing of it is held; its rows are placed, counted and joined by ranges of turns.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm import turns
from sievelake.llm.hot import with_groups
from sievelake.workspace import written

LIMIT = 1 << 16
COMPONENTS = 100_000
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = b"\0" * 16
PREFIXES = "conv_id long, depth long, key binary, up binary, chars long, length long"
STATE = ["c", "d", "p", "w", "leaves", "saved", "top_c", "top_d"]


# ---- conversations as sequences of digests -------------------------------


def tokens(rows: DataFrame) -> DataFrame:
    """conv_id, at (from 0), turns (how many), token, chars of each turn."""
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    token = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keep = {"token": token, "chars": F.char_length("text").cast("long")}
    placed = turns.places(turns.in_order(rows.where("conv_id IS NOT NULL"), keep, "trie-turns"))
    return written(placed.select("conv_id", "at", "turns", "token", "chars"), "trie-tokens")


def whole(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, place, token, chars) and lengths (conv_id, length) of the conversations as they are."""
    return placed.select("conv_id", F.col("at").alias("place"), "token", "chars"), placed.groupBy("conv_id").agg(F.max("turns").alias("length"))


def rebuilt(placed: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """As ``whole``, where the first h turns of the first conversation of each block of ids
    stand in for those of every other one; h: a checksum of the id modulo ``most``."""
    h = turns.checksum(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % block
    convs = placed.groupBy("conv_id").agg(F.max("turns").alias("n")).select("conv_id", "n", h.alias("h"), base.alias("base"))
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    lengths = convs.join(bases, "base", "left").select("conv_id", (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    heads = placed.where((F.col("conv_id") % block == 0) & (F.col("at") < most - 1)).select(F.col("conv_id").alias("base"), "at", "token", "chars")
    first = convs.join(heads, "base").where("at < h").select("conv_id", F.col("at").alias("place"), "token", "chars")
    own = placed.where(F.col("at") >= h).select("conv_id", (F.col("at") + most).alias("place"), "token", "chars")
    return first.union(own), lengths


def prefixes(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation, the empty one included; written."""

    def run(batches):
        key, depth, length = ROOT, 0, 0
        for batch in batches:
            out = []
            for conv_id, token, chars in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "token", "chars")), strict=True):
                if token is None:
                    key, depth, length = ROOT, 0, chars
                    out.append((conv_id, 0, ROOT, None, 0, length))
                else:
                    up, depth = key, depth + 1
                    key = hashlib.sha256(up + token).digest()[:16]
                    out.append((conv_id, depth, key, up, chars, length))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in PREFIXES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names)

    heads = lengths.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("token"), F.col("length").alias("chars"))
    stream = sequences.union(heads).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return written(stream.mapInArrow(run, PREFIXES), "trie-prefixes")


# ---- nodes ---------------------------------------------------------------


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of the conversations (key, conv_id) that end at each node, their
    ids ascending. Ids are packed into texts where their range is, so that a node at which
    a third of all conversations end is some texts, not rows, where its digest is made."""

    def pack(batches):
        key, ids = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "first", "ids"])

        for batch in batches:
            for k, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (k != key or len(ids) >= 1 << 15):
                    yield out()
                    ids = []
                key = k
                ids.append(conv_id)
        if ids:
            yield out()

    def digest(batches):
        key, now = None, None
        for batch in batches:
            keys, found = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if now is not None:
                        keys.append(key)
                        found.append(now.hexdigest())
                    key, now = k, hashlib.sha256(ids.encode())
                else:
                    now.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([now.hexdigest()])], ["key", "ends_sha256"])

    packed = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pack, "key binary, first long, ids string")
    return packed.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


def nodes_of(rows: DataFrame) -> DataFrame:
    """key, conv_id, depth, n_convs, chars, weight, n_children, parent_conv_id of each node; written."""
    left = (F.col("length") - F.col("depth") + 1).alias("left")
    nodes = rows.select("key", "conv_id", "depth", "chars", "up", left).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.max("chars").alias("chars"), F.max("up").alias("up"), F.sum("left").alias("weight"),
    )
    nodes = written(nodes, "trie-nodes")
    children = nodes.where("up IS NOT NULL").groupBy("up").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("up", "key")
    nodes = written(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    below = with_groups(nodes.where("up IS NOT NULL"), parents, "up", "siblings", nodes.count()).drop("siblings")
    return written(below.unionByName(nodes.where("up IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))).drop("up"), "trie-forest")


# ---- rollup --------------------------------------------------------------


def _preorder(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each node in a walk from the tops down, and where its subtree ends there;
    parent: the number of each node's parent, -1 at a top."""
    n = len(parent)
    by = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[by], np.arange(n + 1) - 1, side="left").tolist() + [n]
    child, at, end = by.tolist(), [0] * n, [0] * n
    clock, waiting = 0, child[first[0] : first[1]][::-1]
    while waiting:
        v = waiting.pop()
        if v < 0:
            end[~v] = clock
            continue
        at[v] = clock
        clock += 1
        waiting.append(~v)
        waiting.extend(child[first[v + 1] : first[v + 2]][::-1])
    return np.array(at, np.int64), np.array(end, np.int64)


def rolled_up(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values (n x k) over the subtrees of a forest, by centroid decomposition of
    all its components at once; a weight is larger than all those below it together."""
    n = len(parent)
    at, end = _preorder(parent)
    order = np.argsort(at)  # nodes in that order: components are runs, or runs without others
    parent, values, end, w = np.where(parent >= 0, at[parent], -1)[order], values[order], end[order], weight[order].astype(np.int64)
    out = np.zeros_like(values)
    depth = np.zeros(n, np.int64)
    label = np.arange(n)  # the component's top
    for v in np.flatnonzero(parent >= 0).tolist():  # parents come first
        depth[v], label[v] = depth[parent[v]] + 1, label[parent[v]]
    live = np.arange(n)
    while len(live):
        top = label[live]
        heavy = live[2 * w[live] > w[top]]
        centroid = np.zeros(n, np.int64)
        by = heavy[np.argsort(depth[heavy], kind="stable")]
        centroid[label[by]] = by  # the deepest is the last
        z = centroid[top]
        inside = (live >= z) & (live < end[z])
        totals = np.zeros_like(values)
        np.add.at(totals, top[inside], values[live[inside]])
        out[heavy] += totals[label[heavy]]
        z_weight = w[centroid[label[heavy]]]
        above = heavy != centroid[label[heavy]]
        lower = live[inside & (live != z)]
        children = live[inside & (parent[live] == z)]
        w[heavy[above]] -= z_weight[above]
        # a node lies below the last child of its own component's centroid that doesn't come after it
        if len(lower):
            keys = label[children] * n + children
            sorted_children = children[np.argsort(keys)]
            label[lower] = sorted_children[np.searchsorted(np.sort(keys), label[lower] * n + lower, side="right") - 1]
        live = live[live != z]
    return out[at]


def _solved(pile: DataFrame) -> DataFrame:
    """c, d, leaves, saved: sums over subtrees within components that fit a task."""
    fields = "c long, d long, leaves long, saved long"

    def solve(frame: pd.DataFrame) -> pa.RecordBatch:
        here = pd.MultiIndex.from_arrays([frame["c"], frame["d"]])
        parent = here.get_indexer(pd.MultiIndex.from_arrays([frame["p"], frame["d"] - 1]))
        # the parent of a top isn't of its component
        parent = np.where((frame["c"] == frame["top_c"]) & (frame["d"] == frame["top_d"]), -1, parent)
        sums = rolled_up(parent, frame["w"].to_numpy(), frame[["leaves", "saved"]].to_numpy(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(frame["c"].to_numpy()), pa.array(frame["d"].to_numpy()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["c", "d", "leaves", "saved"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            frame = batch.to_pandas()
            if not len(frame):
                continue
            if size >= LIMIT:  # up to the last component begun
                everything = pd.concat([*held, frame])
                top = everything[["top_c", "top_d"]].to_numpy()
                new = np.flatnonzero((top[1:] != top[:-1]).any(axis=1)) + 1
                if len(new):
                    yield solve(everything.iloc[: new[-1]])
                    everything = everything.iloc[new[-1] :]
                held, size = [everything], len(everything)
            else:
                held.append(frame)
                size += len(frame)
        if held:
            yield solve(pd.concat(held))

    placed = pile.select(*STATE).withColumn("p", F.coalesce("p", "c")).repartition("top_c", "top_d").sortWithinPartitions("top_c", "top_d", "d", "c")
    return placed.mapInArrow(run, fields)


def rollup(nodes: DataFrame, paths, limit: int | None = None) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens of each node of ``nodes_of``. ``paths``
    gives, when asked, (conv_id, depth, owner, up_owner): the node at each depth of a
    conversation, and the one above it."""
    root = nodes.where("parent_conv_id IS NULL").select("conv_id", "weight").first()
    if root is None:
        return nodes.select("conv_id", "depth", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    limit = limit or max(LIMIT, root["weight"] // COMPONENTS)
    state = nodes.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("parent_conv_id").alias("p"), F.col("weight").alias("w"),
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        F.lit(root["conv_id"]).alias("top_c"), F.lit(0).cast("long").alias("top_d"),
    )
    piles, sums = [], []
    if root["weight"] <= limit:
        piles = [state]
    else:
        known = written(paths(), "trie-paths")
        state = written(state, "trie-state")
        while not state.isEmpty():
            small, state, added = _round(state, known, limit)
            piles.append(small)
            sums.append(added)
    solved = _solved(reduce(DataFrame.union, piles))
    both = reduce(DataFrame.union, [*sums, solved])
    return both.groupBy(F.col("c").alias("conv_id"), F.col("d").alias("depth")).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _round(state: DataFrame, paths: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits every component at its centroid: nodes of components that fit a task now,
    those of others, and what the nodes of the paths to the centroids get."""
    top = ["top_c", "top_d"]
    tops = state.groupBy(*top).agg(F.max("w").alias("all"))
    heavy = state.join(F.broadcast(tops), top).where("2 * w > all")
    z = F.max(F.struct("d", "c", "w")).alias("z")
    centroids = heavy.groupBy(*top).agg(z, F.max("all").alias("all")).select(*top, "all", F.col("z.c").alias("z_c"), F.col("z.d").alias("z_d"), F.col("z.w").alias("z_w"))
    centroids = written(centroids, "trie-centroids")
    if (n := centroids.count()) > 8 * COMPONENTS:
        raise ValueError(f"{n} components are more than their weights allow")
    depths = centroids.select((F.col("z_d") + 1).alias("depth")).distinct()
    under = paths.join(F.broadcast(depths), "depth").select(F.col("conv_id").alias("c"), F.col("depth").alias("child_d"), F.col("owner").alias("child_c"), "up_owner")
    marked = state.join(F.broadcast(centroids), top).withColumn("child_d", F.col("z_d") + 1)
    is_z = (F.col("c") == F.col("z_c")) & (F.col("d") == F.col("z_d"))
    # only nodes deeper than the centroid can lie below it: the others need no look-up
    deeper = marked.where("d > z_d").join(under, ["c", "child_d"], "left").withColumn("below", F.coalesce(F.col("up_owner") == F.col("z_c"), F.lit(False))).drop("up_owner")
    others = marked.where("d <= z_d").withColumn("child_c", F.lit(None).cast("long")).withColumn("below", F.lit(False))
    stepped = written(deeper.unionByName(others).withColumn("is_z", is_z).withColumn("heavy", F.col("w") * 2 > F.col("all")), "trie-round")
    totals = stepped.where("below OR is_z").groupBy(*top).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    added = written(stepped.where("heavy").select("c", "d", *top).join(F.broadcast(totals), top).select("c", "d", F.col("more_leaves").alias("leaves"), F.col("more_saved").alias("saved")), "trie-sums")
    rest = stepped.where("NOT is_z").select(
        "c", "d", "p", F.when(F.col("heavy"), F.col("w") - F.col("z_w")).otherwise(F.col("w")).alias("w"), "leaves", "saved",
        F.when(F.col("below"), F.col("child_c")).otherwise(F.col("top_c")).alias("top_c"),
        F.when(F.col("below"), F.col("child_d")).otherwise(F.col("top_d")).alias("top_d"),
    )
    # the heaviest node of a component is its top; those that don't fit a task are as few as their weights allow
    large = written(rest.groupBy(*top).agg(F.max("w").alias("all")).where(F.col("all") > limit).select(*top), "trie-large")
    fits = rest.join(F.broadcast(large), top, "left_anti").select(*STATE)
    return fits, written(rest.join(F.broadcast(large), top, "left_semi").select(*STATE), "trie-state"), added


# ---- the whole -----------------------------------------------------------


def trie(sequences: DataFrame, lengths: DataFrame, limit: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    rows = prefixes(sequences, lengths)
    nodes = nodes_of(rows)
    total = rows.count()

    def paths():
        of = nodes.select("key", F.col("conv_id").alias("owner"), F.col("parent_conv_id").alias("up_owner"), "n_convs")
        return with_groups(rows.select("key", "conv_id", "depth"), of, "key", "n_convs", total).select("conv_id", "depth", "owner", "up_owner")

    sums = rollup(nodes, paths, limit)
    ends = digests_of_ends(rows.where("depth = length").select("key", "conv_id"))
    told = nodes.join(ends, "key", "left").join(sums, ["conv_id", "depth"])
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The trie of the conversations in ``rows`` (conv_id, turn, role, text)."""
    return trie(*whole(tokens(rows)))


def report(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The trie of the conversations rebuilt with shared beginnings."""
    return trie(*rebuilt(tokens(rows)), limit)


def sql() -> str:
    crc = turns.CRC_SQL.format("CAST(conv_id AS VARCHAR)")
    return f"""
        WITH placed AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, {crc} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM placed)),
        seq AS (SELECT c.conv_id, p.i, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.i <= c.h
                UNION ALL SELECT c.conv_id, p.i + 6, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.i > c.h),
        tok AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, sha256(length(role) || ':' || role || text) AS t, length(text) AS chars FROM seq),
        path AS (SELECT conv_id, d, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY d) AS key, chars FROM tok
                 UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
        full_ AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS n FROM path),
        nodes AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends FROM full_ GROUP BY key, d),
        kids AS (SELECT key[:length(key) - 64] AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
        own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, CASE WHEN d > 0 THEN up.conv_id END AS parent FROM nodes LEFT JOIN kids USING (key)
                LEFT JOIN (SELECT key AS up_key, conv_id FROM nodes) up ON up.up_key = nodes.key[:length(nodes.key) - 64]),
        sums AS (SELECT p.key, count(*) FILTER (o.n_children = 0) AS n_leaves, CAST(sum((o.n_convs - 1) * o.chars) AS BIGINT) AS saved
                 FROM own o JOIN path p ON p.conv_id = o.conv_id AND p.d <= o.d GROUP BY p.key)
        SELECT conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved AS saved_tokens, ends AS ends_sha256 FROM own JOIN sums USING (key)"""
