"""From matches to the sets present in a sample and their proportions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.functions import sequences
from sievelake.operators import covers
from sievelake.workspace import written


def dense_matrix(found: DataFrame, reads: DataFrame, strains: DataFrame) -> DataFrame:
    """read, strain, frac of every pair, 0 where there is no match; a match of an unknown strain is an error."""
    strains = strains.select("strain").distinct()
    known = found.join(F.broadcast(strains.withColumn("known", F.lit(True))), "strain", "left")
    checked = known.select("read", F.when(F.col("known"), F.col("strain")).otherwise(F.raise_error(F.concat(F.lit("unknown strain: "), F.col("strain").cast("string")))).alias("strain"), "frac")
    listed = strains.agg(F.array_sort(F.collect_list("strain")).alias("all"))
    pairs = reads.select("read").distinct().join(F.broadcast(listed)).select("read", F.explode("all").alias("strain"))
    return pairs.join(checked, ["read", "strain"], "left").select("read", "strain", F.coalesce("frac", F.lit(0.0)).alias("frac"))


def rank_weights(found: DataFrame, at_least: int = 50, top: int = 12) -> DataFrame:
    """read, strain, pct, weight. Candidates of a read are its matches of enough
    percent; reads with int(1.5 top) or more are dropped as ambiguous. Of the rest the
    best ``top`` stay (ties by strain), weighted by reversed dense rank: the weakest has 0."""
    pct = sequences.percent(F.col("frac"))
    candidates = found.select("read", "strain", pct.alias("pct")).where(F.col("pct") >= at_least)
    read = W.partitionBy("read")
    order = read.orderBy(F.desc("pct"), "strain")
    cut = candidates.withColumn("n", F.count(F.lit(1)).over(read)).where(F.col("n") < int(top * 1.5)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    dense = cut.withColumn("dense", F.dense_rank().over(read.orderBy(F.desc("pct"))))
    return dense.select("read", "strain", "pct", (F.max("dense").over(read) - F.col("dense")).cast("int").alias("weight"))


def ambiguous_reads(found: DataFrame, at_least: int = 50, top: int = 12) -> DataFrame:
    """read, candidates of the reads that are dropped."""
    pct = sequences.percent(F.col("frac"))
    counts = found.where(pct >= at_least).groupBy("read").agg(F.count(F.lit(1)).alias("candidates"))
    return counts.where(F.col("candidates") >= int(top * 1.5))


def marginal(ranks: DataFrame) -> DataFrame:
    """strain, reads, weight, is_marginal: at most 1 % of the reads or 2 % of the weight (whole-number division)."""
    per = ranks.groupBy("strain").agg(F.count(F.lit(1)).alias("reads"), F.sum("weight").cast("long").alias("weight"))
    limits = ranks.agg(F.count_distinct("read").alias("elements"), F.sum("weight").alias("all_weight")).select(F.expr("(elements + 50) div 100").alias("n1"), F.expr("(all_weight + 25) div 50").alias("n2"))
    return per.join(F.broadcast(limits)).select("strain", "reads", "weight", ((F.col("reads") <= F.col("n1")) | (F.col("weight") <= F.col("n2"))).alias("is_marginal"))


def cover(ranks: DataFrame, max_shapes: int = 200_000) -> DataFrame:
    """strain, support, signed of the best cover of the reads.

    Marginal strains can't be chosen, and reads that one of them matches need no
    cover. Every other read needs a chosen strain; a chosen strain needs a read that
    no other chosen one matches. Fewest strains first, then the largest weight,
    then the largest signed support (weight of reads with one chosen cover, and of
    the larger of two, if it is over 1 and the other has no read of its own), then
    the smallest set of names.

    Reads with the same weighted strains are one row. The smallest covers of the
    largest weight are found by branch and bound over rows (``_best_covers``), whatever
    the number of strains. Those alone are judged. The groups go along as one row;
    ``max_shapes`` bounds their number."""
    spark = ranks.sparkSession
    strains = [r["strain"] for r in marginal(ranks).where("NOT is_marginal").orderBy("strain").collect()]
    kind = ranks.schema["strain"].dataType.simpleString()
    if not strains:
        return spark.createDataFrame([], f"strain {kind}, support long, signed long")
    number = spark.createDataFrame(list(enumerate(strains)), f"bit int, strain {kind}")
    coded = ranks.join(F.broadcast(number), "strain", "left")
    reads = coded.groupBy("read").agg(F.sort_array(F.collect_list(F.when(F.col("bit").isNotNull(), F.struct("bit", "weight")))).alias("w"), F.bool_or(F.col("bit").isNull()).alias("marginal"))
    shapes = written(reads.where(F.size("w") > 0).groupBy("w", "marginal").agg(F.count(F.lit(1)).alias("n")), "shapes")
    need = shapes.where("NOT marginal").select(F.transform("w", lambda s: s["bit"]).alias("mask")).distinct()
    n_need = need.count()
    if n_need > max_shapes:
        raise ValueError(f"{n_need} groups of strains are more than max_shapes")
    weights = shapes.select("n", F.explode("w").alias("s")).groupBy(F.col("s.bit").alias("bit")).agg(F.sum(F.col("n") * F.col("s.weight")).cast("long").alias("weight"))
    sets = _best_covers(need, n_need, number, weights)
    chosen = sets.select("chosen", F.explode("chosen").alias("bit"))
    met = chosen.join(shapes.select("w", "marginal", "n", F.explode("w").alias("s")).withColumn("bit", F.col("s.bit")), "bit").groupBy("chosen", "w", "marginal", "n").agg(F.collect_list("s").alias("hit"))
    each = met.select("chosen", "n", F.size("hit").alias("covers"), F.explode("hit").alias("s")).select("chosen", "n", "covers", "s.bit", "s.weight")
    per = each.groupBy("chosen", "bit").agg(F.sum(F.when(F.col("covers") == 1, F.col("n")).otherwise(0)).alias("own"), F.sum(F.col("n") * F.col("weight")).alias("support"), F.sum(F.when(F.col("covers") == 1, F.col("n") * F.col("weight")).otherwise(0)).alias("alone"))
    lone = per.where("alone > 0").select("chosen", F.col("bit").alias("other"))
    # the other strain's weight on the same reads
    first, second = F.col("hit")[0], F.col("hit")[1]
    pairs = met.where(F.size("hit") == 2).select("chosen", "n", F.explode(F.array(F.struct(first.alias("x"), second.alias("y")), F.struct(second.alias("x"), first.alias("y")))).alias("p"))
    pairs = pairs.where("p.x.weight > 1 AND p.x.weight > p.y.weight").select("chosen", "n", F.col("p.x.bit").alias("bit"), F.col("p.x.weight").alias("weight"), F.col("p.y.bit").alias("other"))
    won = pairs.join(lone, ["chosen", "other"], "left_anti").groupBy("chosen", "bit").agg(F.sum(F.col("n") * F.col("weight")).alias("won"))
    scored = per.join(won, ["chosen", "bit"], "left").withColumn("signed", F.col("alone") + F.coalesce("won", F.lit(0)))
    whole = scored.groupBy("chosen").agg(F.count(F.lit(1)).alias("k"), F.min("own").alias("own"), F.sum("support").alias("w"), F.sum("signed").alias("s"))
    best = whole.where((F.col("own") > 0) & (F.col("k") == F.size("chosen"))).orderBy("k", F.desc("w"), F.desc("s"), "chosen").limit(1)
    return scored.join(F.broadcast(best.select("chosen")), "chosen").join(F.broadcast(number), "bit").select("strain", F.col("support").cast("long").alias("support"), F.col("signed").cast("long").alias("signed"))


def _best_covers(need: DataFrame, n_need: int, number: DataFrame, weights: DataFrame, budget: int = 5_000) -> DataFrame:
    """chosen (ordered bits): the sets of the fewest bits that have one of every mask, and of
    these the ones of the largest weight; without masks, every single bit.

    Branch and bound. Sub-problems are rows: bits chosen, and bits banned as another row
    has them. A task works on its rows until ``budget`` steps are done; what is open then
    are rows of the next round, dealt out anew, and all tasks of a round know the best
    cover of the rounds before. Before that, groups that hold another one are left
    out, and bits whose groups another bit of more weight has as well."""
    spark = need.sparkSession
    if not n_need:
        return number.select(F.array("bit").alias("chosen"))
    listed = need.agg(F.array_sort(F.collect_list("mask")).alias("need"))
    weighed = number.join(weights, "bit", "left").agg(F.array_sort(F.collect_list(F.struct("bit", F.coalesce("weight", F.lit(0)).alias("weight")))).alias("w"))
    problem = listed.join(F.broadcast(weighed)).select("need", F.transform("w", lambda x: x["weight"]).alias("weights"))  # one row each

    def reduce(batches):
        for batch in batches:
            rows = [covers.reduced(*r) for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            greedy = [covers.greedy(*r) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.list_(pa.int32()))), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array(greedy, pa.list_(pa.int32()))], ["need", "weights", "greedy"])

    problem = written(problem.mapInArrow(reduce, "need array<array<int>>, weights array<long>, greedy array<int>"), "cover-problem")
    fields = "chosen array<int>, banned array<int>, whole boolean, size int, weight long"

    def search(batches):
        solver = None
        for batch in batches:
            for chosen, banned, groups, weight, size, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                solver = solver or covers.Search(groups, weight, size, best, budget)
                solver.run(chosen, banned)
        if solver is not None:
            rows = [(sorted(c), [], True, len(c), solver.weight) for c in solver.best] + [(c, x, False, 0, 0) for c, x in solver.open]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in fields.split(", ")])

    first = problem.select("greedy", F.aggregate("greedy", F.lit(0).cast("long"), lambda a, b: a + F.get("weights", b)).alias("weight")).first()
    bound = (len(first["greedy"]), first["weight"])
    open_ = spark.createDataFrame([([], [])], "chosen array<int>, banned array<int>")
    found, tasks = None, spark.sparkContext.defaultParallelism
    while True:
        known = problem.select("need", "weights", F.lit(bound[0]).alias("size"), F.lit(bound[1]).cast("long").alias("best"))
        rows = open_.repartition(tasks).join(F.broadcast(known)).select("chosen", "banned", "need", "weights", "size", "best")  # one row
        told = written(rows.mapInArrow(search, fields), "covers")
        found = told.where("whole") if found is None else found.union(told.where("whole"))
        top = told.where("whole").agg(F.min(F.struct("size", (-F.col("weight")).alias("less")))).first()[0]
        bound = bound if top is None else min(bound, (top["size"], -top["less"]), key=lambda b: (b[0], -b[1]))
        open_ = told.where("NOT whole").select("chosen", "banned")
        if open_.isEmpty():
            break
    return found.where((F.col("size") == bound[0]) & (F.col("weight") == bound[1])).select("chosen").distinct()


def read_sets(found: DataFrame, kept: DataFrame) -> DataFrame:
    """members (ordered strains), n: how many reads match just these of the kept strains."""
    sets = found.join(F.broadcast(kept.select("strain").distinct()), "strain", "left_semi").groupBy("read").agg(F.array_sort(F.collect_set("strain")).alias("members"))
    return sets.groupBy("members").agg(F.count(F.lit(1)).alias("n"))


def lengths_of(strains: DataFrame, lengths: DataFrame) -> DataFrame:
    """strain, length; a name without a length of its own is tried with dashes for underscores."""
    from sievelake.functions import names

    first = strains.select("strain", names.dashed(F.col("strain").cast("string")).alias("dashed"))
    own = lengths.select("strain", F.col("length").alias("own"))
    other = lengths.select(F.col("strain").cast("string").alias("dashed"), F.col("length").alias("other"))
    return first.join(own, "strain", "left").join(other, "dashed", "left").select("strain", F.coalesce("own", "other").alias("length"))


EM_BLOCK = 1 << 16


def abundance(sets: DataFrame, lengths: DataFrame, steps: int = 100, block: int = EM_BLOCK) -> DataFrame:
    """strain, abundance after a fixed number of expectation-maximisation steps. A member
    of a set without a length is an error.

    Reads are already collapsed to sets of strains; these are packed into blocks of numbers
    (members, ends, counts), which stay where they are. A step sends the proportions, a
    number for each strain, to all blocks and gets back as many sums from each task. What
    a single block holds takes its steps without going back in between, by the same
    function."""
    spark = sets.sparkSession
    known = lengths.select("strain", "length").orderBy("strain").collect()
    kind = lengths.schema["strain"].dataType.simpleString()
    size = np.array([np.nan if r["length"] is None else float(r["length"]) for r in known])
    listed = [(r["strain"], i) for i, r in enumerate(known) if r["length"] is not None]
    number = spark.createDataFrame(listed, f"strain {kind}, at int").agg(F.map_from_entries(F.collect_list(F.struct("strain", "at"))).alias("number"))  # one row
    missing = lambda m: F.raise_error(F.concat(F.lit("no length: "), m.cast("string"))).cast("int")
    coded = sets.join(F.broadcast(number)).select(F.transform("members", lambda m: F.coalesce(F.try_element_at("number", m), missing(m))).alias("at"), F.col("n").cast("double").alias("n"))

    def pack(batches):
        at, n = [], []

        def out():
            ends = np.cumsum([len(x) for x in at])
            packed = (np.concatenate(at).astype(np.int32), ends.astype(np.int32), np.array(n))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], ["at", "ends", "n"])

        for batch in batches:
            for members, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at.append(np.array(members, np.int32))
                n.append(count)
                if len(n) >= block:
                    yield out()
                    at, n = [], []
        if n:
            yield out()

    blocks = written(coded.where("size(at) > 0").mapInArrow(pack, "at binary, ends binary, n binary"), "abundance-blocks")
    unpacked = lambda row: (np.frombuffer(row[0], np.int32), np.frombuffer(row[1], np.int32), np.frombuffer(row[2]))

    def advanced(a, shares):
        raw = np.where(shares > 0, a * shares / size, 0.0)
        return raw / raw.sum() if raw.sum() else raw

    def whole(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, a = unpacked(row), np.full(len(size), 1 / len(size))
                for _ in range(steps):
                    a = advanced(a, _shares(*held, a))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a), dtype=np.int32)), pa.array(a)], ["at", "a"])

    if blocks.count() == 1:
        ended = blocks.mapInArrow(whole, "at int, a double")
    else:
        a = np.full(len(size), 1 / max(1, len(size)))
        for _ in range(steps):

            def step(batches, a=a):
                total = np.zeros(len(a))
                for batch in batches:
                    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        total += _shares(*unpacked(row), a)
                met = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["at", "q"])

            shares = np.zeros(len(a))
            for r in blocks.mapInArrow(step, "at int, q double").groupBy("at").agg(F.sum("q").alias("q")).collect():
                shares[r["at"]] = r["q"]
            a = advanced(a, shares)
        ended = spark.createDataFrame(list(enumerate(a.tolist())), "at int, a double")
    names = spark.createDataFrame([(r["strain"], i) for i, r in enumerate(known)], f"strain {kind}, at int")
    return names.join(F.broadcast(ended), "at").select("strain", F.round("a", 2).alias("abundance"), F.round("a", 6).alias("exact"))


def _shares(at: np.ndarray, ends: np.ndarray, n: np.ndarray, a: np.ndarray) -> np.ndarray:
    """By strain, the sum over the sets that have it of their reads over their proportions."""
    starts = np.append(0, ends[:-1])
    p = np.add.reduceat(a[at], starts)
    q = np.divide(n, p, out=np.zeros(len(n)), where=p > 0)
    return np.bincount(at, np.repeat(q, np.diff(np.append(0, ends))), len(a))


def log_likelihood(sets: DataFrame, abundances: DataFrame) -> DataFrame:
    """log_likelihood of the reads under given proportions (exact). A member without one is an error."""
    each = sets.withColumn("set", F.col("members")).select("set", "n", F.explode("members").alias("strain")).join(F.broadcast(abundances), "strain", "left")
    known = F.coalesce("exact", F.raise_error(F.concat(F.lit("no proportion: "), F.col("strain").cast("string"))).cast("double"))
    return each.groupBy("set", "n").agg(F.sum(known).alias("p")).agg(F.round(F.sum(F.col("n") * F.log("p")), 4).alias("log_likelihood"))
