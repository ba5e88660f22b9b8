"""Language identification with character language models.

One interpolated Kneser-Ney model of character ``order``-grams per language is
estimated from the labelled rows given. Tasks count the n-grams of their rows'
distinct words; Spark adds them up and derives continuation counts, discounts
and context totals with joins and aggregates. All n-grams are kept: a model is a
table in the shared folder, by language and order, of 64-bit hashes in order with
their counts, and tasks read it as arrays that are looked up by binary search.
Nothing of it passes the driver but five rows of totals per language.

A language needs 12 bytes a distinct n-gram and 16 a context in a task's memory,
some 20 bytes per n-gram together. Languages are independent of each other, so
they are scored in groups of ``memory`` bytes at most, each in a pass over the
documents (one language above that is a group of its own); results don't depend
on the grouping.

A text gets the language of the lowest cross-entropy per character. It is
rejected if that cross-entropy lies far outside what held-out labelled texts of
the language show, both as such and in proportion to the length (see
``calibrate``), or if it has no letter. Characters other than letters and marks
only separate words.

Defined results: null texts and texts without a letter are ``und`` with score 0
and rejected; ties go to the alphabetically first language; without any labelled
row everything is ``und``. Very long texts take time in proportion to their length.
Equal texts get equal results; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.batches import slices
from sievelake.workspace import scratch, written

BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


@dataclass
class Words:
    """The distinct words of a batch and where they stand."""

    cleaned: list[str]  # lower case, letters and marks, other characters as one space
    lettered: np.ndarray
    index: np.ndarray  # of each word of each text
    offsets: np.ndarray  # of each text in index


def words_of(texts: pa.Array) -> Words:
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    coded = pc.dictionary_encode(lists.values)
    cleaned = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}\p{M}]+", " "), " ")
    lettered = np.asarray(pc.match_substring_regex(cleaned, r"\p{L}"))
    return Words(cleaned.to_pylist(), lettered.astype(bool), np.asarray(coded.indices).astype(np.int64), offsets)


def grams_of(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each predicted character of each word (its end counts as one): the
    hashes of the n-grams of order 0 to ``order`` that end there, and the word's number.

    A hash is a polynomial, so that dropping an n-gram's first character gives
    the hash of the next shorter one: hashes[k] is the suffix of hashes[k + 1].
    """
    pad = "\0" * (order - 1)
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words)) + order
    codes = np.frombuffer("".join([f"{pad}{w}\0" for w in words]).replace(" ", "\0").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), sizes)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.flatnonzero(np.arange(len(codes)) - starts >= order - 1)
    hashes, power = [np.zeros(len(ends), np.uint64)], np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(order):
            hashes.append(hashes[-1] + codes[ends - k] * power)
            power = power * BASE
    return hashes, word[ends]


def contexts_of(hashes: list[np.ndarray], order: int) -> list[np.ndarray]:
    """Hash of the context (all but the last character) of each order's n-gram:
    (hash - last code) / BASE, as BASE is odd."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return [None, *[(hashes[k] - hashes[1]) * inverse for k in range(1, order + 1)]]


def count_grams(labelled: DataFrame, order: int, flush: int = 250_000) -> DataFrame:
    """lang, k, gram, suffix, context, n: the n-grams of all rows (text, lang); n
    is their number for the longest only, for the others the next step finds weights."""
    fields = "lang string, k int, gram long, suffix long, context long, n long"
    names = [f.split()[0] for f in fields.split(", ")]

    def merged(parts):
        keys, rest, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        return keys, rest[at], np.bincount(inverse, n, len(keys)).astype(np.int64)

    def out(held):
        for (lang, k), parts in held.items():
            keys, rest, n = merged(parts)
            for at in range(0, len(keys), 200_000):
                s = slice(at, at + 200_000)
                size = len(keys[s])
                columns = [pa.array([lang] * size, pa.string()), pa.array(np.full(size, k, np.int32)), pa.array(keys[s].view(np.int64)), pa.array(np.ascontiguousarray(rest[s, 0]).view(np.int64)), pa.array(np.ascontiguousarray(rest[s, 1]).view(np.int64)), pa.array(n[s])]
                yield pa.RecordBatch.from_arrays(columns, names)
        held.clear()

    def run(batches):
        held: dict[tuple[str, int], list] = {}
        size = 0
        for batch in slices(batches, 0, 2 << 20):
            langs = batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                words = words_of(batch.column(0).filter(pc.equal(langs, lang)))
                times = np.bincount(words.index, minlength=len(words.cleaned))
                kept = [i for i, w in enumerate(words.cleaned) if w]
                if not kept:
                    continue
                for first in range(0, len(kept), 15_000):
                    some = kept[first : first + 15_000]
                    hashes, word = grams_of([words.cleaned[i] for i in some], order)
                    contexts, weights = contexts_of(hashes, order), times[some][word]
                    # the shorter n-grams are those that end the longest ones
                    keys, at, inverse = np.unique(hashes[order], return_index=True, return_inverse=True)
                    hashes, contexts = [h[at] for h in hashes], [None, *[c[at] for c in contexts[1:]]]
                    n = np.bincount(inverse, weights, len(keys)).astype(np.int64)
                    for k in range(order, 0, -1):
                        keys, at = np.unique(hashes[k], return_index=True)
                        part = keys, np.stack([hashes[k - 1][at], contexts[k][at]], axis=1), n[at]
                        parts = held.setdefault((lang, k), [])
                        parts.append(part)
                        if len(parts) > 4:
                            held[lang, k] = [merged(parts)]
            size = sum(len(p[0]) for parts in held.values() for p in parts)
            if size > flush:
                yield from out(held)
        yield from out(held)

    rows = labelled.select("text", "lang").mapInArrow(run, fields)
    return rows.groupBy("lang", "k", "gram").agg(F.min("suffix").alias("suffix"), F.min("context").alias("context"), F.sum("n").alias("n"))


@dataclass
class Level:
    """One order of one language's model."""

    discount: float
    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray


@dataclass
class Model:
    """Where the arrays are and what is needed besides them; slot = language * 16 + order."""

    order: int
    languages: list[str]
    path: str | None
    discounts: dict[int, float]
    sizes: dict[int, int]  # n-grams by slot
    limits: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)

    def groups(self, memory: int) -> list[list[int]]:
        """Languages that a task holds at once."""
        out, held = [], 0
        for j in range(len(self.languages)):
            own = 28 * sum(self.sizes[j * 16 + k] for k in range(1, self.order + 1))
            if not out or held + own > memory:
                out.append([])
                held = 0
            out[-1].append(j)
            held += own
        return out

    def levels(self, j: int) -> list[Level]:
        return [Level(self.discounts[j * 16 + k], *_arrays(f"{self.path}/grams", j * 16 + k, "a"), *_arrays(f"{self.path}/contexts", j * 16 + k, "total", "kinds")) for k in range(1, self.order + 1)]


def _arrays(path: str, slot: int, *values: str) -> list[np.ndarray]:
    """The sorted hashes of a slot and what belongs to them."""
    store, root = fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(f"{root}/slot={slot}")) if f.path.endswith(".parquet"))
    tables = [pq.ParquetFile(store.open_input_file(f)).read(["hash", *values]) for f in files]
    # signed hashes are in order within a file and from file to file; as unsigned ones they are in two runs
    columns = [np.concatenate([np.asarray(t.column(c)) for t in tables]) for c in ("hash", *values)]
    keys = columns[0].view(np.uint64)
    by = np.argsort(keys, kind="stable")
    return [keys[by], *[c[by] for c in columns[1:]]]


class Scorer:
    """The languages of one group, in a task."""

    def __init__(self, model: Model, group: list[int]):
        self.order = model.order
        self.levels = [model.levels(j) for j in group]

    def bits(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Bits of each word under each language, and the number of predicted characters."""
        bits, sizes = [np.zeros(len(words)) for _ in self.levels], np.zeros(len(words))
        step = 15_000
        for at in range(0, len(words), step):
            part = words[at : at + step]
            hashes, word = grams_of(part, self.order)
            _, first, inverse = np.unique(hashes[-1], return_index=True, return_inverse=True)
            own = [h[first] for h in hashes]
            contexts = contexts_of(own, self.order)
            # distinct and sorted, so that looking them up is quick for every language
            grams = [None, *[np.unique(h, return_inverse=True) for h in own[1:]]]
            around = [None, *[np.unique(h, return_inverse=True) for h in contexts[1:]]]
            sizes[at : at + step] = np.bincount(word, minlength=len(part))
            for j, levels in enumerate(self.levels):
                p = np.full(len(first), 1 / (len(levels[0].grams) + 1))
                for k, level in enumerate(levels, 1):
                    (seen,) = lookup(level.grams, grams[k][0], level.counts)
                    total, kinds = lookup(level.contexts, around[k][0], level.totals, level.kinds)
                    seen, total, kinds = seen[grams[k][1]], total[around[k][1]], kinds[around[k][1]]
                    known = total > 0
                    p = np.where(known, (np.maximum(seen - level.discount, 0) + level.discount * kinds * p) / np.where(known, total, 1), p)
                bits[j][at : at + step] = np.bincount(word, -np.log2(p)[inverse], len(part))
        return bits, sizes


def lookup(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values of each wanted hash in a sorted hash array, 0 where absent."""
    if not len(keys):
        return [np.zeros(len(wanted))] * len(values)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return [np.where(found, v[at], 0).astype(float) for v in values]


def fit(labelled: DataFrame, order: int = 5) -> Model:
    """A model of the rows (text, lang), lang not null."""
    spark = labelled.sparkSession
    counted = written(count_grams(labelled, order), "langid-grams")
    totals = counted.groupBy("lang", "k").agg(F.count(F.lit(1)).alias("grams")).collect()
    languages = sorted({r["lang"] for r in totals})
    if not languages:
        return Model(order, [], None, {}, {})
    numbers = spark.createDataFrame(list(enumerate(languages)), "j int, lang string")
    counted = counted.join(numbers, "lang").withColumn("slot", F.col("j") * 16 + F.col("k"))
    # the weight of a shorter n-gram: how many different characters come before it
    before = counted.where("k > 1").groupBy((F.col("slot") - 1).alias("slot"), F.col("suffix").alias("gram")).agg(F.count(F.lit(1)).alias("before"))
    grams = counted.join(before, ["slot", "gram"], "left").withColumn("a", F.when(F.col("k") == order, F.col("n")).otherwise(F.coalesce("before", F.lit(1))))
    grams = written(grams.select("slot", "gram", "context", "a"), "langid-weights")
    sizes = {r["slot"]: r for r in grams.groupBy("slot").agg(F.count_if(F.col("a") == 1).alias("n1"), F.count_if(F.col("a") == 2).alias("n2"), F.count(F.lit(1)).alias("grams")).collect()}
    path = scratch(spark, "langid-model")
    files = max(1, sum(r["grams"] for r in sizes.values()) // 2_000_000)

    def save(rows: DataFrame, name: str) -> None:
        rows.repartitionByRange(files, "slot", "hash").sortWithinPartitions("slot", "hash").write.partitionBy("slot").parquet(f"{path}/{name}")

    save(grams.select("slot", F.col("gram").alias("hash"), F.col("a").cast("float").alias("a")), "grams")
    contexts = grams.groupBy("slot", F.col("context").alias("hash")).agg(F.sum("a").cast("float").alias("total"), F.count(F.lit(1)).cast("float").alias("kinds"))
    save(contexts, "contexts")
    discounts = {slot: r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5 for slot, r in sizes.items()}
    return Model(order, languages, path, discounts, {slot: r["grams"] for slot, r in sizes.items()})


def _score(rows: DataFrame, model: Model, memory: int) -> DataFrame:
    """The columns of ``rows``, packed in ``row``, with each (bits per character under
    each language), size (predicted characters) and lettered."""
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col("text"), F.array().cast("array<double>").alias("each"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("lettered"))
    kind = packed.schema["row"].dataType.simpleString()
    groups = model.groups(memory)

    def scoring(group: list[int]):
        def run(batches):
            scorer = Scorer(model, group)
            for batch in slices(batches, 1, 2 << 20):
                words = words_of(batch.column(1))
                texts = batch.num_rows
                kept = np.array([i for i, w in enumerate(words.cleaned) if w], np.int64)
                bits, sizes = scorer.bits([words.cleaned[i] for i in kept.tolist()]) if len(kept) else ([np.zeros(0)] * len(group), np.zeros(0))
                place = np.zeros(len(words.cleaned) + 1, np.int64)
                place[kept] = np.arange(1, len(kept) + 1)
                index = place[words.index]
                text = np.repeat(np.arange(texts), np.diff(words.offsets))
                sums = [np.bincount(text, np.append(0, x)[index], texts) for x in (sizes, *bits)]
                letters = np.bincount(text, words.lettered[words.index], texts) > 0
                new = np.stack(sums[1:], axis=1) / np.maximum(sums[0], 1)[:, None]
                before = batch.column(2)
                if len(before.flatten()):
                    new = np.concatenate([np.asarray(before.flatten()).reshape(texts, -1), new], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, new.size + 1, max(1, new.shape[1]), dtype=np.int32)), pa.array(new.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(sums[0].astype(np.int64)), pa.array(letters)], ["row", "text", "each", "size", "lettered"])

        return run

    for n, group in enumerate(groups):
        if n:
            packed = written(packed, "langid-group")
        packed = packed.mapInArrow(scoring(group), f"row {kind}, text string, each array<double>, size long, lettered boolean")
    return packed


def _predicted(scored: DataFrame, model: Model) -> DataFrame:
    """row with lang_pred, score, bits and size."""
    if not model.languages:
        return scored.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"), "size")
    low = F.array_min("each")
    name = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("each", low).cast("int"))
    score = 1 / F.aggregate("each", F.lit(0.0), lambda held, e: held + F.pow(F.lit(2.0), 10 * (low - e)))
    return scored.select("row", F.when(F.col("lettered"), name).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("lettered"), F.round(score, 6)).otherwise(0.0).alias("score"), low.alias("bits"), "size")


MEMORY = 256 << 20


def calibrate(model: Model, held_out: DataFrame, least: int = 30, memory: int = MEMORY) -> Model:
    """Learns from labelled rows that the model was not fitted on, for each language,
    mean and deviation of the bits per character, and of the excess over that mean
    times the square root of the length (short texts scatter more). A language with
    fewer than ``least`` such rows takes the widest limits of the others."""
    scored = written(_predicted(_score(held_out.select("text", "lang"), model, memory), model).where("lang_pred = row.lang").select("lang_pred", "bits", "size"), "langid-bits")
    own = scored.groupBy("lang_pred").agg(F.avg("bits").alias("mean"), F.stddev_pop("bits").alias("sd"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    excess = scored.join(F.broadcast(own), "lang_pred").withColumn("z", (F.col("bits") - F.col("mean")) * F.sqrt("size"))
    for r in excess.groupBy("lang_pred").agg(F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.avg("z").alias("zm"), F.stddev_pop("z").alias("zs")).collect():
        model.limits[r["lang_pred"]] = (r["mean"], r["sd"], r["zm"], r["zs"])
    if model.limits:
        widest = tuple(max(x) for x in zip(*model.limits.values(), strict=True))
        for lang in model.languages:
            model.limits.setdefault(lang, widest)
    return model


def learn(labelled: DataFrame, order: int = 5, fold: int = 10, least: int = 30, memory: int = MEMORY) -> Model:
    """A model fitted on the rows (text, lang) of all but one of ``fold`` folds, by the
    texts' hashes, and calibrated on the one left. Languages with fewer than ``fold`` x
    ``least`` rows hold none out: all of them go into the model."""
    known = labelled.where("lang IS NOT NULL").select("text", "lang")
    large = [r["lang"] for r in known.groupBy("lang").count().where(F.col("count") >= fold * least).collect()]
    held_out = F.coalesce((F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(fold)) == 0) & F.col("lang").isin(large), F.lit(False))
    return calibrate(fit(known.where(~held_out), order), known.where(held_out), least, memory)


def identify(docs: DataFrame, model: Model, deviations: float = 6.0, memory: int = MEMORY) -> DataFrame:
    """``docs`` with lang_pred, score and rejected (columns of these names are replaced)."""
    scored = _predicted(_score(docs.drop("lang_pred", "score", "rejected"), model, memory), model)
    far = F.lit(False)
    for lang, (mean, sd, zm, zs) in model.limits.items():
        z = (F.col("bits") - mean) * F.sqrt("size")
        far = far | ((F.col("lang_pred") == lang) & (F.col("bits") > mean + deviations * sd) & (z > zm + deviations * zs))
    return scored.select("row.*", "lang_pred", "score", (far | (F.col("lang_pred") == UNKNOWN)).alias("rejected"))
