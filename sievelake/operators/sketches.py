"""From elements to filters: single filters, unions, intersections, minimum abundance.

Windows are made, chosen and hashed for whole sequences at once, in Arrow batches,
and added up there, so that what is exchanged is distinct numbers with counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import hashing, sequences, windows
from sievelake.workspace import written


DIGITS = str.maketrans("ACGT", "0123")
#: Windows that a task adds up before it gives their q-grams out, rows of a batch given out.
ADDED, GIVEN = 1 << 20, 1 << 16


def _span(seeds: list[str]) -> int:
    spans = {len(sequences.check_seed(s)) for s in seeds}
    if len(spans) != 1:
        raise ValueError("seeds differ in length")
    return spans.pop()


def _keyed(rows: DataFrame, key: Column, seq: Column) -> tuple[DataFrame, str]:
    flat = rows.select(key.alias("key"), seq.alias("seq"))
    return flat, flat.schema["key"].dataType.simpleString()


def _qgrams(batches, span: int, seeds: list[str]):
    """(keys, seed, number of each window's key, packed q-grams, and what finds the other
    windows: characters, places, numbers of their keys) of each piece."""
    for batch, rows, data, ends in windows.pieces(batches, span):
        at, part = windows.places(ends, span)
        codes = windows.codes_of(data)
        good = windows.plain(codes, at, span)
        own, keys = windows.keys_of(batch, rows)
        for seed in seeds:
            # q-grams that don't fit a number go by their characters
            fits = good if seed.count("1") <= windows.MAX_K else np.zeros(len(at), bool)
            yield keys, seed, own[part[fits]], windows.canonical(codes, at[fits], seed), (data, at[~fits], own[part[~fits]])


def _added(pieces):
    """(keys, seed, number of the key, q-gram, n) of pieces (keys, seed, numbers, q-grams), added
    up over ADDED windows. Arrow batches among the pieces are given out as they are."""
    numbers: dict = {}
    held: dict[str, list] = {}
    size, kind = 0, None

    def out():
        keys = pa.array(list(numbers), kind)
        numbers.clear()
        for seed in list(held):
            parts = held.pop(seed)
            g, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            yield keys, seed, *windows.counted(g, v)

    for piece in pieces:
        if isinstance(piece, pa.RecordBatch):
            yield piece
            continue
        keys, seed, groups, values = piece
        kind = keys.type
        of = np.array([numbers.setdefault(k, len(numbers)) for k in keys.to_pylist()], np.int32)
        held.setdefault(seed, []).append((of[groups], values))
        size += len(values)
        if size >= ADDED or len(numbers) >= ADDED >> 4:
            yield from out()
            size = 0
    yield from out()


def qgram_counts(rows: DataFrame, key: Column, seq: Column, seeds: list[str]) -> DataFrame:
    """key, qgram, n: the q-grams of all windows under each seed."""
    span, (flat, kind) = _span(seeds), _keyed(rows, key, seq)
    names = ["key", "code", "odd", "weight", "n"]

    names = ["key", "code", "odd", "weight", "n"]

    def pieces(batches):
        for keys, seed, groups, values, (data, at, odd_groups) in _qgrams(batches, span, seeds):
            yield keys, seed, groups, values
            if len(at):
                odd = [windows.at_seed(w, seed) for w in windows.odd_words(data, at, span)]
                # where the seed skips the other characters, what is left is a word like any
                code = [-1 if len(w) > windows.MAX_K or set(w) - set("ACGT") else int(w.translate(DIGITS), 4) for w in odd]
                spelled_out = [w if c < 0 else None for w, c in zip(odd, code, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(odd_groups)), pa.array(code, pa.int64()), pa.array(spelled_out, pa.string()), pa.array(np.full(len(odd), seed.count("1"), np.int32)), pa.array(np.ones(len(odd), np.int64))], names)

    def run(batches):
        for got in _added(pieces(batches)):
            if isinstance(got, pa.RecordBatch):
                yield got
            else:
                keys, seed, g, v, n = got
                for a in range(0, len(v), GIVEN):
                    b = slice(a, a + GIVEN)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(g[b])), pa.array(v[b]), pa.nulls(len(v[b]), pa.string()), pa.array(np.full(len(v[b]), seed.count("1"), np.int32)), pa.array(n[b])], names)

    added = flat.mapInArrow(run, f"key {kind}, code long, odd string, weight int, n long").groupBy("key", "code", "odd", "weight").agg(F.sum("n").alias("n"))
    # words under seeds of different weight differ, those of one weight meet
    return added.select("key", F.coalesce("odd", spelled(F.col("code"), F.col("weight"))).alias("qgram"), "n")


def spelled(code: Column, k: Column | int) -> Column:
    """A packed word as characters: its base-four digits."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, F.lit("0") if isinstance(k, Column) else "0"), "0123", "ACGT")


def qgram_hashes(rows: DataFrame, key: Column, seq: Column, seeds: list[str], hash_seed: int = 0) -> DataFrame:
    """key, hash (the 64 bits as a signed long), n: per ADDED windows; 0 for q-grams with
    other characters than ACGT."""
    span, (flat, kind) = _span(seeds), _keyed(rows, key, seq)
    names = ["key", "hash", "n"]

    def pieces(batches):
        for keys, seed, groups, values, (data, at, odd_groups) in _qgrams(batches, span, seeds):
            yield keys, seed, groups, values
            if seed.count("1") > windows.MAX_K and len(at):
                h = hashing.hash_words(pa.array([windows.at_seed(w, seed) for w in windows.odd_words(data, at, span)], pa.string()), seed.count("1"), hash_seed)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(odd_groups)), pa.array(h.view(np.int64)), pa.array(np.ones(len(h), np.int64))], names)
            elif len(at):
                code = windows.odd_codes(data, at, seed)
                yield keys, seed, odd_groups[code >= 0], code[code >= 0]
                zero = np.bincount(odd_groups[code < 0], minlength=len(keys))
                g = np.flatnonzero(zero)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(g)), pa.array(np.zeros(len(g), np.int64)), pa.array(zero[g])], names)

    def run(batches):
        for got in _added(pieces(batches)):
            if isinstance(got, pa.RecordBatch):
                yield got
            else:
                keys, seed, g, v, n = got
                for a in range(0, len(v), GIVEN):
                    b = slice(a, a + GIVEN)
                    h = windows.hashes(v[b], seed.count("1"), hash_seed)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(g[b])), pa.array(h.view(np.int64)), pa.array(n[b])], names)

    return flat.mapInArrow(run, f"key {kind}, hash long, n long")


def modulo(h: Column, modulus: int) -> Column:
    """An unsigned 64-bit number modulo a number below 2 to the 62nd."""
    return F.pmod(F.pmod(F.shiftrightunsigned(h, 1), F.lit(modulus)) * 2 + h.bitwiseAND(F.lit(1)), F.lit(modulus))


def qgram_bags(rows: DataFrame, key: Column, seq: Column, seeds: list[str], modulus: int, hash_seed: int = 0) -> DataFrame:
    """key, pos, n: positions with how often each is hit. Q-grams with other characters
    than ACGT hit position 0."""
    pos = modulo(F.col("hash"), modulus)
    return qgram_hashes(rows, key, seq, seeds, hash_seed).groupBy("key", pos.alias("pos")).agg(F.sum("n").alias("n"))


def filters_of(bags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filter, pos) and (filter, set_size): a filter per key; the size counts repeats."""
    return bags.select(F.col("key").alias("filter"), "pos"), bags.groupBy(F.col("key").alias("filter")).agg(F.sum("n").alias("set_size"))


def union_filter(hashed: DataFrame, num_bits: int) -> DataFrame:
    """pos of the union of the filters of all q-grams (key, hash): their hashes taken
    modulo the union's own size, whatever that of the single filters is."""
    return hashed.select(modulo(F.col("hash"), num_bits).alias("pos")).distinct()


def intersection_filter(hashed: DataFrame, num_bits: int) -> DataFrame:
    """pos set in the filter of every key, hashes taken modulo the result's own size."""
    held = written(hashed.select("key", modulo(F.col("hash"), num_bits).alias("pos")).distinct(), "held")
    members = held.agg(F.count_distinct("key").alias("members"))
    return held.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(members)).where("n = members").select("pos")  # one row


def word_counts(rows: DataFrame, seq: Column, k: int, canonical: bool = True) -> DataFrame:
    """code (packed), n of the windows of ACGT of either case; others start the run anew."""
    if k > windows.MAX_K:
        raise ValueError(f"words of more than {windows.MAX_K} bases")

    def run(batches):
        for _, _, data, ends in windows.pieces(batches, k):
            at, _ = windows.places(ends, k)
            codes = windows.codes_of(data, lower=True)
            word, other = windows.both_strands(codes, at[windows.plain(codes, at, k)], k)
            v, n = np.unique(np.minimum(word, other) if canonical else word, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n)], ["code", "n"])

    flat = rows.select(F.lit(0).alias("key"), seq.alias("seq"))
    return flat.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def long_word_counts(rows: DataFrame, seq: Column, k: int, canonical: bool = True) -> DataFrame:
    """kmer, n as ``word_counts``, for words that don't fit a number: by their characters."""

    def run(batches):
        for _, _, data, ends in windows.pieces(batches, k):
            at, _ = windows.places(ends, k)
            codes = windows.codes_of(data, lower=True)
            at = at[windows.plain(codes, at, k)]
            upper = np.frombuffer(b"ACGTN", np.uint8)[codes]
            words = windows.odd_words(upper, at, k) if canonical else [upper[i : i + k].tobytes().decode() for i in at.tolist()]
            v, n = np.unique(np.array(words, str), return_counts=True) if words else (np.zeros(0, str), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(v.tolist(), pa.string()), pa.array(n.astype(np.int64))], ["kmer", "n"])

    return rows.select(F.lit(0).alias("key"), seq.alias("seq")).mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def kmer_counts(rows: DataFrame, seq: Column, k: int, at_least: int = 1, canonical: bool = True) -> DataFrame:
    """kmer, n over all rows: (canonical) words of ACGT that occur often enough."""
    if k > windows.MAX_K:
        return long_word_counts(rows, seq, k, canonical).where(F.col("n") >= at_least)
    found = word_counts(rows, seq, k, canonical).where(F.col("n") >= at_least)
    return found.select(spelled(F.col("code"), k).alias("kmer"), "n")


def strand_agreement(rows: DataFrame, seq: Column, k: int, seed: int = 0) -> DataFrame:
    """same, n: windows whose two-strand hash is, or isn't, that of their reverse complement."""

    def run(batches):
        for _, _, data, ends in windows.pieces(batches, k):
            at, _ = windows.places(ends, k)
            codes = windows.codes_of(data)
            word, other = windows.both_strands(codes, at[windows.plain(codes, at, k)], k)
            same, n = np.unique(windows.hashes(word, k, seed, other) == windows.hashes(other, k, seed, word), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(same), pa.array(n)], ["same", "n"])

    return rows.select(F.lit(0).alias("key"), seq.alias("seq")).mapInArrow(run, "same boolean, n long").groupBy("same").agg(F.sum("n").alias("n"))


def kmer_filter(counts: DataFrame, k: int, modulus: int, num_bits: int, num_hashes: int = 1, seeds: tuple[int, int] = (0, 1)) -> DataFrame:
    """pos of a Bloom filter of the k-mers; positions at num_bits or beyond fall away."""
    return counts.select(F.explode(hashing.positions(F.col("kmer"), k, modulus, num_hashes, seeds)).alias("pos")).where(F.col("pos") < num_bits).distinct()


def contains(queries: DataFrame, bits: DataFrame, k: int, modulus: int, num_hashes: int, seeds: tuple[int, int] = (0, 1)) -> DataFrame:
    """kmer, present: whether all positions of a k-mer are set."""
    at = queries.select("kmer").distinct().select("kmer", F.explode(F.array_distinct(hashing.positions(F.col("kmer"), k, modulus, num_hashes, seeds))).alias("pos"))
    marked = at.join(bits.select("pos", F.lit(True).alias("set")), "pos", "left")
    return marked.groupBy("kmer").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("present"))


def consistent(filters: DataFrame, parameters: list[str]) -> DataFrame:
    """parameter, values of the parameters that differ between filters: none if they agree."""
    counts = filters.agg(*[F.count_distinct(F.coalesce(F.col(p).cast("string"), F.lit("null"))).alias(p) for p in parameters])
    return counts.unpivot([], parameters, "parameter", "values").where("values > 1")
