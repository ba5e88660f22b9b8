"""Column functions on sequences: windows, complements, spaced seeds, read quality."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The recommended seed, and complements of the nucleotide codes.
DEFAULT_SEED = "111111001111111"
COMPLEMENT = ("ACGT", "TGCA")
IUPAC_COMPLEMENT = ("ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd")


def reverse_complement(seq: Column, iupac: bool = False) -> Column:
    """Upper-case ACGT alone are swapped, or all nucleotide codes in both cases."""
    return F.translate(F.reverse(seq), *(IUPAC_COMPLEMENT if iupac else COMPLEMENT))


def canonical(mer: Column, iupac: bool = False) -> Column:
    """The smaller of a word and its reverse complement."""
    return F.least(mer, reverse_complement(mer, iupac))


def check_seed(seed: str) -> str:
    """A 0/1 string of at most 127 characters; anything else is an error."""
    if not re.fullmatch("[01]{1,127}", seed):
        raise ValueError(f"not a spaced seed: {seed!r}")
    return seed


def apply_seed(mer: Column, seed: str) -> Column:
    """The characters at the seed's 1 positions."""
    runs = [(m.start() + 1, len(m[0])) for m in re.finditer("1+", check_seed(seed))]
    return F.concat(*[F.substring(mer, at, size) for at, size in runs])


def as_nucleotides(text: Column) -> Column:
    """Letters of a text as nucleotides: a, b, c, d, e, ... are A, C, G, T, A, ..."""
    letters = "".join(map(chr, range(97, 123)))
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), letters, ("ACGT" * 7)[:26])


def as_reads(text: Column) -> Column:
    """Letters of a text as bases of reads: as ``as_nucleotides``, but capitals give
    small letters, and q, x and z (either case) an N."""
    letters = "".join(map(chr, range(97, 123)))
    bases = ("ACGT" * 7)[:26]
    own = "".join("N" if c in "qxz" else b for c, b in zip(letters, bases, strict=True))
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), letters + letters.upper(), own + own.lower().replace("n", "N"))


def read_quality(qual: Column, newline: bool = False) -> Column:
    """-10 log10 of the mean error probability of a quality string (codes from 33);
    ``newline`` counts a line end as one more base, of code 10. Whole batches are
    added up at once."""
    errors = 10.0 ** -((np.arange(256) - 33) / 10.0)

    @F.arrow_udf("double")
    def of(quals: pa.Array) -> pa.Array:
        texts = [q.encode("latin-1", "replace") for q in pc.fill_null(quals, "").to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        own = np.fromiter((errors[np.frombuffer(t, np.uint8)].sum() for t in texts), float, len(texts))
        sizes, own = sizes + int(newline), own + newline * errors[10]
        return pa.array(-10 * np.log10(np.where(sizes > 0, own, 1) / np.maximum(sizes, 1)), mask=(sizes == 0) | quals.is_null().to_numpy(zero_copy_only=False))

    return of(qual)


def keeps_read(seq: Column, qual: Column, min_quality: float = 9, min_length: int = 2000, newline: bool = False) -> Column:
    """Longer than min_length and of min_quality at least."""
    return (F.char_length(seq) + int(newline) > min_length) & (read_quality(qual, newline) >= min_quality)


def fraction(hits: Column, total: Column) -> Column:
    """Single-precision hits / total to 6 digits, 0 for an empty total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round((hits.cast("float") / total.cast("float")).cast("double"), 6))


def false_positive_rate(num_bits: Column, items: Column, hashes: int = 1) -> Column:
    if hashes < 1:
        return F.lit(1.0)
    rate = 1 - F.exp(-hashes * items.cast("double") / num_bits)
    return rate if hashes == 1 else F.pow(rate, F.lit(float(hashes)))


def adjusted_hits(hits: Column, total: Column, fp: Column) -> Column:
    """Hits less what false positives account for, rounded half away from zero."""
    share = F.greatest(F.lit(0.0), (hits / total - fp) / (1 - fp))
    return F.round(share * total).cast("long")


def percent(value: Column) -> Column:
    """A fraction as a percentage of two significant digits (half-even), cut to a whole number."""
    exact = value.cast("decimal(20,6)") * 100
    return F.when(exact >= 10, F.bround(exact, 0)).when(exact >= 1, F.bround(exact, 1)).otherwise(F.bround(exact, 2)).cast("int")


def parse_units(text: str) -> int:
    """4K, 0.25G, ...: decimal units; fractions only with a unit."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([KMGTP]?)", text.strip(), re.I)
    if not m or ("." in m[1] and not m[2]):
        raise ValueError(f"not a number of bits: {text!r}")
    return round(float(m[1]) * 1000 ** " KMGTP".index(m[2].upper() or " "))


def parse_probability(text: str) -> float:
    """0.5, 50% or 1/2, within 0 and 1."""
    text = text.strip()
    if text.endswith("%"):
        p = float(text[:-1]) / 100
    elif "/" in text:
        over, under = text.split("/")
        p = float(over) / float(under)
    else:
        p = float(text)
    if not 0 <= p <= 1:
        raise ValueError(f"not a probability: {text!r}")
    return p


def optimal_bits(max_length: Column, fpr: float = 0.01) -> Column:
    return F.bround(-max_length / math.log(1 - fpr)).cast("long")


def parse_query_file(text: str, default: float = 0.7) -> tuple[str, float]:
    """File name and threshold of ``file``, ``file=F`` or ``file:F``."""
    m = re.fullmatch(r"(.+)[=:]([0-9./%]+)", text)
    return (m[1], parse_probability(m[2])) if m else (text, default)


def read_seeds(text: str) -> list[str]:
    """The seeds of a seed file: one per line."""
    return [check_seed(line.strip()) for line in text.splitlines() if line.strip()]
