"""The 64-bit nucleotide hash, as Arrow functions over whole batches.

Steps of shift and xor over a word's characters, then murmur3's finaliser; words
with other characters hash to 0, and no valid word does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
LEFT, RIGHT = np.uint64(17), np.uint64(47)
KERNELS = {"A": 0xC02069C411718AC9, "C": 0x29A37009B8869707, "G": 0x1A14AE384351C3F6, "T": 0x900E988F0E40231E}
FINISH = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def kernels(seed: int, complement: bool = False) -> np.ndarray:
    out = np.zeros(256, np.uint64)
    for base, other in zip("ACGT", "TGCA", strict=True):
        value = KERNELS[other if complement else base] * (2 * seed + 1) % (1 << 64)
        out[ord(base)] = out[ord(base.lower())] = value
    return out


def forward(u: np.ndarray) -> np.ndarray:
    u = u ^ (u << LEFT)
    return u ^ (u >> RIGHT)


def finish(u: np.ndarray) -> np.ndarray:
    u = u ^ (u >> S33)
    for m in FINISH:
        u = u * np.uint64(m)
        u = u ^ (u >> S33)
    return u


def unfinish(u: np.ndarray) -> np.ndarray:
    """Inverse of ``finish``."""
    u = u ^ (u >> S33)
    for m in reversed(FINISH):
        u = u * np.uint64(pow(m, -1, 1 << 64))
        u = u ^ (u >> S33)
    return u


def hash_words(words: pa.Array, k: int, seed: int = 0, both_strands: bool = False) -> np.ndarray:
    """Hashes of the first k characters of each word; ``both_strands`` adds the
    reverse complement's state before the finish."""
    words = pc.fill_null(words, "").cast(pa.binary())
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    fits = lengths >= k
    starts = np.where(fits, offsets, 0)
    own, other = kernels(seed), kernels(seed, complement=True)
    h, r, valid = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64), fits.copy()
    if len(data) < k:
        return h
    starts = np.minimum(starts, len(data) - k)
    with np.errstate(over="ignore"):
        for i in range(k):
            value = own[data[starts + i]]
            valid &= value != 0
            h = forward(h) ^ value
            if both_strands:
                r = forward(r) ^ other[data[starts + k - 1 - i]]
        out = finish(h + r if both_strands else h)
    return np.where(valid, np.where(out == 0, np.uint64(1), out), np.uint64(0))


def more_hashes(h1: np.ndarray, h2: np.ndarray, n: int) -> list[np.ndarray]:
    """n hashes from two: a xorshift128+ chain."""
    out, s0, s1 = [h1, h2], h1, h2
    for _ in range(2, n):
        s1 = s1 ^ (s1 << np.uint64(23))
        s2 = s1 ^ s0 ^ (s1 >> np.uint64(17)) ^ (s0 >> np.uint64(26))
        out.append(s2)
        s0, s1 = s1, s2
    return out[:n]


def position(word: Column, k: int, modulus: int, seed: int = 0, both_strands: bool = False, num_bits: int | None = None) -> Column:
    """hash % modulus; null where that is not below num_bits, if given."""

    @F.arrow_udf("long")
    def of(words: pa.Array) -> pa.Array:
        pos = (hash_words(words, k, seed, both_strands) % np.uint64(modulus)).astype(np.int64)
        return pa.array(pos, mask=pos >= num_bits if num_bits is not None else None)

    return of(word)


def positions(word: Column, k: int, modulus: int, num_hashes: int, seeds: tuple[int, int] = (0, 1), both_strands: bool = True) -> Column:
    """Array of the positions under num_hashes hashes."""

    @F.arrow_udf("array<long>")
    def of(words: pa.Array) -> pa.Array:
        h1 = hash_words(words, k, seeds[0], both_strands)
        all_of = more_hashes(h1, hash_words(words, k, seeds[1], both_strands), num_hashes) if num_hashes > 1 else [h1]
        flat = np.stack([(h % np.uint64(modulus)).astype(np.int64) for h in all_of], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, num_hashes, dtype=np.int32)), pa.array(flat.ravel()))

    return of(word)
