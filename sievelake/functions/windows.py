"""Windows of whole sequences in numpy: packed words, both strands, canonical choice,
spaced seeds and the nucleotide hash, for Arrow functions over batches.

A word of A, C, G and T is a number of two bits a base, so that numbers order as the
words do. Windows with any other character are kept apart as characters, as they
are compared and hashed by their characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sievelake.functions import hashing

MAX_K = 31
PIECE = 1 << 18
#: Bases that a table of the hash has at once.
SIX = 6
CODES = np.full(1 << 8, 4, np.uint8)
CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
EITHER = CODES.copy()
EITHER[np.frombuffer(b"acgt", np.uint8)] = range(4)
EXCHANGED = np.arange(1 << 8, dtype=np.uint8)
EXCHANGED[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)


def pieces(batches, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers of the batch, characters, their ends) of (key, seq) batches, each with
    the batch, some PIECE characters at a time: rows laid end to end, long ones cut into
    parts that overlap by k - 1 characters."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "").to_pylist()
        rows, parts, size = [], [], 0
        for row, text in enumerate(texts):
            for at in range(0, max(1, len(text) - k + 1), PIECE):
                part = text[at : at + PIECE + k - 1]
                if len(part) < k:
                    continue
                rows.append(row)
                parts.append(part)
                size += len(part)
                if size >= PIECE:
                    yield batch, np.array(rows), *_laid(parts)
                    rows, parts, size = [], [], 0
        if rows:
            yield batch, np.array(rows), *_laid(parts)


def _laid(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    text = "".join(parts)
    data = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return data, np.cumsum([len(p) for p in parts])


def places(ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of length k starts, and the number of its part."""
    sizes = np.diff(ends, prepend=0)
    n = np.maximum(sizes - k + 1, 0)
    part = np.repeat(np.arange(len(ends)), n)
    starts = ends - sizes
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + starts[part], part


def codes_of(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """0 to 3 for A, C, G, T (with ``lower``, a, c, g, t too), 4 for others."""
    small = np.where(data < 128, data, 0).astype(np.uint8) if data.dtype != np.uint8 else data
    if lower:
        small = np.where((small >= 97) & (small <= 122), small - 32, small)
    return CODES[small]


def plain(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Which windows have no other character."""
    bad = np.concatenate([[0], np.cumsum(codes == 4)])
    return bad[at + k] == bad[at]


def _rolled(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed window at each place and its reverse complement: words of 1, 2, 4, ... bases
    are made of two neighbours each, and those that k is the sum of put together."""
    kind, n = np.uint32 if k <= 16 else np.uint64, max(0, len(codes) - k + 1)
    own = (codes & 3).astype(kind)
    other, size = 3 - own, 1
    word, back, got = np.zeros(n, kind), np.zeros(n, kind), 0
    while True:
        if k & size:
            word = word << kind(2 * size) | own[got : got + n]
            back |= other[got : got + n] << kind(2 * got)
            got += size
        if got == k:
            return word, back
        own = own[:-size] << kind(2 * size) | own[size:]
        other = other[:-size] | other[size:] << kind(2 * size)
        size *= 2


def both_strands(codes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed windows and their reverse complements."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, other = _rolled(codes, k)
    return word[at].astype(np.int64), other[at].astype(np.int64)


def canonical(codes: np.ndarray, at: np.ndarray, seed: str) -> np.ndarray:
    """The packed characters at a seed's 1 positions of the smaller of each window and its
    reverse complement. Windows of any length, as numbers of MAX_K bases at most that are
    compared one after the other; the seed has MAX_K positions at most."""
    k = len(seed)
    if k <= MAX_K:
        return seeded(np.minimum(*both_strands(codes, at, k)), seed)
    out, other = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    smaller, decided = np.zeros(len(at), bool), np.zeros(len(at), bool)
    for start in range(0, k, MAX_K):
        size = min(MAX_K, k - start)
        own, back = both_strands(codes, at + start, size)[0], both_strands(codes, at + k - start - size, size)[1]
        smaller |= ~decided & (back < own)
        decided |= back != own
        part = seed[start : start + size]
        out, other = (x << 2 * part.count("1") | seeded(w, part) for x, w in ((out, own), (other, back)))
    return np.where(smaller, other, out)


def seeded(words: np.ndarray, seed: str) -> np.ndarray:
    """The packed characters at a seed's 1 positions."""
    out = np.zeros(len(words), np.int64)
    for run in re.finditer("1+", seed):
        size = len(run[0])
        out = out << (2 * size) | (words >> 2 * (len(seed) - run.end())) & ((1 << 2 * size) - 1)
    return out


@lru_cache(32)
def _tables(k: int, seed: int) -> list[np.ndarray]:
    """What each SIX bases of a word, from its end, add to its hash before the finish: a
    step of the hash takes the exclusive or of two states to that of their successors."""
    steps = hashing.kernels(seed)[np.frombuffer(b"ACGT", np.uint8)]
    tables = []
    for first in range(0, k, SIX):
        table = np.zeros(1, np.uint64)
        for _ in range(first, min(k, first + SIX)):
            table = (table[None, :] ^ steps[:, None]).ravel()
            steps = hashing.forward(steps)
        tables.append(table)
    return tables


def hashes(words: np.ndarray, k: int, seed: int = 0, other: np.ndarray | None = None) -> np.ndarray:
    """The nucleotide hash of packed words of k bases; ``other`` (the reverse
    complements) adds the other strand's state before the finish."""
    out = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for strand in (words, other) if other is not None else (words,):
            h = np.zeros(len(words), np.uint64)
            for i, table in enumerate(_tables(k, seed)):
                h ^= table[(strand >> 2 * SIX * i) & (len(table) - 1)]
            out = out + h
        out = hashing.finish(out)
    return np.where(out == 0, np.uint64(1), out)


def odd_words(data: np.ndarray, at: np.ndarray, k: int) -> list[str]:
    """The canonical words of windows with other characters: the smaller, by characters,
    of the window and its reverse, in which A, C, G and T alone are exchanged."""
    own = data[at[:, None] + np.arange(k)].astype(np.uint32)
    other = own[:, ::-1].copy()
    for a, b in zip(b"ACGT", b"TGCA", strict=True):
        other[own[:, ::-1] == a] = b
    unlike = own != other
    first = np.argmax(unlike, axis=1)
    row = np.arange(len(at))
    smaller = own[row, first] <= other[row, first]
    words = np.where(smaller[:, None], own, other)
    return [w.tobytes().decode("utf-32-le") for w in np.ascontiguousarray(words)]


def odd_codes(data: np.ndarray, at: np.ndarray, seed: str) -> np.ndarray:
    """For windows with other characters, the packed characters of ``odd_words`` at a
    seed's 1 positions, of either case; -1 where one of these is none of A, C, G and T."""
    k, cols = len(seed), np.flatnonzero(np.frombuffer(seed.encode(), np.uint8) == ord("1"))
    out = np.empty(len(at), np.int64)
    if data.dtype != np.uint8:  # all characters beyond a byte are alike here but for their order
        for i, w in enumerate(odd_words(data, at, k)):
            codes = EITHER[[min(ord(w[c]), 255) for c in cols]]
            out[i] = -1 if (codes == 4).any() else int("".join(map(str, codes)), 4)
        return out
    for a in range(0, len(at), PIECE // 8):
        part = at[a : a + PIECE // 8]
        wide = np.zeros((2, len(part), -(-k // 8) * 8), np.uint8)
        wide[0, :, :k] = data[part[:, None] + np.arange(k)]
        wide[1, :, :k] = EXCHANGED[wide[0, :, :k][:, ::-1]]
        own, other = wide.view(">u8")
        smaller, decided = np.zeros(len(part), bool), np.zeros(len(part), bool)
        for i in range(own.shape[1]):
            smaller |= ~decided & (other[:, i] < own[:, i])
            decided |= other[:, i] != own[:, i]
        word, bad = np.zeros(len(part), np.int64), np.zeros(len(part), bool)
        for c in cols:
            code = EITHER[np.where(smaller, wide[1, :, c], wide[0, :, c])]
            bad |= code == 4
            word = word << 2 | code
        out[a : a + PIECE // 8] = np.where(bad, -1, word)
    return out


def at_seed(word: str, seed: str) -> str:
    return "".join(c for c, s in zip(word, seed, strict=True) if s == "1")


def counted(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, value) with their numbers."""
    width = int(values.max()).bit_length() if len(values) and values.min() >= 0 else 64
    if len(values) and width + int(groups.max()).bit_length() <= 63:  # one number for both
        key = np.sort(groups.astype(np.int64) << width | values)
        change = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[change] >> width, key[change] & ((1 << width) - 1), np.diff(np.append(change, len(key)))
    by = np.lexsort((values, groups))
    groups, values = groups[by], values[by]
    change = np.flatnonzero(np.append(True, (groups[1:] != groups[:-1]) | (values[1:] != values[:-1]))) if len(by) else by
    return groups[change], values[change], np.diff(np.append(change, len(by)))


def keys_of(batch: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each row's key, and the keys."""
    coded = pc.dictionary_encode(batch.column(0), null_encoding="encode")
    return np.asarray(coded.indices)[rows], coded.dictionary
