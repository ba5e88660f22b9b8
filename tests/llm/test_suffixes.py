import hashlib
import random

import pytest

from sievelake.llm import suffixes


def brute(rows):
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                covered[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1]))
        out.append((doc_id, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [2, 256])
def test_against_every_window(make, real, group):
    rng = random.Random(group)
    line = "".join(rng.choice("abcdef ") for _ in range(140))
    texts = [t for _, t, _ in real[:120]]
    texts += [f"{rng.random()}{line}{rng.random()}" * rng.choice([1, 2]) for _ in range(40)]  # a common passage
    texts += ["a" * n for n in (99, 100, 101, 400)] + ["ab" * 200, None, "", "é" * 120, real[3][1], real[3][1][:500] + "!" + real[3][1][501:]]
    texts += [line[:101], line[:99], line + line]
    got = sorted(tuple(r) for r in suffixes.dedup(make(texts, extra=True), group=group).collect())
    assert got == brute(list(enumerate(texts)))


@pytest.mark.parametrize("group", [256, suffixes.GROUP])
def test_many_surroundings_of_one_line(make, group):
    rng = random.Random(11)
    line = "".join(rng.choice("abcdefghij ") for _ in range(97))
    around = [rng.choice("uvwxyz") + rng.choice("uvwxyz") for _ in range(40)]
    texts = [f"{rng.random()}{rng.choice(around)}{line}{rng.choice(around)}{rng.random()}" for _ in range(10_000)]
    assert sorted(tuple(r) for r in suffixes.dedup(make(texts), group=group).collect()) == brute(list(enumerate(texts)))


def test_classes_give_what_pairs_give(monkeypatch):
    rng = random.Random(3)
    for n in (3, 20, 90):
        entries = sorted(
            (b"x" * 32 + bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 3]))) + b"c" * rng.choice([5, 40, 65]),
             (b"d" * rng.choice([0, 10, 50]) + bytes(rng.choice(b"ab") for _ in range(18)))[: suffixes.BEFORE], rng.randrange(9), 0, i, 100)
            for i in range(n)
        )
        common = [0] + [suffixes.shared(a[0], b[0]) for a, b in zip(entries, entries[1:])]
        got = {}
        for pairwise in (0, 1000):
            monkeypatch.setattr(suffixes, "PAIRWISE", pairwise)
            got[pairwise] = sorted(suffixes.repeats(entries, common))
        assert got[0] == got[1000] and (n < 90 or got[0])


def test_long_document_in_pieces(make):
    rng = random.Random(5)
    once = "".join(rng.choice("abcdefgh") for _ in range(1_300_000))
    texts = [once + once[1000:1_200_000], "short " + once[500_000:500_300]]
    assert sorted(tuple(r) for r in suffixes.dedup(make(texts)).collect()) == brute(list(enumerate(texts)))


def test_repeated_rows_and_empty(make):
    text = "".join(chr(97 + i % 23) + str(i) for i in range(80))
    rows = suffixes.dedup(make([text, text, text], ids=[1, 1, None])).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, len(text), len(text)]
    assert [r["doc_id"] for r in rows if r["n_removed"] == 0] == [None]
    assert suffixes.dedup(make([])).count() == 0


def test_merge_sorts_and_knows_prefixes():
    rng = random.Random(7)
    entries = [(bytes(rng.choice(b"ab") for _ in range(rng.choice([40, 60, 100]))), b"x", i, 0, i, 0) for i in range(500)]
    runs = [suffixes.pack(sorted(entries[i::7])) for i in range(7)]
    merged, last = [], b""
    for n, e in suffixes.merge(runs):
        assert n == suffixes.shared(last, e[0]) or not merged
        last = e[0]
        merged.append(e)
    assert [m[0] for m in merged] == sorted(e[0] for e in entries) and sorted(merged) == sorted(entries)
