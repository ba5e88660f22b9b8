import hashlib
import itertools
import random
import zlib

import pytest

from sievelake.llm import repair
from sievelake.workspace import written

TURNS = "conv_id long, turn long, role string, text string"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 0:
            continue
        x = "" if kind == 1 else "".join(ch for ch in x if ch not in ".!?") if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        solid = x.strip(WHITE)
        out.append("b" if not solid else "d" if (r, x) in seen else "t" if solid[-1] not in ".!?" else "-")
        seen.add((r, x))
    return out


def cheapest(rows, faults):
    """The least of all cheapest edit strings, by a shortest path over (row, state) that keeps whole strings."""
    best = {(0, 0): (0, "", ())}
    n = len(rows)
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    for _ in range(3 * n + 4):
        new = dict(best)
        for (i, s), (cost, audit, made) in best.items():
            moves = [((i, step[s]), 2, "I", ("user" if step[s] == 2 else "assistant", ""))]
            if i < n:
                r, x, extra = rows[i][2], rows[i][3], int(faults[i] == "t")
                moves.append(((i + 1, s), 3, "D", None))
                if faults[i] not in "bd":
                    moves.append(((i + 1, step[s]), 2 + extra, "R", ("user" if step[s] == 2 else "assistant", x)))
                    to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((r[:1], s))
                    if to:
                        moves.append(((i + 1, to), extra, "K", (r, x)))
            for at, price, edit, turn in moves:
                found = (cost + price, audit + edit, (*made, turn) if turn else made)
                if at not in new or found[:2] < new[at][:2]:
                    new[at] = found
        if new == best:
            break
        best = new
    return min((best[n, s] for s in (0, 3) if (n, s) in best), key=lambda f: f[:2])


def brute(original, rows):
    out = set()
    for c in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        if not own:
            out.add((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
            continue
        faults = faults_of(own)
        cost, audit, made = cheapest(own, faults)
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        text = "\n".join(f"{r}:{x}" for r, x in made)
        out.add((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def noise(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"])
            text = rng.choice([None, "", " \t", "Yes.", "No", "a. b", "Go!", f"t{rng.random()}."])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows


def frame(spark, rows):
    return written(spark.createDataFrame(rows, TURNS).repartition(5), "test-turns")


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = noise(seed, 120, 9)
    table = frame(spark, rows)
    got = {tuple(r) for r in repair.report(repair.damaged(table), table).collect()}
    assert got == brute(rows, damage(rows))


def test_long_conversations_go_over_blocks(spark):
    """Conversations of many blocks and parts equal the plain programme."""
    rows = [(7, t, random.Random(t).choice(["user", "assistant", "system"]), f"{t}" + random.Random(-t).choice([".", ""])) for t in range(400)]
    rows += [(8, None, "user", "again.")] * 150 + noise(3, 30, 5)
    got = {tuple(r) for r in repair.report(frame(spark, rows)).collect()}
    assert got == brute(rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Yes."), (None, 0, "system", "Be brief."), (2, 0, "user", "")]
    made = sorted(tuple(r) for r in repair.repaired(frame(spark, rows)).where("conv_id IS NOT NULL").collect())
    assert made == [(1, 0, "user", ""), (1, 1, "assistant", "Hello."), (1, 2, "user", "Yes."), (1, 3, "assistant", "")]
    lonely = [tuple(r)[1:] for r in repair.repaired(frame(spark, rows)).where("conv_id IS NULL").orderBy("place").collect()]
    assert lonely == [] or [r[1] for r in lonely][:1] == ["system"]


def test_edges(spark):
    rows = [(1, 0, "user", "x" * 300_000), (1, 1, "assistant", "é" * 100_000 + "."), (2, None, None, None), (None, 5, "user", "Hi."), (3, 1, "user", "a."), (3, 1, "user", "a."), (3, 9, "assistant", "b.")]
    table = frame(spark, rows)
    for name in ("pos", "after", "edits", "at", "initial"):
        from pyspark.sql import functions as F

        table = table.withColumn(name, F.lit("clash"))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert {tuple(r) for r in repair.report(table).collect()} == brute(rows, plain)
    empty = table.where("conv_id = 99")
    assert repair.report(empty).collect() == [] and repair.repaired(empty).collect() == []


def test_block_maps_chain():
    """Costs through the maps of blocks are those of the rows themselves."""
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randint(2, 40)
        initials, faults = rng.choices("suax", k=n), rng.choices("bdt--", k=n)
        cut = rng.randint(1, n - 1)
        behind = repair.through(repair.transfer(initials[cut:], faults[cut:]), repair.END)
        assert behind == repair.vectors(initials[cut:], faults[cut:], repair.END)[0]
        assert repair.through(repair.transfer(initials[:cut], faults[:cut]), behind) == repair.vectors(initials, faults, repair.END)[0]


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    got = repair.report(repair.damaged(table), table)
    want = con.sql(repair.sql())
    assert want.columns == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
