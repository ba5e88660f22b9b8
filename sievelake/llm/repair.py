"""Structure repair of conversations: the cheapest edits that make roles alternate.

A repaired conversation is empty, or an optional system turn and then pairs of user
and assistant: ``(s?(ua)+)?`` in initials. Each row is kept (0), gets the role that is
due (Rerole, 2) or goes (Delete, 3); the role that is due may be put in with an empty
text anywhere (Insert, 2). Blank rows, and rows whose role and text were there before,
must go; a truncated one that stays costs 1. Of the cheapest edits those whose initials
come first in ASCII order are taken: from left to right, the least of D, I, K, R that is
tight, that is, still leads to the lowest cost.

The costs come from a backward dynamic programme over the state that the roles so far
have led to (0 nothing, 1 system, 2 user, 3 assistant). It is square-root checkpointed:

1. Rows are sorted and written (``turns.in_order``), and cut into blocks of at most the
   square root of all rows, a block being rows of one conversation in one part.
2. What a block does to any vector of costs behind it is four columns, a min-plus map.
   Only blocks that aren't a whole conversation need it.
3. Along each conversation, from its end, the maps give the costs at the end of each
   block: the checkpoints, the only vectors that are stored.
4. Each block recomputes its own vectors from its checkpoint, and walks forward. Where
   it begins in the middle of a conversation it does so from all four states.
5. The rows pass by in order, with their blocks' edits: the state at the end of one block
   says which of the walks of the next one holds.

So the programme of a conversation with a third of all rows is spread over many tasks,
and none holds more than a block of it, or a row per block. Step 5 streams a conversation
through one task, a batch of rows at a time, as a digest of a whole text is a chain.

Defined results: null roles and texts are one space (so such a text is blank, and such a
role is none of the three); a role counts by its first character; null turns come first;
rows of one turn are ordered by role and text; repeated rows are duplicates; a null
conv_id is a conversation of its own; texts may be of any length; an empty table gives
no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm import turns
from sievelake.workspace import written

INF = 1 << 60
DUE = (2, 2, 3, 2)  # the state after the role that is due
NAMES = {2: "user", 3: "assistant"}
END = (0, 4, 2, 0)  # costs where no row is left: what is begun is completed
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}  # by initial: the state that keeping leads to
BLANK, DUPLICATE, TRUNCATED, FINE = "bdt-"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, role string, text string"


# ---- the programme -------------------------------------------------------


def back(initial: str, fault: str, after) -> list[int]:
    """Costs before a row, by state, from those behind it."""
    out = [3 + c for c in after]
    if fault not in (BLANK, DUPLICATE):
        extra, keeps = int(fault == TRUNCATED), KEEPS.get(initial, {})
        for s in range(4):
            out[s] = min(out[s], 2 + extra + after[DUE[s]])
            if s in keeps:
                out[s] = min(out[s], extra + after[keeps[s]])
    two, three = min(out[2], 2 + out[3]), min(out[3], 2 + out[2])
    return [min(out[0], 2 + two), min(out[1], 2 + two), two, three]


def transfer(initials: str, faults: str) -> list[list[int]]:
    """For each state behind a block the costs before it of ending there."""
    columns = [[0 if s == t else INF for s in range(4)] for t in range(4)]
    for i in range(len(initials) - 1, -1, -1):
        columns = [back(initials[i], faults[i], c) for c in columns]
    return columns


def through(columns, after) -> list[int]:
    """Costs before a block from those behind it."""
    return [min(columns[t][s] + after[t] for t in range(4)) for s in range(4)]


def walk(initials: str, faults: str, costs: list[list[int]], state: int) -> tuple[str, int]:
    """The least tight edits of a block from a state, and the state that they lead to;
    costs: before each row, and behind the last."""
    edits = []
    for i, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
        here, after, extra = costs[i], costs[i + 1], int(fault == TRUNCATED)
        while True:
            if here[state] == 3 + after[state]:
                edits.append("D")
                break
            if here[state] == 2 + here[DUE[state]]:
                edits.append("I")
                state = DUE[state]
                continue
            to = KEEPS.get(initial, {}).get(state)
            if to is not None and here[state] == extra + after[to]:
                edits.append("K")
                state = to
            else:
                edits.append("R")
                state = DUE[state]
            break
    return "".join(edits), state


def vectors(initials: str, faults: str, after) -> list[list[int]]:
    costs = [list(after)]
    for i in range(len(initials) - 1, -1, -1):
        costs.append(back(initials[i], faults[i], costs[-1]))
    return costs[::-1]


# ---- rows and blocks -----------------------------------------------------


def sound(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the latter two."""
    space = F.lit(" ")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as the checks of this operator damage them, by a checksum of conversation and turn."""
    rows = sound(rows)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = turns.checksum(F.concat(number("conv_id"), F.lit(":"), number("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    hit = rows.withColumn("kind", kind).where("kind <> 0")
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _classified(placed: DataFrame) -> DataFrame:
    """conv_id, pos, initial, fault of each row of ``placed``."""
    first = placed.groupBy("conv_id", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    joined = placed.select("conv_id", "pos", "initial", "blank", "truncated").join(first, "pos", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(FINE)
    return joined.select("conv_id", "pos", "initial", fault.alias("fault"))


def _placed(rows: DataFrame) -> DataFrame:
    solid = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    keep = {
        "turn": F.col("turn"),
        "role": F.col("role"),
        "text": F.col("text"),
        "initial": F.substring("role", 1, 1),
        "blank": F.length(solid) == 0,
        "truncated": ~F.substring(solid, -1, 1).isin(".", "!", "?"),
        "same": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)),
    }
    return turns.in_order(rows, keep, "repair-rows")


class Block:
    """Rows of a conversation that follow one another; ``whole`` if they are all of it."""

    def __init__(self, conv_id, start: int, alone: bool):
        self.conv_id, self.start, self.whole = conv_id, start, alone
        self.initials: list[str] = []
        self.faults: list[str] = []
        self.after = None


def blocks(batches, limit: int) -> Iterator[Block]:
    """The blocks of rows (conv_id, pos, initial, fault, after) in the order of pos; a row
    with ``after`` is a checkpoint, for the block that begins at its pos."""
    now, last, after = None, None, None
    for batch in batches:
        for conv_id, pos, initial, fault, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if vector is not None:
                after = vector
                continue
            same_part = last is not None and pos >> turns.ROW_BITS == last >> turns.ROW_BITS
            goes_on = same_part and conv_id == now.conv_id
            if not goes_on or len(now.faults) >= limit:
                if now is not None:
                    now.whole = now.whole and same_part and not goes_on
                    yield now
                now = Block(conv_id, pos, same_part and not goes_on)
                now.after, after = after, None
            now.initials.append(initial)
            now.faults.append(fault)
            last = pos
    if now is not None:
        now.whole = False  # it may go on in the next part
        yield now


def _in_parts(rows: DataFrame) -> DataFrame:
    """Rows of a part in one task, in order, checkpoints first."""
    return rows.repartition(turns.part(F.col("pos"))).sortWithinPartitions(F.col("pos"), F.col("after").isNull())


def _record(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _collected(rows: Iterator[tuple], fields: str, step: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= step:
            yield _record(held, fields)
            held = []
    if held:
        yield _record(held, fields)


def _checkpoints(classified: DataFrame, limit: int) -> DataFrame:
    """pos, after: the costs at the end of each block that isn't a whole conversation, by its start."""
    maps = "conv_id long, pos long, costs array<long>"

    def read(batches):
        yield from _collected(((b.conv_id, b.start, sum(transfer(b.initials, b.faults), [])) for b in blocks(batches, limit) if not b.whole), maps)

    def chain(batches):
        def rows():
            conv, known = None, None
            for batch in batches:
                for conv_id, pos, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if known is None or conv_id != conv:
                        conv, known = conv_id, END
                    yield pos, list(known)
                    known = through([costs[4 * t : 4 * t + 4] for t in range(4)], known)

        yield from _collected(rows(), "pos long, after array<long>")

    found = _in_parts(classified.withColumn("after", F.lit(None).cast("array<long>"))).mapInArrow(read, maps)
    back_to_front = found.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("pos"))
    return back_to_front.mapInArrow(chain, "pos long, after array<long>")


def _walked(classified: DataFrame, checkpoints: DataFrame, limit: int) -> DataFrame:
    """conv_id, pos (a block's first row), faults, and by state before it the edits and the state behind it."""
    fields = "conv_id long, pos long, faults string, edits array<string>, ends array<long>"

    def run(batches):
        def rows():
            for b in blocks(batches, limit):
                costs = vectors(b.initials, b.faults, END if b.whole else b.after)
                found = [walk(b.initials, b.faults, costs, s) for s in range(1 if b.whole else 4)]
                yield b.conv_id, b.start, "".join(b.faults), [f[0] for f in found], [f[1] for f in found]

        yield from _collected(rows(), fields, 500)

    marks = checkpoints.select(F.lit(None).cast("long").alias("conv_id"), "pos", F.lit(None).cast("string").alias("initial"), F.lit(None).cast("string").alias("fault"), "after")
    return _in_parts(classified.withColumn("after", F.lit(None).cast("array<long>")).union(marks)).mapInArrow(run, fields)


class _Conversation:
    """What is told of a conversation while its rows pass by."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.cost = conv_id, 0, 0
        self.counts = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED, FINE), 0)
        self.illegal, self.initial = 0, None
        self.low = self.high = None
        self.distinct = self.lines = 0
        self.audit, self.hash = [], hashlib.sha256()
        self.edits, self.faults, self.at, self.row = "", "", 0, 0

    def put(self, role: str, text: str) -> tuple:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        return self.conv_id, self.lines - 1, role, text

    def insert(self) -> tuple:
        self.state = DUE[self.state]
        self.cost += 2
        return self.put(NAMES[self.state], "")

    def block(self, faults: str, edits: list[str]) -> None:
        self.faults, self.edits, self.at, self.row = faults, edits[self.state if len(edits) > 1 else 0], 0, 0
        self.audit.append(self.edits)

    def take(self, turn, role: str, text: str) -> Iterator[tuple]:
        """The turns that come of a row, and of what is put in before it."""
        fault, initial = self.faults[self.row], role[:1]
        self.row += 1
        self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        while self.edits[self.at] == "I":
            self.at += 1
            yield self.insert()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "D":
            self.cost += 3
            return
        self.cost += fault == TRUNCATED
        if edit == "K":
            self.state = KEEPS[initial][self.state]
        else:
            self.state, self.cost = DUE[self.state], self.cost + 2
            role = NAMES[self.state]
        yield self.put(role, text)

    def end(self) -> Iterator[tuple]:
        while self.state in (1, 2):
            self.audit.append("I")
            yield self.insert()

    def row_of_report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        counts = [self.counts[f] for f in (BLANK, DUPLICATE, TRUNCATED)]
        return self.conv_id, gaps, *counts, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _streamed(rows: DataFrame, originals: DataFrame, with_turns: bool) -> DataFrame:
    """Steps 1 to 5: a row per conversation, or per repaired turn."""
    placed = _placed(rows)
    classified = written(_classified(placed), "repair-classes")
    limit = math.isqrt(placed.count()) + 1
    checkpoints = written(_checkpoints(classified, limit), "repair-checkpoints")
    walked = written(_walked(classified, checkpoints, limit), "repair-edits")
    fields = TURNS if with_turns else REPORT

    def run(batches):
        def out():
            now = None
            for batch in batches:
                for conv_id, pos, turn, role, text, faults, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if pos < 0:
                        if now is not None:
                            yield from finished(now)
                        now = _Conversation(conv_id)
                    elif edits is not None:
                        now.block(faults, edits)
                    else:
                        for made in now.take(turn, role, text):
                            if with_turns:
                                yield made
            if now is not None:
                yield from finished(now)

        def finished(conversation):
            for made in conversation.end():
                if with_turns:
                    yield made
            if not with_turns:
                yield conversation.row_of_report()

        yield from _collected(out(), fields, 500)

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    texts = placed.select("conv_id", "pos", "turn", "role", "text", none("string", "faults"), none("array<string>", "edits"))
    edits = walked.select("conv_id", "pos", none("long", "turn"), none("string", "role"), none("string", "text"), "faults", "edits")
    marks = originals.distinct().select("conv_id", F.lit(-1).cast("long").alias("pos"), none("long", "turn"), none("string", "role"), none("string", "text"), none("string", "faults"), none("array<string>", "edits"))
    stream = texts.union(edits).union(marks).repartition("conv_id").sortWithinPartitions("conv_id", "pos", F.col("edits").isNull())
    return stream.mapInArrow(run, fields)


def report(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """A row per conversation: gaps, faults, cost, the edits and the digest of the repaired
    turns. ``originals``: conv_ids to be told of though no row of theirs is left."""
    rows = sound(rows)
    ids = rows.select("conv_id")
    return _streamed(rows, ids if originals is None else ids.union(originals.select(F.col("conv_id").cast("long"))), False)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text of the repaired turns."""
    rows = sound(rows)
    return _streamed(rows, rows.select("conv_id"), True)


def sql() -> str:
    """The same by recursion over rows, for tables whose conversations are short."""
    from sievelake.llm.turns import CRC_SQL

    key = "(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))"
    go = lambda s: {0: 2, 1: 2, 2: 3, 3: 2}[s]
    keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def base(s: int) -> str:
        kept = " ".join(f"WHEN ini = '{i}' THEN b.c{t} + x" for i, t in keep[s].items())
        return f"least(b.c{s} + 3, CASE WHEN gone THEN 1000000 ELSE least(b.c{go(s)} + 2 + x, CASE {kept} ELSE 1000000 END) END) AS d{s}"

    state = lambda column: f"CASE w.s WHEN 0 THEN {column.format(0)} WHEN 1 THEN {column.format(1)} WHEN 2 THEN {column.format(2)} ELSE {column.format(3)} END"
    due = "CASE w.s WHEN 2 THEN 3 ELSE 2 END"
    to_keep = "CASE WHEN ini = 's' AND w.s = 0 THEN 1 WHEN ini = 'u' AND w.s <> 2 THEN 2 WHEN ini = 'a' AND w.s = 2 THEN 3 END"
    of = lambda alias, s: f"CASE {s} WHEN 0 THEN {alias}.c0 WHEN 1 THEN {alias}.c1 WHEN 2 THEN {alias}.c2 WHEN 3 THEN {alias}.c3 END"
    return f"""
        WITH RECURSIVE t AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC_SQL.format(key)} % 20 AS kind FROM conversations),
        hit AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                       CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                       unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
                FROM t WHERE kind <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM hit),
        faults AS (SELECT conv_id, turn, role, text, i, n, role[1:1] AS ini, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS solid,
                          row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
        r AS (SELECT *, CASE WHEN solid = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN solid[-1:] NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM faults),
        rows_ AS (SELECT *, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS x, ini || lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM r),
        back AS (
            SELECT DISTINCT conv_id, n + 1 AS i, 0 AS c0, 4 AS c1, 2 AS c2, 0 AS c3 FROM rows_
            UNION ALL
            SELECT conv_id, i, least(d0, 2 + least(d2, 2 + d3)), least(d1, 2 + least(d2, 2 + d3)), least(d2, 2 + d3), least(d3, 2 + d2)
            FROM (SELECT b.conv_id, b.i - 1 AS i, {base(0)}, {base(1)}, {base(2)}, {base(3)} FROM back b JOIN rows_ q ON q.conv_id = b.conv_id AND q.i = b.i - 1)),
        walk AS (
            SELECT conv_id, 1 AS i, 0 AS s, '' AS audit, '' AS made, 0 AS k FROM back WHERE i = 1
            UNION ALL
            SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END,
                   CASE edit WHEN 'D' THEN s WHEN 'K' THEN kept ELSE due END,
                   audit || edit,
                   CASE edit WHEN 'D' THEN made ELSE made || CASE WHEN k > 0 THEN chr(10) ELSE '' END
                        || CASE edit WHEN 'K' THEN role WHEN 'I' THEN CASE due WHEN 2 THEN 'user' ELSE 'assistant' END ELSE CASE due WHEN 2 THEN 'user' ELSE 'assistant' END END
                        || ':' || CASE edit WHEN 'I' THEN '' ELSE text END END,
                   CASE edit WHEN 'D' THEN k ELSE k + 1 END
            FROM (SELECT w.*, q.role, q.text, {due} AS due, {to_keep} AS kept,
                         CASE WHEN q.i IS NULL THEN 'I'
                              WHEN {of("h", "w.s")} = 3 + {of("a", "w.s")} THEN 'D'
                              WHEN {of("h", "w.s")} = 2 + {of("h", f"({due})")} THEN 'I'
                              WHEN {of("h", "w.s")} = q.x + {of("a", f"({to_keep})")} THEN 'K' ELSE 'R' END AS edit
                  FROM walk w JOIN back h ON h.conv_id = w.conv_id AND h.i = w.i
                  LEFT JOIN back a ON a.conv_id = w.conv_id AND a.i = w.i + 1
                  LEFT JOIN rows_ q ON q.conv_id = w.conv_id AND q.i = w.i
                  WHERE q.i IS NOT NULL OR w.s IN (1, 2))),
        done AS (SELECT w.conv_id, w.audit, w.made FROM walk w JOIN back e ON e.conv_id = w.conv_id AND e.i = w.i
                 WHERE w.s IN (0, 3) AND NOT EXISTS (SELECT 1 FROM rows_ q WHERE q.conv_id = w.conv_id AND q.i = w.i)),
        stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
        cost AS (SELECT conv_id, c0 AS cost FROM back WHERE i = 1)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats USING (conv_id) LEFT JOIN cost USING (conv_id) LEFT JOIN done USING (conv_id)"""
