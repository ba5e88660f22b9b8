"""Benchmark decontamination: every passage of every document as a query against
a BM25 index of the test items.

An index holds the items of one shard (about 768, at most ``ITEMS``). It has, for
each word, the items with their BM25 weights, and the largest weight in each block
of ``BLOCK`` items. The indexes are built by tasks, as files in the shared folder; a task looks its
documents up in one after the other and holds at most ``HELD`` of them, so its
memory does not grow with the number of items. Weights are divided by what the
item must reach, so that every threshold is 1:

* an item counts as leaked if a passage holds at least ``OVERLAP`` = 0.8 of its
  distinct 5-word shingles, and of its question and of its answer at least
  ``PART`` = 0.5 of the distinct words each (both shares of shingles are reported);
* then at most the share of words that 0.2 of the shingles span is missing, so
  the passage's BM25 score is at least the item's own score less its largest
  weights of that number. That is the item's threshold: retrieval loses nothing.

Passages are the windows of two adjoining segments; a segment has half as many
words again as the longest item of the shard. The sum of the largest weights of a
passage's words bounds all its scores, and where that reaches 1, the sum of the block maxima of a
passage's words bounds the score of every item in a block (block-max WAND's
bound, for all passages of a batch at once): only (passage, block) pairs that
reach 1 are scored, and what reaches 1 is verified on shingles, question and answer.

Words are runs of letters and digits in lower case. An item's last sentence is its
answer; if that is all of it, the last third of its words is. Defined results: null
and empty texts and items without words match nothing; items of fewer than five
words are one shingle; repeated rows and repeated items each give their own hits;
very long texts are many passages; other columns are kept, but one named ``hits``.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.batches import slices
from sievelake.workspace import numbered, scratch

SHINGLE, OVERLAP, PART = 5, 0.8, 0.5
ITEMS, BLOCK, HELD = 1024, 16, 8
K1, B = 1.2, 0.75
HIT = "item_id long, score double, overlap double, question_overlap double, answer_overlap double, first_word long"
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_lists(texts: pa.Array) -> pa.Array:
    """The words of each text; a text without any has one empty word, which no index knows."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), r"[^\p{L}\p{N}]+", " ")
    return pc.ascii_split_whitespace(pc.ascii_trim(plain, " "))


def shingles(ids: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE words (of all words, if there are fewer)."""
    h = np.zeros(max(1, len(ids) - SHINGLE + 1) if len(ids) else 0, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(ids))):
            h = (h + ids[k : k + len(h)].astype(np.uint64) + np.uint64(1)) * MIX
            h ^= h >> np.uint64(29)
    return h


@dataclass
class Index:
    words: pa.Array
    item_ids: list
    question: list[np.ndarray]
    answer: list[np.ndarray]
    whole: list[np.ndarray]
    parts: list[tuple[np.ndarray, np.ndarray]]  # distinct words of question and answer
    own: np.ndarray
    need: np.ndarray
    first: np.ndarray  # postings of a word: first[w] to first[w + 1]
    items: np.ndarray
    weights: np.ndarray
    tops: np.ndarray  # largest weight of each word in each block
    top: np.ndarray  # and in all
    segment: int


def build(rows: list[tuple]) -> Index | None:
    """An index of (item_id, text) rows."""
    texts = pa.array([t for _, t in rows], pa.string())
    # the last sentence is the answer, what comes before it the question
    lists = [[w for w in words if w] for words in word_lists(texts).to_pylist()]
    tails = [len(word_lists(pa.array([re.split(r"(?<=[.!?])\s+", (t or "").strip())[-1]])).to_pylist()[0]) for _, t in rows]
    kept = sorted((i for i, w in enumerate(lists) if w), key=lambda i: lists[i])
    if not kept:
        return None
    vocabulary = {w: n for n, w in enumerate(sorted({w for i in kept for w in lists[i]}))}
    coded = [np.array([vocabulary[w] for w in lists[i]]) for i in kept]
    lengths = np.array([len(c) for c in coded])
    seen = np.bincount(np.concatenate([np.unique(c) for c in coded]), minlength=len(vocabulary))
    idf = np.log(1 + (len(kept) - seen + 0.5) / (seen + 0.5))
    posted, weights, own, need, parts = [], [], [], [], []
    for n, c in enumerate(coded):
        ids, tf = np.unique(c, return_counts=True)
        w = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[n] / lengths.mean()))
        whole = np.unique(shingles(c))
        lost = len(shingles(c)) - math.ceil(OVERLAP * len(whole) - 1e-9)
        threshold = w.sum() - np.sort(w)[::-1][:lost].sum() if lost else w.sum()
        threshold = max(threshold * (1 - 1e-6), 1e-9)
        posted.append(np.stack([ids, np.full(len(ids), n)]))
        weights.append(w / threshold)
        own.append(w.sum())
        need.append(threshold)
        tail = tails[kept[n]] if 0 < tails[kept[n]] < len(c) else max(1, len(c) // 3)
        question, answer = (c[: len(c) - tail], c[len(c) - tail :]) if len(c) > tail else (c, c)
        parts.append((np.unique(shingles(question)), np.unique(shingles(answer)), whole, (np.unique(question), np.unique(answer))))
    posted, weights = np.concatenate(posted, axis=1), np.concatenate(weights)
    by = np.argsort(posted[0], kind="stable")
    posted, weights = posted[:, by], weights[by]
    tops = np.zeros((len(vocabulary), -(-len(kept) // BLOCK)), np.float32)
    np.maximum.at(tops, (posted[0], posted[1] // BLOCK), weights.astype(np.float32))
    return Index(
        pa.array(list(vocabulary), pa.large_string()), [rows[i][0] for i in kept], *map(list, zip(*parts, strict=True)), np.array(own), np.array(need),
        np.searchsorted(posted[0], np.arange(len(vocabulary) + 1)), posted[1], weights, tops, tops.max(axis=1), int(lengths.max() * 3 // 2) + SHINGLE,
    )


@dataclass
class Words:
    """Texts as words: where each text's begin, their codes, and the distinct ones."""

    offsets: np.ndarray
    codes: np.ndarray
    dictionary: pa.Array


def words_of(texts: pa.Array) -> Words:
    lists = word_lists(texts)
    coded = pc.dictionary_encode(lists.values)
    return Words(np.asarray(lists.offsets).astype(np.int64), np.asarray(coded.indices), coded.dictionary)


def search(index: Index, texts: Words) -> dict[int, dict[int, tuple]]:
    """text number -> item number -> the hit in its best passage.

    Bounds go before sums: a passage whose words' largest weights don't reach the
    threshold is left at that; of others the blocks of items are summed up, and only items
    of the blocks that reach it are scored."""
    offsets = texts.offsets
    place = pc.fill_null(pc.index_in(texts.dictionary, value_set=index.words), -1).to_numpy().astype(np.int64)
    ids = place[texts.codes] if len(place) else np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    # segments of each text, one after the other
    per = np.maximum(1, -(-sizes // index.segment))
    starts = np.cumsum(per) - per
    text = np.repeat(np.arange(len(sizes)), sizes)
    known = np.flatnonzero(ids >= 0)
    segment = starts[text[known]] + (known - offsets[text[known]]) // index.segment
    # distinct words of each segment
    words = np.unique(segment * len(index.words) + ids[known])
    at, word = np.divmod(words, len(index.words))
    n_segments = int(per.sum())
    most = np.bincount(at, index.top[word], n_segments)
    follows = np.append(np.diff(np.repeat(np.arange(len(sizes)), per)) == 0, False)
    likely = most + np.where(follows, np.append(most[1:], 0), 0) >= 1 - 1e-3
    # block maxima for the segments of these passages alone
    likely = likely | np.append(False, (likely & follows)[:-1]) if n_segments else likely
    looked = likely[at] if len(at) else np.zeros(0, bool)
    at, word = at[looked], word[looked]
    bound = np.zeros((n_segments + 1, index.tops.shape[1]), np.float32)
    if len(at):
        change = np.flatnonzero(np.diff(at, prepend=-1))
        bound[at[change]] = np.add.reduceat(index.tops[word], change, axis=0)
    owner = np.repeat(np.arange(len(sizes)), per)
    pair = bound[:-1].copy()
    inner = np.flatnonzero(np.append(np.diff(owner) == 0, False))
    pair[inner] += bound[inner + 1]
    # a later segment alone is part of the passage that it ends
    passages = np.flatnonzero((pair >= 1 - 1e-3).any(axis=1))
    found: dict[int, dict[int, tuple]] = {}
    for p in passages.tolist():
        t = int(owner[p])
        low = int(offsets[t] + (p - starts[t]) * index.segment)
        high = int(min(low + 2 * index.segment, offsets[t + 1]))
        passage = ids[low:high]
        distinct = np.unique(passage)
        distinct = distinct[distinct >= 0]
        lists_of = [slice(index.first[w], index.first[w + 1]) for w in distinct.tolist()]
        if not lists_of:
            continue
        items = np.concatenate([index.items[s] for s in lists_of])
        weights = np.concatenate([index.weights[s] for s in lists_of])
        alive = (pair[p] >= 1 - 1e-3)[items // BLOCK]
        scores = np.bincount(items[alive], weights[alive], len(index.item_ids))
        retrieved = np.flatnonzero(scores >= 1)
        if not len(retrieved):
            continue
        here = _inside(passage)
        for i in retrieved.tolist():
            overlap = _share(index.whole[i], here, passage, low)
            if overlap[0] + 1e-9 < OVERLAP or any(np.isin(part, distinct).mean() < PART for part in index.parts[i]):
                continue
            score = float(scores[i] * index.need[i] / index.own[i])
            hit = (round(overlap[0], 6), round(score, 6), -(overlap[1] - int(offsets[t])), round(_share(index.question[i], here, passage, low)[0], 6), round(_share(index.answer[i], here, passage, low)[0], 6))
            best = found.setdefault(t, {})
            if i not in best or hit > best[i]:
                best[i] = hit
    return found


def _inside(passage: np.ndarray) -> np.ndarray:
    """Hashes of the passage's word runs of 1 to SHINGLE words, by length."""
    out = [shingles(passage)] if len(passage) >= SHINGLE else [np.zeros(0, np.uint64)]
    for k in range(1, SHINGLE):
        h = np.zeros(max(0, len(passage) - k + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = (h + passage[j : j + len(h)].astype(np.uint64) + np.uint64(1)) * MIX
                h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out)


def _share(wanted: np.ndarray, here: np.ndarray, passage: np.ndarray, low: int) -> tuple[float, int]:
    """Share of the wanted shingles in the passage, and the word at which the first of them starts."""
    hits = np.isin(here, wanted)
    first = np.flatnonzero(hits)
    start = int(first[0]) if len(first) and first[0] <= len(passage) else 0
    return len(np.unique(here[hits])) / len(wanted), low + start


def indexes(items: DataFrame) -> list[str]:
    """Writes indexes of at most ITEMS items each to the shared folder, in tasks; their places.
    Items of like length are together, as the longest one of an index sets its passages."""
    items = items.select(F.col("item_id").cast("long"), "text")
    n = items.count()
    if not n:
        return []
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    shard = (F.col("place") / (ITEMS * 3 // 4)).cast("long").alias("shard")
    placed = numbered(items.withColumn("size", size), "place", F.col("size"), F.col("item_id"), F.col("text")).select(shard, "item_id", "text")
    folder = scratch(items.sparkSession, "decontaminate")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        held: dict[int, list] = {}
        done = []

        def finish(number: int) -> None:
            rows = sorted(held.pop(number), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
            if (index := build(rows)) is not None:
                here, at = fs.FileSystem.from_uri(folder)
                name = f"{number}-{uuid.uuid4().hex}"  # a task that runs again writes a file of its own
                with here.open_output_stream(f"{at}/{name}") as out:
                    out.write(pickle.dumps(index))
                done.append((number, name))

        for batch in batches:
            for number, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for other in [x for x in held if x != number]:
                    finish(other)
                held.setdefault(number, []).append(row)
        for number in list(held):
            finish(number)
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["shard", "name"])

    tasks = -(-n // (ITEMS * 3 // 4))
    rows = placed.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, "shard long, name string")
    return [f"{folder}/{r['name']}" for r in sorted(rows.collect())]


def _index(place: str) -> Index:
    store, path = fs.FileSystem.from_uri(place)
    with store.open_input_stream(path) as source:
        return pickle.loads(source.read())


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with ``hits``: the items found in the text, with their scores."""
    columns = [c for c in docs.columns if c != "hits"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    kind = packed.schema["row"].dataType.simpleString()
    hit_type = pa.list_(pa.struct([(n, pa.int64() if k == "long" else pa.float64()) for n, k in (f.split() for f in HIT.split(", "))]))
    places = indexes(items)

    def run(batches):
        held: dict[str, Index] = {}
        # with more indexes than are held, more text is looked up in one before the next is read
        for batch in slices(batches, 1, 4 << 20 if len(places) <= HELD else 32 << 20):
            found = [[] for _ in range(batch.num_rows)]
            parts = [words_of(part.column(1)) for part in slices([batch], 1)]  # once for all indexes
            for place in places:
                index = held.get(place) or _index(place)
                if len(held) < HELD:
                    held[place] = index
                first = 0
                for part in parts:
                    for t, hits in search(index, part).items():
                        found[first + t] += [
                            {"item_id": index.item_ids[i], "score": h[1], "overlap": h[0], "question_overlap": h[3], "answer_overlap": h[4], "first_word": -h[2]}
                            for i, h in sorted(hits.items())
                        ]
                    first += len(part.offsets) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, hit_type)], ["row", "hits"])

    hits = f"array<struct<{HIT.replace(', ', ',').replace(' ', ':')}>>"
    return packed.mapInArrow(run, f"row {kind}, hits {hits}").select("row.*", "hits")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and one of the leaked items with its scores, for each leak."""
    found = leaks(docs.select("doc_id", "text"), items).where(F.size("hits") > 0)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
