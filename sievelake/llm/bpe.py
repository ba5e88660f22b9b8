"""BPE encoding and decoding with a tokenization automaton.

The merges of a public tokenizer file are compiled, one merge gadget after the
other, into an automaton whose states are tokens: an arc ``x -> y`` stays as
long as the two tokens may stand side by side in a correct tokenization. The
gadget of a merge ``(u, v) -> w``

* takes the arc ``u -> v`` away,
* gives ``w`` the arcs that lead into ``u``, and
* gives ``w`` the arcs that leave ``v``.

Spelled out, the arcs of a vocabulary of 49,408 tokens are some 2.4 thousand
million, so what is compiled is the gadgets themselves, as a table with default
transitions: for each token the merge that made it and the token whose arcs it
took over on either side (``born``, ``left``, ``right``), and the arcs that were
taken away (``pairs`` with ``ranks``). An arc is found by following the defaults
until an exception or two symbols are met. The symbols are read through a table
of the vocabulary's trie with failure links. All of this is compiled once, on the
driver, into arrays whose size the tokenizer file bounds, and broadcast; tasks
fill in the transitions they need, in tables of bounded size.

As every word has one correct tokenization, reading it symbol by symbol through
that automaton is deterministic: of the vocabulary entries that end at a symbol,
one alone can be reached by an arc from the token that ended before it.
Decoding emits the labels of the arcs taken.

The distinct words of a batch are read once, all of them together, symbol by
symbol; what makes up a text is gathered from their tokens by Arrow.
Character classes, composition and lower case are those of the tokenizers library,
as Unicode versions differ: classes and lower case are asked for once, on the
driver, and texts with combining marks are composed by it.

Null texts count as empty (no tokens, empty decoded text). Long words and long
texts cost time in proportion to their length. Repeated rows give repeated
results; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from sievelake.llm.batches import hand_back, slices

NO_MERGE, SPACE = 1 << 60, pa.scalar(" ", pa.large_string())
#: Unicode's white space beyond ASCII's six characters.
WIDE_SPACE = "\x85\xa0                　"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols, extra = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(extra)
            extra += 1
    return [symbols[b] for b in range(256)]


@functools.cache
def characters() -> tuple[dict[str, str], dict[int, str]]:
    """The library's letters and numbers, as the inside of a class of a pattern, and
    the characters whose lower case it sees otherwise than Python."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    classes = {}
    for kind in "LN":  # what one of the two takes for such a character, the other took or will take for one
        asked = "".join(regex.findall(rf"\p{{{kind}}}", every))
        runs = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str(asked)
        codes = np.array([ord(c) for run, _ in runs for c in run])
        first = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
        last = np.append(first[1:], len(codes)) - 1
        classes[kind] = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(codes[first].tolist(), codes[last].tolist(), strict=True))
    upper = regex.findall(r"[\p{Lu}\p{Lt}\p{Other_Uppercase}]", every)
    lower = normalizers.Lowercase().normalize_str("\n".join(upper)).split("\n")
    # each character by itself: a final sigma is not special
    return classes, {ord(c): own for c, own in zip(upper, lower, strict=True) if own != c.lower() or c == "Σ"}


@dataclass
class Compiled:
    """The automaton as arrays, and what is needed to cut texts into words."""

    labels: list[str]  # by token
    widths: np.ndarray  # symbols of each token
    born: np.ndarray  # merge that made a token, -1 for symbols
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray  # sorted x << 20 | y: arcs taken away
    ranks: np.ndarray  # by which merge
    edges: np.ndarray  # sorted node << 9 | symbol of the trie
    targets: np.ndarray
    fail: np.ndarray
    token_at: np.ndarray  # token that a node spells, or -1
    depth: np.ndarray
    pattern: str
    lower: dict[int, str]
    specials: dict[str, int]


def compile_file(path: str) -> Compiled:
    """Compiles a word-level BPE file (NFC, white space, lower case; split by pattern;
    byte level; word-end suffix)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    size = max(*vocab.values(), *(t["id"] for t in spec["added_tokens"])) + 1
    labels = [""] * size
    for s, i in (vocab | {t["content"]: t["id"] for t in spec["added_tokens"]}).items():
        labels[i] = s
    widths = np.array([len(s) - len(end) * (s.endswith(end) and len(s) > len(end)) for s in labels])
    born, left, right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
    gone: dict[int, int] = {}
    for at, merge in enumerate(model["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        u, v, w = vocab[a], vocab[b], vocab[a + b]
        gone.setdefault(u << 20 | v, at)
        if born[w] < 0:
            born[w], left[w], right[w] = at, u, v
    # the vocabulary as a trie; a symbol is a byte, or a byte that ends its word (256 + byte)
    code = {s: b for b, s in enumerate(byte_symbols())}
    edges: dict[int, int] = {}
    token_at, depth = [-1], [0]
    symbols = {vocab[s] for s in code if s in vocab} | {vocab[s + end] for s in code if s + end in vocab}
    for text, token in vocab.items():
        if born[token] < 0 and token not in symbols:
            continue
        last = text.endswith(end) and len(text) > len(end)
        word = [code[c] for c in (text[: -len(end)] if last else text)]
        word[-1] += 256 * last
        node = 0
        for symbol in word:
            to = edges.get(node << 9 | symbol)
            if to is None:
                to = edges[node << 9 | symbol] = len(depth)
                depth.append(depth[node] + 1)
                token_at.append(-1)
            node = to
        token_at[node] = token
    fail = [0] * len(depth)
    for edge, to in sorted(edges.items(), key=lambda e: depth[e[1]]):
        node, symbol = edge >> 9, edge & 511
        while node:
            node = fail[node]
            if (down := edges.get(node << 9 | symbol)) is not None:
                fail[to] = down
                break
    classes, lower = characters()
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    # runs of letters stay as they are when all that isn't one is set apart: no other alternative starts with a letter
    pattern = "|".join(a for a in pattern.split("|") if a != r"[\p{L}]+")
    for kind, inside in classes.items():
        pattern = pattern.replace(rf"\p{{{kind}}}", inside)

    def table(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.fromiter(pairs, np.int64, len(pairs))
        by = np.argsort(keys)
        return keys[by], np.fromiter(pairs.values(), np.int64, len(pairs))[by]

    return Compiled(
        labels, widths, born, left, right, *table(gone), *table(edges), np.array(fail), np.array(token_at), np.array(depth),
        pattern.replace(r"\s", r"\t-\r " + WIDE_SPACE), lower, {t["content"]: t["id"] for t in spec["added_tokens"]},
    )


class TokenAutomaton:
    """A compiled automaton with the transitions that were needed so far."""

    def __init__(self, compiled: Compiled):
        self.labels, self.widths = compiled.labels, compiled.widths
        self.born, self.left, self.right = compiled.born.tolist(), compiled.left.tolist(), compiled.right.tolist()
        self.gone = dict(zip(compiled.pairs.tolist(), compiled.ranks.tolist(), strict=True))
        self.edges = dict(zip(compiled.edges.tolist(), compiled.targets.tolist(), strict=True))
        self.fail = compiled.fail.tolist()
        # tokens that end at a node, the longest first: its own, then those of the node it falls back to
        ending: list[tuple] = [()] * len(self.fail)
        token_at, depth = compiled.token_at.tolist(), compiled.depth.tolist()
        for node in np.argsort(compiled.depth, kind="stable").tolist():
            own = ((depth[node], token_at[node]),) if token_at[node] >= 0 else ()
            ending[node] = own + (ending[self.fail[node]] if node else ())
        self.first = np.cumsum([0, *map(len, ending)])
        self.lengths, self.tokens = (np.array([e[i] for es in ending for e in es] + [0]) for i in (0, 1))
        self.moves, self.arcs = Table(9, 18), Table(20, 19)

    def goto(self, node: int, symbol: int) -> int:
        while (to := self.edges.get(node << 9 | symbol)) is None:
            if node == 0:
                return 0
            node = self.fail[node]
        return to

    def arc(self, x: int, y: int) -> bool:
        """Whether the arc x -> y is left after all gadgets."""
        until = NO_MERGE - 1
        while True:
            if self.gone.get(x << 20 | y, NO_MERGE) <= until:
                return False
            bx, by = self.born[x], self.born[y]
            if bx < 0 and by < 0:
                return True
            if by >= bx:  # y's gadget copied the arcs into its left part, after taking one away
                y, until = self.left[y], by
            else:  # x's gadget copied the arcs out of its right part, before that
                x, until = self.right[x], bx - 1

    def tabulated(self, table: Table, keys: np.ndarray, of) -> np.ndarray:
        """Values of transitions, worked out where they aren't known yet."""
        values, missing = table.get(keys)
        if len(missing):
            new = np.unique(keys[missing])
            found = np.fromiter((of(k >> table.shift, k & table.low) for k in new.tolist()), np.int64, len(new))
            table.put(new, found)
            values[missing] = found[np.searchsorted(new, keys[missing])]
        return values

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of pre-split words, one word after the other, and the number
        of each word's: the words take their transitions together, symbol by symbol."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        data[starts + sizes - 1] += 256
        # longer words first: those that go on are the first ones
        by = np.argsort(-sizes, kind="stable")
        offset, length = starts[by], sizes[by]
        ended = np.full((len(data) + len(words)), -1, np.int32)  # of each word: before it, then after each symbol
        base = (starts + np.arange(len(words)))[by]
        node = np.zeros(len(words), np.int64)
        going = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right") if len(words) else []
        for j, n in enumerate(going):
            node = self.tabulated(self.moves, node[:n] << 9 | data[offset[:n] + j], self.goto)
            left, at = np.arange(n), self.first[node]
            while len(left):
                if (at >= self.first[node[left] + 1]).any():
                    raise ValueError("the vocabulary lacks a byte")
                token = self.tokens[at]
                before = ended[base[left] + j + 1 - self.lengths[at]]
                good = before < 0
                inner = np.flatnonzero(~good)
                if len(inner):
                    good[inner] = self.tabulated(self.arcs, before[inner].astype(np.int64) << 20 | token[inner], self.arc) > 0
                ended[base[left[good]] + j + 1] = token[good]
                left, at = left[~good], at[~good] + 1
        # back from the ends
        found, owner, alive, at = [], [], np.arange(len(words)), length.copy()
        while len(alive):
            token = ended[base[alive] + at]
            found.append(token)
            owner.append(alive)
            at = at - self.widths[token]
            alive, at = alive[at > 0], at[at > 0]
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        word = by[np.concatenate(owner)]
        step = np.repeat(np.arange(len(found)), [len(f) for f in found])
        order = np.lexsort((-step, word))
        return np.concatenate(found)[order], np.bincount(word, minlength=len(words))


class Table:
    """Values by key, in a bounded number of places: a newer key may take an older one's."""

    def __init__(self, shift: int, places: int):
        self.shift, self.low = shift, (1 << shift) - 1
        self.keys, self.values = np.full(1 << places, -1, np.int64), np.zeros(1 << places, np.int64)
        self.drop = np.uint64(64 - places)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.drop).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.place(keys)
        return self.values[at], np.flatnonzero(self.keys[at] != keys)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self.place(keys)
        self.keys[at] = keys
        self.values[at] = values
        # of keys that fell on one place the last one's value counts
        same = self.keys[at] == keys
        self.values[at[same]] = values[same]


class WordBpe:
    """Encodes and decodes texts with a compiled automaton."""

    def __init__(self, compiled: Compiled):
        self.automaton = TokenAutomaton(compiled)
        self.lower, self.specials, self.pattern = compiled.lower, compiled.specials, compiled.pattern
        self.special = regex.compile("|".join(map(regex.escape, self.specials)))
        self.odd = regex.compile("[" + "".join(map(chr, self.lower)) + "]")
        self.marks = regex.compile(r"\p{M}")
        self.composed = normalizers.NFC()
        self.labels = pa.array(compiled.labels, pa.large_string())
        self.digits = pa.array(list(map(str, range(len(compiled.labels)))), pa.large_string())

    def plain(self, text: str) -> str:
        """Composed and in lower case."""
        if not text.isascii():
            # only where marks stand do Unicode versions compose otherwise
            text = self.composed.normalize_str(text) if self.marks.search(text) else unicodedata.normalize("NFC", text)
            if self.odd.search(text):
                text = text.translate(self.lower)
        return text.lower()

    def words(self, texts: pa.Array) -> pa.Array:
        """The words of each text."""
        plain = pc.fill_null(texts, "").cast(pa.large_string())
        special = np.flatnonzero(pc.match_substring(plain, "<|").to_numpy(zero_copy_only=False))
        lists = self._split(pa.array([self.plain(t) for t in plain.to_pylist()], pa.large_string()))
        if not any(self.special.search(plain[i].as_py()) for i in special.tolist()):
            return lists
        # texts with special tokens: these are words of their own, between words of what is around them
        out = lists.to_pylist()
        for i in special.tolist():
            text, at, out[i] = plain[i].as_py(), 0, []
            for m in self.special.finditer(text):
                out[i] += self._split(pa.array([self.plain(text[at : m.start()])], pa.large_string()))[0].as_py() + [m[0]]
                at = m.end()
            out[i] += self._split(pa.array([self.plain(text[at:])], pa.large_string()))[0].as_py()
        return pa.array(out, pa.large_list(pa.large_string()))

    def _split(self, plain: pa.Array) -> pa.Array:
        apart = pc.replace_substring_regex(plain, self.pattern, r" \0 ")
        wide = f"[{WIDE_SPACE}]"
        if pc.any(pc.match_substring_regex(apart, wide)).as_py():
            apart = pc.replace_substring_regex(apart, wide, " ")
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(apart))
        # a text without words is split into one empty word
        empty = pc.equal(lists.values, "")
        if pc.any(empty).as_py():
            kept = np.concatenate([[0], np.cumsum(~empty.to_numpy(zero_copy_only=False))])
            lists = pa.LargeListArray.from_arrays(pa.array(kept[np.asarray(lists.offsets)]), lists.values.filter(pc.invert(empty)))
        return lists

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """Number of ids, ids as text, decoded text of each text, and all ids one after the other."""
        lists = self.words(texts)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        coded = pc.dictionary_encode(lists.values)
        distinct = coded.dictionary.to_pylist()
        ids, own = self.automaton.read([w.encode() for w in distinct])
        firsts = np.cumsum(own) - own
        if self.specials.keys() & set(distinct):
            ids = np.append(ids, np.zeros(len(self.specials), np.int32))
            for n, (name, token) in enumerate(self.specials.items()):
                if name in distinct:  # no text gives such a word otherwise
                    at, place = distinct.index(name), len(ids) - len(self.specials) + n
                    ids[place], firsts[at], own[at] = token, place, 1
        index = np.asarray(coded.indices).astype(np.int64)
        sizes = own[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(firsts[index] - ends[:-1], sizes) + np.arange(ends[-1])] if len(index) else ids[:0]
        places = pa.array(ends[offsets])
        joined = [pc.binary_join(pa.LargeListArray.from_arrays(places, names.take(pa.array(flat))), SPACE) for names in (self.digits, self.labels)]
        return np.diff(ends[offsets]), *joined, flat


def encode(docs: DataFrame, path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs``;
    ``with_ids`` adds the ids (array), ``with_text`` the decoded text.

    ``path``: a tokenizer file that the driver can open."""
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    names = [f.split()[0] for f in fields.split(", ")]
    known = docs.sparkSession.sparkContext.broadcast(compile_file(path))

    def run(batches):
        bpe = WordBpe(known.value)  # its tables live as long as the task
        for batch in slices(batches, 1, 2 << 20):
            counts, texts, decoded, flat = bpe.encode(batch.column(1))
            digests = [pa.array([hashlib.sha256(x).hexdigest() for x in xs.cast(pa.large_binary()).to_pylist()], pa.string()) for xs in (texts, decoded)]
            columns = [batch.column(0), pa.array(counts), *digests]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat)))
            if with_text:
                columns.append(decoded.cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)
        del bpe
        hand_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields)
