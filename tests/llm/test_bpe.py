import hashlib
import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from sievelake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield ids, t.decode(ids, skip_special_tokens=False)


def test_whole_table_and_edges(make, real):
    texts = [t for _, t, _ in real] + [None, "", " \n", "a" * 20000, "x<|endoftext|>Y<|startoftext|>", "ΣΑΣ İ é ﬁ", "😀❤️ don't WE'LL 1234", "same", "same"]
    rows = {r["doc_id"]: r for r in bpe.encode(make(texts, extra=True), PATH, with_ids=True, with_text=True).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, (ids, decoded) in enumerate(expected(texts)):
        r = rows[i]
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (ids, decoded, len(ids)), texts[i]
        assert (r["ids_sha256"], r["decoded_sha256"]) == (sha(" ".join(map(str, ids))), sha(decoded))


def test_random_words_and_small_tables():
    tokenizer = bpe.WordBpe(bpe.compile_file(PATH))
    rng = random.Random(4)
    texts = ["".join(rng.choice(a) for _ in range(rng.choice([1, 5, 30]))) for a in ("ab", "aeiou stn'", "abcé中 \n", "'srtvemld ", "0a1 #!") for _ in range(400)]
    texts += ["".join(chr(c) for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x32000, 64)]  # every assigned character
    want = list(expected(texts))
    for lo in range(0, len(texts), 50):
        for table in (tokenizer.automaton.arcs, tokenizer.automaton.moves):
            table.keys[:] = -1
        counts, ids, decoded, flat = tokenizer.encode(pa.array(texts[lo : lo + 50]))
        assert flat.tolist() == [i for w, _ in want[lo : lo + 50] for i in w]
        for i in range(len(counts)):
            own, text = want[lo + i]
            assert (counts[i], ids[i].as_py(), decoded[i].as_py()) == (len(own), " ".join(map(str, own)), text)


def test_crowded_tables():
    """Transitions that take each other's places are worked out again."""
    tokenizer = bpe.WordBpe(bpe.compile_file(PATH))
    tokenizer.automaton.moves, tokenizer.automaton.arcs = bpe.Table(9, 5), bpe.Table(20, 5)
    texts = ["the quick brown fox jumps over the lazy dog", "pneumonoultramicroscopicsilicovolcanoconiosis"] * 3
    counts, _, _, flat = tokenizer.encode(pa.array(texts))
    assert flat.tolist() == [i for ids, _ in expected(texts) for i in ids]


def test_arcs_equal_merging():
    """An arc x -> y stands just if merging the two labels' symbols gives x, y again."""
    import json

    spec = json.load(open(PATH, encoding="utf-8"))["model"]
    merges = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): n for n, m in enumerate(spec["merges"])}
    automaton = bpe.TokenAutomaton(bpe.compile_file(PATH))

    def merged(symbols):
        while True:
            pairs = [(merges[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
            if not pairs:
                return symbols
            i = min(pairs)[1]
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]

    rng, end = random.Random(2), spec["end_of_word_suffix"]
    inner = [t for t in spec["vocab"] if not t.endswith(end) and spec["vocab"][t] in set(spec["vocab"].values())]
    symbols_of = lambda t: [*t[: -len(end)][:-1], t[: -len(end)][-1] + end] if t.endswith(end) and len(t) > len(end) else [*t]
    tokens = rng.sample([t for t in inner if not t.startswith("<|") and merged(symbols_of(t)) == [t]], 60) + ["e", "t", "s", "th", "in"]
    for x in tokens:
        for y in rng.sample(tokens, 20) + ["s" + end, "ing" + end]:
            assert automaton.arc(spec["vocab"][x], spec["vocab"][y]) == (merged(symbols_of(x) + symbols_of(y)) == [x, y]), (x, y)


def test_empty(make):
    assert bpe.encode(make([]), PATH).count() == 0
