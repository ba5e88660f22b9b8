import hashlib
import re

from sievelake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


ODD = [
    None, "", "no data", "a@b.co", "a@b.c_d@e.f.g x@y", "..a@b.c.", "a@@b.cc", "é😀 mail+x@ex-ample.org, ñ@b.cd", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255", "1.2.3.", "4111 1111-1111 1111",
    "4111111111111112 4111111111111111", "+1 (743) 555-3824 +123 +12345678901234567", "+4111111111111111", "9" * 3000, "1 " * 3000, "a" * 20000, "a." * 3000 + "@", "x@" + "b." * 3000 + "c", "1-2-3-4-5-6-7-8-9-0-1-2-8",
    "+" * 500, "@" * 500, "\ta@b.cd\n1.1.1.1\r\n", "50.50.50.50@a.b",
]


def test_base_spans(make, real):
    texts = [t for _, t, _ in real] + ODD + ["a@b.co", "a@b.co"]
    rows = {r["doc_id"]: r for r in pii.report(make(texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        spans = brute(t)
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in spans) for k in PATTERNS], t
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert rows[i]["spans"].split(",term")[0] == ",".join(spans) or rows[i]["n_term"]
    assert pii.report(make([])).count() == 0


def test_disclosing_terms(make):
    mark = ["lorem ipsum dolor", "sit amet elit", "sed eiusmod tempor", "incididunt labore", "magna aliqua enim"]
    texts = [f"{m} the zorblax wrote from joe@mail.org today {m}" for m in mark] + [f"the weather today {i} {m} from there" for i, m in enumerate(mark * 20)]
    rows = {r["doc_id"]: r for r in pii.report(make(texts), support=4).collect()}
    for i, t in enumerate(texts[:5]):
        at = t.index("zorblax")
        assert f"term:{at}:{at + 7}" in rows[i]["spans"] and rows[i]["spans"].startswith("email:")
        assert f"term:{t.index('today')}" not in rows[i]["spans"]
    assert all(rows[i]["n_term"] == 0 for i in range(5, len(texts)))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(make(texts + [None, "x", "+4111111111111111!"]), support=4).collect()}
    # what occurs in these texts alone goes, what stands in others too stays
    assert clean[0].split() == ["lorem", "ipsum", "dolor", "the", "from", "[EMAIL]", "today", "lorem", "ipsum", "dolor"]
    assert all("zorblax" not in clean[i] for i in range(5))
    assert "joe" not in clean[0] and clean[50] == texts[50] and clean[len(texts)] is None and clean[len(texts) + 1] == "x"
    assert clean[len(texts) + 2] in ("[CARD]!", "[PHONE]!", "+[CARD]!")


def test_entity_of_one_text(make):
    """An entity seen once has disclosing terms, wherever they stand in its text."""
    far = "and so on " * 40
    texts = [f"Quixbert {far} wrote from joe@mail.org {far} so QUIXBERT did"] + [f"{far} wrote from the weather of day {i} did" for i in range(400)]
    rows = {r["doc_id"]: r for r in pii.report(make(texts)).collect()}
    places = [texts[0].index("Quixbert"), texts[0].index("QUIXBERT")]
    assert rows[0]["spans"].split(",")[1:] == [f"term:{at}:{at + 8}" for at in places] and rows[0]["n_term"] == 2
    assert all(rows[i]["n_term"] == 0 for i in range(1, len(texts)))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(make(texts)).collect()}
    assert clean[0] == f"[TERM] {far} wrote from [EMAIL] {far} so [TERM] did"
    assert all(clean[i] == texts[i] for i in range(1, len(texts)))


def brute_terms(rows, alpha=0.9, support=4, prior=0.5):
    """Spans of terms of each row, by counts over all rows."""
    import math

    import regex

    outside, values = [], []
    for text in rows:
        blank, own = list(text or ""), set()
        for span in brute(text):
            lo, hi = map(int, span.split(":")[1:])
            own.add(text[lo:hi])
            blank[lo:hi] = " " * (hi - lo)
        outside.append("".join(blank))
        values.append(own)
    terms = [{t.lower() for t in regex.findall(r"\p{L}{3,}", o)} for o in outside]
    n_t = {}
    for own in terms:
        for t in own:
            n_t[t] = n_t.get(t, 0) + 1
    risky = [set() for _ in rows]
    for e in set().union(*values):
        at = [i for i, own in enumerate(values) if e in own]
        p = len(at) / len(rows)
        for t in set().union(*(terms[i] for i in at)):
            n_te = sum(t in terms[i] for i in at)
            if p < 1 and math.log2((n_te + prior * p) / (n_t[t] + prior) / p) >= -alpha * math.log2(p):
                for i in at:
                    risky[i].add(t)
    return [[f"term:{m.start()}:{m.end()}" for m in regex.finditer(r"\p{L}{3,}", o) if m[0].lower() in own] for o, own in zip(outside, risky, strict=True)]


def test_terms_of_a_whole_table(make, real):
    """Terms equal those of brute-force counts of co-occurrence over the whole table."""
    texts = [t for _, t, _ in real]
    want = brute_terms(texts)
    rows = {r["doc_id"]: r["spans"] for r in pii.report(make(texts)).collect()}
    assert [[s for s in rows[i].split(",") if s.startswith("term")] for i in range(len(texts))] == want
    assert sum(map(len, want)) > 20


def test_many_spans_in_one_text(make):
    """A hundred thousand addresses in one text, in linear time, and the text put together again."""
    import time

    text = " ".join(f"u{i}@m{i % 7}.org" for i in range(100_000)) + " é 1.2.3.4"
    began = time.time()
    docs = make([text, "x"])
    row = {r["doc_id"]: r for r in pii.report(docs).collect()}[0]
    assert time.time() - began < 60
    assert row["n_email"] == 100_000 and row["n_ip"] == 1
    spans = brute(text)
    assert row["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] == " ".join(["[EMAIL]"] * 100_000) + " é [IP]" and clean[1] == "x"
