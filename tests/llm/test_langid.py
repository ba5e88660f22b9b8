import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import langid


def test_held_out_accuracy_and_edges(make, spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.learn(docs.where(~held_out))
    found = langid.identify(docs.where(held_out), model)
    right, rejected, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count_if("rejected"), F.count(F.lit(1))).first()
    assert right / n >= 0.98 and rejected <= 0.01 * n
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), n)) for n in (200, 1000)] + [" ".join("".join(rng.choice(list("qxzjkvwh"), 7)) for _ in range(60))]
    odd = [None, "", "12 34 !!", "Железо бетонный завод " * 40, "the and of", "the and of", "x" * 50000, *noise]
    rows = {r["doc_id"]: r for r in langid.identify(make(odd, extra=True), model).collect()}
    assert [rows[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and all(rows[i]["rejected"] and rows[i]["score"] == 0 for i in range(3))
    assert rows[3]["rejected"] and rows[3]["lang_pred"] in model.languages
    assert rows[4]["lang_pred"] == "en" and not rows[4]["rejected"] and rows[4][6:] == rows[5][6:]
    assert all(rows[i]["rejected"] for i in range(7, 10))
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[0]["bits"] == "bits"
    assert langid.identify(make([]), model).count() == 0
    # the grouping of the languages changes nothing
    assert len(model.groups(1)) == len(model.languages)
    alone = {r["doc_id"]: r for r in langid.identify(make(odd), model, memory=1).collect()}
    assert all(alone[i]["lang_pred"] == rows[i]["lang_pred"] and abs(alone[i]["score"] - rows[i]["score"]) < 1e-6 for i in rows)


@pytest.mark.parametrize("absent", ["de", "es"])
def test_rejects_an_unlearned_language(spark, absent):
    """Documents of a language that the models don't have, in letters that they do have, are rejected."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.learn(docs.where(~held_out & (F.col("lang") != absent)))
    assert absent not in model.languages and len(model.languages) >= 2
    found = langid.identify(docs.where(held_out & F.col("lang").isNotNull()), model)
    rates = {r["strange"]: r["rate"] for r in found.groupBy((F.col("lang") == absent).alias("strange")).agg(F.avg(F.col("rejected").cast("int")).alias("rate")).collect()}
    assert rates[True] >= 0.9 and rates[False] <= 0.02, rates


def kneser_ney(texts, order):
    """P(character | context) by the definition, from all n-grams as strings."""
    counts = [collections.Counter() for _ in range(order + 1)]
    for text in texts:
        for word in text.split():
            padded = "^" * (order - 1) + word + "$"
            for i in range(order - 1, len(padded)):
                counts[order][padded[i - order + 1 : i + 1]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    below = []
    for k in range(order + 1):
        n1, n2 = (sum(v == n for v in counts[k].values()) for n in (1, 2))
        below.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)

    def p(context, c, k):
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        own = context[len(context) - k + 1 :]
        around = {g: v for g, v in counts[k].items() if g[:-1] == own}
        lower = p(context, c, k - 1)
        if not around:
            return lower
        return (max(counts[k][own + c] - below[k], 0) + below[k] * len(around) * lower) / sum(around.values())

    return p, counts


@pytest.mark.parametrize("order", [2, 3, 5])
def test_equals_brute_force(make, order):
    texts = ["ab abc abd abcab", "ab abc ça", "bad cab ab dada"]
    model = langid.fit(make(texts, langs=["xx"] * 3).select("text", "lang"), order=order)
    p, counts = kneser_ney(texts, order)
    words = ["abc", "abd", "ab", "zzz", "ça", "b", "dad", "abcabcabc"]
    bits, sizes = langid.Scorer(model, [0]).bits(words)
    for w, b, n in zip(words, bits[0], sizes, strict=True):
        padded = "^" * (order - 1) + w + "$"
        want = -sum(math.log2(p(padded[i - order + 1 : i], padded[i], order)) for i in range(order - 1, len(padded)))
        assert abs(b - want) < 1e-4 and n == len(w) + 1
    # after any context the characters seen, the end of a word and one unseen character have probability 1
    for context in ("^" * (order - 1), "ab"[: order - 1].rjust(order - 1, "^"), "zz"[: order - 1].rjust(order - 1, "z")):
        assert abs(sum(p(context, c, order) for c in [*counts[1], "?"]) - 1) < 1e-9


def test_nothing_is_left_out(make):
    """A model holds every n-gram of its texts, however rare."""
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdefghijklmnop"), 8)) for _ in range(400)) for _ in range(20)]
    model = langid.fit(make(texts, langs=["xx"] * 20).select("text", "lang"))
    words = [w for t in texts for w in t.split()]
    grams = {("\0\0\0\0" + w + "\0")[i : i + 5] for w in words for i in range(len(w) + 1)}
    assert model.sizes[5] == len(grams) == len(model.levels(0)[4].grams)


def test_without_labels(make):
    docs = make(["some text"], langs=[None])
    assert [r["lang_pred"] for r in langid.identify(docs, langid.learn(docs)).collect()] == ["und"]


def test_few_labels(make):
    """A language with too few held-out texts is not rejected, or takes the limits of the others."""
    docs = make(["ein kurzer satz", "a short sentence", "noch ein satz"], langs=["de", "en", "de"])
    rows = langid.identify(docs, langid.learn(docs)).collect()
    assert len(rows) == 3 and not any(r["rejected"] for r in rows)
