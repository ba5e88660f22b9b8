"""Licenses, media, decontamination, WARC, sharding: round trips and brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import decontaminate, licenses, media, sharding, warc
from sievelake.workspace import scratch


def test_licenses_equal_sql(make, spark, real):
    mit = licenses.TEMPLATES["MIT"]
    texts = [t for _, t, _ in real] + [None, "", "mit", "RELEASED under the   mit license", "Released under MIT License.", mit, mit.replace(". ", ".\n\n"), "intro\n\n" + mit.replace(", ", ",\n") + "\n\nend", "x " * 5000, "Released under the MIT License."]
    docs = make(texts, extra=True)
    got = sorted(tuple(r) for r in licenses.scan(docs).collect())
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(licenses.sql()).df()[["doc_id", "segment", "number", "license", "shared", "n_segment", "n_template", "dice"]]
    assert got == sorted(want.itertuples(index=False, name=None))
    found = {(r[0], r[3]) for r in got}
    n = len(real)
    assert (n + 3, "MIT-notice") in found and (n + 5, "MIT") in found and (n + 6, "MIT") in found and (n + 7, "MIT") in found
    assert licenses.scan(make([])).count() == 0


def test_planted_licenses(make, real):
    """Every license in the middle of a document: wrapped over lines, within a line, with a word in fifteen changed."""
    import random

    rng = random.Random(2)
    texts, planted = [], []
    for name, text in licenses.TEMPLATES.items():
        w = text.split()
        changed = [rng.choice(["foo", "bar", "baz"]) if i % 15 == 9 else x for i, x in enumerate(w)]
        for form in (" ".join(w), "\n# ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)), " ".join(changed)):
            before, after = rng.choice(real)[1] or "", rng.choice(real)[1] or ""
            texts.append(f"{before} {form} {after}")
            planted.append(name)
    found = {}
    for r in licenses.scan(make(texts)).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    caught = [name in found.get(i, ()) for i, name in enumerate(planted)]
    assert sum(caught) >= 0.9 * len(caught), [n for n, c in zip(planted, caught, strict=True) if not c]
    assert all(c for i, c in enumerate(caught) if i % 3 < 2)


def test_license_windows(make):
    notice = "released under the mit license"
    many = licenses.scan(make([f"a {notice} " * 3, f"one {notice}", notice.replace("released", "given")]))
    got = sorted((r["doc_id"], r["number"]) for r in many.where("segment = 'window' AND license = 'MIT-notice'").collect())
    assert got == [(0, 1), (0, 7), (0, 13), (1, 1)]
    own = licenses.scan(make(["x own terms y"]), {"own": "Own terms"})
    assert [(r["segment"], r["number"], r["dice"]) for r in own.collect()] == [("window", 1, 1.0)]


def test_license_lines_of_the_tables(make):
    lines = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."]
    found = {r["doc_id"]: r["license"] for r in licenses.scan(make([f"some words\n{t}\nmore words" for t in lines])).where("dice = 1").collect()}
    assert found == {0: "CC-BY-NC-4.0-notice", 1: "MIT-notice", 2: "Apache-2.0-notice", 3: "GPL-3.0-notice"}


def test_media_round_trip(make, spark, real):
    texts = [t for _, t, _ in real[:60]] + [None, "", "a", "é" * 32, "b" * 64, "c" * 500_000, "same", "same"]
    path = scratch(spark, "media-test")
    media.store(make(texts, extra=True), path)
    rows = {r["doc_id"]: r for r in media.describe(media.load(spark, path, range_bytes=20_000, batch_bytes=5_000)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), None)
    assert rows[len(texts) - 1][2:] == rows[len(texts) - 2][2:]
    assert media.describe(media.load(spark, scratch(spark, "nothing"))).count() == 0


def test_media_damaged_member(make, spark):
    path = scratch(spark, "media-damaged")
    media.store(make(["first text", "second text"]).coalesce(1), path)
    from pathlib import Path

    (archive,) = Path(path.removeprefix("file://")).glob("*.zip")
    data = bytearray(archive.read_bytes())
    data[60] ^= 0xFF
    archive.write_bytes(data)
    rows = media.describe(media.load(spark, path)).collect()
    assert sorted((r["payload_bytes"] is None, r["error"] is not None) for r in rows) == [(False, False), (True, True)]


def test_media_damaged_directory(make, spark):
    from pathlib import Path

    path = scratch(spark, "media-directory")
    media.store(make(["first text", "second text", None]).coalesce(1), path)
    (archive,) = Path(path.removeprefix("file://")).glob("*.zip")
    data = bytearray(archive.read_bytes())
    data[-22:-18] = b"none"
    archive.write_bytes(data)
    rows = media.describe(media.load(spark, path)).collect()
    assert sorted(r["n_bytes"] for r in rows) == [0, 10, 11] and not any(r["error"] for r in rows)


def unfiltered(png):
    """Samples of an 8-bit grey image, by the format's definition."""
    at, idat, width, height = 8, b"", 0, 0
    while at < len(png):
        size, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert tuple(body[8:]) == (8, 0, 0, 0, 0)
        idat += body if kind == b"IDAT" else b""
        at += size + 12
    raw = zlib.decompress(idat)
    assert all(raw[y * (width + 1)] == 0 for y in range(height))
    return b"".join(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)] for y in range(height))


def test_media_features(make, spark, real):
    """What is stored is a valid image of the payload, and features follow from its samples."""
    texts = [t for _, t, _ in real[:20]] + [None, "a" * 700, "é" * 3000]
    path = scratch(spark, "media-features")
    media.store(make(texts), path)
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.load(spark, path).collect()}
    for r in media.describe(media.load(spark, path)).collect():
        png = stored[r["doc_id"]]
        samples = list(unfiltered(png))
        assert bytes(samples).rstrip(b"\0") == (texts[r["doc_id"]] or "").encode() and hashlib.sha256(bytes(samples)).hexdigest() == r["payload_sha256"]
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        mean = sum(samples) / len(samples)
        sd = (sum((x - mean) ** 2 for x in samples) / len(samples)) ** 0.5
        step = sum(abs(a - b) for a, b in zip(samples, samples[1:])) / (len(samples) - 1)
        m, d, s, bits = r["feature"].split(";")
        assert abs(float(m) - mean) < 1e-5 and abs(float(d) - sd) < 1e-5 and abs(float(s) - step) < 1e-5 and len(bits) == 16


def brute_leaks(texts, items):
    words = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    out = set()
    for d, t in enumerate(texts):
        w = words(t)
        own = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in range(1, 6)}
        for item, text in items:
            g, iw = grams(words(text)), words(text)
            tail = len(words(re.split(r"(?<=[.!?])\s+", (text or "").strip())[-1]))
            tail = tail if 0 < tail < len(iw) else max(1, len(iw) // 3)
            parts = (set(iw[: len(iw) - tail]), set(iw[len(iw) - tail :])) if len(iw) > tail else (set(iw), set(iw))
            if g and sum(x in own[len(x)] for x in g) / len(g) >= 0.8 and all(len(p & set(w)) >= 0.5 * len(p) for p in parts):
                out.add((d, item))
    return out


def test_decontamination_equals_brute_force(make, spark, sf, real, monkeypatch):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    longest = max(items, key=lambda r: len(r[1]))[1]
    texts = [t for _, t, _ in real]
    texts += [None, "", "filler words here " * 200 + longest.upper() + " more filler" * 300, longest.replace(" ", "  ,"), " ".join(longest.split()[:-3]), " ".join(longest.split()[: len(longest.split()) // 2]), "tiny item here", longest, longest]
    items += [(1000, None), (1001, "Tiny item here!"), (1002, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make(texts, extra=True)
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(texts, items)
    marked = decontaminate.leaks(docs, bench)
    assert marked.count() == len(texts) and marked.where("size(hits) = 0 AND row = 'row'").count() == len(texts) - len({r["doc_id"] for r in got})
    # by shards, more of them than are held at once, the same is found
    for name, value in (("ITEMS", 8), ("HELD", 2)):
        monkeypatch.setattr(decontaminate, name, value)
    assert len(decontaminate.indexes(bench)) > 4
    again = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["overlap"], r["first_word"]) for r in again} == {(r["doc_id"], r["item_id"], r["overlap"], r["first_word"]) for r in got}
    for r in got:  # what is reported besides the decision
        w = re.sub(r"[\W_]+", " ", texts[r["doc_id"]].lower()).split()
        iw = re.sub(r"[\W_]+", " ", dict(items)[r["item_id"]].lower()).split()
        near = w[max(0, r["first_word"]) : r["first_word"] + 2 * len(iw)]
        assert near[0] in iw and 0 < r["score"] <= 3 and 0 <= min(r["question_overlap"], r["answer_overlap"]) <= max(r["question_overlap"], r["answer_overlap"]) <= 1
        if r["overlap"] == 1:
            assert r["question_overlap"] == r["answer_overlap"] == 1
    assert decontaminate.contaminated(make([]), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_warc(spark):
    long = "<p>" + "x" * 1200
    pages = [(1, "http://a/1", long), (2, "http://a/2", long), (2, "http://a/2", long), (3, None, "short"), (4, "u", "short"), (5, "u\n", None), (None, "n", long), (6, "é", "é" * 700), (7, "é", "é" * 700), (8, "r", "a\r\n\r\nb" * 300)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("row", F.lit(1)).repartition(2, "url")
    from sievelake.workspace import written

    path = scratch(spark, "warc-test")
    index = warc.write(warc.plan(written(frame, "pages")), path, file_bytes=400)
    rows = warc.read(index, path, gap=0).collect()
    assert len(rows) == len(pages) and index.select("file").distinct().count() > 2
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in rows)
    assert kinds == collections.Counter({(1, "revisit", 2): 1, (2, "response", None): 1, (2, "revisit", 2): 1, (None, "revisit", 2): 1, (3, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (6, "revisit", 7): 1, (7, "response", None): 1, (8, "response", None): 1})
    html = {p: (h or "").encode() for p, _, h in pages}
    for r in rows:
        want = html[r["page_id"]] if r["page_id"] is not None else long.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(want), hashlib.sha1(want).hexdigest())
        assert r["payload"] == (want if r["record_type"] == "response" else None)
    only = warc.read(index.where("page_id = 8"), path).collect()
    assert len(only) == 1 and only[0]["payload"] == html[8]
    assert warc.read(warc.write(warc.plan(frame.limit(0)), scratch(spark, "warc-none")), path).count() == 0


def test_warc_hot_and_very_long_payloads(spark):
    from sievelake.workspace import written

    rng = random.Random(8)
    once = "".join(rng.choice("abcdefgh <>é") for _ in range(3_000_000))
    hot = "h" * 1500
    kinds = [hot, once, once[:-1], *("p" * 999 + c for c in "xyz"), "p" * 999, "", None]
    pages = [(i, f"http://{i}", hot if i % 3 == 0 else rng.choice(kinds[3:])) for i in range(2_000)] + [(5_000 + i, None, kinds[1 + i % 2]) for i in range(4)]
    rng.shuffle(pages)
    frame = written(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7, "page_id"), "pages")
    path = scratch(spark, "warc-hot")
    found = warc.read(warc.write(warc.plan(frame), path), path, payloads=False).collect()
    last = {}
    for page_id, _, html in pages:
        last[html or ""] = max(page_id, last.get(html or "", -1))
    want = []
    for page_id, url, html in pages:
        again = len((html or "").encode()) >= 1000 and last[html] != page_id
        want.append((page_id, url, len((html or "").encode()), hashlib.sha1((html or "").encode()).hexdigest(), "revisit" if again else "response", last[html] if again else None))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_warc_refuses_pages_that_changed(spark):
    from sievelake.workspace import written

    planned, other = (warc.plan(written(spark.createDataFrame([(i, c * 1200) for i in range(4)], "page_id long, html string").selectExpr("page_id", "'u' AS url", "html").coalesce(1), "pages")) for c in "ab")
    with pytest.raises(Exception, match="have changed"):
        warc.write(warc.Plan(other.pages, planned.revisits), scratch(spark, "warc-changed"))


def test_sharding_exact_and_repeatable(make, spark):
    texts = [None, "", "é"] + ["copy"] * 300 + [str(i) for i in range(400)]
    docs = make(texts, extra=True)
    runs = [sharding.shuffle(docs, 24, seed=3, rows_per_bucket=7).select("doc_id", "shard", "slot", "row").collect() for _ in range(2)]
    assert sorted(map(tuple, runs[0])) == sorted(map(tuple, runs[1]))
    by = collections.defaultdict(list)
    for r in runs[0]:
        by[r["shard"]].append(r["slot"])
        assert r["row"] == "row"
    sizes = [len(v) for v in by.values()]
    assert len(by) == 24 and max(sizes) - min(sizes) <= 1 and sum(sizes) == len(texts)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shuffle(make([]), 24).count() == 0


def test_communication_matrix():
    counts, sizes = np.array([5, 0, 70, 25]), np.array([40, 30, 30])
    total = np.zeros((4, 3))
    for seed in range(300):
        m = np.array([sharding.partition_row(counts, sizes, p, seed) for p in range(4)])
        assert (m.sum(axis=1) == counts).all() and (m.sum(axis=0) == sizes).all()
        total += m
    assert np.abs(total / 300 - np.outer(counts, sizes) / 100).max() < 1


@pytest.mark.parametrize("good,bad,take", [(3_000_000_000, 1_000_000_000, 2_000_000_000), (1_000_000_000, 4_000_000_000, 4_500_000_000)])
def test_large_draws(good, bad, take):
    rng, n = np.random.default_rng(1), good + bad
    x = np.array([sharding._hypergeometric(rng, good, bad, take) for _ in range(1500)], float)
    sd = np.sqrt(take * (good / n) * (bad / n) * (n - take) / (n - 1))
    assert abs(x.mean() - take * good / n) < 5 * sd / np.sqrt(len(x)) and 0.9 < x.std() / sd < 1.1


def _places(counts, shards, buckets, seed):
    """shard and slot of each row, told from the deal by plain sorting."""
    rows = []
    for part, n in enumerate(counts.tolist()):
        if n:
            bucket, keys = sharding.dealt(counts, shards, buckets, part, seed)
            rows += [(b // buckets, k, len(rows) + i) for i, (b, k) in enumerate(zip(bucket.tolist(), keys.tolist(), strict=True))]
    out, slot = [None] * len(rows), collections.Counter()
    for shard, _, row in sorted(rows):
        out[row] = (shard, slot[shard])
        slot[shard] += 1
    return out


def test_places_are_uniform():
    """Over many seeds every row is in every place about equally often."""
    counts = np.array([5, 0, 9, 6])
    seen = np.zeros((20, 20))
    for seed in range(2000):
        for row, (shard, slot) in enumerate(_places(counts, 4, 2, seed)):
            seen[row, 5 * shard + slot] += 1
    assert (seen.sum(axis=0) == 2000).all() and (seen.sum(axis=1) == 2000).all()
    chi = ((seen - 100) ** 2 / 100).sum()
    assert 361 - 6 * np.sqrt(2 * 361) < chi < 361 + 6 * np.sqrt(2 * 361)


def test_shuffle_is_uniform(spark):
    """The shuffle itself equals the plain one, and where a row stood tells nothing of where it goes."""
    from sievelake.workspace import written

    n, shards = 24_000, 24
    made = spark.range(0, n, 1, 5).withColumn("part", F.spark_partition_id())
    rows = written(made, "uniform").withColumn("here", F.spark_partition_id())
    seen = [np.zeros((20, 24)), np.zeros((20, 20)), np.zeros((6, 6))]
    for seed in range(4):
        got = sharding.shuffle(rows, shards, seed, rows_per_bucket=300).toPandas()
        if seed == 0:  # files come in the order of their sizes, a part's rows in theirs
            order = got.sort_values(["here", "id"])
            counts = order.groupby("here").size().reindex(range(int(order["here"].max()) + 1), fill_value=0).to_numpy()
            assert list(zip(order["shard"], order["slot"], strict=True)) == _places(counts, shards, 4, 0)
        got = got.sort_values("id")
        block, shard, slot = got["id"].to_numpy() * 20 // n, got["shard"].to_numpy(), got["slot"].to_numpy()
        assert sorted(zip(shard.tolist(), slot.tolist(), strict=True)) == [(s, k) for s in range(shards) for k in range(n // shards)]
        place = (shard * (n // shards) + slot) * 6 // n
        np.add.at(seen[0], (block, shard), 1)
        np.add.at(seen[1], (block, slot * 20 // (n // shards)), 1)
        np.add.at(seen[2], (place[:-1], place[1:]), 1)  # neighbours
    for table in seen:
        expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0, keepdims=True) / table.sum()
        free = (table.shape[0] - 1) * (table.shape[1] - 1)
        assert abs(((table - expected) ** 2 / expected).sum() - free) < 6 * np.sqrt(2 * free)


def test_shuffle_equals_the_plain_one(spark):
    """In whatever order the files are read: those of one size come as the folder lists them."""
    from sievelake.workspace import written

    for seed in range(3):
        rows = written(spark.range(0, 24_000, 1, 5), "plain").withColumn("here", F.spark_partition_id()).withColumn("read", F.monotonically_increasing_id())
        got = sharding.shuffle(rows, 24, seed, rows_per_bucket=300).toPandas().sort_values("read")
        counts = got.groupby("here").size().reindex(range(int(got["here"].max()) + 1), fill_value=0).to_numpy()
        assert list(zip(got["shard"], got["slot"], strict=True)) == _places(counts, 24, 4, seed)


def test_registered_columns(spark, sf):
    """What the registered queries derive from their operators' results."""
    from sievelake.llm import catalog

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    shards = catalog.op9_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in shards) == sorted(rows)
    for r in shards:
        data = (rows[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    slots = collections.defaultdict(list)
    for r in shards:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    langs = catalog.op10_langid(spark, sf).collect()
    assert sorted(r["doc_id"] for r in langs) == sorted(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in langs)
    found = catalog.op5_media(spark, sf).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(rows) and all(r["n_bytes"] == len((rows[r["doc_id"]] or "").encode()) for r in found)
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in catalog.op8_warc(spark, sf).collect():
        assert (r["payload_bytes"], r["payload_digest"]) == (len(pages[r["page_id"]]), hashlib.sha1(pages[r["page_id"]]).hexdigest())
