import collections
import gzip
import random
from decimal import ROUND_HALF_EVEN, Context, Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelake.functions import hashing, names, sequences, windows
from sievelake.operators import sketches
from sievelake.sources import filter_tables, sequence_files, topology

MASK = (1 << 64) - 1


def plain_hash(word, k, seed=0, both=False):
    def state(w):
        h = 0
        for c in w[:k]:
            h ^= h << 17 & MASK
            h ^= h >> 47
            h ^= hashing.KERNELS[c.upper()] * (2 * seed + 1) & MASK
        return h

    if len(word) < k or any(c.upper() not in "ACGT" for c in word[:k]):
        return 0
    u = state(word)
    if both:
        u = u + state(word[:k][::-1].upper().translate(str.maketrans("ACGT", "TGCA"))) & MASK
    for m in (*hashing.FINISH, None):
        u ^= u >> 33
        if m:
            u = u * m & MASK
    return u or 1


def test_hash():
    rng = random.Random(1)
    words = ["".join(rng.choice("ACGTacgtN") if rng.random() < 0.1 else rng.choice("ACGT") for _ in range(rng.choice([5, 13, 20]))) for _ in range(500)] + ["", None]
    for seed in (0, 3):
        for both in (False, True):
            got = hashing.hash_words(pa.array(words), 13, seed, both).tolist()
            assert got == [plain_hash(w or "", 13, seed, both) for w in words]
    x = np.array([plain_hash(w or "", 13) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        assert (hashing.unfinish(hashing.finish(x)) == x).all()
    sliced = pa.array(words).slice(7, 50)
    assert hashing.hash_words(sliced, 13).tolist() == [plain_hash(w or "", 13) for w in words[7:57]]
    h = hashing.more_hashes(x[:1], x[1:2], 4)
    s0, s1 = int(x[0]), int(x[1])
    for i in (2, 3):
        s1 ^= s1 << 23 & MASK
        s0, s1 = s1, s1 ^ s0 ^ s1 >> 17 ^ s0 >> 26
        assert int(h[i][0]) == s1


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def brute_qgrams(seq, seed):
    swap = str.maketrans("ACGT", "TGCA")
    found = []
    for i in range(len(seq) - len(seed) + 1):
        w = seq[i : i + len(seed)]
        c = min(w, w[::-1].translate(swap))
        found.append("".join(x for x, s in zip(c, seed) if s == "1"))
    return found


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_windows_and_seeds(spark, monkeypatch, piece):
    """Whole sequences, cut into pieces or not, with small letters, Ns, and other characters."""
    monkeypatch.setattr(windows, "PIECE", piece)
    rng = random.Random(piece)
    seqs = ["", "ACGTA", "AACG", "ACNgt", "acgtACGTNNacé😀GT", None, "N" * 9, *["".join(rng.choice("ACGTACGTacgtN") for _ in range(60)) for _ in range(8)], "ACGT" * 30]
    rows = spark.createDataFrame([(i % 3, s) for i, s in enumerate(seqs)], "key int, seq string").coalesce(1)
    for seeds in (["1011"], ["11011", "01110"], ["111111001111111"]):
        want = collections.Counter((i % 3, q) for i, s in enumerate(seqs) for seed in seeds for q in brute_qgrams(s or "", seed))
        got = {(r["key"], r["qgram"]): r["n"] for r in sketches.qgram_counts(rows, F.col("key"), F.col("seq"), seeds).collect()}
        assert got == dict(want)
        bags = {(r["key"], r["pos"]): r["n"] for r in sketches.qgram_bags(rows, F.col("key"), F.col("seq"), seeds[:1], 1009).collect()}
        hashed = collections.Counter()
        for i, s in enumerate(seqs):
            for q in brute_qgrams(s or "", seeds[0]):
                hashed[i % 3, int(hashing.hash_words(pa.array([q]), len(q))[0]) % 1009] += 1
        assert bags == dict(hashed)
    for k in (1, 4, 9):
        want = collections.Counter()
        for s in seqs:
            for i in range(len(s or "") - k + 1):
                w = s[i : i + k].upper()
                if set(w) <= set("ACGT") and set(s[i : i + k]) <= set("ACGTacgt"):
                    want[min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))] += 1
        assert {r["kmer"]: r["n"] for r in sketches.kmer_counts(rows, F.col("seq"), k).collect()} == dict(want)
    assert one(spark, sequences.reverse_complement(F.col("s")), s="AaCNR") == "RNGaT"
    assert one(spark, sequences.reverse_complement(F.col("s"), True), s="ACRyk") == "mrYGT"
    assert one(spark, sequences.apply_seed(F.col("s"), "111111001111111"), s="abcdefghijklmno") == "abcdefijklmno"
    with pytest.raises(ValueError):
        sequences.check_seed("11*1")
    with pytest.raises(ValueError):
        sketches.qgram_counts(rows, F.col("key"), F.col("seq"), ["11", "111"])


def test_unsigned_modulo(spark):
    values = [0, 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1, 0xDEADBEEFCAFEF00D]
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "h long")
    for m in (7, 1 << 24, 3_000_017, (1 << 61) - 1):
        assert [r[0] for r in rows.select(sketches.modulo(F.col("h"), m)).collect()] == [v % m for v in values]


def test_records_with_marks(spark, tmp_path):
    """Quality lines that start with any code, marks in headers, line ends of both kinds, gz, many small blocks."""
    rng = random.Random(9)
    for name, end in (("a.fastq", "\n"), ("b.fastq", "\r\n"), ("c.fastq.gz", "\n")):
        sizes = [rng.randint(1, 40) for _ in range(200)]
        reads = [(f"r{i}", "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@+I>", k=n))) for i, n in enumerate(sizes)]
        text = "".join(f"@{h} d{end}{s}{end}+{end}{q}{end}" for h, s, q in reads)
        path = tmp_path / name
        path.write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
        got = sorted((r["name"], r["seq"], r["qual"]) for r in sequence_files.fastq(spark, str(path), block_bytes=500).collect())
        assert got == sorted((f"query{h}", s, q) for h, s, q in reads), name
    (tmp_path / "m.fasta").write_text("\n>one a->b >c\r\nAC>GT\r\nAC\r\n>two\r\nGG\r\n")
    (tmp_path / "lines.txt").write_text("\nACGT\nGG\n")
    assert {(r["name"], r["seq"]) for r in sequence_files.query_sequences(spark, str(tmp_path / "m.fasta")).collect()} == {("one", "AC>GTAC"), ("two", "GG")}
    assert {(r["name"], r["seq"]) for r in sequence_files.query_sequences(spark, str(tmp_path / "lines.txt")).collect()} == {("lines.txt:2", "ACGT"), ("lines.txt:3", "GG")}


def test_records_in_any_layout(spark, tmp_path):
    """Records of several lines, empty lines between any two, both line ends, any range."""
    rng = random.Random(4)
    for name, end, gap in (("a.fastq", "\n", ""), ("b.fastq", "\r\n", ""), ("c.fastq", "\n", "\n"), ("d.fastq.gz", "\n", "\n")):
        reads = [(f"r{i}", "".join(rng.choices("ACGTN", k=n)), "".join(rng.choices("@+I>A", k=n))) for i, n in enumerate(rng.choices(range(1, 90), k=150))]
        cut = lambda s: end.join(s[i : i + 20] for i in range(0, len(s), 20))
        text = "".join(f"@{h}\tx y{end}{gap}{cut(s)}{end}{gap}+{rng.choice(['', h])}{end}{gap}{cut(q)}{end}{gap}" for h, s, q in reads)
        data = text.encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
        for block in (97, 1000, 1 << 20):
            got = sorted((r["name"], r["seq"], r["qual"]) for r in sequence_files.fastq(spark, str(tmp_path / name), block_bytes=block).collect())
            assert got == sorted((f"query{h}", s, q) for h, s, q in reads), (name, block)
    assert sequence_files.fastq(spark, str(tmp_path)).count() == 600


def test_broken_records(spark, tmp_path):
    path = tmp_path / "x.fastq"
    path.write_text("@a\nACGT\n+\nIIII\n@b\nACGT\n@c\nAC\n+\nI\n!!!\nnoise\n@d\nA\n+\nI\n@e\nAA\n+\nI")
    with pytest.raises(Exception, match="no quality: @b"):
        sequence_files.fastq(spark, str(path)).collect()
    from sievelake.sources import reads

    rows = reads.read(spark, str(path), keep_bad=True).collect()
    assert [r["name"] for r in rows if r["bad"] is None] == ["a", "d"]
    assert [r["bad"] for r in rows if r["bad"]] == ["no quality: @b", "quality of another length: @c", "quality of another length: @e"]


def test_lines_are_numbered_by_blocks(spark, tmp_path):
    for f in "ab":
        (tmp_path / f).write_text("".join(f"{f}{i}\n" if i % 7 else "\n" for i in range(900)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        frame = sequence_files.lines(spark, str(tmp_path))
        got = {(r["source"], r["line_no"]): r["value"] for r in frame.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(f, i): f"{f}{i}" for f in "ab" for i in range(900) if i % 7}
    listed = spark.createDataFrame([("ACGT\t3",), ("  GGGG 1",)], ["l"])
    assert [r["kmer"] for r in sequence_files.kmer_list(listed, "l", 4).collect()] == ["ACGT", "GGGG"]


def test_numbers(spark):
    ctx = Context(prec=2, rounding=ROUND_HALF_EVEN)
    for v in ["0.265", "0.275", "0.995", "0.0995", "0.09951", "0.09949", "0.005", "1", "0"]:
        want = int(ctx.multiply(Decimal(v), Decimal(100)))
        assert one(spark, sequences.percent(F.col("v")), v=float(v)) == want, v
    assert [sequences.parse_units(t) for t in ("500000", "4K", "0.25G")] == [500000, 4000, 250_000_000]
    assert [sequences.parse_probability(t) for t in ("0.5", "50%", "1/2")] == [0.5] * 3
    for bad in ("0.5", "x", "4KB"):
        with pytest.raises(ValueError):
            sequences.parse_units(bad)
    with pytest.raises(ValueError):
        sequences.parse_probability("3/2")
    assert one(spark, sequences.fraction(F.col("h"), F.col("t")), h=2, t=3) == 0.666667
    assert one(spark, sequences.fraction(F.col("h"), F.col("t")), h=0, t=0) == 0
    assert one(spark, sequences.read_quality(F.col("q")), q="++++") == pytest.approx(10)
    assert one(spark, sequences.keeps_read(F.col("s"), F.col("q"), 9, 4, True), s="ACGT", q="IIII") is False
    assert one(spark, sequences.keeps_read(F.col("s"), F.col("q"), 9, 3), s="ACGT", q="++++") is True
    assert one(spark, sequences.adjusted_hits(F.col("h"), F.col("t"), F.lit(0.5)), h=6, t=10) == 2


def test_names(spark):
    f = lambda rule, v: one(spark, rule(F.col("n")), n=v)
    assert f(names.strip_filter_suffix, "05-34.fna.detbrief.rrr.bf") == "05-34.fna"
    assert f(names.matrix_name, "0_4_.bf 9/10 0.9") == "0_4_" and f(names.matrix_name, "A.fna.bf 1/2 0.5") == "A"
    assert f(names.identification_name, "A.b.fasta.bf") == "A.b" and f(names.abundance_name, "A_.fna") == "A"
    assert f(names.without_two_parts, "A.b.fna.bf") == "A.b" and f(names.dashed, "A_1") == "A-1"


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x\nACGT\nAC\n>two\nNNA\n>none\n\n>three\ngg")
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(">z\nTTT\n")
    rows = {(r["source"], r["name"]): r["seq"] for r in sequence_files.fasta(spark, str(tmp_path)).collect()}
    assert rows == {("a.fasta", "one"): "ACGTAC", ("a.fasta", "two"): "NNA", ("a.fasta", "three"): "gg", ("b.fasta.gz", "z"): "TTT"}
    (tmp_path / "r.fastq").write_text("@r1 d\nACGT\n+\nIIII\n@r2\nA\n+\n!\n")
    reads = sequence_files.fastq(spark, str(tmp_path / "r.fastq")).collect()
    assert [(r["name"], r["seq"], r["qual"]) for r in reads] == [("queryr1", "ACGT", "IIII"), ("queryr2", "A", "!")]
    (tmp_path / "list").write_text("x.bf\ny.bf\n")
    assert sorted((r["line_no"], r["value"]) for r in sequence_files.lines(spark, str(tmp_path / "list")).collect()) == [(0, "x.bf"), (1, "y.bf")]
    assert sorted(r["name"] for r in sequence_files.sequence_lines(spark, str(tmp_path / "list")).collect()) == ["list:1", "list:2"]
    short = spark.createDataFrame([("ACG 1",), ("NNN",)], ["l"])
    assert [r["kmer"] for r in sequence_files.kmer_list(short, "l", 3).collect()] == ["ACG"]
    with pytest.raises(Exception, match="wrong k-mer length"):
        sequence_files.kmer_list(short, "l", 4).collect()


def tree(spark, text):
    return spark.createDataFrame([("t", i, line) for i, line in enumerate(text.split())], "source string, line_no int, value string")


def test_topology(spark):
    rows = {r["node"]: r for r in topology.parse(tree(spark, "root.bf *child1.bf **child3.bf ***child5.bf ***child6.bf **child4[x.bf] *child2.bf")).collect()}
    assert {n for n, r in rows.items() if r["is_leaf"]} == {"child5", "child6", "child4", "child2"}
    assert {n: r["parent"] for n, r in rows.items()} == {"root": None, "child1": "root", "child3": "child1", "child5": "child3", "child6": "child3", "child4": "child1", "child2": "root"}
    assert rows["child4"]["file"] == "x.bf"
    forest = topology.parse(tree(spark, "a.bf *b.bf c.bf *d.bf"))
    assert {r["node"]: r["parent"] for r in forest.collect()} == {"a": None, "b": "a", "c": None, "d": "c"}
    with pytest.raises(Exception, match="depth jump"):
        topology.parse(tree(spark, "a.bf **b.bf")).collect()
    assert [r["line"] for r in topology.render(forest).orderBy("preorder").collect()] == ["a", "*b", "c", "*d"]


def test_parameters():
    assert sequences.parse_query_file("a.fa=0.5") == ("a.fa", 0.5) and sequences.parse_query_file("a.fa:1/4") == ("a.fa", 0.25)
    assert sequences.parse_query_file("a.fa") == ("a.fa", 0.7)
    assert sequences.read_seeds("111\n\n101\n") == ["111", "101"]
    with pytest.raises(ValueError):
        sequences.read_seeds("1*1")


def test_filter_tables(spark, tmp_path):
    row = lambda name, k: (name, "simple", k, 1, 0, 1, 16, 16, 3)
    filters = spark.createDataFrame([row("a", 15), row("b", 15)], filter_tables.SCHEMA)
    bits = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "filter string, pos long")
    filter_tables.save(filters, bits, str(tmp_path / "f"))
    got, back = filter_tables.load(spark, str(tmp_path / "f"))
    assert got.count() == 2 and sorted((r["filter"], r["pos"]) for r in back.collect()) == [("a", 1), ("a", 3), ("b", 5)]
    assert back.where("filter = 'b'").count() == 1 and filter_tables.like(got, "a")["k"] == 15
    filter_tables.save(spark.createDataFrame([row("c", 14)], filter_tables.SCHEMA), bits.limit(0), str(tmp_path / "f"))
    with pytest.raises(ValueError, match="differ in k"):
        filter_tables.load(spark, str(tmp_path / "f"))
    lines = spark.createDataFrame([(0, "0.0000 0.1875"), (1, "0.1875 0.0000")], "line_no int, value string")
    assert {(r["i"], r["j"]): r["dist"] for r in filter_tables.parse_matrix(lines).collect()}[0, 1] == 0.1875
    reads = spark.createDataFrame([(i, "A") for i in range(9)], "read_ix long, seq string")
    assert [r["read_ix"] for r in sequence_files.first_reads(reads, 3).collect()] == [0, 1, 2]


def _canonical_words(text, seed):
    """The window or its reverse, whichever is smaller, at the seed's 1 positions."""
    k, other = len(seed), str.maketrans("ACGT", "TGCA")
    for i in range(len(text) - k + 1):
        w = text[i : i + k]
        yield windows.at_seed(min(w, w.translate(other)[::-1]), seed)


@pytest.mark.parametrize("seed", ["11111" + "0" * 30 + "11111", "1" * 20 + "0" * 50 + "1" * 11, "111111001111111"])
def test_windows_of_any_length_as_numbers(seed):
    """windows of more than 31 bases have packed q-grams too, palindromes among them."""
    rng = random.Random(len(seed))
    text = "".join(rng.choice("ACGT") for _ in range(300))
    text += text[-60:].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    got = windows.canonical(windows.codes_of(np.frombuffer(text.encode(), np.uint8)), np.arange(len(text) - len(seed) + 1), seed)
    assert got.tolist() == [int(w.translate(str.maketrans("ACGT", "0123")), 4) for w in _canonical_words(text, seed)]


def test_odd_windows_as_numbers():
    """small letters count as capitals where they are hashed, not where windows are compared."""
    rng, seed = random.Random(3), "111111001111111"
    data = np.frombuffer("".join(rng.choice("ACGTACGTacgtN") for _ in range(3000)).encode(), np.uint8)
    at = np.arange(len(data) - 14)
    want = hashing.hash_words(pa.array([windows.at_seed(w, seed) for w in windows.odd_words(data, at, 15)]), 13)
    code = windows.odd_codes(data, at, seed)
    assert ((code < 0) == (want == 0)).all() and (code >= 0).any() and (code < 0).any()
    assert (windows.hashes(code[code >= 0], 13) == want[code >= 0]).all()


def test_qgrams_are_added_up_across_batches(spark, monkeypatch):
    """a task gives a q-gram of a key out once for ADDED windows, whatever batches they came in."""
    text = "ACGTTGCAGGTCATCGA" * 3
    rows = spark.createDataFrame([(k, text) for k in ("a", "b") * 40], "key string, seq string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        hashed = sketches.qgram_hashes(rows, F.col("key"), F.col("seq"), ["1101011"])
        found = {(r["key"], r["hash"]): r["n"] for r in hashed.collect()}
        assert len(found) == hashed.count() and sum(found.values()) == 80 * (len(text) - 6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
