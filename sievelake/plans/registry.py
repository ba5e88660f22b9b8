"""Named queries over the input tables, with the SQL that must give the same rows.

Two mappings are used. Integer sets: a filter per supplier (or line number) with
the parts it has lines of, orders as reads. Texts: letters as nucleotides,
documents as genomes (by source or language), benchmark passages as reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import hashing, names, sequences
from sievelake.operators import bitmaps, containment, distances, graphs, identify, reports, sketches, trees
from sievelake.plans import sql
from sievelake.sources import filter_tables, sequence_files, topology
from sievelake.workspace import numbered, scratch, table, written

BITS, SEEDS, MODULUS = sql.BITS, ["111111001111111"], sql.MODULUS
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


# ---- inputs -------------------------------------------------------------


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("pos", F.col("l_partkey") % BITS)


def supplier_bits(spark, d):
    return bitmaps.of(lines(spark, d), F.col("l_suppkey"), F.col("pos"))


def supplier_sizes(spark, d):
    return lines(spark, d).groupBy(F.col("l_suppkey").alias("filter")).agg(F.count(F.lit(1)).alias("set_size"))


def order_probes(spark, d):
    return containment.bags(lines(spark, d), F.col("l_orderkey"), F.col("pos"))


def two_vectors(spark, d):
    """Two bit vectors per line number: parts bought in small numbers, parts with a discount."""
    rows = lines(spark, d)
    key = F.col("l_linenumber")
    return bitmaps.of(rows.where("l_quantity < 25"), key, F.col("pos")), bitmaps.of(rows.where("l_discount >= 0.05"), key, F.col("pos")), rows.select(key.alias("filter"))


def texts(spark, d, name: str, key: str) -> DataFrame:
    return table(spark, d, name).where("text IS NOT NULL").select(F.col(key).alias("key"), sequences.as_nucleotides(F.col("text")).alias("seq"))


def bags(rows: DataFrame, seeds=SEEDS) -> DataFrame:
    return sketches.qgram_bags(rows, F.col("key"), F.col("seq"), seeds, MODULUS)


def supplier_tree(spark, d) -> DataFrame:
    """Topology lines: root, regions, nations, suppliers, those with suppliers."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "n_nationkey", "s_suppkey")
    none = F.lit(-1)
    rows = s.select(F.struct(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), F.col("s_suppkey").alias("s")).alias("p"), F.lit(3).alias("depth"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("node"))
    rows = rows.union(s.select(F.struct("n_regionkey", "n_nationkey", none.cast("long")), F.lit(2), F.concat(F.lit("N"), F.col("n_nationkey"))).distinct())
    rows = rows.union(s.select(F.struct("n_regionkey", none, none.cast("long")), F.lit(1), F.concat(F.lit("R"), F.col("n_regionkey"))).distinct())
    rows = rows.union(spark.range(1).select(F.struct(none, none, none.cast("long")), F.lit(0), F.lit("root")))
    return numbered(rows, "line_no", F.col("p")).select(F.lit("tree").alias("source"), F.col("line_no").cast("int").alias("line_no"), F.concat(F.repeat(F.lit("*"), F.col("depth")), F.col("node"), F.lit(".bf")).alias("value"))


def tree(spark, d):
    """Nodes, leaf bits, and each node's union with what all its leaves share."""
    nodes = written(topology.parse(supplier_tree(spark, d)), "tree-nodes")
    bits = supplier_bits(spark, d).select(F.concat(F.lit("S"), F.col("filter")).alias("filter"), "pos")
    return nodes, bits, written(trees.cup_and_cap(nodes, bits), "tree-sets")


def region_matches(spark, d) -> DataFrame:
    """read (order), strain (region), hits, total, frac: the share of an order's lines that a region's suppliers have."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("strain"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    found = rows.join(s, "l_suppkey").groupBy(F.col("l_orderkey").alias("read"), "strain").agg(F.count(F.lit(1)).alias("hits"))
    total = rows.groupBy(F.col("l_orderkey").alias("read")).agg(F.count(F.lit(1)).alias("total"))
    return found.join(total, "read").select("read", "strain", "hits", "total", sequences.fraction(F.col("hits"), F.col("total")).alias("frac"))


# ---- sequences ----------------------------------------------------------


@query(sql.CLASSIFY_READS)
def classify_reads(spark, d):
    """Benchmark passages against the documents of each source, by spaced-seed q-grams."""
    genomes, _ = sketches.filters_of(bags(texts(spark, d, "documents", "source")))
    reads = bags(texts(spark, d, "benchmark", "item_id")).withColumnRenamed("key", "read")
    found = containment.matches(reads, genomes, 0.5)
    return containment.ranked(found).select("read", "filter", "hits", "total", "frac", F.col("place").cast("long").alias("place"))


@query(sql.QGRAMS)
def spaced_qgrams(spark, d):
    return sketches.qgram_counts(texts(spark, d, "documents", "lang"), F.col("key"), F.col("seq"), SEEDS).withColumnRenamed("key", "lang")


@query(sql.MULTI_SEED)
def multi_seed_qgrams(spark, d):
    return sketches.qgram_counts(texts(spark, d, "documents", "lang"), F.col("key"), F.col("seq"), ["1101011", "1110111"]).withColumnRenamed("key", "lang")


@query(sql.READ_QGRAMS)
def read_qgram_filter(spark, d):
    """Positions of reads with small letters and Ns: q-grams with other characters than ACGT of either case hit position 0."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("lang").alias("key"), sequences.as_reads(F.col("text")).alias("seq"))
    return bags(rows).select(F.col("key").alias("lang"), "pos", "n")


@query(sql.READ_KMERS)
def read_kmer_counts(spark, d):
    """Canonical words of reads with small letters and Ns, which start the run anew."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(sequences.as_reads(F.col("text")).alias("seq"))
    return sketches.kmer_counts(rows, F.col("seq"), 9)


@query(sql.IUPAC)
def iupac_complements(spark, d):
    """Reverse complements of letters as nucleotide codes, both cases."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))
    return rows.select("doc_id", F.md5(sequences.reverse_complement(F.col("seq"))).alias("plain"), F.md5(sequences.reverse_complement(F.col("seq"), iupac=True)).alias("iupac"))


def hashed_qgrams(spark, d):
    return sketches.qgram_hashes(texts(spark, d, "documents", "source"), F.col("key"), F.col("seq"), SEEDS)


@query(sql.QGRAM_UNION)
def qgram_union_filter(spark, d):
    """The union of the sources' filters, in twice as many bits as they have."""
    return sketches.union_filter(hashed_qgrams(spark, d), 2 * MODULUS)


@query(sql.QGRAM_INTERSECTION)
def qgram_intersection_filter(spark, d):
    """What the filters of all sources share, in a modulus of its own."""
    return sketches.intersection_filter(hashed_qgrams(spark, d), 3_000_017)


@query(sql.FILTER_STATS)
def filter_stats(spark, d):
    """Per source: q-grams added, bits set, false-positive rate."""
    of_each = bags(texts(spark, d, "documents", "source")).groupBy(F.col("key").alias("filter"))
    sizes = of_each.agg(F.sum("n").cast("long").alias("set_size"), F.count(F.lit(1)).alias("ones")).where("filter IS NOT NULL")
    return sizes.select("filter", "set_size", "ones", F.round(sequences.false_positive_rate(F.lit(MODULUS), F.col("set_size")), 6).alias("fp_rate"))


@query(sql.CANONICAL_KMERS)
def canonical_kmer_counts(spark, d):
    return sketches.kmer_counts(texts(spark, d, "documents", "doc_id"), F.col("seq"), 11, 3)


@query()
def kmer_filter_membership(spark, d):
    """k-mers of the benchmark in a two-hash filter of the documents' k-mers."""
    bits = sketches.kmer_filter(sketches.kmer_counts(texts(spark, d, "documents", "doc_id"), F.col("seq"), 15), 15, 1 << 26, 1 << 26, 2)
    return sketches.contains(sketches.kmer_counts(texts(spark, d, "benchmark", "item_id"), F.col("seq"), 15), bits, 15, 1 << 26, 2)


@query(sql.KMER_LIST)
def kmer_list_filter(spark, d):
    """A filter from a k-mer list: all words of 12 of the documents, what follows on the line ignored."""
    words = sketches.kmer_counts(texts(spark, d, "documents", "doc_id"), F.col("seq"), 12, canonical=False)
    lines_of = words.select(F.concat("kmer", F.lit(" "), F.col("n").cast("string")).alias("line"))
    listed = sequence_files.kmer_list(lines_of, "line", 12)
    return listed.groupBy(hashing.position(F.col("kmer"), 12, MODULUS).alias("pos")).agg(F.count(F.lit(1)).alias("kmers"))


@query(sql.REVCOMP)
def reverse_complements(spark, d):
    rows = texts(spark, d, "documents", "doc_id")
    return rows.select(F.col("key").alias("doc_id"), F.md5(sequences.reverse_complement(F.col("seq"))).alias("plain"), F.md5(sequences.reverse_complement(F.lower("seq"), iupac=True)).alias("iupac"))


@query(sql.STRANDS)
def strand_symmetric_hashes(spark, d):
    """Words whose two-strand hash differs from that of their reverse complement: none."""
    return sketches.strand_agreement(texts(spark, d, "documents", "doc_id"), F.col("seq"), 21)


def with_quality(spark, d) -> DataFrame:
    """Documents as reads: quality characters follow the letters of the text."""
    letters = "ACGT"
    return texts(spark, d, "documents", "doc_id").select(F.col("key").alias("read"), "seq", F.translate("seq", letters, "+5?I").alias("qual"))


@query(sql.READ_FILTER)
def read_quality_filter(spark, d):
    reads = with_quality(spark, d)
    kept = reads.where(sequences.keeps_read(F.col("seq"), F.col("qual"), 14.5, 500))
    return kept.select("read", F.char_length("seq").cast("long").alias("length"), F.round(sequences.read_quality(F.col("qual")), 4).alias("quality"))


@query(sql.READ_FILTER_LINES)
def read_quality_filter_lines(spark, d):
    """The published form: a line end counts as one more base, in length and quality."""
    reads = with_quality(spark, d)
    kept = reads.where(sequences.keeps_read(F.col("seq"), F.col("qual"), 6, 500, newline=True))
    return kept.select("read", F.char_length("seq").cast("long").alias("length"), F.round(sequences.read_quality(F.col("qual"), newline=True), 4).alias("quality"))


@query(sql.FASTA)
def fasta_records(spark, d):
    """Documents written as FASTA, two lines a sequence and a mark within the header, and read again."""
    path = scratch(spark, "fasta")
    half = F.floor(F.length("seq") / 2).cast("int")
    rows = texts(spark, d, "documents", "doc_id").where("length(seq) > 1")
    text = F.concat(F.lit(">doc"), F.col("key").cast("string"), F.lit(" a->b >c\n"), F.col("seq").substr(F.lit(1), half), F.lit("\r\n"), F.expr("substring(seq, int(floor(length(seq) / 2)) + 1)"))
    rows.select(text.alias("value")).write.text(path)
    return sequence_files.query_sequences(spark, path).select("name", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("digest"))


@query(sql.FASTQ)
def fastq_records(spark, d):
    """Documents written as FASTQ, with quality lines that start with any code, '@' and '+' among them, and read again."""
    path = scratch(spark, "fastq")
    rows = texts(spark, d, "documents", "doc_id").where("length(seq) > 1")
    qual = F.concat(F.element_at(F.array(*map(F.lit, "@+>5")), (F.col("key") % 4 + 1).cast("int")), F.translate(F.expr("substring(seq, 2)"), "ACGT", "@+>5"))
    text = F.concat(F.lit("@r"), F.col("key").cast("string"), F.lit(" x\n"), F.col("seq"), F.lit("\n+\n"), qual)
    rows.select(text.alias("value")).write.text(path)
    return sequence_files.fastq(spark, path).select("name", F.md5("seq").alias("digest"), F.md5("qual").alias("quality"))


@query(sql.FASTQ)
def fastq_layouts(spark, d):
    """The same records in other layouts: lines of 60 characters, and an empty line after each, as the published read filter writes them."""
    path = scratch(spark, "fastq")
    rows = texts(spark, d, "documents", "doc_id").where("length(seq) > 1")
    qual = F.concat(F.element_at(F.array(*map(F.lit, "@+>5")), (F.col("key") % 4 + 1).cast("int")), F.translate(F.expr("substring(seq, 2)"), "ACGT", "@+>5"))
    cut = lambda c: F.when(F.col("key") % 2 == 0, F.regexp_replace(c, "(.{60})", "$1\n")).otherwise(c)
    gap = F.when(F.col("key") % 3 == 0, "\n\n").otherwise("\n")
    text = F.concat(F.lit("@r"), F.col("key").cast("string"), F.lit("\tx y"), gap, cut(F.col("seq")), gap, F.lit("+"), gap, cut(qual), F.when(F.col("key") % 3 == 0, "\n").otherwise(""))
    rows.select(text.alias("value")).write.text(path)
    return sequence_files.fastq(spark, path, block_bytes=1 << 20).select("name", F.md5("seq").alias("digest"), F.md5("qual").alias("quality"))


@query(sql.LONG_SEED)
def long_seed_qgrams(spark, d):
    """Q-grams under a seed of 40 characters, as many as letters repeat in the documents at all."""
    found = sketches.qgram_counts(texts(spark, d, "documents", "lang"), F.col("key"), F.col("seq"), ["11111" + "0" * 30 + "11111"])
    return found.withColumnRenamed("key", "lang")


@query(sql.FIRST_READS)
def first_reads(spark, d):
    """The first 50 reads, by number: the reading limit of a query."""
    reads = with_quality(spark, d).select(F.col("read").alias("read_ix"), F.char_length("seq").cast("long").alias("length"))
    return sequence_files.first_reads(reads, 50)


@query(sql.LIST_LINES)
def list_file_lines(spark, d):
    """Orders as list files, one for each priority, empty lines in between: the lines' numbers when read again."""
    path = scratch(spark, "lists")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").substr(1, 1).alias("list"), "o_orderkey")
    value = F.concat("list", F.lit(":"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "\n").otherwise(""))
    rows.repartition("list").sortWithinPartitions("list", "o_orderkey").select("list", value.alias("value")).write.partitionBy("list").text(path)
    found = sequence_files.lines(spark, f"{path}/*")
    return found.select(F.split("value", ":")[0].alias("list"), F.split("value", ":")[1].cast("long").alias("o_orderkey"), F.col("line_no").cast("long").alias("line_no"))


@query(sql.FILTER_TABLES)
def filter_tables_read_again(spark, d):
    """Suppliers' filters written with their parameters, checked and read again: parameters and bits."""
    path = scratch(spark, "filters")
    bits = supplier_bits(spark, d)
    sizes = supplier_sizes(spark, d).select(F.col("filter").cast("string").alias("filter"), F.lit("set").alias("kind"), F.lit(1).alias("k"), F.lit(1).alias("num_hashes"), F.lit(0).cast("long").alias("seed1"), F.lit(0).cast("long").alias("seed2"), F.lit(BITS).cast("long").alias("modulus"), F.lit(BITS).cast("long").alias("num_bits"), "set_size")
    filter_tables.save(sizes, bits.withColumn("filter", F.col("filter").cast("string")), path)
    filters, found = filter_tables.load(spark, path)
    ones = found.groupBy("filter").agg(F.count(F.lit(1)).alias("ones"), F.sum("pos").alias("positions"))
    return filters.join(ones, "filter").select(F.col("filter").cast("long").alias("filter"), "modulus", F.col("set_size").cast("long").alias("set_size"), "ones", "positions")


@query(sql.LENGTH_FALLBACK)
def length_fallback(spark, d):
    """Lengths of suppliers by names with underscores; those of odd number are listed under dashes."""
    counted = lines(spark, d).groupBy(F.col("l_suppkey").alias("s")).agg(F.count(F.lit(1)).alias("length")).where("s % 7 <> 0")
    listed = counted.select(F.concat(F.lit("strain"), F.when(F.col("s") % 2 == 1, "-").otherwise("_"), F.col("s").cast("string")).alias("strain"), "length")
    strains = table(spark, d, "supplier").select(F.concat(F.lit("strain_"), F.col("s_suppkey").cast("string")).alias("strain"))
    return identify.lengths_of(strains, listed)


@query(sql.READ_SUMMARY)
def read_filter_summary(spark, d):
    reads = with_quality(spark, d)
    return reports.read_summary(reads, reads.where(sequences.keeps_read(F.col("seq"), F.col("qual"), 14.5, 500)))


@query(sql.READ_SUMMARY_LINES)
def read_filter_summary_lines(spark, d):
    """The summary in its published form: a line end counts as one more base."""
    reads = with_quality(spark, d)
    return reports.read_summary(reads, reads.where(sequences.keeps_read(F.col("seq"), F.col("qual"), 6, 500, newline=True)), newline=True)


@query(sql.LENGTHS)
def sequence_length(spark, d):
    return reports.sequence_lengths(texts(spark, d, "documents", "source").withColumnRenamed("key", "strain"))


@query(sql.BLOOM_SIZE)
def bloom_size(spark, d):
    lengths = reports.sequence_lengths(texts(spark, d, "documents", "source").withColumnRenamed("key", "strain"))
    longest = lengths.agg(F.greatest(F.max("length") - (len(SEEDS[0]) - 1), F.lit(0)).alias("max_length"))
    return longest.select("max_length", sequences.optimal_bits(F.col("max_length")).alias("num_bits"))


@query(sql.NAME_RULES)
def name_rules(spark, d):
    """Names of parts as file names, under each rule."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.element_at(F.array(*map(F.lit, [".fna.bf", ".fasta.detbrief.rrr.bf", ".bf", "_.fna"])), (F.col("p_partkey") % 4 + 1).cast("int")))
    rows = table(spark, d, "part").select("p_partkey", name.alias("file"))
    f = F.col("file")
    return rows.select("p_partkey", names.strip_filter_suffix(f).alias("filter_name"), names.matrix_name(f).alias("matrix_name"), names.identification_name(f).alias("ident_name"), names.abundance_name(f).alias("em_name"), names.without_two_parts(f).alias("clean_name"), names.without_last_part(f).alias("length_name"), names.genome_file(f).alias("is_genome"), names.dashed(f).alias("dashed"))


# ---- filters and bit vectors --------------------------------------------


@query(sql.FILTER_UNION)
def filter_union(spark, d):
    return sketches.union_filter(supplier_bits(spark, d).select(F.col("filter").alias("key"), F.col("pos").alias("hash")), 4096)


@query(sql.FILTER_INTERSECT)
def filter_intersect(spark, d):
    rows = lines(spark, d)
    return sketches.intersection_filter(rows.select(F.col("l_linenumber").alias("key"), F.col("pos").alias("hash")), 4096)


@query(sql.BINARY["and"])
def bit_and(spark, d):
    a, b, _ = two_vectors(spark, d)
    return bitmaps.and_(a, b)


@query(sql.BINARY["or"])
def bit_or(spark, d):
    a, b, _ = two_vectors(spark, d)
    return bitmaps.or_(a, b)


@query(sql.BINARY["xor"])
def bit_xor(spark, d):
    a, b, _ = two_vectors(spark, d)
    return bitmaps.xor(a, b)


@query(sql.BINARY["mask"])
def bit_mask(spark, d):
    a, b, _ = two_vectors(spark, d)
    return bitmaps.mask(a, b)


@query(sql.BINARY["not"])
def bit_not(spark, d):
    a, _, filters = two_vectors(spark, d)
    return bitmaps.not_(a, filters, BITS)


@query(sql.BINARY["eq"])
def bit_eq(spark, d):
    return bitmaps.eq(*two_vectors(spark, d), BITS)


@query(sql.BINARY["ornot"])
def bit_ornot(spark, d):
    return bitmaps.or_not(*two_vectors(spark, d), BITS)


@query(sql.SQUEEZE)
def bit_squeeze(spark, d):
    a, b, _ = two_vectors(spark, d)
    return bitmaps.squeeze(a, b)


@query(sql.BINARY["and"])
def bit_unsqueeze(spark, d):
    """Squeezing and its inverse leave what both vectors have."""
    a, b, _ = two_vectors(spark, d)
    return bitmaps.unsqueeze(bitmaps.squeeze(a, b), b)


@query(sql.RANKS)
def rank_select(spark, d):
    a, _, filters = two_vectors(spark, d)
    zero = bitmaps.select0(a, filters, BITS).groupBy("filter").agg(F.max_by("pos", "i").alias("last_clear"), F.count(F.lit(1)).alias("clear"))
    return bitmaps.ranks(a).join(zero, "filter").select("filter", "pos", "rank", "clear", "last_clear")


@query(sql.PAIR_COUNTS)
def bit_counts(spark, d):
    a, b, _ = two_vectors(spark, d)
    return bitmaps.pair_counts(a, b)


@query(sql.DENSITY)
def filter_density(spark, d):
    return bitmaps.density(supplier_bits(spark, d), BITS)


@query(sql.INTEGERS)
def filter_integers(spark, d):
    return bitmaps.integers(supplier_bits(spark, d))


@query(sql.KINDS)
def filter_kinds(spark, d):
    bits = supplier_bits(spark, d)
    return bitmaps.kinds(bits, table(spark, d, "supplier").select(F.col("s_suppkey").alias("filter")), BITS)


@query(sql.PACKED)
def packed_union_sizes(spark, d):
    """Bits of the suppliers' filters by nation, on bitmaps."""
    rows = lines(spark, d).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    maps = bitmaps.packed(bitmaps.of(rows, F.struct("s_nationkey", "l_suppkey"), F.col("pos")))
    return bitmaps.packed_sizes(bitmaps.packed_or(maps, F.col("filter.s_nationkey")))


@query(sql.CHECKSUMS)
def bit_checksums(spark, d):
    return bitmaps.checksums(bitmaps.packed(supplier_bits(spark, d)), BITS)


@query(sql.EXACTLY)
def exact_random_vectors(spark, d):
    """1,000 random bits for each supplier's filter, and whether all lie within it."""
    drawn = bitmaps.random_exactly(supplier_bits(spark, d), BITS, 1000, seed=5)
    return drawn.groupBy("filter").agg(F.count_distinct("pos").alias("ones"), (F.max("pos") < BITS).alias("inside"))


@query()
def random_vectors(spark, d):
    """As many random bits per supplier as its filter has, and how many of them it shares."""
    bits = supplier_bits(spark, d)
    drawn = bitmaps.random_bits(bits, BITS, 0.1, seed=7)
    return bitmaps.pair_counts(bits, drawn)


@query(sql.LOAD_TEST)
def load_test(spark, d):
    """Order lines as lookups in the first vector of their line number: ones and zeros found."""
    a, _, _ = two_vectors(spark, d)
    probes = lines(spark, d).select(F.col("l_linenumber").alias("filter"), "pos")
    return probes.join(a.withColumn("one", F.lit(1)), ["filter", "pos"], "left").groupBy("filter").agg(F.count("one").alias("ones"), F.count_if(F.col("one").isNull()).alias("zeros"))


@query(sql.CONSISTENT)
def filter_consistency(spark, d):
    """Line numbers of orders as filter parameters: those that differ between orders' priorities."""
    rows = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_orderstatus").alias("kinds"), F.count(F.lit(1)).alias("set_size"))
    return sketches.consistent(rows, ["kinds", "set_size"])


# ---- containment --------------------------------------------------------


@query(sql.CLASSIFY_SETS)
def classify_sets(spark, d):
    return containment.matches(order_probes(spark, d), supplier_bits(spark, d), 0.5)


@query(sql.CLASSIFY_DISTINCT)
def classify_sets_distinct(spark, d):
    return containment.matches(order_probes(spark, d), supplier_bits(spark, d), 0.5, distinct=True)


@query(sql.FILE_THRESHOLDS)
def classify_by_file(spark, d):
    """Orders as reads of three query files, each with a threshold of its own."""
    probes = order_probes(spark, d)
    thresholds = probes.select("read").distinct().withColumn("theta", F.element_at(F.array(*map(F.lit, sql.THETAS)), (F.col("read") % 3 + 1).cast("int")))
    return containment.matches(probes, supplier_bits(spark, d), thresholds)


@query(sql.JUST_COUNT)
def just_count(spark, d):
    return containment.totals(order_probes(spark, d)).select("read", F.col("total").cast("long").alias("total"))


def nation_bits(spark, d):
    rows = lines(spark, d).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return bitmaps.of(rows.where("l_returnflag = 'R'"), F.col("s_nationkey"), F.col("pos"))


@query(sql.COUNT_ALL)
def count_all_hits(spark, d):
    bits = nation_bits(spark, d)
    return containment.all_counts(order_probes(spark, d), bits, bits, 0.5).select("read", "filter", F.col("hits").cast("long").alias("hits"), F.col("total").cast("long").alias("total"), "passed")


@query(sql.MATCH_COUNTS)
def match_counts(spark, d):
    probes = order_probes(spark, d)
    return containment.match_counts(containment.matches(probes, supplier_bits(spark, d), 0.5), probes)


@query(sql.ADJUSTED)
def adjusted_hits(spark, d):
    found = containment.matches(order_probes(spark, d), supplier_bits(spark, d), 0.5)
    ranked = containment.ranked(containment.adjusted(found, supplier_sizes(spark, d), BITS), "adjusted")
    return ranked.select("read", "filter", "hits", "total", "adjusted", F.col("place").cast("long").alias("place"))


@query(sql.PRESENT)
def querybf_present(spark, d):
    a, _, _ = two_vectors(spark, d)
    return containment.presence(order_probes(spark, d), a).groupBy("read", "filter").agg(F.count(F.lit(1)).alias("present"))


@query(sql.ALL_STATES)
def querybf_all(spark, d):
    a, _, _ = two_vectors(spark, d)
    return containment.presence(order_probes(spark, d), a, a).groupBy("read", "filter", "state").agg(F.count(F.lit(1)).alias("n"))


@query(sql.RESULT_TEXT)
def result_text(spark, d):
    probes = order_probes(spark, d)
    return sequence_files.render_results(containment.matches(probes, supplier_bits(spark, d), 0.5).withColumn("leaf", F.col("filter").cast("string")), probes)


@query(sql.CLASSIFY_SETS)
def result_text_parsed(spark, d):
    """The text form read back gives the matches again."""
    path = scratch(spark, "results")
    result_text(spark, d).select(F.col("text").alias("value")).write.text(path)
    text = spark.read.option("lineSep", "\n*").text(path).select(F.lit("results").alias("source"), F.concat(F.lit("*"), F.ltrim(F.col("value"), F.lit("*"))).alias("value"))
    back = sequence_files.query_results(text)
    return back.select(F.col("read").cast("long").alias("read"), F.col("leaf").cast("long").alias("filter"), "hits", "total", "frac")


# ---- distances and graphs -----------------------------------------------


def pair_sizes(spark, d):
    bits = supplier_bits(spark, d)
    return distances.pair_sizes(bits, bits), bits


def rounded(dist):
    return dist.withColumn("dist", F.round("dist", 6))


@query(sql.DISTANCE["hamming"])
def hamming_matrix(spark, d):
    return rounded(distances.hamming(pair_sizes(spark, d)[0], BITS))


@query(sql.DISTANCE["intersect"])
def distance_intersect(spark, d):
    return rounded(distances.intersection(pair_sizes(spark, d)[0], BITS))


@query(sql.DISTANCE["union"])
def distance_union(spark, d):
    return rounded(distances.union(pair_sizes(spark, d)[0], BITS))


@query(sql.THETA)
def distance_theta(spark, d):
    return distances.theta(pair_sizes(spark, d)[0])


@query(sql.INTERVAL)
def hamming_interval(spark, d):
    bits = supplier_bits(spark, d)
    return rounded(distances.hamming(distances.pair_sizes(distances.within(bits, 64, 1024), bits), 960))


def close_suppliers(spark, d):
    """Pairs that are little farther apart than the closest one."""
    bits = written(supplier_bits(spark, d), "supplier-bits")
    return distances.nearly_closest(bits, bits, sql.CLOSE, BITS).select("i", "j")


@query(sql.EDGES)
def distance_edges(spark, d):
    return close_suppliers(spark, d)


@query(sql.ADJACENCY)
def distance_adjacency(spark, d):
    return distances.adjacency(close_suppliers(spark, d))


@query(sql.DOT)
def distance_dot(spark, d):
    return distances.dot(close_suppliers(spark, d))


@query(sql.MATRIX)
def distance_matrix_text(spark, d):
    bits = supplier_bits(spark, d)
    return distances.matrix_of(bits, bits, BITS)


@query(sql.HISTOGRAM)
def distance_histogram(spark, d):
    pairs, bits = pair_sizes(spark, d)
    return distances.histogram(distances.hamming(pairs, BITS), bits)


def merged(spark, d):
    return graphs.components(close_suppliers(spark, d).select(F.col("i").alias("a"), F.col("j").alias("b")))


@query(sql.COMPONENTS)
def merge_components(spark, d):
    return merged(spark, d)


@query(sql.MERGED)
def merged_filters(spark, d):
    groups = written(merged(spark, d), "merged")
    sizes = graphs.merged_bits(supplier_bits(spark, d), groups).groupBy("root").agg(F.count(F.lit(1)).alias("ones"))
    return graphs.merged_names(groups).join(sizes, "root")


@query(sql.MERGED_LENGTHS)
def merged_lengths(spark, d):
    lengths = lines(spark, d).groupBy(F.col("l_suppkey").alias("strain")).agg(F.count(F.lit(1)).alias("length"))
    return graphs.merged_lengths(graphs.merged_names(merged(spark, d)), lengths)


@query(sql.SUPERSEDED)
def clean_merge(spark, d):
    filters = table(spark, d, "supplier").select(F.col("s_suppkey").alias("filter"))
    return graphs.superseded(filters, graphs.merged_names(merged(spark, d)))


@query(sql.CLIQUES)
def maximal_cliques(spark, d):
    near = close_suppliers(spark, d).select(F.col("i").alias("a"), F.col("j").alias("b"))
    return graphs.maximal_cliques(near).select(F.array_join(F.transform("clique", lambda c: c.cast("string")), "_").alias("clique"), F.size("clique").alias("members"))


@query()
def disjoint_cliques(spark, d):
    """Groups of close suppliers that no supplier shares, by density of links and smallest cuts."""
    near = close_suppliers(spark, d).select(F.col("i").alias("a"), F.col("j").alias("b"))
    return graphs.disjoint_cliques(near).select(F.array_join(F.transform("clique", lambda c: c.cast("string")), "_").alias("clique"), F.size("clique").alias("members"))


def merged_by_cliques(spark, d):
    near = close_suppliers(spark, d).select(F.col("i").alias("a"), F.col("j").alias("b"))
    return written(graphs.clique_groups(graphs.disjoint_cliques(near)), "merged-cliques")


@query()
def merged_clique_filters(spark, d):
    """The published merging: a filter per final clique, named by its members, in bits and mean length."""
    groups = merged_by_cliques(spark, d)
    names_of = graphs.merged_names(groups)
    sizes = graphs.merged_bits(supplier_bits(spark, d), groups).groupBy("root").agg(F.count(F.lit(1)).alias("ones"))
    lengths = lines(spark, d).groupBy(F.col("l_suppkey").alias("strain")).agg(F.count(F.lit(1)).alias("length"))
    return names_of.join(sizes, "root").join(graphs.merged_lengths(names_of, lengths), "name")


@query()
def clique_superseded(spark, d):
    """The filters that stay beside those merged by clique."""
    filters = table(spark, d, "supplier").select(F.col("s_suppkey").alias("filter"))
    return graphs.superseded(filters, graphs.merged_names(merged_by_cliques(spark, d)))


# ---- trees --------------------------------------------------------------


@query(sql.TREE_NODES)
def tree_topology_parse(spark, d):
    return topology.parse(supplier_tree(spark, d)).select("node", "file", F.col("depth").cast("long").alias("depth"), F.col("preorder").cast("long").alias("preorder"), "parent", "is_leaf")


@query(sql.TREE_TEXT)
def tree_topology_text(spark, d):
    return topology.render(topology.parse(supplier_tree(spark, d)), "both").select(F.col("preorder").cast("long").alias("preorder"), "line")


@query(sql.SIBLINGS)
def tree_siblings_packed(spark, d):
    return topology.siblings_packed(topology.parse(supplier_tree(spark, d)))


@query(sql.TREE["union"])
def build_union(spark, d):
    return trees.build_union(tree(spark, d)[2])


@query(sql.TREE["intersection"])
def build_intersection(spark, d):
    return trees.build_intersection(tree(spark, d)[2])


@query(sql.TREE["allsome"])
def build_allsome(spark, d):
    nodes, _, sets = tree(spark, d)
    return trees.build_allsome(nodes, sets)


@query(sql.TREE["determined"])
def build_determined(spark, d):
    nodes, _, sets = tree(spark, d)
    return trees.build_determined(nodes, sets)


@query(sql.TREE["brief"])
def build_determined_brief(spark, d):
    nodes, _, sets = tree(spark, d)
    return trees.squeezed(nodes, sets)


@query(sql.NODE_STATS)
def node_stats(spark, d):
    nodes, _, sets = tree(spark, d)
    sizes = supplier_sizes(spark, d).select(F.concat(F.lit("S"), F.col("filter")).alias("node"), F.col("set_size").alias("items"))
    stats = trees.node_stats(nodes, sets.select("node", "pos"), BITS, sizes)
    return stats.withColumns({"depth": F.col("depth").cast("long"), "height": F.col("height").cast("long"), "fp_rate": F.round("fp_rate", 6)})


@query(sql.BIT_STATS)
def bit_stats(spark, d):
    nodes, _, sets = tree(spark, d)
    return trees.bit_stats(trees.build_determined(nodes, sets), sets, nodes).withColumn("s_x", F.round("s_x", 6))


@query(sql.RATIOS)
def determined_ratios(spark, d):
    nodes, _, sets = tree(spark, d)
    return trees.determined_ratio(nodes, sets, BITS).withColumn("ratio", F.round("ratio", 6))


@query(sql.CULL)
def cull_nodes(spark, d):
    """Parents after the nodes are culled whose determined ratio is a deviation below the mean, or more."""
    nodes, _, sets = tree(spark, d)
    ratios = trees.determined_ratio(nodes, sets, BITS)
    return trees.cull(nodes, ratios, trees.culling_threshold(ratios, sql.DEVIATIONS))


@query(sql.ORDERS)
def culled_orders(spark, d):
    """Pre-order and post-order of the tree that is left after culling."""
    return trees.orders(cull_nodes(spark, d))


@query()
def cluster_build(spark, d):
    """Nodes of the clustered suppliers' tree, however deep: size of the union and of the intersection of the filters below."""
    bits = supplier_bits(spark, d).select(F.col("filter").cast("string").alias("filter"), "pos")
    nodes = trees.with_depth(cluster_tree(spark, d))
    sets = trees.cup_and_cap(nodes, bits)
    sizes = sets.groupBy("node").agg(F.count(F.lit(1)).alias("n_union"), F.count_if("in_cap").alias("n_intersection"))
    return nodes.join(sizes, "node", "left").select("node", "parent", F.col("depth").cast("long").alias("depth"), "is_leaf", F.coalesce("n_union", F.lit(0)).alias("n_union"), F.coalesce("n_intersection", F.lit(0)).alias("n_intersection"))


@query(sql.NUMBERED)
def node_numbers(spark, d):
    return trees.numbered(topology.parse(supplier_tree(spark, d)))


@query(sql.VALIDATE)
def validate_tree(spark, d):
    nodes, _, sets = tree(spark, d)
    return trees.violations(nodes, sets, sets.select("node", "pos"))


def tree_visits(spark, d):
    nodes, _, sets = tree(spark, d)
    probes = containment.bags(lines(spark, d), F.concat(F.col("l_orderkey").cast("string")), F.col("pos"))
    return trees.query(nodes, sets, written(probes, "tree-probes"), 0.5)


@query(sql.EXAMINED)
def nodes_examined(spark, d):
    return trees.nodes_examined(tree_visits(spark, d))


@query(sql.TREE_STATS)
def tree_query_stats(spark, d):
    return trees.query_stats(tree_visits(spark, d))


@query()
def cluster_tree(spark, d):
    return trees.cluster(supplier_bits(spark, d), first_bits=BITS)


# ---- identification -----------------------------------------------------


@query(sql.MATCH_MATRIX)
def match_matrix(spark, d):
    found = region_matches(spark, d)
    return identify.dense_matrix(found.select("read", "strain", "frac"), found, found)


@query(sql.RANKS_OF_READS)
def read_ranks(spark, d):
    return identify.rank_weights(region_matches(spark, d), 10, 3).select("read", "strain", "pct", F.col("weight").cast("long").alias("weight"))


@query(sql.AMBIGUOUS)
def ambiguous_reads(spark, d):
    return identify.ambiguous_reads(region_matches(spark, d), 10, 3)


@query(sql.MARGINAL)
def marginal_strains(spark, d):
    return identify.marginal(identify.rank_weights(region_matches(spark, d), 10, 3))


@query(sql.COVER)
def strain_cover(spark, d):
    return identify.cover(written(identify.rank_weights(region_matches(spark, d), 10, 3), "ranks"))


@query(sql.READ_SETS)
def read_signatures(spark, d):
    found = region_matches(spark, d)
    return identify.read_sets(found, found).select(F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "n")


def proportions(spark, d):
    found = written(region_matches(spark, d), "region-matches")
    lengths = found.groupBy("strain").agg(F.sum("hits").alias("length"))
    sets = identify.read_sets(found, found)
    return identify.abundance(sets, identify.lengths_of(found.select("strain").distinct(), lengths)), sets


def kept_regions(found):
    """The three regions of the most hits."""
    return found.groupBy("strain").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "strain").limit(3).select("strain")


@query(sql.KEPT_SETS)
def kept_signatures(spark, d):
    """Reads by what they match of the kept regions alone."""
    found = written(region_matches(spark, d), "region-matches")
    return identify.read_sets(found, kept_regions(found)).select(F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "n")


@query(sql.KEPT_ABUNDANCE)
def kept_abundance(spark, d):
    """Proportions of the kept regions alone."""
    found = written(region_matches(spark, d), "region-matches")
    kept = kept_regions(found)
    lengths = found.join(F.broadcast(kept), "strain", "left_semi").groupBy("strain").agg(F.sum("hits").alias("length"))
    return identify.abundance(identify.read_sets(found, kept), lengths).select("strain", "abundance")


@query(sql.ABUNDANCE)
def abundance_em(spark, d):
    return proportions(spark, d)[0].select("strain", "abundance")


@query(sql.LIKELIHOOD)
def abundance_likelihood(spark, d):
    found, sets = proportions(spark, d)
    return identify.log_likelihood(sets, found)


@query(sql.CLEAN)
def clean_results(spark, d):
    """Shares of regions in the order lines and of the merged pair of the first two, spelled out."""
    hits = region_matches(spark, d).groupBy("strain").agg(F.sum("hits").alias("hits"))
    merged = F.when(F.col("strain") < 2, F.concat(F.col("strain"), F.lit("_"), F.col("strain") + 1, F.lit("_"))).otherwise(F.concat(F.lit("region"), F.col("strain")))
    shares = hits.join(F.broadcast(hits.agg(F.sum("hits").alias("all")))).select(merged.alias("strain"), (F.col("hits") / F.col("all")).alias("abundance"))
    return reports.clean_results(shares, table(spark, d, "region").select(F.col("r_regionkey").alias("number"), F.col("r_name").alias("name")))
