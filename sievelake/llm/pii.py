r"""Personal data: patterns, and an information-theoretic sanitisation of the terms around them.

Base spans are the leftmost non-overlapping matches of four patterns (email, ip,
card, phone) that pass their checks. A term is a run of letters outside all base
spans. In a text with a protected entity, every term is a disclosure risk if the
corpus shows that it reveals the entity: with n_t, n_e and n_te the numbers of
rows that hold the term, the entity, and both, N that of all rows, p = n_e / N,

    PMI(e; t) = log2(q / p), q = (n_te + k p) / (n_t + k),   and   IC(e) = log2(1 / p),

a term with PMI >= alpha IC is generalised to "[TERM]" wherever it stands in the
texts that hold the entity. q is the share of the term's rows with the entity,
drawn towards p by ``prior`` = k = 1/2 rows, so a pair seen once is judged like
any other, with the doubt that one row leaves. A term that occurs nowhere else
and meets the entity in at least ``support`` different texts is removed instead.

All of it is DataFrame operations. Counts are partial aggregates, so a frequent
entity, term or text is no hot spot; what depends on a
text alone is worked out once for equal texts, and entities of the same texts
(most stand in one text only) are judged once together. The patterns below are rewritten with possessive quantifiers
and look-behinds that change no match but keep the matcher's time linear and its
stack flat on long runs.

Defined results: a null text is empty and has no spans; positions are code
points, ends exclusive; spans of different kinds may overlap, and sanitising
replaces what they cover together once; repeated rows give repeated results; an empty
table gives no rows. Texts may be very long and hold any number of spans: no span
copies the text or the spans before it. Other columns of ``docs`` travel packed in one,
so their names meet none of those here, and ``sanitise`` gives them back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.workspace import written

LOCAL = "[A-Za-z0-9._%+-]"
HOST = "[A-Za-z0-9-]"
# kind -> (pattern, cheap test that must hold for a text to have a match)
PATTERNS = {
    "email": (rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{HOST}++(?:\.{HOST}++)++", lambda t: F.contains(t, F.lit("@"))),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: F.regexp_like(t, F.lit(r"[0-9]\.[0-9]"))),
    # a run of fewer than 13 digits fails whatever part of it is taken
    "card": (r"[0-9](?:[\x20-]?[0-9]){12,}+", lambda t: F.regexp_like(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}"))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+"))),
}
SPAN = "struct<start:int,end:int,value:string>"
TERM = r"\p{L}{3,}"
OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"


RUN, CUT = 256, 1024


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op) -> Column:
    """op (sum or maximum) of each of an array of numbers and all before it, from 0. An append
    copies the array it makes longer, so RUN numbers at a time are gone through, from
    what all RUNs before come to."""
    nothing = F.array().cast("array<int>")

    def last(run: Column) -> Column:
        return F.aggregate(run, F.lit(0), op)

    def through(run: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), nothing.alias("out"))
        return F.aggregate(run, begin, lambda held, x: F.struct(op(held["at"], x).alias("at"), F.array_append(held["out"], op(held["at"], x)).alias("out")), lambda held: held["out"])

    def of(runs: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
        starts = F.aggregate(runs, begin, lambda held, run: F.struct(op(held["at"], last(run)).alias("at"), F.array_append(held["out"], held["at"]).alias("out")), lambda held: held["out"])
        return F.flatten(F.zip_with(runs, starts, through))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))), lambda i: F.slice(v, i * RUN + 1, F.lit(RUN)))
    return let(values, lambda v: let(cut(v), of))


def matches(text: Column, pattern: str, wanted=None) -> Column:
    """The matches of a pattern (those whose value is ``wanted``) with their places:
    what lies between them is what splitting at the pattern leaves."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)

    def placed(both: Column) -> Column:
        steps = F.zip_with(F.slice(both["gaps"], F.lit(1), F.size(both["hits"])), both["hits"], lambda gap, hit: gap + F.char_length(hit))
        ends = running(steps, lambda x, y: x + y)
        return F.zip_with(ends, both["hits"], lambda end, hit: F.struct((end - F.char_length(hit)).alias("start"), end.alias("end"), hit.alias("value")))

    spans = let(F.struct(gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), placed)
    return spans if wanted is None else F.filter(spans, lambda s: wanted(s["value"]))


def rewritten(text: Column, spans: Column, put) -> Column:
    """The text with what ``put`` gives for each span (ordered), the end of those before it
    and the span itself, in between what lies outside of all spans. A place in a long text
    can't be reached but from its start, so texts are cut into pieces of CUT characters first."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))

    def of(x: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            first = F.floor(start / CUT).cast("int")
            some = F.slice(x["pieces"], first + 1, F.floor((end - 1) / CUT).cast("int") - first + 1)
            return F.when(end > start, F.substring(F.array_join(some, ""), start % CUT + 1, end - start)).otherwise("")

        def around(ends: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
            made = F.zip_with(x["spans"], before, lambda s, at: F.concat(between(at, s["start"]), put(s, at)))
            return F.concat(F.array_join(made, ""), between(F.element_at(ends, -1), F.char_length(text)))

        return let(running(F.transform(x["spans"], lambda s: s["end"]), lambda x, y: F.greatest(x, y)), around)

    return let(F.struct(pieces.alias("pieces"), spans.alias("spans")), of)


def _luhn(digits: Column) -> Column:
    def weight(i):
        digit = F.substring(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        double = 2 * digit
        return F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda held, i: held + weight(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.regexp_like(part, F.lit(OCTET)))
    if kind == "card":
        return F.char_length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    pattern, test = PATTERNS[kind]
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(test(text), F.filter(matches(text, pattern), lambda s: _valid(kind, s["value"]))).otherwise(none)


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` packed in ``row``, with text (not null) and an array of spans per kind."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    # explode(array(x)) computes the spans once: a projection would be merged into each use
    spans = F.struct(*[base_spans(F.col("text"), kind).alias(kind) for kind in PATTERNS])
    return rows.select("row", "text", F.explode(F.array(spans)).alias("s")).select("row", "text", *[f"s.{kind}" for kind in PATTERNS])


def _sizes() -> Column:
    return sum((F.size(kind) for kind in PATTERNS), F.lit(0))


def outside() -> Column:
    """The text with spaces for the characters of base spans, so that places stay."""
    # repeat gives nothing for lengths below 0, as in overlaps
    blank = lambda s, at: F.repeat(F.lit(" "), s["end"] - F.greatest(at, s["start"]))
    return F.when(_sizes() == 0, F.col("text")).otherwise(rewritten(F.col("text"), F.array_sort(F.concat(*PATTERNS)), blank))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _digest() -> Column:
    return F.unhex(F.md5(F.encode("text", "UTF-8")))  # half the bytes of the digits


def contexts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """digest, copies, entities, term: every term of each distinct text with base spans,
    for each set of its entities that stand in the same texts; and entity, entities."""
    held = found.where(_sizes() > 0).select(_digest().alias("digest"), F.array_distinct(F.transform(F.concat(*PATTERNS), lambda s: s["value"])).alias("values"), terms_of(outside()).alias("terms"))
    held = written(held.groupBy("digest").agg(F.first("values").alias("values"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("copies")), "pii-held")
    each = held.select("digest", F.explode("values").alias("entity"))
    # a set of texts by two sums of hashes, gathered nowhere
    texts = F.unhex(F.concat(*[F.lpad(F.hex(F.bit_xor(F.xxhash64(F.lit(i), "digest"))), 16, "0") for i in (1, 2)]))
    sets = each.groupBy("entity").agg(texts.alias("entities"))
    of_text = each.join(sets, "entity").select("digest", "entities").distinct()
    near = of_text.join(held.select("digest", "copies", "terms"), "digest").select("digest", "copies", "entities", F.explode("terms").alias("term"))
    return near, sets


def disclosing(found: DataFrame, near: DataFrame, alpha: float, support: int, prior: float) -> DataFrame:
    """entities, term, action of the terms in ``near`` that exceed the threshold, by
    counts over all rows of ``found``."""
    joint = near.groupBy("entities", "term").agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("texts"))
    entities = near.select("digest", "copies", "entities").distinct().groupBy("entities").agg(F.sum("copies").alias("n_e"))
    if near.isEmpty():
        return near.select("entities", "term", F.lit("removed").alias("action"))
    total = found.count()
    held = found.select(F.explode(terms_of(outside())).alias("term"))
    # counted before it is joined: a join first would give a row for each text that holds a term looked for
    terms = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    scored = joint.join(terms, "term").join(entities, "entities")
    p = F.col("n_e") / F.lit(float(total))
    pmi = F.log2((F.col("n_te") + prior * p) / (F.col("n_t") + prior) / p)
    content = -F.log2(p)
    only = (F.col("n_te") >= F.col("n_t")) & (F.col("texts") >= support)
    return scored.where((content > 0) & (pmi >= alpha * content)).select("entities", "term", F.when(only, "removed").otherwise("generalised").alias("action"))


def decisions(docs: DataFrame, alpha: float = 0.9, support: int = 4, prior: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``contexts`` gives, and entities, term, action."""
    found = with_base(docs.select("text"))
    near, sets = contexts(found)
    near = written(near, "pii-contexts")
    return near, sets, disclosing(found, near, alpha, support, prior)


def risky_terms(docs: DataFrame, **options) -> DataFrame:
    """digest (MD5 of a text), generalised, removed (terms) of the texts with such terms."""
    near, _, risky = decisions(docs, **options)
    hits = near.join(risky, ["entities", "term"]).groupBy("digest", "term").agg(F.max("action").alias("action"))
    both = [F.collect_list(F.when(F.col("action") == action, F.col("term"))).alias(action) for action in ("generalised", "removed")]
    return hits.groupBy("digest").agg(*both)


def detect(docs: DataFrame, **options) -> DataFrame:
    """``docs`` packed in ``row``, with text, the base spans per kind and terms."""
    terms = written(risky_terms(docs, **options), "pii-terms")
    found = with_base(docs).withColumn("digest", _digest()).join(terms, "digest", "left")
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    spans = matches(outside(), TERM, lambda hit: F.array_contains("generalised", F.lower(hit)) | F.array_contains("removed", F.lower(hit)))
    action = lambda s: F.when(F.array_contains("removed", F.lower(s["value"])), "removed").otherwise("generalised")
    placed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), action(s).alias("action")))
    # explode(array(x)) as above
    return found.select("row", "text", *PATTERNS, F.explode(F.array(F.when(F.col("removed").isNull(), none).otherwise(placed))).alias("terms"))


def _listed(kinds: list[str]) -> Column:
    def named(kind: str) -> Column:
        return F.transform("terms" if kind == "term" else kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    found = detect(docs.select("doc_id", "text"), **options)
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    return found.select(
        F.col("row.doc_id"), *counts, F.sha2(F.encode(_listed([*PATTERNS]), "UTF-8"), 256).alias("base_sha256"),
        _listed([*PATTERNS, "term"]).alias("spans"), F.size("terms").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with base spans replaced by [EMAIL], [IP], [CARD] or [PHONE], and
    disclosing terms by [TERM] or nothing. Null texts stay null."""
    found = detect(docs, **options)

    def labelled(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("label")))

    labels = list(map(labelled, PATTERNS))
    labels.append(F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "removed", "").otherwise("[TERM]").alias("label"))))
    ordered = F.array_sort(F.concat(*labels))

    put = lambda s, at: F.when(s["start"] >= at, s["label"]).otherwise("")
    clean = F.when(_sizes() + F.size("terms") == 0, F.col("row.text")).otherwise(rewritten(F.col("text"), ordered, put))
    return found.select(*[clean.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
