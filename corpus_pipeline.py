"""The corpus pipeline: documents in, tokenized documents out.

STAGES are applied in order; each works on all that the one before it kept and
its result is written before the next one reads it. Null texts are ``und`` and
go with the first stage; an empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import bpe, decontaminate, langid, pii, simhash
from sievelake.workspace import table, written

TOKENIZER = "word_bpe_49k.json"


def packed(docs: DataFrame) -> DataFrame:
    """The documents as row and text, so that no column of theirs meets one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected. Models learn from the labelled ones."""
    model = langid.learn(docs.select("text", "lang"))
    return langid.identify(packed(docs), model).where("NOT rejected").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (5-word shingles, similarity 0.8):
    the one with the smallest id. Rows of one id in different groups are different
    documents; rows without an id come last."""
    return simhash.first_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    found = decontaminate.leaks(packed(docs), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select("row.*")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and the terms that disclose it, in the texts."""
    clean = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digests of the tokens, the ids themselves and the decoded text's digest."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [
    ("language_id", keep_identified),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("pii", sanitise),
    ("bpe", tokenize),
]

#: Models, fixed points over links and tokenization are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
