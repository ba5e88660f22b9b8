"""The corpus queries, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import bpe, decontaminate, exact, langid, licenses, media, pii, repair, sharding, simhash, suffixes, trie, warc
from sievelake.workspace import scratch, table

TOKENIZER = "word_bpe_49k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch(spark, "media")
    media.store(table(spark, sf_dir, "documents"), archives)
    return media.describe(media.load(spark, archives))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch(spark, "warc")
    index = warc.write(warc.plan(table(spark, sf_dir, "pages")), archives)
    return warc.read(index, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shuffle(table(spark, sf_dir, "documents"), 24, seed=9)
    text = F.coalesce("text", F.lit(""))
    return shards.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold == 1).alias("held_out"))
    labelled = docs.where("NOT held_out AND lang IS NOT NULL").select("text", "lang")
    return langid.identify(docs.select("doc_id", "text", "held_out"), langid.learn(labelled)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(turns), turns)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_simhash": op1_simhash, "op2_licenses": op2_licenses, "op3_suffixes": op3_suffixes, "op4_bpe": op4_bpe, "op5_media": op5_media, "op6_decontaminate": op6_decontaminate, "op7_pii": op7_pii, "op8_warc": op8_warc, "op9_sharding": op9_sharding, "op10_langid": op10_langid, "op11_exact_dedup": op11_exact_dedup, "op12_repair": op12_repair, "op13_prefix_trie": op13_prefix_trie}
ORACLES: dict[str, str] = {
    "op2_licenses": licenses.sql(),
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM k""",
    "op11_exact_dedup": exact.sql(),
    "op12_repair": repair.sql(),
    "op13_prefix_trie": trie.sql(),
}
