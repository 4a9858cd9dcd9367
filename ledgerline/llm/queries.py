"""The queries of the training-data operators, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import embedding_dedup, language, near_dedup, packing, quality, secrets, sentencepiece_np, substring_dedup, toxicity, url_filter

# The rules that come before the block list, as (host, path prefix, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# Hosts blocked with all their subdomains where no rule decides.
BLOCKED_HOSTS = [
    "casino-bonus.example.com", "casino-bonus.example.net", "casino-bonus.example.org",
    "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org",
    "free-bets.example.com", "free-bets.example.net", "free-bets.example.org",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = sentencepiece_np.decode(sentencepiece_np.encode(table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str, listed: str | None = None) -> DataFrame:
    """listed: the path of a Parquet table as of url_filter.read_list; the fixed hosts, which the SQL has too, only where none is named."""
    blocked = [(host, "", "block") for host in BLOCKED_HOSTS] if listed is None else url_filter.read_list(spark.read.parquet(listed))
    judged = url_filter.filter_urls(spark, table(spark, sf_dir, "pages"), URL_RULES, blocked)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "bucket"
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean(table(spark, sf_dir, "documents")).drop("clean_text", "lost_chars")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind_order"] < len(secrets.BASE_RULES))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sentencepiece": op1_sentencepiece, "op2_url_filter": op2_url_filter, "op3_packing": op3_packing, "op4_embedding_dedup": op4_embedding_dedup, "op5_minhash": op5_minhash, "op6_quality_rules": op6_quality_rules, "op8_language_id": op8_language_id, "op9_toxicity": op9_toxicity, "op10_secret_scan": op10_secret_scan, "op7_substring_dedup": op7_substring_dedup}


def oracle_sql() -> dict[str, str]:
    from ledgerline.llm import oracles  # it reads this module's fixed values

    return oracles.oracle_sql()
