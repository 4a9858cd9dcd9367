"""The corpus pipeline: each stage applies one operator to all documents that the stage before kept.

Stages take (spark, docs, sf_dir) and all but the last return the columns of
documents. Rows with a null doc_id are judged like others where texts alone
decide, and kept where ids are needed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import near_dedup, packing, secrets, substring_dedup, toxicity
from ledgerline.llm.shared import checkpointed


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays."""
    dropped = near_dedup.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur earlier go; other documents stay as they are."""
    cut = substring_dedup.dedup_substrings(docs, layout="original", carry=True)
    return _restored(docs, cut)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span becomes a mark."""
    found = secrets.scan(docs, carry=True)
    return _restored(docs, found.select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("text"), "carried"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids; see packing.pack."""
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.crc32("token_ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", ids, "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "bucket", "token_ids")


def _restored(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs, with the changed text and its length."""
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return changed.select(*[new.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]
#: Classifier, candidate search and tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them rows lie in the shared folder, so a lost executor costs no earlier stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
