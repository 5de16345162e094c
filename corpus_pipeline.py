"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

1. toxicity: documents that the model rejects go.
2. dedup: of each group of similar documents the one with the smallest id stays.
3. secrets: every secret in a text is replaced by a mark, and n_chars follows; no document goes.
4. mix: each document appears as many times as the source mix draws it (a draw of less than half of it is not one).
5. pack: the tokens of every document that is left, in sequences.

Nulls and odd rows, stage by stage: a null or empty text is scored like an empty
one, is in no group, has no secret, has no words and so is never drawn by the
mix (a source's target is in words), and would be packed as the end token alone.
A row with a null id is scored, never goes as a copy, is redacted, mixed and
packed. Null sources are one source. Repeated rows are rows of their own, but of
a group of similar documents all rows with the smallest id stay. Empty tables
pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import jaccard, mixing, packing, secrets, toxicity
from shelfmark.llm.common import cut, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact_secrets(docs.withColumn("_text_before", F.xxhash64("text")))
    changed = F.xxhash64("text") != F.col("_text_before")
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: A learned model and a tokenizer's vocabulary are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
