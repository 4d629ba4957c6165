"""Corpus cleaning: quality, near duplicates, benchmark passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of ``documents``. Stages are written to Parquet and read again between them.

Rows with null text pass the filters as empty text would; null ids are kept where ids decide. Of rows
that repeat an id the near-duplicate stage keeps one of every group of near duplicates. Extra columns ride along until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontam, near_dedup, packing, quality, secrets
from veilframe.llm.common import materialise

CAPACITY = 2048


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ranked quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, quality.learnable(labels, "quality", 5, 0)))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest id, of every group of near duplicates (5-word shingles, 0.8)."""
    return near_dedup.distinct_documents(docs, k=5, percent=80)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; keeps all documents."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most ``CAPACITY`` tokens; one row a piece."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicate_filter),
    ("decontamination", benchmark_filter),
    ("secrets", secret_redaction),
    ("packing", packing_stage),
]

#: A trained classifier and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
