"""Corpus pipeline: quality rules, quality classifier, near-duplicates, benchmark leaks, token ids.

Every stage takes all documents that its predecessor kept, from Parquet, and returns a DataFrame; all
but the last return the columns of ``documents``.  What a stage rejects is gone for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from satloom.llm import bpe, common, decontaminate, near_dedup, quality_classifier, quality_rules


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: per document its token ids, and digests of the ids and of the bytes decoded from them."""
    import public_tokenizers as public

    return bpe.roundtrip_digest(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, ["doc_id"], with_ids=True)


STAGES = [
    ("quality_rules", quality_rules.keep_good),
    ("quality_classifier", quality_classifier.keep_good),
    ("near_dedup", near_dedup.keep_one),
    ("decontamination", decontaminate.keep_clean),
    ("byte_bpe", encode),
]

#: SQL can't express the trained classifier, the sketches or the encoder; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
