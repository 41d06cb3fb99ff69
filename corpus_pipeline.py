"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next one.

1. language_id: documents whose text has no letters, or whose language is below MIN_SCORE, go.
2. jaccard_join: one document of each group of near copies stays, the one with the smallest doc_id.
3. decontamination: documents that hold a window of a benchmark item go.
4. secret_scan: the secrets found in the texts are replaced by SECRET; n_chars follows.
5. packing: what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from viewloom.llm import op3_langid, op4_jaccard, op5_secrets, op7_decontam, op9_packing
from viewloom.llm.common import discard, read_table, shared_dir

MIN_SCORE = 0.5
SECRET = "[SECRET]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_langid.keep_identified(docs, op3_langid.fit(docs), MIN_SCORE)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), remove="documents")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_secrets.redact(docs, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", SECRET)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_packing.pack(docs, op9_packing.tokenizer_file())


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can't express the tokenizer and the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`. A stage's rows are deleted as soon as the next one's are written; the last one's stay."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}-{name}")
        if i:
            discard(docs)  # the stage before has served
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
