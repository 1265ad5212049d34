"""The corpus pipeline: quality rules, exact dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner writes it as Parquet and gives what it reads again to
the next stage as docs. All stages but the last return the columns of documents; the last returns the pieces of the
packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexlake.llm import bpe, common, exact_dedup, packing, pii, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 in 5-word shingles, the row with the least doc_id."""
    return simhash.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind."""
    return pii.redact(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, bpe.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("personal_data", personal_data),
    ("best_fit_packing", packed_sequences),
]

#: Hashes, boosted trees and tokens have no SQL counterpart; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage has read is removed once it has written its own result; the last result stays for the session, as the DataFrame reads it.
    """
    docs = common.read(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k == 0:
            common.gone_at_end(spark, folder)
        docs = spark.read.parquet(path)
        if before:
            common.remove_folder(spark, before)
        before = path
    return docs
