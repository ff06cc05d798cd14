"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, decontam, langid, neardup, quality
from orrery.llm.shared import checkpointed, drop, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from the labelled ones."""
    return langid.identified(docs, *langid.fit(langid.training_rows(docs)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source."""
    return quality.passed(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near copies."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    return bpe.encoded(docs, with_ids=True, keep=("lang", "source", "n_chars"))


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: No SQL for hashed models and subword vocabularies; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch() as made:
            out = checkpointed(stage(spark, docs, sf_dir), name.split()[0])
        # what a stage has stored is read no more, nor is the stage before
        drop(docs, *[t for t in made if t is not out])
        docs = out
    return docs
