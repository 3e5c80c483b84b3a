"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm._common import Stage
from sparkloom.llm.bpe import digest_documents
from sparkloom.llm.decontaminate import remove_contaminated
from sparkloom.llm.langid import keep_identified
from sparkloom.llm.neardup import keep_one_of_each
from sparkloom.llm.pii import redact_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the stage's own documents; those without a letter go (``und``); if nothing can be learnt, all stay."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text is replaced by its kind."""
    return redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document left, as digests."""
    return digest_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("PII", personal_data),
    ("BPE", encode),
]

#: Language models, the EM of the labelers and BPE have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = Stage(spark, "pipeline")
    for _, step in STAGES:
        before, docs = docs, stage.keep(step(spark, docs, sf_dir))
        stage.drop(before)
    return docs
