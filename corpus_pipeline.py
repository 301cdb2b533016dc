"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselight.llm import decontaminate, exactdedup, mixing, similar, toxicity
from caselight.llm.common import shared_folder, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go. Null and empty texts have no clause and stay; equal rows go or stay alike; empty tables pass."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) one row stays, that of the largest id; null ids are beaten by any other and
    shield nothing; of rows equal in id and text one stays. Empty tables pass."""
    return exactdedup.one_of_each(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose sets of five-word shingles reach a Jaccard similarity of 0.8, and all that such links connect, the row with
    the smallest id stays. Rows are known by their texts, not by ids, so null and repeated ids lose and shield nothing. Texts
    without words are alike. Empty tables pass."""
    return similar.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null and empty texts contain none; equal rows go or stay alike; empty tables pass."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their words, copies and words taken. Of equal rows as many are taken as the budget
    needs; documents without words are in no mix; an empty table gives an empty one."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("SimHash near-dedup", simhash_stage), ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
#: SQL can't express the learnt grammar, the fingerprints and the templates; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
