"""The corpus pipeline: each stage works on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which `run` writes as Parquet and reads again as the next one's documents.
No SQL expresses the toxicity stage, so ORACLE_SQL is None and the pipeline is tested
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import common, decontam, linededup, mixing, neardup, toxicity

ORACLE_SQL = None


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.clean_documents(docs, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; every document stays."""
    return linededup.without_boilerplate(docs)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (5-word shingles, similarity 0.8 or more) stays: SimHash fingerprints link first, with an exact check, and an exact join finds what they miss."""
    return neardup.one_of_each(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return decontam.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row per emitted copy of a document."""
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("line dedup", stage_line_dedup),
    ("simhash near-dedup", stage_simhash),
    ("benchmark decontamination", stage_decontamination),
    ("mixing", stage_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
