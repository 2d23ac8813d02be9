"""Training corpus from ``documents``: five stages, each over all rows the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketspark.llm import contamination, line_dedup, mixing, near_duplicates, toxicity
from marketspark.llm.common import table
from marketspark.llm.registry import ORACLES as OPERATOR_ORACLES, QUERIES as OPERATOR_QUERIES
from marketspark.sources.snapshot import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the cut stay; the classifier learns from labelled rows of ``docs``."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal an earlier one go, and longer ones within one word of one."""
    return line_dedup.dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked shingle sets stays."""
    return near_duplicates.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more stand in benchmark windows go."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # the classifier has no SQL form; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs


QUERIES = {**OPERATOR_QUERIES, "pipeline": run}
ORACLES = OPERATOR_ORACLES
