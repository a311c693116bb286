"""The corpus pipeline: quality, exact and near duplicates, mixing, packing; each stage's table is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import exact, mixing, neardup, packing, quality
from eventloom.llm.shared import documents, table


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    Null and empty texts get the score of no evidence; repeated rows are judged alike; all columns are kept, whatever their names.
    """
    return quality.keep_good(docs, quality.fit(docs, quality.training_labels(_labels(spark, sf_dir))))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text.

    Null texts count as empty; rows with a null doc_id go; of rows that repeat an id, one with each text that stays is kept.
    """
    return exact.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates (five words, similarity of 0.8 or more).

    Null, empty and wordless texts are linked with nothing and stay; rows with a null doc_id go.
    """
    return neardup.keep_one_each(docs, 80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, band: float = 0.0) -> DataFrame:
    """Documents as often as the mixture's rates say: all tokens to what is not toxic.

    Low quality is no domain here: the first stage has judged it, and what it leaves of it has no words of its own, so that
    a target of none would cost clean documents instead.
    Documents with a rate within ``band`` of 1 stay once. Null and empty texts have no tokens and the rate of the prior; rows with a
    null doc_id go.
    """
    return mixing.resample(docs, _labels(spark, sf_dir), domains={"toxic": "toxic = 1", "other": "true"}, band=band)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences of at most 4096 tokens; null and empty texts are one piece of the end token."""
    return packing.pack_documents(docs)


STAGES = [("quality", good_quality), ("exact", exact_copies), ("near", near_copies), ("mixing", mixture), ("packing", packed)]

#: The stages learn, sketch and pack; SQL does not express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
