"""The corpus pipeline: documents pass the stages one after another, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import decontamination, pii, simhash, toxicity
from pagewright.llm.queries import packed_digests
from pagewright.llm.store import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def mild(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labelled ones among them."""
    return toxicity.keep_mild(docs, toxicity.train(docs, table(spark, folder, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.keep_clean(docs, table(spark, folder, "benchmark"))


def anonymous(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with the kind of personal data in its place."""
    return pii.redact(docs, pii.train())


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of the documents with their places in sequences."""
    return packed_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", mild),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("pii", anonymous),
    ("packing", packed),
]
#: A trained model, 64-bit fingerprints and tokenizer ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage. Null and empty texts pass as the stages' operators say."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
