"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, secret redaction, packing.

Each stage takes what its predecessor kept, written as Parquet and read again,
and all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import ngram_join, packing, quality, secrets, winnowing
from quern.llm.common import saved, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_filter(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return ngram_join.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    return winnowing.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported spans are replaced in the text; every document stays."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: SQL can neither fit the quality rules nor tokenise; tests hold the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
