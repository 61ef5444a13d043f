"""Registered queries of the corpus operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import centroids, fill_in_middle, oracles
from quern.llm.common import table
from quern.llm.exact_dedup import exact_groups
from quern.llm.html_text import extract
from quern.llm.language import identify
from quern.llm.ngram_join import jaccard_components
from quern.llm.packing import pack
from quern.llm.quality import quality
from quern.llm.secrets import scan
from quern.llm.token_counts import token_counts
from quern.llm.url_filter import judge
from quern.llm.warc import archive
from quern.llm.winnowing import contamination


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), ("source", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), ["doc_id"], digests=True)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 2 that SQL can express."""
    return op2_quality_rules(spark, sf_dir).drop("n_bad_votes", "posterior", "kept")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 4 that SQL can express."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 6 that SQL can express: verdicts of rules, null where the method decides."""
    return op6_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_html_extraction, op2_quality_rules, op3_ngram_jaccard_join, op4_secret_scan, op5_warc, op6_url_filter, op7_token_counts,
        op8_packing, op9_benchmark_decontamination, op10_language_id, op11_exact_dedup, op12_fill_in_middle, op13_centroid_clustering, pipeline,
        quality_counts, secret_base_spans, url_rules,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
