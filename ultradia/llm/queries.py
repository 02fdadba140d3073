"""Queries of the training-data problems 7 to 10 over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ultradia.llm import clusters, packing, residue, tokens
from ultradia.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LIKENESS = ("night_sleep_mean_z", "total_sleep_mean_z", "p_wake_mean_z")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.similar_groups(table(spark, sf_dir, "features_z"), "feature_id", LIKENESS, 0.2, 5).select("feature_id", "cluster_id")


def p7_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each community of like flies within its group: sizes and most typical flies."""
    return clusters.described(table(spark, sf_dir, "features_z"), "feature_id", LIKENESS, 0.2, 5)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their training context of 2,048 tokens."""
    sizes = written(tokens.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text", only_count=True), "sizes")
    return packing.pack(sizes, "doc_id", "n_tokens", 2048)


def p10_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"), written)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_flags(spark, sf_dir).select("doc_id")


QUERIES = {"p7_found": p7_found, "p7_clusters": p7_clusters, "p8_ids": p8_ids, "p9_packed": p9_packed, "p10_found": p10_found, "p10_flags": p10_flags}
ORACLE: dict[str, str] = {}
