"""The corpus operators' queries over the synthetic tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_ann, language, licenses, positional_index, quality, secrets, simhash, sql, substring_dedup, token_files, tree_bpe
from .common import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_multi_index_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return positional_index.flags(docs, read(spark, sf_dir, "benchmark")).drop("items")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read(spark, sf_dir, "documents"), keep_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.encode(read(spark, sf_dir, "documents"), keep_ids=False, keep_text=False).drop("ids", "decoded")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_multi_index_ann,
        op3_token_files,
        op4_benchmark_decontamination,
        op5_substring_dedup,
        op6_simhash_near_dedup,
        op7_tree_bpe,
        op8_license_scan,
        op9_secret_scan,
        op10_language_id,
    )
}
#: The others are tested against brute force, round trips or held-out labels.
SQL: dict[str, str] = {"op4_benchmark_decontamination": sql.OP4, "op5_substring_dedup": sql.OP5}
