"""A training corpus from documents, stage by stage.

Each stage is written as Parquet in the folder that driver and executors share, and read back as
the next one's documents, so a lost executor costs at most the stage that runs. A stage's files
go when the next stage's are written; the last one's stay for the result to be read from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vectide.llm import near_copies, positional_index, quality, secrets, tree_bpe
from vectide.llm.common import read, remove, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles) stays: that with the smallest doc_id.

    The near-duplicate operator in its form for sets of shingles; near_copies says why.
    """
    return near_copies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return positional_index.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    masked = secrets.redact(docs)
    return masked.selectExpr(*("cast(length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with hashes of the ids and of what they decode to."""
    return tree_bpe.encode(docs, keep_text=False).drop("decoded")


STAGES = [
    ("quality", keep_good),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: Neither trained embeddings nor ranked merges can be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
