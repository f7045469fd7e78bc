"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import kept as checkpointed
from ..functions.durable import shared_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What is run inside sends workers Arrow batches of about so many bytes at most (or single rows); for tables of large rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read, on whichever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two hashes, key1 and key2, that tell rows with another doc_id or another text apart; never null."""
    i, t = F.col(doc_id), F.col(text).cast("string")
    return [F.xxhash64(i.isNull(), i, t.isNull(), t).alias("key1"), F.xxhash64(t, F.lit(7), t.isNull(), i, F.lit(1)).alias("key2")]


def keep_one(docs: DataFrame, groups: DataFrame, row_group: str = "root") -> DataFrame:
    """The first row of each group of docs: that with the smallest doc_id, then key; none without a doc_id if another has one.

    groups is (key1, key2, doc_id, row_group) of every row; of rows that are equal in doc_id and text one stays.
    """
    first = groups.groupBy(row_group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key1", "key2")).alias("f"))
    names = [free_name(docs, "key1"), free_name(docs, "key2")]
    keyed = docs.select("*", *(k.alias(n) for n, k in zip(names, row_key())))
    kept = keyed.join(first.select(F.col("f.key1").alias(names[0]), F.col("f.key2").alias(names[1])), names, "left_semi")
    return kept.dropDuplicates(names).select(*docs.columns)


def free_name(docs: DataFrame, name: str) -> str:
    """name, lengthened until docs has no column of it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def low_hash(key: str, size: int, total: int) -> Column:
    """Holds for about four times size of total rows, by a hash of key; for all if there are fewer.

    A sample of the size rows with the smallest hashes needs no others, so what its tasks send on
    follows the sample, not the number of tasks.
    """
    share = min(1.0, 4 * size / max(1, total))
    return F.xxhash64(key) <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))


#: What a worker keeps between tasks for the operator it last ran.
_kept: dict = {}


def kept(key: tuple, make: Callable):
    """make()'s value, made once in a worker as long as it runs the same operator with the same parameters.

    Another key drops it, so that the operators of a pipeline don't add up in a worker's memory.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def keep_nothing() -> None:
    """For kernels that keep nothing: what the worker keeps of another operator goes, and memory that is free goes back to the system."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def row_slices(batches: Iterator[pa.RecordBatch], text_column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each slice's text takes max_bytes at most (or is a single row)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_column))
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(column).to_pylist()):
            if size and size + (n or 0) > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long; root is the component's smallest node.

    Alternating star contraction: each round hangs the larger neighbours of every node on its
    smallest neighbour, first over all neighbours, then over the smaller ones. Only grouped
    minima and equality joins are used, so a hub's neighbours never meet in one place; each
    round is checkpointed. Rounds grow with the logarithm of the longest path.
    """
    now = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        now = checkpointed(small.select("e.a", "e.b").where("a <> b").distinct())
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


__all__ = [
    "batches_of", "checkpointed", "connected_components", "free_name", "keep_nothing", "keep_one", "kept", "let", "low_hash", "read", "remove", "row_key", "row_slices", "shared_folder", "shuffle_partitions",
]
