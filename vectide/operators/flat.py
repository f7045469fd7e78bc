"""Exact search over a table of vectors: nearest k, filtered, by range, by document; upserts and deletes.

Tables are (vec_id, embedding, ...), queries (qid, qv); results (qid, vec_id, dist, rk), nearest
first, ties to the smaller vec_id. Distances come from matrix products; those that may count are
worked out again row by row, so that equal vectors get equal distances wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distance import array_distances, dimension, metric
from .blocks import CHUNK, every_pair, found_table, in_blocks, least, matrix
from .topk import RESULT, top_k

FOUND = "qid long, vec_id long, dist double"


def queries_of(vectors: DataFrame, which: Column) -> DataFrame:
    """Rows of a table as queries."""
    return vectors.where(which).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def close_distances(by: str, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """For each query its number, its distances to all rows, and how far off they may be."""
    squares = np.einsum("ij,ij->i", x, x)
    largest = float(np.sqrt(squares.max(initial=0.0)))
    for a in range(0, len(y), CHUNK):
        some = y[a : a + CHUNK]
        products = some @ x.T
        for j, q in enumerate(some):
            norm = float(np.sqrt(q @ q))
            d = 1.0 - products[j] if by == "ip" else squares - 2.0 * products[j] + norm * norm
            yield a + j, d, 1e-12 * len(q) * (1.0 + (largest + norm) ** 2)


def _top(by: str, k: int):
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids, x, qids, y = left.column("vec_id").to_numpy(), matrix(left.column("embedding")), right.column("qid").to_numpy(), matrix(right.column("qv"))
            for i, d, off in close_distances(by, x, y):
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1] + 2 * off) if k < len(d) else np.arange(len(d))
                exact = array_distances(by, x[near], y[i])
                best = least(ids[near], exact, k)
                found.append((qids[i], ids[near[best]], exact[best]))
        return found_table(found)

    return task


def nearest(base: DataFrame, queries: DataFrame, k: int = 10, by: str = "ip", where: Column | None = None) -> DataFrame:
    """The k nearest rows of each query, of those where a predicate holds."""
    metric(by)
    kept = base if where is None else base.where(where)
    return top_k(every_pair(kept.select("vec_id", "embedding"), queries, _top(by, k), FOUND), k)


def nearest_in_blocks(base: DataFrame, queries: DataFrame, k: int = 10, by: str = "ip") -> DataFrame:
    """The same for any number of queries, without a broadcast."""
    metric(by)
    return top_k(in_blocks(base.select("vec_id", "embedding"), queries, _top(by, k), FOUND), k)


def within(base: DataFrame, queries: DataFrame, eps: float, least_rows: int = 0, most: int | None = None, by: str = "ip") -> DataFrame:
    """Rows at most eps from each query, the nearest most of them; never fewer than the nearest least_rows."""
    metric(by)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids, x, qids, y = left.column("vec_id").to_numpy(), matrix(left.column("embedding")), right.column("qid").to_numpy(), matrix(right.column("qv"))
            for i, d, off in close_distances(by, x, y):
                edge = eps
                if least_rows:
                    edge = max(eps, np.partition(d, least_rows - 1)[least_rows - 1] if least_rows < len(d) else np.inf)
                near = np.flatnonzero(d <= edge + 2 * off)
                exact = array_distances(by, x[near], y[i])
                order = np.lexsort((ids[near], exact))
                good = (exact[order] <= eps) | (np.arange(len(order)) < least_rows)
                order = order[good] if most is None else order[good][:most]
                found.append((qids[i], ids[near[order]], exact[order]))
        return found_table(found)

    order = Window.partitionBy("qid").orderBy("dist", "vec_id")
    found = every_pair(base.select("vec_id", "embedding"), queries, task, FOUND)
    placed = found.withColumn("rk", F.row_number().over(order).cast("long")).where((F.col("dist") <= eps) | (F.col("rk") <= least_rows))
    return (placed if most is None else placed.where(F.col("rk") <= most)).select("qid", "vec_id", "dist", "rk")


def before_last_document(found: DataFrame, documents: int) -> DataFrame:
    """Of (qid, vec_id, doc_id, dist) a query's rows before the first of one document too many, with rk; found is read once."""
    place = Window.partitionBy("qid", "doc_id").orderBy("dist", "vec_id")
    order = Window.partitionBy("qid").orderBy("dist", "vec_id")
    firsts = found.repartition("qid").withColumn("first", (F.row_number().over(place) == 1).cast("int"))
    # rows of one distance and id, of several documents, count all of these
    placed = firsts.withColumn("n", F.sum("first").over(order)).withColumn("rk", F.row_number().over(order).cast("long"))
    return placed.where(F.col("n") <= documents).select("qid", "vec_id", "doc_id", "dist", "rk")


def by_documents(base: DataFrame, queries: DataFrame, documents: int, doc: str = "doc_id", by: str = "ip") -> DataFrame:
    """(qid, vec_id, doc_id, dist, rk): the nearest vectors up to the first of one document too many."""
    metric(by)
    kind = base.schema[doc].dataType.simpleString()

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.nulls(0, left.schema.field("doc_id").type)]
        found = []
        if left.num_rows and right.num_rows:
            ids, x, qids, y = left.column("vec_id").to_numpy(), matrix(left.column("embedding")), right.column("qid").to_numpy(), matrix(right.column("qv"))
            docs = left.column("doc_id").combine_chunks()
            codes = pc.dictionary_encode(docs, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            for i, q in enumerate(y):
                d = array_distances(by, x, q)
                order = np.lexsort((ids, d))
                firsts = np.sort(np.unique(codes[order], return_index=True)[1])
                if len(firsts) > documents:  # what comes later here comes later among all rows, too
                    order = order[: firsts[documents] + 1]
                found.append((qids[i], ids[order], d[order]))
                out.append(docs.take(pa.array(order)))
        table = found_table(found)
        return pa.table([table["qid"], table["vec_id"], pa.concat_arrays(out), table["dist"]], names=["qid", "vec_id", "doc_id", "dist"])

    stored = base.select("vec_id", "embedding", F.col(doc).alias("doc_id"))
    return before_last_document(every_pair(stored, queries, task, f"qid long, vec_id long, doc_id {kind}, dist double"), documents)


def delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    """base without ids' vec_ids; unknown ones change nothing."""
    return base.join(ids.select("vec_id"), "vec_id", "left_anti").select(*base.columns)


def upsert(base: DataFrame, rows: DataFrame) -> DataFrame:
    """base with rows in place of those of the same vec_id, or added; of repeated rows one that is the largest stays."""
    last = rows.select(*base.columns).groupBy("vec_id").agg(F.max(F.struct(*(c for c in base.columns if c != "vec_id"))).alias("r")).select("vec_id", "r.*")
    return delete(base, last).unionByName(last.select(*base.columns))


class FlatIndex:
    """Exact search as an index."""

    def __init__(self, base: DataFrame, by: str = "ip"):
        metric(by)
        self.base, self.by = base, by

    @classmethod
    def build(cls, base: DataFrame, by: str = "ip") -> FlatIndex:
        dimension(base)
        return cls(base, by)

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
        return nearest(self.base, queries, k, self.by, where)

    def get(self, vec_id: int) -> DataFrame:
        """The vector of an id, as a table of one row or none."""
        return self.base.where(F.col("vec_id") == vec_id)

    def upsert(self, rows: DataFrame) -> FlatIndex:
        dimension(rows)
        return FlatIndex(upsert(self.base, rows), self.by)

    def delete(self, ids: DataFrame) -> FlatIndex:
        return FlatIndex(delete(self.base, ids), self.by)

    def save(self, path: str) -> None:
        self.base.write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, by: str = "ip") -> FlatIndex:
        return cls(spark.read.parquet(path), by)


__all__ = ["RESULT", "FlatIndex", "before_last_document", "by_documents", "close_distances", "delete", "nearest", "nearest_in_blocks", "queries_of", "upsert", "within"]
