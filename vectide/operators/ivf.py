"""Inverted file: vectors by cell, the nearest cells probed; alone, or over product codes.

A cell's rows are dealt into shares of bounded size (those of one cell alone by a hash), and the
queries that probe the cell go to each of them: an equality join, worked out share by share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distance import array_distances, dimension
from . import kmeans, pq
from .blocks import PART_ROWS, QUERY_ROWS, Kernel, found_table, least, matrix
from .sq import rerank
from .topk import top_k


def centroid_table(spark: SparkSession, centres: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cid int, centroid array<double>")


def in_cells(postings: DataFrame, probed: DataFrame, task: Kernel, schema: str) -> DataFrame:
    """task(rows of a cell, queries that probe it), both of bounded size, over all cells; postings and probed have cid."""
    rows = postings.groupBy("cid").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("shares"))
    asked = probed.groupBy("cid").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    sizes = rows.join(asked, "cid")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    left = postings.join(sizes, "cid").withColumn("share", one("vec_id", "shares")).withColumn("block", every("blocks")).drop("shares", "blocks")
    right = probed.join(sizes, "cid").withColumn("block", one("qid", "blocks")).withColumn("share", every("shares")).drop("shares", "blocks")
    keys = ("cid", "share", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, schema)


class IVFIndex:
    """Centres, and postings (cid, vec_id, embedding)."""

    def __init__(self, centres: list[list[float]], postings: DataFrame):
        self.centres, self.postings = centres, postings

    @classmethod
    def build(cls, base: DataFrame, cells: int = 256, rounds: int = 15, digits: int | None = None) -> IVFIndex:
        dimension(base)
        centres = kmeans.train(base, cells, rounds, digits=digits)
        return cls(centres, kmeans.assign(base.select("vec_id", "embedding"), centres))

    def save(self, path: str) -> None:
        """Postings in folders by cell, so that a search reads the probed cells' files alone."""
        spark = self.postings.sparkSession
        self.postings.repartition("cid").write.partitionBy("cid").parquet(f"{path}/postings")
        centroid_table(spark, self.centres).coalesce(1).write.parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IVFIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cid").collect()
        return cls([list(r["centroid"]) for r in rows], spark.read.parquet(f"{path}/postings"))

    def probes(self, queries: DataFrame, nprobe: int = 8) -> DataFrame:
        """(qid, cid, dist, rk, qv): the nearest cells of each query; ties go to the lower cell."""
        shared = queries.sparkSession.sparkContext.broadcast(np.array(self.centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = 1.0 - kmeans.sequential_products(matrix(batch.column(1)), shared.value)
                cells = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
                n, of = cells.shape[1], np.repeat(np.arange(len(d)), cells.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of)), pa.array(cells.reshape(-1), pa.int32()), pa.array(d[of, cells.reshape(-1)]), pa.array(np.tile(np.arange(1, n + 1), len(d)), pa.int64()), batch.column(1).take(pa.array(of))],
                    names=["qid", "cid", "dist", "rk", "qv"],
                )

        kind = queries.schema["qv"].dataType.simpleString()
        return queries.select(F.col("qid").cast("long").alias("qid"), "qv").mapInArrow(run, f"qid long, cid int, dist double, rk long, qv {kind}")

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 8) -> DataFrame:
        """Exact within the probed cells; fewer than k rows if these hold fewer."""

        def task(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if left.num_rows and right.num_rows:
                ids, x, qids, y = left.column("vec_id").to_numpy(), matrix(left.column("embedding")), right.column("qid").to_numpy(), matrix(right.column("qv"))
                for i, q in enumerate(y):
                    d = array_distances("ip", x, q)
                    best = least(ids, d, k)
                    found.append((qids[i], ids[best], d[best]))
            return found_table(found)

        return top_k(in_cells(self.postings.select("cid", "vec_id", "embedding"), self.probes(queries, nprobe).select("qid", "cid", "qv"), task, "qid long, vec_id long, dist double"), k)


class IVFPQIndex:
    """An inverted file whose postings hold product codes of the raw vectors."""

    def __init__(self, ivf: IVFIndex, books: list[list[list[float]]]):
        self.ivf, self.books = ivf, books
        self.coded = pq.encode(ivf.postings.select("cid", "vec_id", "embedding"), books)

    @classmethod
    def build(cls, base: DataFrame, cells: int = 256, m: int = 8, words: int = 256, rounds: int = 15, digits: int | None = None, pq_rounds: int | None = None) -> IVFPQIndex:
        if dimension(base) % m:
            raise ValueError(f"{m} sub-spaces don't divide the vectors")
        return cls(IVFIndex.build(base, cells, rounds, digits), pq.train(base, m, words, rounds if pq_rounds is None else pq_rounds, digits))

    def coarse(self, queries: DataFrame, p: int, nprobe: int = 16, parts: DataFrame | None = None) -> DataFrame:
        """The p nearest by codes in the probed cells; by each part (cid, part) if parts are given."""
        shared = queries.sparkSession.sparkContext.broadcast(np.array(self.books))

        def task(left: pa.Table, right: pa.Table) -> pa.Table:
            found, cell = [], left.column("cid")[0].as_py() if left.num_rows else 0
            if left.num_rows and right.num_rows:
                ids, codes, qids, y = left.column("vec_id").to_numpy(), matrix(left.column("codes")).astype(np.int64), right.column("qid").to_numpy(), matrix(right.column("qv"))
                for i, q in enumerate(y):
                    d = pq.looked_up(pq.lookup(q[None], shared.value)[0], codes)
                    best = least(ids, d, p)
                    found.append((qids[i], ids[best], d[best]))
            table = found_table(found)
            return table.append_column("cid", pa.array(np.full(table.num_rows, cell), pa.int32()))

        met = in_cells(self.coded.select("cid", "vec_id", "codes"), self.ivf.probes(queries, nprobe).select("qid", "cid", "qv"), task, "qid long, vec_id long, dist double, cid int")
        if parts is None:
            return top_k(met, p)
        order = Window.partitionBy("qid", "part").orderBy("dist", "vec_id")
        return met.join(parts, "cid").withColumn("rk", F.row_number().over(order).cast("long")).where(F.col("rk") <= p).select("qid", "vec_id", "dist", "rk")

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 16, p: int | None = None, parts: DataFrame | None = None) -> DataFrame:
        """By codes alone, or with the exact distance of the best p (of all cells together, or of each part)."""
        if p is None:
            return self.coarse(queries, k, nprobe)
        return rerank(self.ivf.postings, queries, self.coarse(queries, p, nprobe, parts), k)
