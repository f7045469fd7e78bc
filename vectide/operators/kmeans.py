"""Cells by inner product: seeds, Lloyd rounds that assign to the cell of the largest inner product and move centres to means, without normalisation; an empty cell keeps its centre.

Centres are cells x dimensions numbers: collected each round and broadcast as a matrix, so that
lineage doesn't grow. Rows are assigned without a shuffle, by matrix products, and each task sums
up its cells before the one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import matrix

#: Rows that distance-weighted seeds are drawn from at most, and buckets that ids are counted by at most.
SEED_ROWS, BUCKETS = 20_000, 4_096


def seeds(base: DataFrame, cells: int, column: str = "embedding") -> list[list[float]]:
    """Vectors at places (c * (n div cells)) mod n in the order of vec_id; ids are ranked by range, not in one task."""
    n = base.count()
    if not n:
        raise ValueError("no vectors to take cells from")
    places = {(c * (n // cells)) % n for c in range(cells)}
    found = {r["at"]: list(map(float, r["v"])) for r in numbered(base.select("vec_id", F.col(column).alias("v")), n).where(F.col("at").isin(*places)).select("at", "v").collect()}
    return [found[(c * (n // cells)) % n] for c in range(cells)]


def weighted_seeds(base: DataFrame, cells: int, column: str = "embedding", part: slice = slice(None), seed: int = 42, rows: int = SEED_ROWS) -> list[list[float]]:
    """Vectors (or a part of each) drawn one after another, each with weight of its distance 1 - inner product to the nearest drawn so far, none below zero.

    They are drawn from rows vectors at most, those whose vec_ids have the smallest hashes.
    """
    some = base.select("vec_id", F.col(column).alias("v")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).collect()
    if not some:
        raise ValueError("no vectors to take cells from")
    x = np.array([r["v"] for r in some], np.float64)[:, part]
    rng = np.random.default_rng(seed)
    chosen, nearest = [int(rng.integers(len(x)))], np.full(len(x), np.inf)
    while len(chosen) < cells:
        nearest = np.minimum(nearest, np.maximum(0.0, 1.0 - x @ x[chosen[-1]]))
        reach = np.cumsum(nearest)
        chosen.append(int(np.searchsorted(reach, rng.random() * reach[-1])) % len(x) if reach[-1] > 0 else 0)
    return x[chosen].tolist()


def numbered(base: DataFrame, n: int | None = None) -> DataFrame:
    """base with at, the place of each row in the order of vec_id: counted by buckets of about as many ids, then within them; in one task if there is one bucket (fewer than 200,000 ids)."""
    n = base.count() if n is None else n
    buckets = min(BUCKETS, max(1, n // 100_000))
    if buckets == 1:
        return base.withColumn("_b", F.lit(0)).withColumn("at", F.row_number().over(Window.partitionBy("_b").orderBy("vec_id")) - F.lit(1)).withColumn("at", F.col("at").cast("long")).drop("_b")
    edges = base.agg(F.percentile_approx("vec_id", [i / buckets for i in range(1, buckets)]).alias("e")).first()["e"]
    dealt = base.withColumn("_b", F.size(F.filter(F.lit(edges).cast("array<long>"), lambda e: e <= F.col("vec_id"))))
    sizes = dealt.groupBy("_b").count()
    starts = sizes.select("_b", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    inside = Window.partitionBy("_b").orderBy("vec_id")
    return dealt.join(starts, "_b").withColumn("at", F.row_number().over(inside) - 1 + F.col("_s")).drop("_b", "_s")


def sequential_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices, each summed from the first component to the last."""
    out = np.zeros((len(x), len(c)))
    for a, b in zip(x.T, c.T, strict=True):
        out += a[:, None] * b
    return out


def nearest_cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest cell of each row; ties go to the lowest."""
    out = np.empty(len(x), np.int32)
    for a in range(0, len(x), 4096):
        some = x[a : a + 4096]
        products = some @ centres.T
        best = products.argmax(axis=1)
        off = 1e-12 * x.shape[1] * (1.0 + float(np.abs(products).max(initial=0.0)))
        close = np.flatnonzero((products >= products[np.arange(len(some)), best][:, None] - off).sum(axis=1) > 1)
        if len(close):  # products may be off by their last bits
            best[close] = (1.0 - sequential_products(some[close], centres)).argmin(axis=1)
        out[a : a + 4096] = best
    return out


def assign(base: DataFrame, centres: list[list[float]], column: str = "embedding") -> DataFrame:
    """base with cid."""
    shared = base.sparkSession.sparkContext.broadcast(np.array(centres, np.float64))
    place = base.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = nearest_cells(matrix(batch.column(place)), shared.value) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=[*batch.schema.names, "cid"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("cid", T.IntegerType())]))


def cell_sums(rows: DataFrame, books: np.ndarray, column: str = "embedding") -> dict[tuple[int, int, int], float]:
    """{(m, cell, component): mean} for the sub-vectors of rows by the nearest of each sub-space's centres, books[m]; cells without rows are missing."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        m, words, width = books.shape
        sums, counts = np.zeros((m, words, width)), np.zeros((m, words), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            for i in range(m):
                sub = x[:, i * width : (i + 1) * width]
                cells = nearest_cells(sub, books[i])
                counts[i] += np.bincount(cells, minlength=words)
                for j in range(width):
                    sums[i, :, j] += np.bincount(cells, sub[:, j], words)
        i, c = np.nonzero(counts)
        places = np.tile(np.arange(width), len(i))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(i, width), pa.int64()), pa.array(np.repeat(c, width), pa.int64()), pa.array(places, pa.int64()), pa.array(sums[i, c].reshape(-1), pa.float64()), pa.array(np.repeat(counts[i, c], width), pa.int64())],
            names=["m", "c", "i", "s", "n"],
        )

    found = rows.select(column).mapInArrow(run, "m long, c long, i long, s double, n long").groupBy("m", "c", "i").agg((F.sum("s") / F.sum("n")).alias("x"))
    return {(r["m"], r["c"], r["i"]): r["x"] for r in found.collect()}  # as many as there are numbers in books


def moved(rows: DataFrame, books: np.ndarray, rounds: int, column: str = "embedding", digits: int | None = None) -> np.ndarray:
    """Centres of every sub-space after some rounds, rounded to digits after each if given."""
    books = np.array(books, np.float64)
    for _ in range(rounds):
        for place, x in cell_sums(rows, books, column).items():
            books[place] = x if digits is None else half_up(x, digits)
    return books


def half_up(x: float, digits: int) -> float:
    """Rounded as SQL does."""
    scale = 10.0**digits
    return float(np.copysign(np.floor(abs(x) * scale + 0.5), x) / scale)


def lloyd(base: DataFrame, centres: list[list[float]], rounds: int, column: str = "embedding", digits: int | None = None) -> list[list[float]]:
    """Centres after some rounds, rounded to digits after each if given."""
    return moved(base, np.array([centres]), rounds, column, digits)[0].tolist()


def train(base: DataFrame, cells: int, rounds: int = 15, column: str = "embedding", digits: int | None = None) -> list[list[float]]:
    return lloyd(base, seeds(base, cells, column), rounds, column, digits)


__all__ = ["assign", "lloyd", "moved", "nearest_cells", "numbered", "seeds", "train", "weighted_seeds"]
