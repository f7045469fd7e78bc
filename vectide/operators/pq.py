"""Product quantisation: sub-vectors by their best codeword (largest inner product), a scan by table look-up, exact ranking of the best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.distance import dimension
from . import kmeans
from .blocks import every_pair, found_table, least, matrix
from .sq import rerank
from .topk import top_k

#: Sums of look-ups are taken over whole numbers of this part of one, so that their order doesn't matter.
UNIT = 1e9


def train(base: DataFrame, m: int, words: int, rounds: int, digits: int | None = None, weighted: bool = False, seed: int = 42) -> list[list[list[float]]]:
    """Codebooks [sub-space][word][component], each trained by itself from strided seeds, or from distance-weighted ones."""
    width = dimension(base) // m
    spans = [slice(i * width, (i + 1) * width) for i in range(m)]
    if weighted:
        books = [kmeans.weighted_seeds(base, words, part=s, seed=seed + i) for i, s in enumerate(spans)]
    else:
        rows = kmeans.seeds(base, words)
        books = [[r[s] for r in rows] for s in spans]
    return kmeans.moved(base, np.array(books), rounds, digits=digits).tolist()


def codes_of(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes of rows, one for each sub-space; ties go to the lowest word."""
    width = books.shape[2]
    return np.stack([kmeans.nearest_cells(x[:, i * width : (i + 1) * width], book) for i, book in enumerate(books)], axis=1)


def encode(base: DataFrame, books: list[list[list[float]]], column: str = "embedding") -> DataFrame:
    """base with codes in place of its vectors."""
    shared = base.sparkSession.sparkContext.broadcast(np.array(books))
    place = base.columns.index(column)
    fields = [f for f in base.schema.fields if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = codes_of(matrix(batch.column(place)), shared.value) if batch.num_rows else np.zeros((0, len(shared.value)), np.int32)
            kept = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(list(codes.astype(np.int16)), pa.list_(pa.int16()))], names=[*(f.name for f in fields), "codes"])

    return base.mapInArrow(run, T.StructType([*fields, T.StructField("codes", T.ArrayType(T.ShortType()))]))


def lookup(y: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Inner products of queries' sub-vectors with all words, [query][sub-space][word], in whole units."""
    width = books.shape[2]
    exact = np.stack([kmeans.sequential_products(y[:, i * width : (i + 1) * width], book) for i, book in enumerate(books)], axis=1) * UNIT
    return (np.sign(exact) * np.floor(np.abs(exact) + 0.5)).astype(np.int64)


def looked_up(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """1 - inner product of every row of codes, by a query's table."""
    return 1.0 - table[np.arange(len(table)), codes].sum(axis=1).astype(np.float64) / UNIT


class PQIndex:
    """Codebooks, and codes (vec_id, codes) beside the table they stand for."""

    def __init__(self, base: DataFrame, books: list[list[list[float]]], coded: DataFrame):
        self.base, self.books, self.coded = base, books, coded

    @classmethod
    def build(cls, base: DataFrame, m: int = 8, words: int = 256, rounds: int = 15, digits: int | None = None, weighted: bool = False) -> PQIndex:
        size = dimension(base)
        if size % m:
            raise ValueError(f"{m} sub-spaces don't divide {size} components")
        if not 0 < words <= 256:
            raise ValueError("a code is one byte: 1 to 256 words")
        books = train(base, m, words, rounds, digits, weighted)
        return cls(base, books, encode(base.select("vec_id", "embedding"), books))

    def tables(self, queries: DataFrame) -> DataFrame:
        """(qid, lut): a query's look-up tables [sub-space][word]."""
        shared = queries.sparkSession.sparkContext.broadcast(np.array(self.books))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    some = batch.slice(a, 256)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(lookup(matrix(some.column(1)), shared.value).tolist(), pa.list_(pa.list_(pa.int64())))], names=["qid", "lut"])

        return queries.select("qid", "qv").mapInArrow(run, "qid long, lut array<array<long>>")

    def coarse(self, queries: DataFrame, p: int = 100) -> DataFrame:
        """The p nearest by codes alone."""
        shared = queries.sparkSession.sparkContext.broadcast(np.array(self.books))

        def task(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if left.num_rows and right.num_rows:
                ids, codes, qids, y = left.column("vec_id").to_numpy(), matrix(left.column("codes")).astype(np.int64), right.column("qid").to_numpy(), matrix(right.column("qv"))
                for i, q in enumerate(y):
                    d = looked_up(lookup(q[None], shared.value)[0], codes)
                    best = least(ids, d, p)
                    found.append((qids[i], ids[best], d[best]))
            return found_table(found)

        return top_k(every_pair(self.coded.select("vec_id", "codes"), queries, task, "qid long, vec_id long, dist double"), p)

    def search(self, queries: DataFrame, k: int = 10, p: int = 100) -> DataFrame:
        return rerank(self.base, queries, self.coarse(queries, p), k)
