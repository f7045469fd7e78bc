"""Scalar quantisation: one byte a component, over the range of the whole table; a scan of codes, then exact ranking of the best."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import ip_distance
from .blocks import CHUNK, every_pair, found_table, least, matrix
from .topk import top_k


def train(base: DataFrame) -> DataFrame:
    """One row (gmin, gscale, dim)."""
    low = F.min(F.array_min("embedding")).cast("double")
    high = F.max(F.array_max("embedding")).cast("double")
    scale = F.when(high - low > 1e-8, F.lit(255.0) / (high - low)).otherwise(F.lit(1.0))
    return base.agg(low.alias("gmin"), scale.alias("gscale"), F.max(F.size("embedding")).alias("dim"))


def codes(vector: Column, params: dict) -> Column:
    """Codes 0 to 255; components outside the trained range are cut to it."""
    step = lambda x: F.floor((x.cast("double") - F.lit(params["gmin"])) * F.lit(params["gscale"]) + F.lit(0.5)).cast("int")
    return F.transform(vector, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), step(x))).cast("smallint"))


def total(code: Column) -> Column:
    return F.aggregate(code, F.lit(0), lambda s, x: s + x)


def encode(base: DataFrame, params: dict) -> DataFrame:
    """(vec_id, code, code_sum)."""
    return base.select("vec_id", codes(F.col("embedding"), params).alias("code")).withColumn("code_sum", total(F.col("code")))


def distance(dots: np.ndarray, query_sum: int, code_sums: np.ndarray, params: dict) -> np.ndarray:
    """1 - inner product, from inner products and sums of codes."""
    gmin, scale, dim = params["gmin"], params["gscale"], params["dim"]
    return 1.0 - (dots / (scale * scale) + gmin / scale * (query_sum + code_sums) + gmin * gmin * dim)


def nearest_codes(coded: DataFrame, asked: DataFrame, k: int, score: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The k nearest of (vec_id, code, code_sum) to each of (qid, qv), qv being codes.

    score gets the inner products of a query's codes with all rows', the query's codes, and the rows'.
    """

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids, x, qids, y = left.column("vec_id").to_numpy(), matrix(left.column("code")), right.column("qid").to_numpy(), matrix(right.column("qv"))
            for a in range(0, len(y), CHUNK):
                dots = y[a : a + CHUNK] @ x.T  # of whole numbers, so exact
                for j, own in enumerate(dots):
                    d = score(own, y[a + j], x)
                    best = least(ids, d, k)
                    found.append((qids[a + j], ids[best], d[best]))
        return found_table(found)

    return top_k(every_pair(coded.select("vec_id", "code"), asked.select("qid", "qv"), task, "qid long, vec_id long, dist double"), k)


def code_l2(dots: np.ndarray, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances of codes."""
    return (query * query).sum() - 2.0 * dots + (rows * rows).sum(axis=1)


def code_ip(dots: np.ndarray, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Minus the inner products of codes."""
    return -dots


class SQIndex:
    """Codes beside the table they stand for."""

    def __init__(self, base: DataFrame, params: dict, coded: DataFrame):
        self.base, self.params, self.coded = base, params, coded

    @classmethod
    def build(cls, base: DataFrame) -> SQIndex:
        params = train(base).first().asDict()
        return cls(base, params, encode(base, params))

    def coarse(self, queries: DataFrame, p: int = 50) -> DataFrame:
        """The p nearest by codes."""
        params = self.params
        asked = queries.select("qid", codes(F.col("qv"), params).alias("qv"))
        return nearest_codes(self.coded, asked, p, lambda dots, q, x: distance(dots, q.sum(), x.sum(axis=1), params))

    def search(self, queries: DataFrame, k: int = 10, p: int = 50) -> DataFrame:
        return rerank(self.base, queries, self.coarse(queries, p), k)


def rerank(base: DataFrame, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The k nearest of found by the exact distance; only found rows' vectors are read on."""
    exact = found.select("qid", "vec_id").join(base.select("vec_id", "embedding"), "vec_id").join(queries, "qid")
    return top_k(exact.withColumn("dist", ip_distance(F.col("qv"), F.col("embedding"))), k)
