"""Distances between array columns, and the check that a column holds vectors.

Arithmetic is in double precision, summed from the first component to the last. Inner-product
distance is 1 minus the inner product, without normalisation, so it may be negative. A folded
higher-order function is used: unrolling a component's terms is slower and outgrows codegen.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _folded(a: Column, b: Column, term: Callable, zero: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, term), zero, lambda s, t: s + t)


def inner_product(a: Column, b: Column) -> Column:
    return _folded(a, b, lambda x, y: x.cast("double") * y.cast("double"), F.lit(0.0))


def ip_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - inner_product(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    """Squared, without the root."""
    return _folded(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")), F.lit(0.0))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"ip": ip_distance, "l2": l2_distance}


def metric(name: str) -> Callable[[Column, Column], Column]:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known are {sorted(METRICS)}")
    return METRICS[name]


def array_distances(name: str, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The same for a matrix and a vector in a worker; equal rows get equal distances, wherever they stand."""
    metric(name)
    return 1.0 - np.einsum("ij,j->i", rows, query) if name == "ip" else ((rows - query) ** 2).sum(axis=1)


def checked(vectors: DataFrame, column: str = "embedding") -> tuple[int, int]:
    """The vectors' one length (0 without rows), and how many there are; ValueError for nulls, non-finite components and mixed lengths."""
    v = F.col(column)
    bad = ~F.coalesce(F.forall(v, lambda x: F.abs(x) < F.lit(float("inf")).cast("float")), F.lit(False))  # one comparison a component: NaN is above all, null gives null
    seen = vectors.agg(F.min(F.size(v)).alias("low"), F.max(F.size(v)).alias("high"), F.count(F.when(bad, 1)).alias("bad"), F.count("*").alias("n")).first()
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} rows of {column} are null or hold null or non-finite components")
    if seen["low"] != seen["high"]:
        raise ValueError(f"{column} holds vectors of {seen['low']} to {seen['high']} components")
    return seen["low"] or 0, seen["n"]


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The vectors' one length, as checked gives it."""
    return checked(vectors, column)[0]
