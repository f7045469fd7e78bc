"""Recall of found neighbours against true ones, and sweeps over a search's parameters."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import kept


def recall_by_query(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the true k among the found, over k even if fewer were found."""
    right = truth.where(F.col("rk") <= k).select("qid", "vec_id")
    hits = found.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1))
    return right.join(hits, ["qid", "vec_id"], "left").groupBy("qid").agg((F.count("hit") / F.lit(k)).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return recall_by_query(found, truth, k).agg(F.avg("recall").alias("recall"))


def named(config: dict) -> str:
    return ", ".join(f"{n}={v}" for n, v in config.items())


def sweep(search: Callable[..., DataFrame], configs: Iterable[dict], truth: DataFrame, k: int) -> DataFrame:
    """A row (config, recall) for each set of a search's parameters."""
    rows = [mean_recall(search(**c), truth, k).select(F.lit(named(c)).alias("config"), "recall") for c in configs]
    return reduce(DataFrame.unionByName, rows)


def timed_sweep(search: Callable[..., DataFrame], configs: Iterable[dict], truth: DataFrame, k: int) -> DataFrame:
    """A row (config, recall, query_us, speed_up) for each set: wall time over the number of queries, and the first set's over it."""
    truth = kept(truth)
    n, rows = truth.select("qid").distinct().count(), []
    for config in configs:
        began = time.perf_counter()
        found = kept(search(**config))
        rows.append((named(config), mean_recall(found, truth, k).first()["recall"], (time.perf_counter() - began) / max(1, n) * 1e6))
    return truth.sparkSession.createDataFrame([(*r, rows[0][2] / r[2]) for r in rows], "config string, recall double, query_us double, speed_up double")
