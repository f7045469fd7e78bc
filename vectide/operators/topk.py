"""The k first rows of each query. A window with a rank limit keeps k rows of a query in each task before the shuffle, so partial results merge by the same plan.

What kernels have ranked already goes as lists (LISTS), several rows of a query in one, and is
merged in workers, so that Spark neither shuffles nor sorts single rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "qid long, vec_id long, dist double, rk long"
LISTS = "qid long, ids array<long>, dists array<double>"
#: Rows of a list at most, and lists that are merged at a time.
LIST_ROWS, MERGED_LISTS = 512, 1024
#: Rows of a query that a worker may hold to merge lists; a larger k is ranked by a window, which spills.
MERGED_ROWS = 1 << 20


class Index(Protocol):
    """What every index answers: the k nearest rows (RESULT) of each of queries (qid, qv)."""

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame: ...


def ranked(found: DataFrame, k: int) -> DataFrame:
    """found's k first rows of each qid by (dist, vec_id), with their place in rk."""
    order = Window.partitionBy("qid").orderBy("dist", "vec_id")
    return found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).withColumn("rk", F.col("rk").cast("long"))


def top_k(found: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, dist, rk): the nearest k of each query; ties go to the smaller vec_id."""
    return ranked(found.select("qid", "vec_id", "dist"), k)


def lists_table(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """LISTS of (qid, ids, distances), each cut into pieces of LIST_ROWS."""
    none = np.zeros(0)
    sizes = np.array([len(ids) for _, ids, _ in found], np.int64)
    pieces = -(-sizes // LIST_ROWS)
    of = np.repeat(np.arange(len(found)), pieces)
    place = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.minimum(LIST_ROWS, sizes[of] - place * LIST_ROWS))]).astype(np.int32))
    ids, dists = (pa.array(np.concatenate([f[i] for f in found] + [none]), kind) for i, kind in ((1, pa.int64()), (2, pa.float64())))
    return pa.table({"qid": np.array([q for q, *_ in found], np.int64)[of], "ids": pa.ListArray.from_arrays(ends, ids), "dists": pa.ListArray.from_arrays(ends, dists)})


def merged(lists: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, dist, rk): the nearest k of each query over all of its lists; ties go to the smaller vec_id. A worker holds 2 k rows of a query, and MERGED_LISTS lists, at most."""

    def table(qid: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> pa.Table:
        ends = np.concatenate([[0], np.flatnonzero(qid[1:] != qid[:-1]) + 1, [len(qid)]])  # they are in order of qid
        order, rk = np.arange(len(qid)), np.arange(len(qid)) + 1 - np.repeat(ends[:-1], np.diff(ends))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            best = dist[a:b].argsort(kind="stable")  # lists are runs that this merges
            near, at = dist[a:b][best], ids[a:b][best]
            if (~(near[1:] > near[:-1]) & (at[1:] < at[:-1])).any():  # ties of several lists
                best = np.lexsort((ids[a:b], dist[a:b]))
            order[a:b] = a + best
        order, rk = order[rk <= k], rk[rk <= k]
        return pa.table({"qid": qid[order], "vec_id": ids[order], "dist": dist[order], "rk": rk})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, ids, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for at in range(0, batch.num_rows, MERGED_LISTS):
                some = batch.slice(at, MERGED_LISTS)
                qids, sizes = some.column("qid").to_numpy(), pc.list_value_length(some.column("ids")).to_numpy()
                qid = np.concatenate([qid, np.repeat(qids, sizes)])
                ids, dist = np.concatenate([ids, some.column("ids").flatten().to_numpy()]), np.concatenate([dist, some.column("dists").flatten().to_numpy()])
                cut = np.searchsorted(qid, qids[-1])  # more of the last query may follow
                yield from table(qid[:cut], ids[:cut], dist[:cut]).to_batches(1 << 16)
                qid, ids, dist = qid[cut:], ids[cut:], dist[cut:]
                if len(qid) > 2 * k:
                    best = np.lexsort((ids, dist))[:k]
                    qid, ids, dist = qid[:k], ids[best], dist[best]
        yield from table(qid, ids, dist).to_batches(1 << 16)

    return lists.repartition("qid").sortWithinPartitions("qid").mapInArrow(run, RESULT)


def merge_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """The nearest k over the results of several parts."""
    return top_k(reduce(DataFrame.unionByName, [p.select("qid", "vec_id", "dist") for p in parts]), k)
