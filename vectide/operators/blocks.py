"""Queries meeting stored vectors.

A kernel gets some stored rows and some queries. Queries of BROADCAST_BYTES at most (counted)
are sent to a scan of the stored rows; others meet them in blocks: stored rows lie in parts, and
each part meets each block of the queries that are sent to it in one task, which holds one part
and one block. Parts that lie whole in partitions are scanned where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a part, and queries of a block, at most about so many.
PART_ROWS, QUERY_ROWS = 32_768, 4_096
#: Bytes of queries, as doubles, that are sent to every task at most.
BROADCAST_BYTES = 8 << 20
#: Queries whose distances to a part are held at a time.
CHUNK = 128

Kernel = Callable[[pa.Table, pa.Table], pa.Table]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def deal(n: int, column: str = "vec_id") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def parts_for(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def small_table(queries: DataFrame) -> pa.Table | None:
    """queries as one table if they are few enough to be broadcast; qv is their array column."""
    seen = queries.agg(F.count("*").alias("n"), F.sum(F.size("qv").cast("long") + 2).alias("values")).first()
    return queries.toArrow() if 8 * (seen["values"] or 0) <= BROADCAST_BYTES else None


def meet(stored: DataFrame, queries: DataFrame, task: Kernel, schema: str, asked: DataFrame | None = None) -> DataFrame:
    """task(rows of a part, a block of its queries) for all; both frames have a column part, queries also qid and qv. asked has the same qids, if they are counted there at less cost."""
    blocks = max(1, -(-(queries if asked is None else asked).select("qid").distinct().count() // QUERY_ROWS))
    left = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", deal(blocks, "qid"))
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(task, schema)


def in_blocks(stored: DataFrame, queries: DataFrame, task: Kernel, schema: str) -> DataFrame:
    """task over all pairs of rows and queries, block by block."""
    parts = parts_for(stored.count())
    every = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return meet(stored.withColumn("part", deal(parts)), every, task, schema)


def _sent(stored: DataFrame, small: pa.Table) -> Broadcast:
    """A small table's stream of bytes, sent to every task over stored."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, small.schema) as out:
        out.write_table(small)
    return stored.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part, which come one after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at, runs = 0, pc.run_end_encode(batch.column("part"))
        for end, part in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
            if held and held[0].column("part")[0].as_py() != part:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


def meet_in_place(stored: DataFrame, small: pa.Table, task: Kernel, schema: str) -> DataFrame:
    """task(rows of a part, a block of the queries) for all parts, each of which lies whole in a partition of stored, so that nothing is shuffled."""
    shared = _sent(stored, small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = pa.ipc.open_stream(shared.value).read_all()
        for left in whole_parts(batches):
            for at in range(0, right.num_rows, QUERY_ROWS):
                yield from task(left, right.slice(at, QUERY_ROWS)).to_batches()

    return stored.mapInArrow(run, schema)


def every_pair(stored: DataFrame, queries: DataFrame, task: Kernel, schema: str) -> DataFrame:
    """task over all pairs of rows and queries, each pair in one call."""
    small = small_table(queries)
    if small is None:
        return in_blocks(stored, queries, task, schema)
    shared = _sent(stored, small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = pa.ipc.open_stream(shared.value).read_all()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PART_ROWS:
                yield from task(pa.Table.from_batches(held), right).to_batches()
                held = []
        if sum(b.num_rows for b in held):
            yield from task(pa.Table.from_batches(held), right).to_batches()

    return stored.mapInArrow(run, schema)


def to_every_part(queries: DataFrame, stored: DataFrame, parts: list[int] | None = None) -> DataFrame:
    """queries once for each part of stored; the parts' numbers are collected if they aren't known, PART_ROWS rows giving one."""
    parts = [r["part"] for r in stored.select("part").distinct().collect()] if parts is None else parts
    return queries.withColumn("part", F.explode(F.lit(parts).cast("array<int>")))


def found_table(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """(qid, vec_id, dist) of lists (qid, ids, distances)."""
    none = np.zeros(0)
    return pa.table(
        {
            "qid": pa.array(np.concatenate([np.full(len(i), q, np.int64) for q, i, _ in found] or [none]), pa.int64()),
            "vec_id": pa.array(np.concatenate([i for _, i, _ in found] or [none]), pa.int64()),
            "dist": pa.array(np.concatenate([d for *_, d in found] or [none]), pa.float64()),
        }
    )


def least(ids: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances, in order; ties go to the smaller id."""
    if k < len(distances):
        near = np.flatnonzero(distances <= np.partition(distances, k - 1)[k - 1])
    else:
        near = np.arange(len(distances))
    return near[np.lexsort((ids[near], distances[near]))[:k]]
