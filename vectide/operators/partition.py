"""Dealing cells or rows out to parts."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kmeans
from .blocks import PART_ROWS


def by_blocks(cid: Column, cells: int, parts: int) -> Column:
    """Part r holds cells from r * cells div parts to before (r + 1) * cells div parts."""
    return F.floor(((cid + 1) * parts - 1) / F.lit(cells)).cast("int")


def balanced(sizes: DataFrame, parts: int) -> DataFrame:
    """(cid, part): the largest cell first, each to the part with the fewest rows; sizes is (cid, n), a row for each cell."""
    rows = sorted(((r["n"], r["cid"]) for r in sizes.select("cid", "n").collect()), reverse=True)
    load = [(0, p) for p in range(parts)]
    dealt = []
    for n, cid in rows:
        total, part = heapq.heappop(load)
        dealt.append((cid, part))
        heapq.heappush(load, (total + n, part))
    return sizes.sparkSession.createDataFrame(dealt, "cid int, part int")


def imbalance(rows: DataFrame, parts: int) -> DataFrame:
    """One row: the largest and the smallest part's difference in percent of an even share."""
    every = rows.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    sizes = every.join(rows.groupBy("part").count(), "part", "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    return sizes.agg(((F.max("n") - F.min("n")) / (F.sum("n") / F.lit(parts)) * 100).alias("imbalance"))


def by_range(base: DataFrame, parts: int) -> DataFrame:
    """base with part: even stretches in the order of vec_id."""
    n = base.count()
    return kmeans.numbered(base).withColumn("part", by_blocks(F.col("at"), n, parts)).drop("at")


def by_kmeans(base: DataFrame, parts: int, rounds: int = 10, most: int = PART_ROWS) -> DataFrame:
    """base with part: cells of their own; a cell of more than most rows makes several parts, dealt by a hash, numbered parts further each."""
    dealt = kmeans.assign(base, kmeans.train(base, parts, rounds))
    shares = dealt.groupBy("cid").agg(F.ceil(F.count("*") / most).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("vec_id"), F.col("shares")).cast("int")
    return dealt.join(shares, "cid").withColumn("part", F.col("cid") + share * parts).drop("cid", "shares").select(*base.columns, "part")


def within_bounds(base: DataFrame, most: int, each: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """base, and its parts' sizes: if a part has more than most rows, all of more than each (most without it) are dealt by a hash to several.

    Those are numbered on from the largest part's number, once round for each share, and of about the same size.
    """
    sizes = {r["part"]: r["count"] for r in base.groupBy("part").count().collect()}
    if max(sizes.values(), default=0) <= most:
        return base, sizes
    shares = {part: -(-n // (each or most)) for part, n in sizes.items() if part is not None}
    after = max(shares) + 1
    dealt = base.sparkSession.createDataFrame(pa.table({"of": pa.array(shares, pa.int32()), "shares": pa.array(shares.values(), pa.int32())}))
    share = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("shares")).cast("int")
    found = base.join(F.broadcast(dealt), F.col("part") == F.col("of")).withColumn("part", F.col("part") + share * F.lit(after))
    return found.select(*base.columns), {part + i * after: sizes[part] // n for part, n in shares.items() for i in range(n)}
