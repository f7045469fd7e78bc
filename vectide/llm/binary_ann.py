"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: projections that iterative quantisation has rotated (principal axes, then rotations that
bring the sample's signs closest to its values), several rotations side by side, BITS signs in
all. They are learned from a sample of SAMPLE rows at most, taken by a hash of vec_id; every row
is indexed. Index: codes are cut into TABLES substrings of WORD bits, each with a table of its
own, which is cut by the first bits of the substring into slices of about TABLE_ROWS rows (a
slice that stays larger, since many rows share a key, is dealt out further).

Search: two codes that are at most TABLES * (t + 1) - 1 bits apart are at most t bits apart in
some substring. So a query goes, in each table, to the slices that have keys up to t bits off its
own, and there probes these keys alone: this retrieves every code within that radius. Tables and
queries meet in a shuffle on the slice; in a task queries stream past one slice. A pair is sent on
by the first of the tables that retrieve it; the CANDIDATES nearest by whole codes (and all that
are as near as the last) are ranked by cosine on the original vectors.

The level t follows each query's own neighbours: a row as near as the last neighbour found is
retrieved at level t with a probability that follows from their angle, and t has to make that
1 - MISS at least. All queries start at one level, which the sample suggests; those whose
neighbours turn out to be so far off that it is less than 1 - AGAIN go a second time, at the level
they need. So queries with
near neighbours probe few keys, and those without any pay for it.

Equal vectors are one class: indexed and searched once, with the k + 1 smallest ids as members.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take
no part; vectors of different lengths raise ValueError; rows that share a query's vec_id are not
its candidates; rows that repeat a vec_id with its vector count once; ties go to the smaller
vec_id; an empty table, or one without queries, gives no rows. Long vectors make longer rows and
nothing else. Of the table's columns only vec_id and embedding are read, whatever others are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, low_hash, shuffle_partitions

TABLES, WORD = 20, 16
BITS = TABLES * WORD
SAMPLE, SAMPLE_QUERIES, ROUNDS, SEED = 20_000, 200, 20, 42
#: Rows of a slice of a table, at most about so many.
TABLE_ROWS = 1 << 17
CANDIDATES = 320
#: How likely a neighbour as near as the last one found may be missed, and from what likelihood on a query goes again.
MISS, AGAIN = 0.06, 0.12

_ONES = np.bitwise_count(np.arange(1 << WORD, dtype=np.uint16))
#: Masks by their number of ones, and how many have at most t.
_MASKS = np.argsort(_ONES, kind="stable").astype(np.int64)
_UP_TO = np.cumsum(np.bincount(_ONES))


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projections (dimensions x bits) of the codes."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(sample.T, bias=True).reshape(sample.shape[1], -1))
    values = (sample - centre) @ axes
    found = []
    while sum(x.shape[1] for x in found) < bits:
        turn, _ = np.linalg.qr(rng.normal(size=(values.shape[1],) * 2))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(values.T @ np.where(values @ turn > 0, 1.0, -1.0))
            turn = u @ v
        found.append(axes @ turn)
    return centre, np.concatenate(found, axis=1)[:, :bits]


def codes_of(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    centre, projections = model
    # summed component by component, so that a vector's code doesn't depend on its batch
    values = np.zeros((len(vectors), projections.shape[1]))
    for x, p in zip((vectors - centre).T, projections, strict=True):
        values += x[:, None] * p
    return np.packbits(values > 0, axis=1, bitorder="little").view("<u2")


def least_cosines(miss: float = MISS, tables: int = TABLES) -> list[float]:
    """For each level, the least cosine of a row that it misses with probability miss at most."""

    def missed(cosine: float, level: int) -> float:
        p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
        return (1 - sum(math.comb(WORD, i) * p**i * (1 - p) ** (WORD - i) for i in range(level + 1))) ** tables

    out = []
    for level in range(WORD):
        low, high = -1.0, 1.0
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (low, middle) if missed(middle, level) <= miss else (middle, high)
        out.append(high)
    return [*out, -2.0]


def level_for(cosine: float | None, least: list[float]) -> int:
    """The lowest level for neighbours of a cosine; the last one retrieves everything."""
    return WORD if cosine is None else next(t for t, c in enumerate(least) if cosine >= c)


class Slice:
    """Rows of the table of the substring at place: found by their keys, in order of these."""

    def __init__(self, place: int, codes: np.ndarray):
        keys = codes[:, place].astype(np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.place, self.codes = place, np.ascontiguousarray(codes[self.order])
        self.whole = self.codes.view(np.uint64)
        self.keys, counts = np.unique(keys, return_counts=True)
        self.ends = np.zeros(1 << WORD, np.int64)
        self.ends[self.keys] = np.cumsum(counts)
        self.sizes = np.zeros(1 << WORD, np.int64)
        self.sizes[self.keys] = counts

    def probe(self, code: np.ndarray, level: int, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(rows, bits apart) of all that this table is the first one to retrieve, or of the most nearest it retrieves."""
        own = int(code[self.place])
        if _UP_TO[level] < len(self.keys):
            hit = _MASKS[: _UP_TO[level]] ^ own
            hit = hit[self.sizes[hit] > 0]
        else:  # fewer keys than probes
            hit = self.keys[np.bitwise_count((self.keys ^ own).astype(np.uint16)) <= level]
        sizes = self.sizes[hit]
        rows = np.repeat(self.ends[hit] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        apart = np.bitwise_count(self.whole[rows] ^ np.ascontiguousarray(code).view(np.uint64)).sum(axis=1, dtype=np.int64)
        if most and len(rows) > most:
            near = apart <= np.partition(apart, most - 1)[most - 1]
            rows, apart = rows[near], apart[near]
        if self.place:
            first = ~(np.bitwise_count(self.codes[rows, : self.place] ^ code[: self.place]) <= level).any(axis=1)
            rows, apart = rows[first], apart[first]
        return self.order[rows], apart


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, in double precision."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def encoded(base: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(vec_id, v, class, code); class is a 128-bit hash of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)) + 0.0  # no negative zeros
            codes = codes_of(x / np.linalg.norm(x, axis=1, keepdims=True), model)
            names = [xxhash.xxh3_128_digest(r.tobytes()) for r in x]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "v", "class", "code"])

    return base.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, class binary, code binary")


def _places(coded: DataFrame, bits: int, *columns: str) -> DataFrame:
    """A row for each table, with the table's number (place) and the first bits of the code's substring (head)."""
    key = F.expr("conv(hex(concat(substring(code, 2 * place + 2, 1), substring(code, 2 * place + 1, 1))), 16, 10)").cast("int")
    each = coded.select(*columns, "code", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("place"))
    return each.withColumn("head", F.shiftright(key, WORD - bits))


def retrieve(stored: DataFrame, asked: DataFrame, rows: int, candidates: int = CANDIDATES, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(query, class, apart): of stored (class, code) what probing retrieves for asked (class, code, level).

    At least the candidates nearest by code of each query, if so many are retrieved.
    """
    bits = min(WORD, max(0, math.ceil(math.log2(max(1, rows / table_rows)))))
    left = _places(stored, bits, "class")
    shares = left.groupBy("place", "head").agg(F.ceil(F.count("*") / table_rows).cast("int").alias("shares"))
    slot = F.struct("place", "head", "share").alias("slot")
    dealt = left.join(shares, ["place", "head"]).withColumn("share", F.pmod(F.xxhash64("class"), F.col("shares")).cast("int"))
    visits = _places(asked, bits, "class", "level").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1)))).where(F.expr("bit_count(head ^ other) <= level"))
    sent = visits.select("class", "code", "level", "place", F.col("other").alias("head")).join(shares, ["place", "head"])
    sent = sent.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    both = dealt.select(slot, F.lit(-1).alias("level"), "class", "code").unionByName(sent.select(slot, "level", "class", "code"))
    parts = max(shuffle_partitions(stored.sparkSession), -(-rows * TABLES // table_rows))
    met = both.repartition(parts, "slot").sortWithinPartitions("slot", "level").select("slot.place", "slot.head", "slot.share", "level", "class", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, codes, table = None, [], [], None
        for batch in batches:
            slots = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            levels, own = batch.column(3).to_numpy(), batch.column(4).to_pylist()
            every = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u2").reshape(len(own), -1)
            out_q, out_c, out_d = [], [], []
            cuts = [0, *(np.flatnonzero((np.diff(slots, axis=0) != 0).any(axis=1)) + 1).tolist(), len(own)] if own else []
            for a, b in zip(cuts, cuts[1:]):
                if now is None or (slots[a] != now).any():
                    now, names, codes, table = slots[a], [], [], None
                middle = a + int((levels[a:b] < 0).sum())
                names += own[a:middle]
                codes.append(every[a:middle])
                if middle == b or not names:
                    continue
                if table is None:
                    table = Slice(int(now[0]), np.concatenate(codes))
                for i in range(middle, b):
                    found, apart = table.probe(every[i], int(levels[i]), candidates)
                    out_q += [own[i]] * len(found)
                    out_c += [names[f] for f in found.tolist()]
                    out_d += apart.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.binary()), pa.array(out_c, pa.binary()), pa.array(out_d, pa.int32())], names=["query", "class", "apart"])

    found = met.mapInArrow(run, "query binary, class binary, apart int")
    return found.withColumn("n", F.rank().over(Window.partitionBy("query").orderBy("apart"))).where(F.col("n") <= candidates).drop("n")


def _dot(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, is_query: F.Column, k: int = 5, candidates: int = CANDIDATES, sample: int = SAMPLE, miss: float = MISS, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among all other rows."""
    base = usable(vectors)
    spark = vectors.sparkSession
    shape = base.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if shape["low"] != shape["high"]:
        raise ValueError("the vectors have different lengths")
    if not shape["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = base.where(low_hash("vec_id", sample, shape["n"])).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    some = _matrix(drawn.column(0).combine_chunks())
    some /= np.linalg.norm(some, axis=1, keepdims=True)
    model, least = learn(some), least_cosines(miss)
    near = np.sort(some[:SAMPLE_QUERIES] @ some.T, axis=1)[:, -k - 1] if len(some) > k else []
    start = int(np.quantile([level_for(float(c), least) for c in near] or [WORD], 0.2))

    rows = checkpointed(encoded(base, model))
    once = rows.groupBy("vec_id", "class").count()
    order = Window.partitionBy("class").orderBy("vec_id")
    members = checkpointed(once.select("vec_id", "class", F.row_number().over(order).alias("n")).where(F.col("n") <= k + 1))
    classes = checkpointed(rows.groupBy("class").agg(F.first("code").alias("code"), F.first("v").alias("v"), F.min("vec_id").alias("least")).withColumn("norm", F.sqrt(_dot("v", "v"))))
    queries = once.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("class").alias("query"))
    asked = classes.join(queries.select(F.col("query").alias("class")).distinct(), "class", "left_semi")
    own = asked.select(F.col("class").alias("query"), F.col("v").alias("qv"), F.col("norm").alias("qnorm"))

    def nearest(asked: DataFrame) -> DataFrame:
        """(query, vec_id, score, rk): the k + 1 nearest rows of each asked class, itself included."""
        found = retrieve(classes.select("class", "code"), asked.select("class", "code", "level"), shape["n"], candidates, table_rows)
        scored = found.join(classes.select("class", "v", "norm", "least"), "class").join(own, "query").withColumn("score", _dot("qv", "v") / (F.col("qnorm") * F.col("norm")))
        best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
        few = scored.select("query", "class", "score", "least").withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k + 1)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        every = few.select("query", "class", "score").join(members.select("class", "vec_id"), "class")
        return checkpointed(every.select("query", "vec_id", "score").withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k + 1))

    first = nearest(asked.withColumn("level", F.lit(start)))
    last = first.where(F.col("rk") == k + 1).select(F.col("query").alias("class"), F.col("score").alias("last"))
    level = F.lit(WORD)
    for t in range(WORD, -1, -1):
        level = F.when(F.col("last") >= least[t], t).otherwise(level)
    far = F.coalesce(F.col("last") < least_cosines(max(miss, AGAIN))[start], F.lit(True))
    again = checkpointed(asked.join(last, "class", "left").withColumn("level", level).where(far & (F.col("level") > start)))
    done = first
    if not again.isEmpty():
        second = nearest(again)
        done = first.join(second.select("query").distinct(), "query", "left_anti").unionByName(second)
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = queries.join(done.select("query", "vec_id", "score"), "query").where("vec_id <> query_id")
    return found.select("query_id", F.row_number().over(ranks).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
