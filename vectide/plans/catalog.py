"""Named queries over the synthetic tables, each with the DuckDB SQL that gives the same rows.

Queries are the vectors whose vec_id is divisible by 20, against all. Distances are rounded to
six places, ranks taken before. Sizes fit the tables: 16 cells and words, 8 sub-spaces. Centres
are rounded each round, so that both engines take the same course.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import kept, shared_folder
from ..operators import evaluate, flat, hnsw, kmeans, partition, pq, sq
from ..operators.ivf import IVFIndex, IVFPQIndex
from ..operators.topk import merge_top_k
from ..sources import fbin
from . import oracle as o

K, CELLS, ROUNDS, NPROBE, M, WORDS, WIDTH, PQ_ROUNDS, P, PARTS = 10, 16, 3, 4, 8, 16, 8, 2, 50, 3
EPS = 0.75
#: Without a width a beam holds every node, which makes a graph search exact.
WIDE = None

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def named(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def asked(base: DataFrame) -> DataFrame:
    return flat.queries_of(base, F.col("vec_id") % 20 == 0)


def rounded(x: Column) -> Column:
    """x to six places as DuckDB's round gives it, halves of x * 1e6 away from zero; F.round goes through a decimal's text for each row."""
    y = x * F.lit(1e6)
    near = F.rint(y)  # halves to even
    whole = F.when(F.abs(y - near) == 0.5, y + F.signum(y) * F.lit(0.5)).otherwise(near)
    return F.when(F.abs(y) == float("inf"), x).otherwise(whole / F.lit(1e6))


def shown(found: DataFrame) -> DataFrame:
    return found.withColumn("dist", rounded(F.col("dist")) + F.lit(0.0)).select("qid", "vec_id", "dist", "rk")


# exact search


@named(o.knn(K))
def knn_ip_exact(base):
    return shown(flat.FlatIndex(base).search(asked(base), K))


@named(o.knn(K, o.L2))
def knn_l2_exact(base):
    return shown(flat.FlatIndex(base, "l2").search(asked(base), K))


@named(o.knn(K))
def knn_ip_kernel(base):
    return shown(flat.nearest(base, asked(base), K))


@named(o.knn(K))
def knn_ip_blocks(base):
    return shown(flat.nearest_in_blocks(base, asked(base), K))


@named(o.knn(K, rows="SELECT * FROM e WHERE label < 5"))
def knn_ip_filtered(base):
    return shown(flat.FlatIndex(base).search(asked(base), K, where=F.col("label") < 5))


@named(o.knn(K, rows="SELECT * FROM e WHERE label <> 7"))
def knn_after_delete(base):
    return shown(flat.FlatIndex(base).delete(base.where("label = 7").select("vec_id")).search(asked(base), K))


@named(
    o.knn(
        K,
        rows="SELECT vec_id, v FROM e WHERE label <> 3 UNION ALL SELECT vec_id, list_transform(v, lambda x: -x) FROM e WHERE label = 3"
        " UNION ALL SELECT vec_id + 1000000000, v FROM e WHERE label = 4",
    )
)
def knn_after_upsert(base):
    turned = base.where("label = 3").withColumn("embedding", F.transform("embedding", lambda x: -x))
    added = base.where("label = 4").withColumn("vec_id", F.col("vec_id") + 1_000_000_000)
    return shown(flat.FlatIndex(base).upsert(turned.unionByName(added)).search(asked(base), K))


@named("SELECT vec_id, CAST(i - 1 AS INT) AS i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings WHERE vec_id = 42)")
def vector_lookup(base):
    return flat.FlatIndex(base).get(42).select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


@named(o.query(f"d AS (SELECT qid, vec_id, {o.IP} AS dist FROM q, e)", end=o.result("d", f"dist <= {EPS}")))
def range_search_eps(base):
    return shown(flat.within(base, asked(base), EPS))


@named(o.query(f"d AS (SELECT qid, vec_id, {o.IP} AS dist FROM q, e)", end=o.result("d", f"(dist <= {EPS} OR rk <= 3) AND rk <= 8")))
def range_search_bounded(base):
    return shown(flat.within(base, asked(base), EPS, least_rows=3, most=8))


@named(
    o.query(
        f"d AS (SELECT qid, vec_id, label, {o.IP} AS dist FROM q, e)",
        f"d2 AS ({o.numbered('d')})",
        "f AS (SELECT qid, label, min(rk) AS first FROM d2 GROUP BY qid, label)",
        "f2 AS (SELECT qid, first FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) AS i FROM f) WHERE i = 5)",
        end="SELECT d2.qid, vec_id, label AS doc_id, round(dist, 6) + 0.0 AS dist, rk FROM d2 LEFT JOIN f2 USING (qid) WHERE first IS NULL OR rk < first",
    )
)
def knn_multi_vector_docs(base):
    return flat.by_documents(base, asked(base), 4, "label").withColumn("dist", F.round("dist", 6) + F.lit(0.0))


@named(o.knn(K))
def merge_topk_partitions(base):
    parts = partition.by_range(base, PARTS)
    return shown(merge_top_k([flat.nearest(parts.where(F.col("part") == i), asked(base), K) for i in range(PARTS)], K))


# scalar quantisation


@named(o.query(*o.SQ[:1], end="SELECT gmin, gs AS gscale, CAST(d AS INT) AS dim FROM g"))
def sq_train(base):
    return sq.train(base)


@named(o.query(*o.SQ[:2], end="SELECT vec_id, CAST(i - 1 AS INT) AS i, CAST(x AS INT) AS x, CAST(cs AS INT) AS code_sum FROM (SELECT vec_id, cs, generate_subscripts(code, 1) AS i, unnest(code) AS x FROM sc)"))
def sq_encode(base):
    return sq.SQIndex.build(base).coded.select("vec_id", "code_sum", F.posexplode("code").alias("i", "x")).withColumn("x", F.col("x").cast("int"))


@named(o.query(*o.SQ, end=o.result("d", f"rk <= {P}")))
def sq_coarse(base):
    return shown(sq.SQIndex.build(base).coarse(asked(base), P))


@named(o.query(*o.SQ, *o.reranked(P), end=o.result("x", f"rk <= {K}")))
def sq_coarse_rerank(base):
    return shown(sq.SQIndex.build(base).search(asked(base), K, P))


def _nearest_codes(base: DataFrame, score) -> DataFrame:
    coded = sq.SQIndex.build(base).coded
    return shown(sq.nearest_codes(coded, coded.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("code").alias("qv")), K, score))


@named(o.query(*o.SQ[:3], "d AS (SELECT qid, vec_id, list_sum(list_transform(list_zip(qc, code), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::DOUBLE AS dist FROM sq, sc)", end=o.result("d", f"rk <= {K}")))
def l2_uint8_codes(base):
    return _nearest_codes(base, sq.code_l2)


@named(o.query(*o.SQ[:3], "d AS (SELECT qid, vec_id, -list_dot_product(qc::DOUBLE[], code::DOUBLE[]) AS dist FROM sq, sc)", end=o.result("d", f"rk <= {K}")))
def ip_uint8_codes(base):
    return _nearest_codes(base, sq.code_ip)


# cells


def _centres(base: DataFrame, centres: list[list[float]]) -> DataFrame:
    rows = [(c, i, float(x)) for c, v in enumerate(centres) for i, x in enumerate(v)]
    return base.sparkSession.createDataFrame(rows, "cid long, i long, x double").withColumn("x", F.round("x", 6) + F.lit(0.0))


def _centres_sql(rounds: int) -> str:
    return o.query(*o.cells(CELLS, rounds), end=f"SELECT cid, i - 1 AS i, round(x, 6) + 0.0 AS x FROM (SELECT cid, generate_subscripts(c, 1) AS i, unnest(c) AS x FROM c{rounds})")


@named(_centres_sql(0))
def kmeans_seed(base):
    return _centres(base, kmeans.seeds(base, CELLS))


@named(_centres_sql(ROUNDS))
def kmeans_centroids(base):
    return _centres(base, kmeans.train(base, CELLS, ROUNDS, digits=6))


def _ivf(base: DataFrame, rounds: int = ROUNDS) -> IVFIndex:
    return IVFIndex.build(base, CELLS, rounds, digits=6)


@named(o.query(*o.cells(CELLS, ROUNDS), end="SELECT vec_id, CAST(cid AS INT) AS cid FROM a"))
def ivf_assign(base):
    return _ivf(base).postings.select("vec_id", "cid")


@named(o.query(*o.cells(CELLS, ROUNDS), end="SELECT CAST(cid AS INT) AS cid, count(*) AS n FROM a GROUP BY cid"))
def ivf_cell_sizes(base):
    return _ivf(base).postings.groupBy("cid").agg(F.count("*").alias("n"))


@named(o.query(*o.cells(CELLS, ROUNDS), o.probes(ROUNDS, NPROBE), end="SELECT qid, CAST(cid AS INT) AS cid, round(dist, 6) + 0.0 AS dist, rk FROM p"))
def ivf_probe_cells(base):
    return _ivf(base).probes(asked(base), NPROBE).drop("qv").withColumn("dist", F.round("dist", 6) + F.lit(0.0))


IVF = f"d AS (SELECT p.qid, a.vec_id, {o.IP} AS dist FROM p JOIN a USING (cid))"
IVF_SQL = o.query(*o.cells(CELLS, ROUNDS), o.probes(ROUNDS, NPROBE), IVF, end=o.result("d", f"rk <= {K}"))


@named(IVF_SQL)
def ivf_search(base):
    return shown(_ivf(base).search(asked(base), K, NPROBE))


@named(o.knn(K))
def ivf_full_probe_equals_exact(base):
    return shown(_ivf(base).search(asked(base), K, CELLS))


# product quantisation

BOOKS = o.books(M, WORDS, WIDTH, PQ_ROUNDS)


def _pq(base: DataFrame) -> pq.PQIndex:
    return pq.PQIndex.build(base, M, WORDS, PQ_ROUNDS, digits=6)


@named(o.query(*BOOKS, end=f"SELECT m, k, i - 1 AS i, round(x, 6) + 0.0 AS x FROM (SELECT m, k, generate_subscripts(c, 1) AS i, unnest(c) AS x FROM b{PQ_ROUNDS})"))
def pq_codebook(base):
    books = _pq(base).books
    rows = [(m, k, i, float(x)) for m, b in enumerate(books) for k, c in enumerate(b) for i, x in enumerate(c)]
    return base.sparkSession.createDataFrame(rows, "m long, k long, i long, x double").withColumn("x", F.round("x", 6) + F.lit(0.0))


@named(o.query(*BOOKS, end="SELECT vec_id, CAST(m AS INT) AS m, CAST(k AS INT) AS k FROM z"))
def pq_encode(base):
    return _pq(base).coded.select("vec_id", F.posexplode("codes").alias("m", "k")).withColumn("k", F.col("k").cast("int"))


@named(o.query(*BOOKS, o.lut(WIDTH, PQ_ROUNDS), end="SELECT qid, CAST(m AS INT) AS m, CAST(k AS INT) AS k, round(x / 1e9, 6) + 0.0 AS x FROM l"))
def pq_lut(base):
    tables = _pq(base).tables(asked(base)).select("qid", F.posexplode("lut").alias("m", "t"))
    return tables.select("qid", "m", F.posexplode("t").alias("k", "x")).withColumn("x", F.round(F.col("x") / 1e9, 6) + F.lit(0.0))


@named(o.query(*BOOKS, o.lut(WIDTH, PQ_ROUNDS), o.ADC, end=o.result("d", f"rk <= {P}")))
def pq_adc_topk(base):
    return shown(_pq(base).coarse(asked(base), P))


PQ_SQL = o.query(*BOOKS, o.lut(WIDTH, PQ_ROUNDS), o.ADC, *o.reranked(P), end=o.result("x", f"rk <= {K}"))


@named(PQ_SQL)
def pq_rerank(base):
    return shown(_pq(base).search(asked(base), K, P))


IVFPQ = [*o.cells(CELLS, ROUNDS), o.probes(ROUNDS, NPROBE), *BOOKS, o.lut(WIDTH, PQ_ROUNDS), o.ADC_PROBED]


def _ivfpq(base: DataFrame) -> IVFPQIndex:
    return IVFPQIndex.build(base, CELLS, M, WORDS, ROUNDS, 6, PQ_ROUNDS)


@named(o.query(*IVFPQ, end=o.result("d", f"rk <= {K}")))
def ivfpq_adc(base):
    return shown(_ivfpq(base).search(asked(base), K, NPROBE))


@named(o.query(*IVFPQ, *o.reranked(P), end=o.result("x", f"rk <= {K}")))
def ivfpq_rerank(base):
    return shown(_ivfpq(base).search(asked(base), K, NPROBE, P))


PART = f"CAST(floor(((cid + 1) * {PARTS} - 1) / {CELLS}) AS INT)"


@named(
    o.query(
        *IVFPQ,
        f"t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, {PART} ORDER BY dist, vec_id) AS rk FROM d) WHERE rk <= 12)",
        f"x AS (SELECT t.qid, t.vec_id, {o.IP} AS dist FROM t JOIN q USING (qid) JOIN e USING (vec_id))",
        end=o.result("x", f"rk <= {K}"),
    )
)
def ivfpq_rerank_per_part(base):
    parts = base.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cid"), partition.by_blocks(F.col("id"), CELLS, PARTS).alias("part"))
    return shown(_ivfpq(base).search(asked(base), K, NPROBE, 12, parts))


# parts


@named(o.query(*o.cells(CELLS, ROUNDS), end=f"SELECT {PART} AS part, count(*) AS n FROM a GROUP BY 1"))
def partition_block_load(base):
    rows = _ivf(base).postings.withColumn("part", partition.by_blocks(F.col("cid"), CELLS, PARTS))
    return rows.groupBy("part").agg(F.count("*").alias("n"))


@named(
    o.query(
        *o.cells(CELLS, ROUNDS),
        f"s AS (SELECT {PART} AS part, count(*) AS n FROM a GROUP BY 1)",
        f"w AS (SELECT coalesce(s.n, 0) AS n FROM (SELECT unnest(range(0, {PARTS})) AS part) LEFT JOIN s USING (part))",
        end=f"SELECT round((max(n) - min(n)) / (sum(n) / {PARTS}) * 100, 6) AS imbalance FROM w",
    )
)
def partition_imbalance(base):
    rows = _ivf(base).postings.withColumn("part", partition.by_blocks(F.col("cid"), CELLS, PARTS))
    return partition.imbalance(rows, PARTS).withColumn("imbalance", F.round("imbalance", 6))


@named(
    o.query(
        *o.cells(CELLS, ROUNDS),
        "z AS (SELECT n, row_number() OVER (ORDER BY n DESC, cid DESC) AS i FROM (SELECT cid, count(*) AS n FROM a GROUP BY cid))",
        f"w AS (SELECT 0::BIGINT AS i, [0::BIGINT FOR x IN range({PARTS})] AS load UNION ALL SELECT z.i, list_transform(range(1, {PARTS} + 1),"
        " lambda p: load[p] + CASE WHEN p = list_position(load, list_min(load)) THEN z.n ELSE 0 END) FROM w JOIN z ON z.i = w.i + 1)",
        end=f"SELECT CAST(p - 1 AS INT) AS part, load[p] AS n FROM (SELECT load FROM w ORDER BY i DESC LIMIT 1), (SELECT unnest(range(1, {PARTS} + 1)) AS p)",
    ).replace("WITH e", "WITH RECURSIVE e", 1)
)
def partition_balanced_load(base):
    index = _ivf(base)
    dealt = partition.balanced(index.postings.groupBy("cid").agg(F.count("*").alias("n")), PARTS)
    return index.postings.join(dealt, "cid").groupBy("part").agg(F.count("*").alias("n"))


# evaluation


def _recall_sql(found: str, mean: bool) -> str:
    per = f"SELECT qid, CAST(count(f.vec_id) AS DOUBLE) / {K} AS recall FROM ({o.knn(K)}) t LEFT JOIN ({found}) f USING (qid, vec_id) GROUP BY qid"
    return f"SELECT round(avg(recall), 6) AS recall FROM ({per})" if mean else per


@named(_recall_sql(IVF_SQL, False))
def recall_at_k_ivf(base):
    return evaluate.recall_by_query(ivf_search(base), knn_ip_exact(base), K)


@named(_recall_sql(PQ_SQL, False))
def recall_at_k_pq(base):
    return evaluate.recall_by_query(pq_rerank(base), knn_ip_exact(base), K)


@named(_recall_sql(IVF_SQL, True))
def mean_recall_ivf(base):
    return evaluate.mean_recall(ivf_search(base), knn_ip_exact(base), K).withColumn("recall", F.round("recall", 6))


def _ivf_sql(nprobe: int) -> str:
    return o.query(*o.cells(CELLS, ROUNDS), o.probes(ROUNDS, nprobe), IVF, end=o.result("d", f"rk <= {K}"))


def _sweep_sql(found: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{config}' AS config, recall FROM ({_recall_sql(sql, True)})" for config, sql in found.items())


@named(_sweep_sql({f"nprobe={n}": _ivf_sql(n) for n in (1, 4, CELLS)}))
def recall_sweep(base):
    index, queries = _ivf(base), asked(base)
    index.postings = kept(index.postings)
    found = evaluate.sweep(lambda nprobe: index.search(queries, K, nprobe), [{"nprobe": n} for n in (1, 4, CELLS)], kept(flat.nearest(base, queries, K)), K)
    return found.withColumn("recall", F.round("recall", 6))


def _pq_sql(m: int, p: int) -> str:
    width = 64 // m
    return o.query(*o.books(m, WORDS, width, 1), o.lut(width, 1), o.ADC, *o.reranked(p), end=o.result("x", f"rk <= {K}"))


@named(_sweep_sql({f"m={m}, p={p}": _pq_sql(m, p) for m in (4, 16) for p in (20, 100)}))
def pq_recall_sweep(base):
    """Sub-spaces by rows ranked again, the tables' vectors having 64 components."""
    queries = asked(base)
    built = {m: pq.PQIndex.build(base, m, WORDS, 1, digits=6) for m in (4, 16)}
    found = evaluate.sweep(lambda m, p: built[m].search(queries, K, p), [{"m": m, "p": p} for m in built for p in (20, 100)], kept(flat.nearest(base, queries, K)), K)
    return found.withColumn("recall", F.round("recall", 6))


@named("SELECT CAST(k AS INT) AS k, CAST(m AS INT) AS m, true AS in_table FROM (SELECT unnest(range(0, 16)) AS k), (SELECT unnest(range(0, 8)) AS m)")
def pq_weighted_seeding(base):
    """Distance-weighted seeds are sub-vectors of the table."""
    rows = [(k, m, s) for m in range(M) for k, s in enumerate(kmeans.weighted_seeds(base, WORDS, part=slice(m * WIDTH, (m + 1) * WIDTH), seed=42 + m))]
    drawn = base.sparkSession.createDataFrame(rows, "k int, m int, s array<double>")
    subs = base.select(F.posexplode(F.array(*(F.slice("embedding", m * WIDTH + 1, WIDTH).cast("array<double>") for m in range(M)))).alias("m", "s")).distinct()
    return drawn.join(subs.withColumn("known", F.lit(True)), ["m", "s"], "left").select("k", "m", F.coalesce("known", F.lit(False)).alias("in_table"))


# graphs


@named(o.knn(K))
def hnsw_exhaustive(base):
    return shown(hnsw.HNSWIndex.build(base, parts=2).search(asked(base), K, WIDE))


@named(o.knn(K, o.L2))
def hnsw_l2_exhaustive(base):
    return shown(hnsw.HNSWIndex.build(base, parts=2, by="l2").search(asked(base), K, WIDE))


@named(o.knn(K, rows="SELECT * FROM e WHERE vec_id % 3 = 1"))
def hnsw_filtered_exhaustive(base):
    return shown(hnsw.HNSWIndex.build(base, parts=2).search(asked(base), K, WIDE, where=F.col("vec_id") % 3 == 1))


@named(o.knn(K, rows="SELECT * FROM e WHERE label <> 7"))
def hnsw_after_delete(base):
    return shown(hnsw.HNSWIndex.build(base, parts=2).delete(base.where("label = 7")).search(asked(base), K, WIDE))


@named(SQL["knn_after_upsert"])
def hnsw_after_upsert(base):
    turned = base.where("label = 3").withColumn("embedding", F.transform("embedding", lambda x: -x))
    added = base.where("label = 4").withColumn("vec_id", F.col("vec_id") + 1_000_000_000)
    return shown(hnsw.HNSWIndex.build(base, parts=2).upsert(turned.unionByName(added)).search(asked(base), K, WIDE))


@named(o.knn(K))
def hnsw_parallel_frontier(base):
    return shown(hnsw.HNSWIndex.build(base, parts=2).search(asked(base), K, WIDE, frontier=8))


@named(o.knn(K))
def hnsw_range_parts(base):
    return shown(hnsw.HNSWIndex.build(partition.by_range(base, PARTS)).search(asked(base), K, WIDE))


@named(o.knn(K))
def hnsw_kmeans_parts(base):
    return shown(hnsw.HNSWIndex.build(partition.by_kmeans(base, PARTS)).search(asked(base), K, WIDE))


@named()
def hnsw_approximate(base):
    return shown(hnsw.HNSWIndex.build(base).search(asked(base), K, 50))


SWEPT = [{"width": w, "frontier": f} for w in (50, 100, 200) for f in (1, 8, 32)]


@named(" UNION ALL ".join(f"SELECT '{evaluate.named(c)}' AS config, true AS found, true AS timed" for c in SWEPT))
def hnsw_recall_sweep(base):
    """Widths by nodes expanded at a time: recall of 0.9 at least, and the speed-up over the first."""
    index, queries = hnsw.HNSWIndex.build(base), asked(base)
    found = evaluate.timed_sweep(lambda width, frontier: index.search(queries, K, width, frontier=frontier), SWEPT, flat.nearest(base, queries, K), K)
    return found.select("config", (F.col("recall") >= 0.9).alias("found"), ((F.col("query_us") > 0) & (F.col("speed_up") > 0)).alias("timed"))


@named("SELECT 0::BIGINT AS to_self, 0::BIGINT AS repeated, 0::BIGINT AS to_none, true AS reached, true AS capped")
def hnsw_integrity(base):
    checked = hnsw.integrity(hnsw.HNSWIndex.build(base, parts=2).nodes)
    return checked.select("to_self", "repeated", "to_none", (F.col("least_in") > 0).alias("reached"), (F.col("links") <= 33 * F.lit(base.count())).alias("capped"))


@named("SELECT vec_id AS qid, true AS walked, true AS fewer FROM embeddings WHERE vec_id % 20 = 0")
def hnsw_effort(base):
    """A narrow beam expands nodes and takes fewer distances than there are rows."""
    found = hnsw.HNSWIndex.build(base, parts=1).effort(asked(base), K, 10)
    return found.select("qid", (F.col("hops") > 0).alias("walked"), (F.col("distances") < base.count()).alias("fewer"))


@named(SQL["range_search_eps"])
def hnsw_range_exhaustive(base):
    n = base.count()
    return shown(hnsw.HNSWIndex.build(base, parts=2).within(asked(base), EPS, least=n, most=n))


@named(SQL["knn_multi_vector_docs"])
def hnsw_multi_vector_docs(base):
    found = hnsw.HNSWIndex.build(base, parts=2).by_documents(asked(base), base.select("vec_id", F.col("label").alias("doc_id")), 4, None)
    return found.withColumn("dist", F.round("dist", 6) + F.lit(0.0))


def _folder(base: DataFrame) -> str:
    return f"{shared_folder(base.sparkSession)}/catalog-{uuid.uuid4().hex}"


@named(o.knn(K))
def hnsw_saved_and_loaded(base):
    path = _folder(base)
    hnsw.HNSWIndex.build(base, parts=2).save(path)
    return shown(hnsw.HNSWIndex.load(base.sparkSession, path).search(asked(base), K, WIDE))


@named(o.knn(K))
def flat_saved_and_loaded(base):
    path = _folder(base)
    flat.FlatIndex(base).save(path)
    return shown(flat.FlatIndex.load(base.sparkSession, path).search(asked(base), K))


@named("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, CAST(list_sum(embedding::DOUBLE[]) * 1000 AS BIGINT) AS total, len(embedding) AS size FROM embeddings")
def matrix_files(base):
    """The table's vectors in the order of vec_id, through several binary matrix files."""
    path = _folder(base)
    fbin.write(base, path, files=3)
    v = F.col("embedding").cast("array<double>")
    found = fbin.read(base.sparkSession, path)
    return found.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) * 1000).cast("long").alias("total"), F.size("embedding").cast("long").alias("size"))


@named("SELECT count(*) AS elements, count(*) FILTER (label = 7) AS deleted FROM embeddings")
def hnsw_counts(base):
    return hnsw.HNSWIndex.build(base, parts=2).delete(base.where("label = 7")).counts()


@named(IVF_SQL)
def ivf_hnsw(base):
    return shown(hnsw.CellGraphIndex.build(base, CELLS, ROUNDS, digits=6).search(asked(base), K, NPROBE, WIDE))


@named(o.query(*o.cells(CELLS, 0), o.probes(0, 2), IVF, end=o.result("d", f"rk <= {K}")))
def hnsw_on_hnsw(base):
    return shown(hnsw.CellGraphIndex.build(base, CELLS, 0, coarse=True).search(asked(base), K, 2, WIDE))
