"""Edge cases and properties of the search operators."""

import tempfile
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectide.functions.distance import dimension
from vectide.operators import blocks, evaluate, flat, graph_build, hnsw, kmeans, partition, pq, sq, topk
from vectide.operators.ivf import IVFIndex, IVFPQIndex
from vectide.plans import catalog
from vectide.sources import fbin
from vectide.streaming.search import search_stream, upsert_stream


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def vectors(spark, n=300, d=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return table(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)]).cache()


def queries(base, every=20):
    return flat.queries_of(base, F.col("vec_id") % every == 0)


def rows(df):
    return sorted((r["qid"], r["rk"], r["vec_id"]) for r in df.collect())


def test_ties_short_results_and_negative_distances(spark):
    base = table(spark, [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 0.0])])
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, qv array<float>")
    for found in (flat.nearest(base, asked, 10), flat.nearest_in_blocks(base, asked, 10), hnsw.HNSWIndex.build(base, parts=1).search(asked, 10)):
        assert [(r["vec_id"], r["dist"]) for r in found.orderBy("rk").collect()] == [(2, -4.0), (1, 0.0), (3, 0.0)]
    assert flat.nearest_in_blocks(base, asked, 1).first()["vec_id"] == 2


def test_bad_vectors_raise(spark):
    for bad in ([(1, None)], [(1, [float("nan"), 1.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, [float("inf")])]):
        with pytest.raises(ValueError):
            dimension(table(spark, bad))
    with pytest.raises(ValueError):
        pq.PQIndex.build(vectors(spark), m=3)
    with pytest.raises(ValueError):
        pq.PQIndex.build(vectors(spark), m=4, words=257)
    with pytest.raises(ValueError):
        flat.FlatIndex.build(vectors(spark), by="cosine")


def test_empty_and_single(spark):
    none = table(spark, [])
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, qv array<float>")
    assert flat.FlatIndex.build(none).search(asked).count() == 0
    assert hnsw.HNSWIndex.build(none).search(asked).count() == 0
    one = table(spark, [(7, [1.0, 0.0])])
    assert [r["vec_id"] for r in hnsw.HNSWIndex.build(one).search(asked).collect()] == [7]
    assert [r["vec_id"] for r in IVFIndex.build(one, 4, 2).search(asked, 3, 4).collect()] == [7]


def test_sq_of_equal_and_outside_components(spark):
    params = sq.train(table(spark, [(1, [2.0, 2.0])])).first().asDict()
    assert params["gscale"] == 1.0
    params = sq.train(table(spark, [(1, [0.0, 1.0])])).first().asDict()
    codes = table(spark, [(1, [-3.0, 9.0, 0.5])]).select(sq.codes(F.col("embedding"), params).alias("c")).first()["c"]
    assert codes == [0, 255, 128]


def test_wide_searches_are_exact(spark):
    base = vectors(spark)
    asked, want = queries(base), rows(flat.nearest(base, queries(base), 10))
    assert rows(flat.nearest_in_blocks(base, asked, 10)) == want
    assert rows(sq.SQIndex.build(base).search(asked, 10, 300)) == want
    assert rows(pq.PQIndex.build(base, 4, 16, 2).search(asked, 10, 300)) == want
    assert rows(IVFIndex.build(base, 8, 2).search(asked, 10, 8)) == want
    assert rows(IVFPQIndex.build(base, 8, 4, 16, 2).search(asked, 10, 8, 300)) == want
    for parts in (1, 4):
        index = hnsw.HNSWIndex.build(base, parts=parts)
        assert rows(index.search(asked, 10, 300)) == want
        assert rows(index.search(asked, 10, 300, frontier=8)) == want


def test_recall_grows(spark):
    base = vectors(spark, 1500, 16)
    asked, truth = queries(base, 50), flat.nearest(base, queries(base, 50), 10)
    index = IVFIndex.build(base, 16, 4)
    recall = lambda found: evaluate.mean_recall(found, truth, 10).first()[0]
    by_probe = [recall(index.search(asked, 10, n)) for n in (1, 4, 16)]
    assert by_probe == sorted(by_probe) and by_probe[-1] == 1.0
    graph = hnsw.HNSWIndex.build(base, parts=1)
    assert recall(graph.search(asked, 10, 100)) >= 0.95
    check = hnsw.integrity(graph.nodes).first()
    assert check["to_self"] == check["repeated"] == check["to_none"] == 0
    assert evaluate.mean_recall(truth.where("false"), truth, 10).first()[0] == 0.0


def test_cells_without_rows_keep_their_centre(spark):
    base = table(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])])
    assert kmeans.seeds(base, 5) == [[1.0, 0.0]] * 5
    moved = kmeans.lloyd(base, [[1.0, 0.0], [0.0, 1.0], [-1.0, -1.0]], 2)
    assert moved == [[1.0, 0.0], [0.0, 1.0], [-1.0, -1.0]]


def test_deletes_and_upserts(spark, tmp_path):
    base = vectors(spark, 60)
    asked = queries(base)
    gone = spark.createDataFrame([(0,), (999,)], "vec_id long")
    assert 0 not in {r[2] for r in rows(flat.FlatIndex(base).delete(gone).search(asked, 60))}
    index = hnsw.HNSWIndex.build(base, parts=2)
    with pytest.raises(KeyError):
        index.delete(gone)
    less = index.delete(gone.where("vec_id = 0"))
    with pytest.raises(ValueError):
        less.delete(gone.where("vec_id = 0"))
    with pytest.raises(ValueError):
        index.undelete(gone.where("vec_id = 0"))
    with pytest.raises(KeyError):
        less.get(0)
    assert len(less.undelete(gone.where("vec_id = 0")).get(0)) == 8
    want = rows(flat.FlatIndex(base).delete(gone).search(asked, 10))
    assert rows(less.search(asked, 10, 100)) == want
    assert tuple(less.counts().first()) == (60, 1)
    changed = table(spark, [(5, [0.5] * 8), (100, [0.25] * 8)])
    assert rows(index.upsert(changed).search(asked, 10, 100)) == rows(flat.FlatIndex(base).upsert(changed).search(asked, 10))
    with pytest.raises(ValueError):
        less.upsert(table(spark, [(0, [1.0] * 8)]), replace_deleted=True)
    assert less.upsert(table(spark, [(100, [0.25] * 8), (101, [0.5] * 8), (102, [0.1] * 8)]), replace_deleted=True).counts().first()["deleted"] == 0
    less.save(str(tmp_path / "graph"))
    assert rows(hnsw.HNSWIndex.load(spark, str(tmp_path / "graph")).search(asked, 10, 100)) == want
    less.nodes.limit(7).write.mode("append").parquet(str(tmp_path / "graph" / "nodes"))
    with pytest.raises(ValueError, match="damaged"):
        hnsw.HNSWIndex.load(spark, str(tmp_path / "graph"))
    flat.FlatIndex(base).save(str(tmp_path / "flat"))
    assert rows(flat.FlatIndex.load(spark, str(tmp_path / "flat")).search(asked, 3)) == rows(flat.nearest(base, asked, 3))
    ivf = IVFIndex.build(base, 4, 2)
    ivf.save(str(tmp_path / "ivf"))
    assert rows(IVFIndex.load(spark, str(tmp_path / "ivf")).search(asked, 5, 2)) == rows(ivf.search(asked, 5, 2))


def test_balanced_parts(spark):
    sizes = spark.createDataFrame([(0, 10), (1, 9), (2, 2), (3, 2), (4, 1)], "cid int, n long")
    dealt = {r["cid"]: r["part"] for r in partition.balanced(sizes, 2).collect()}
    load = [sum(n for c, n in [(0, 10), (1, 9), (2, 2), (3, 2), (4, 1)] if dealt[c] == p) for p in (0, 1)]
    assert sorted(load) == [12, 12]
    got = spark.range(10).select(partition.by_blocks(F.col("id"), 10, 3).alias("p")).collect()
    assert [r["p"] for r in got] == [r for r in range(3) for _ in range((r + 1) * 10 // 3 - r * 10 // 3)]


def test_matrix_files(spark, tmp_path):
    base = vectors(spark, 30)
    path = str(tmp_path / "x")
    assert sum(r["rows"] for r in fbin.write(base, path, files=3).collect()) == 30
    assert fbin.read(spark, path).count() == 30
    one = sorted(str(p) for p in (tmp_path / "x").iterdir())
    assert len(one) == 3 and fbin.read(spark, one[0]).count() < 30
    assert sorted(map(tuple, ((r["vec_id"], *r["embedding"]) for r in fbin.read(spark, path).collect()))) == sorted((r["vec_id"], *r["embedding"]) for r in base.collect())
    whole = spark.createDataFrame([(i, [i, -i]) for i in range(5)], "vec_id long, embedding array<int>")
    fbin.write(whole, str(tmp_path / "i"), "int", files=1)
    assert sorted(map(tuple, ((r["vec_id"], *r["embedding"]) for r in fbin.read(spark, str(tmp_path / "i"), "int").collect()))) == [(i, i, -i) for i in range(5)]
    with open(one[1], "ab") as f:
        f.write(b"odd")
    with pytest.raises(ValueError, match="bytes don't hold"):
        fbin.read(spark, path)
    with pytest.raises(FileNotFoundError):
        fbin.read(spark, str(tmp_path / "none"))


def test_queries_beyond_a_broadcast(spark, monkeypatch):
    """All searches give the same for more queries than are broadcast, block by block."""
    base = vectors(spark, 400, 8)
    base = base.withColumn("doc_id", (F.col("vec_id") % 7).cast("int")).cache()
    asked = flat.queries_of(base, F.lit(True))
    scalar, product = sq.SQIndex.build(base), pq.PQIndex.build(base, 4, 16, 2)
    searches = (
        lambda: flat.nearest(base, asked, 5), lambda: flat.nearest(base, asked, 5, "l2"), lambda: flat.within(base, asked, 0.5, 2, 9), lambda: flat.within(base, asked, 0.6),
        lambda: flat.by_documents(base, asked, 3), lambda: scalar.search(asked, 5, 20), lambda: product.search(asked, 5, 20), lambda: sq.nearest_codes(scalar.coded, scalar.coded.selectExpr("vec_id as qid", "code as qv"), 5, sq.code_l2),
    )
    few = [rows(s()) for s in searches]
    for name, n in (("BROADCAST_BYTES", 100), ("QUERY_ROWS", 90), ("PART_ROWS", 70)):
        monkeypatch.setattr(blocks, name, n)
    assert [rows(s()) for s in searches] == few


def test_2500_queries(spark):
    base = vectors(spark, 2500, 4)
    asked = flat.queries_of(base, F.lit(True))
    assert sq.SQIndex.build(base).search(asked, 3, 10).count() == 7500
    assert pq.PQIndex.build(base, 2, 8, 1).search(asked, 3, 10).count() == 7500
    assert flat.within(base, asked, 0.0).where("qid = vec_id").count() > 1000
    assert flat.by_documents(base.withColumn("doc_id", F.col("vec_id") % 2), asked, 1).select("qid").distinct().count() == 2500


def test_equal_vectors_share_a_cell():
    x = np.random.default_rng(3).normal(size=(500, 16))
    centres = np.concatenate((x[:20], x[:20], x[:20]))
    assert (kmeans.nearest_cells(x, centres) == kmeans.nearest_cells(x, x[:20])).all()
    assert (kmeans.nearest_cells(np.repeat(x, 3, axis=0), x[:20]).reshape(500, 3) == kmeans.nearest_cells(x, x[:20])[:, None]).all()


def test_places_of_scattered_ids(spark, monkeypatch):
    ids = [i * i * i - 10**9 * (i % 3) for i in range(250)]
    base = spark.createDataFrame([(i, [1.0]) for i in ids], "vec_id long, embedding array<float>")
    for n in (None, 2_500_000):  # one bucket, and 25
        got = {r["vec_id"]: r["at"] for r in kmeans.numbered(base, n).collect()}
        assert got == {v: at for at, v in enumerate(sorted(ids))}


def test_weighted_seeds(spark):
    base = table(spark, [(i, [1.0, 0.0]) for i in range(50)] + [(100, [0.0, 1.0]), (101, [-1.0, 0.0])])
    assert {tuple(s) for s in kmeans.weighted_seeds(base, 3)} == {(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0)}
    assert kmeans.weighted_seeds(base, 3) == kmeans.weighted_seeds(base, 3)
    same = table(spark, [(i, [1.0, 0.0]) for i in range(5)])
    assert kmeans.weighted_seeds(same, 3) == [[1.0, 0.0]] * 3
    base = vectors(spark, 600, 16)
    truth = flat.nearest(base, queries(base), 10)
    assert evaluate.mean_recall(pq.PQIndex.build(base, 4, 64, 4, weighted=True).search(queries(base), 10, 100), truth, 10).first()[0] >= 0.8


def test_stop_conditions(spark):
    base = vectors(spark, 400, 8).withColumn("doc_id", (F.col("vec_id") % 9).cast("int"))
    asked = queries(base)
    index = hnsw.HNSWIndex.build(base, parts=2)
    assert rows(index.within(asked, 0.4, least=400, most=400)) == rows(flat.within(base, asked, 0.4))
    few = index.within(asked, 0.4, least=1, most=5)
    assert few.where("dist > 0.4").count() == 0 and few.groupBy("qid").count().where("count > 5").count() == 0
    truth = flat.within(base, asked, 0.4)
    near = index.within(asked, 0.4, least=30, most=400)
    assert near.join(truth, ["qid", "vec_id"]).count() >= 0.95 * truth.count()
    assert rows(index.by_documents(asked, base, 3, None)) == rows(flat.by_documents(base, asked, 3))
    docs = index.by_documents(asked, base, 3, 9)
    assert docs.groupBy("qid").agg(F.countDistinct("doc_id").alias("n")).where("n > 3").count() == 0
    assert rows(index.search(asked, 10, None)) == rows(flat.nearest(base, asked, 10))
    narrow, wide = (index.effort(asked, 5, w).agg(F.sum("hops"), F.sum("distances")).first() for w in (5, 100))
    assert 0 < narrow[0] < wide[0] and 0 < narrow[1] < wide[1]


def one_way(spark):
    """A graph whose entry, node 0, links to node 1 and that to none; and another part of one node. Queries descend to node 1."""
    rows = [(0, 0, 10, 1, False, [1.0, 0.0], [[1], [1]]), (0, 1, 11, 1, False, [0.0, 1.0], [[], []]), (1, 0, 12, 0, False, [0.5, 0.0], [[]])]
    return hnsw.HNSWIndex(spark.createDataFrame(rows, hnsw.NODES), 16, 200, "ip")


def _reloaded(index, asked):
    path = f"{tempfile.mkdtemp()}/graph"
    index.save(path)
    return hnsw.HNSWIndex.load(asked.sparkSession, path).search(asked, 10, None)


#: Searches, by the catalogue's queries that make them, through a beam that holds all: what they find from (0, 2).
WHOLE = {
    "hnsw_after_delete": (lambda i, q: i.delete(i.nodes.where("vec_id = 11")).search(q, 10, None), [10, 12]),
    "hnsw_after_upsert": (lambda i, q: i.upsert(i.nodes.where("vec_id = 12").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))).search(q, 10, None), [11, 10, 12]),
    "hnsw_exhaustive": (lambda i, q: i.search(q, 10, None), [11, 10, 12]),
    "hnsw_filtered_exhaustive": (lambda i, q: i.search(q, 10, None, where=F.col("vec_id") != 11), [10, 12]),
    "hnsw_kmeans_parts": (lambda i, q: i.search(q, 2, None), [11, 10]),
    "hnsw_l2_exhaustive": (lambda i, q: hnsw.HNSWIndex(i.nodes, 16, 200, "l2").search(q, 10, None), [11, 12, 10]),
    "hnsw_multi_vector_docs": (lambda i, q: i.by_documents(q, i.nodes.select("vec_id", F.col("vec_id").alias("doc_id")), 5, None), [11, 10, 12]),
    "hnsw_parallel_frontier": (lambda i, q: i.search(q, 10, None, frontier=8), [11, 10, 12]),
    "hnsw_range_exhaustive": (lambda i, q: i.within(q, 1.5, least=3, most=3), [11, 10, 12]),
    "hnsw_range_parts": (lambda i, q: i.search(q, 3, None), [11, 10, 12]),
    "hnsw_saved_and_loaded": (_reloaded, [11, 10, 12]),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_walks_start_at_the_entry(spark, name):
    search, want = WHOLE[name]
    asked = spark.createDataFrame([(0, [0.0, 2.0])], "qid long, qv array<float>")
    found = search(one_way(spark), asked).orderBy("rk").collect()
    assert [r["vec_id"] for r in found] == want and [r["rk"] for r in found] == list(range(1, len(want) + 1))


def test_graphs_send_only_rows_that_may_count(spark):
    base = vectors(spark, 200)
    index = hnsw.HNSWIndex.build(base, parts=2)
    walked = hnsw._walked(index.nodes, queries(base), lambda n, _: hnsw.Width(n, 5), "ip", 16, None, 1)
    assert walked.where("vec_id is not null").groupBy("qid").count().agg(F.max("count")).first()[0] == 10
    assert [tuple(r) for r in walked.where("vec_id is null").groupBy("qid").agg(F.sum("hops"), F.sum("distances")).select("sum(hops)", "sum(distances)").distinct().collect()] == [(200, 200)]


def test_large_parts_make_several_graphs(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "GRAPH_ROWS", 40)
    base = vectors(spark)
    want = rows(flat.nearest(base, queries(base), 10))
    for index in (hnsw.HNSWIndex.build(base, parts=2), hnsw.HNSWIndex.build(partition.by_range(base, 2))):
        assert index.nodes.select("part").distinct().count() == 8
        assert rows(index.search(queries(base), 10, None)) == want


def test_parts_have_a_task_each_and_the_largest_starts_first(spark):
    sizes = {0: 30, 3: 20, 6: 50, 1: 10}  # 0, 3 and 6 leave nothing when divided by 3
    base = spark.createDataFrame([(p, i) for p, n in sizes.items() for i in range(n)], "part int, vec_id long")
    dealt, slots = hnsw.in_slots(base)
    assert slots == [6, 0, 3, 1] and dealt.count() == 110
    assert {r["part"]: r["slot"] for r in dealt.select("part", "slot").distinct().collect()} == {6: 0, 0: 1, 3: 2, 1: 3}


def counted(df):
    """df, and an accumulator of how many of its rows were worked out."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def same(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(same, df.schema), seen


def test_few_ids_are_numbered_in_one_pass(spark):
    """hnsw_range_parts: rows that one task numbers aren't counted in a pass of their own, and joined to the count."""
    base, seen = counted(vectors(spark).where("vec_id % 3 = 1"))
    found = kmeans.numbered(base, 100).select("vec_id", "at")
    assert found.schema["at"].dataType.simpleString() == "bigint"
    assert {r["vec_id"]: r["at"] for r in found.collect()} == {3 * i + 1: i for i in range(100)} and seen.value == 100


def test_given_parts_are_worked_out_once(spark):
    """hnsw_kmeans_parts: cells aren't assigned again for each look at the rows."""
    base = vectors(spark)
    parts, seen = counted(base.withColumn("part", F.pmod("vec_id", F.lit(3)).cast("int")))
    index = hnsw.HNSWIndex.build(parts)
    assert rows(index.search(queries(base), 10, None)) == rows(flat.nearest(base, queries(base), 10))
    assert seen.value == 300


def test_graphs_fill_the_cores(spark, monkeypatch):
    """Eight graphs of 12,821 rows on six cores would take two turns of as long as graphs of that size take."""
    assert [hnsw.graph_rows(102_564, cores) for cores in (1, 6, 8, 100)] == [14_652, 8_547, 12_821, 4_096]
    assert hnsw.graph_rows(10_256, 6) == 4_096 and hnsw.graph_rows(0, 6) == 4_096
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(hnsw, "GRAPH_ROWS", 300 // cores - 4)  # one turn isn't enough
    base = vectors(spark)
    for index in (hnsw.HNSWIndex.build(base, parts=2), hnsw.HNSWIndex.build(partition.by_range(base, 2))):
        assert index.nodes.select("part").distinct().count() == 2 * cores
        assert rows(index.search(queries(base), 10, None)) == rows(flat.nearest(base, queries(base), 10))
    dealt, sizes = partition.within_bounds(base.withColumn("part", (F.col("vec_id") >= 30).cast("int")), 40, 20)
    found = dealt.groupBy("part").count().collect()
    assert sorted(r["part"] for r in found) == sorted(sizes) == sorted([0, 2, *range(1, 2 * 14, 2)]) and sum(r["count"] for r in found) == 300
    same, sizes = partition.within_bounds(base.withColumn("part", (F.col("vec_id") >= 30).cast("int")), 270, 20)
    assert sizes == {0: 30, 1: 270} and same.select("part").distinct().count() == 2


def test_loaded_graphs_know_their_parts(spark, tmp_path):
    """hnsw_saved_and_loaded: the parts counted by a load aren't looked up again; what was saved is described without rows made by workers."""
    base = vectors(spark)
    built = hnsw.HNSWIndex.build(base, parts=3)
    built.save(str(tmp_path / "graph"))
    loaded = hnsw.HNSWIndex.load(spark, str(tmp_path / "graph"))
    assert sorted(loaded.parts) == built.parts == [0, 1, 2]
    assert (loaded.m, loaded.width, loaded.by) == (built.m, built.width, built.by)
    assert dict(spark.read.parquet(str(tmp_path / "graph/meta")).dtypes) == {"m": "int", "width": "int", "metric": "string", "n": "bigint"}
    assert rows(loaded.search(queries(base), 10, None)) == rows(flat.nearest(base, queries(base), 10))


def test_searches_read_the_nodes_once(spark):
    """hnsw_parallel_frontier: the parts that a build made aren't looked up in the nodes again."""
    base = vectors(spark)
    for built in (hnsw.HNSWIndex.build(base, parts=2), hnsw.HNSWIndex.build(partition.by_range(base, 3))):
        nodes, seen = counted(built.nodes)
        found = hnsw.HNSWIndex(nodes, built.m, built.width, built.by, built.parts).search(queries(base), 10, None, frontier=8)
        assert rows(found) == rows(flat.nearest(base, queries(base), 10)) and seen.value == 300


#: Searches that pass on what a build knows of its parts, by the catalogue's queries that make them, and what they have to find.
PASSED_ON = {
    "hnsw_filtered_exhaustive": (lambda i, q: i.search(q, 10, None, where=F.col("vec_id") % 3 == 1), lambda b, q: flat.nearest(b, q, 10, where=F.col("vec_id") % 3 == 1)),
    "hnsw_range_exhaustive": (lambda i, q: i.within(q, 0.75, least=300, most=300), lambda b, q: flat.within(b, q, 0.75)),
}


@pytest.mark.parametrize("name", sorted(PASSED_ON))
def test_other_searches_read_the_nodes_once(spark, name):
    search, want = PASSED_ON[name]
    base = vectors(spark)
    built = hnsw.HNSWIndex.build(base, parts=2)
    nodes, seen = counted(built.nodes)
    found = search(hnsw.HNSWIndex(nodes, built.m, built.width, built.by, built.parts), queries(base))
    assert rows(found) == rows(want(base, queries(base))) and seen.value == 300


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_queries_go_to_the_nodes(spark, monkeypatch):
    """hnsw_filtered_exhaustive: nodes are searched where a build left them, and what each graph finds is merged without sorts of single rows."""
    base = vectors(spark)
    want = rows(flat.nearest(base, queries(base), 10, where=F.col("vec_id") % 3 == 1))
    for built in (hnsw.HNSWIndex.build(base, parts=3), hnsw.HNSWIndex.build(base.withColumn("part", F.expr("if(vec_id < 90, null, 5)")))):
        found = built.search(queries(base), 10, None, where=F.col("vec_id") % 3 == 1)
        assert plan(found).count("Exchange") == 1 and "Window" not in plan(found) and rows(found) == want
        effort = built.effort(queries(base), 10, 300)
        assert [r["hops"] for r in effort.collect()] == [300] * 15
    moved = built.delete(base.where("vec_id % 3 <> 1").select("vec_id"))
    assert not moved.placed and rows(moved.search(queries(base), 10, None)) == want
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    many = built.search(queries(base), 10, None, where=F.col("vec_id") % 3 == 1)
    assert "CoGroup" in plan(many) and rows(many) == want


def test_ranges_are_merged_as_lists(spark, monkeypatch):
    """hnsw_range_exhaustive: rows within eps are merged in workers; more than a worker may hold are ranked by a window."""
    base = vectors(spark)
    index = hnsw.HNSWIndex.build(base, parts=3)
    search = lambda most: index.within(queries(base), 0.75, least=300, most=most)
    want = {most: rows(flat.within(base, queries(base), 0.75, most=most)) for most in (300, 4)}
    for most in want:
        assert "Window" not in plan(search(most)) and rows(search(most)) == want[most]
    monkeypatch.setattr(hnsw, "MERGED_ROWS", 3)
    for most in want:
        assert "Window" in plan(search(most)) and rows(search(most)) == want[most]


def test_distances_are_rounded_as_by_sql(spark):
    """hnsw_range_exhaustive: to the same doubles, halves included, without a decimal for each row."""
    rng = np.random.default_rng(2)
    halves = [*(np.arange(-200, 200) / 128), *(np.arange(-3000, 3000) * 1e-6 + 5e-7), 0.49999999999999994e-6, 4503599627.3704955]
    odd = [0.0, -0.0, 1e300, -1e305, float("inf"), float("-inf"), float("nan")]
    x = pa.table({"x": pa.array([*halves, *odd, *rng.normal(size=5000)])})
    found = spark.createDataFrame(x).select("x", catalog.rounded(F.col("x")).alias("r")).toArrow()
    assert duckdb.sql("SELECT count(*), count(*) FILTER (r IS NOT DISTINCT FROM round(x, 6)) FROM found").fetchall() == [(len(x), len(x))]


def test_parts_are_told_apart():
    """A part may go over several batches, and a batch hold several parts, one without a number."""
    parts = [[0, 0], [0, 3, None], [None], [], [1, 2], [2]]
    batches = [pa.record_batch({"part": pa.array(p, pa.int32()), "at": pa.array([i] * len(p), pa.int32())}) for i, p in enumerate(parts)]
    assert [t.column("part").to_pylist() for t in blocks.whole_parts(iter(batches))] == [[0, 0, 0], [3], [None, None], [1], [2, 2]]
    assert not list(blocks.whole_parts(iter([])))


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_lists_merge(spark, monkeypatch, k):
    """Pieces of lists, ties over several lists, and queries over several slices and batches of lists."""
    monkeypatch.setattr(topk, "LIST_ROWS", 3)
    monkeypatch.setattr(topk, "MERGED_LISTS", 4)
    rng = np.random.default_rng(4)
    found, flat_rows = [], []
    for part in range(5):
        for qid in rng.permutation(30):
            ids = np.sort(rng.choice(1000, int(rng.integers(0, 12)), False)) * 5 + part
            dist = np.sort(rng.integers(0, 6, len(ids)) / 4)
            found.append((int(qid), ids, dist))
            flat_rows += [(int(qid), int(i), float(d)) for i, d in zip(ids, dist, strict=True)]
    lists = topk.lists_table(found)
    assert max(map(len, lists.column("ids").to_pylist())) == 3 and not topk.lists_table([]).num_rows
    want = topk.top_k(spark.createDataFrame(flat_rows, "qid long, vec_id long, dist double"), k)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        merged = topk.merged(spark.createDataFrame(lists), k)
        assert merged.dtypes == want.dtypes
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_marks_go_to_the_nodes(spark, monkeypatch):
    """hnsw_after_delete: ids to delete are read once, and few of them don't shuffle the nodes."""
    base = vectors(spark)
    for most, exchanged in ((hnsw.BROADCAST_BYTES, False), (16 * 29, True)):
        monkeypatch.setattr(hnsw, "BROADCAST_BYTES", most)
        ids, seen = counted(base.where("vec_id % 10 = 3").select("vec_id"))
        index = hnsw.HNSWIndex.build(base, parts=2).delete(ids)
        assert seen.value == 30
        plan = index.nodes._jdf.queryExecution().optimizedPlan().toString()
        assert ("rightHint=(strategy=broadcast)" in plan) != exchanged
        assert rows(index.search(queries(base, 3), 10, None)) == rows(flat.nearest(base, queries(base, 3), 10, where=F.col("vec_id") % 10 != 3))
        assert tuple(index.undelete(base.where("vec_id = 13")).counts().first()) == (300, 29)
        with pytest.raises(KeyError):
            index.delete(table(spark, [(1, [0.0] * 8), (1000, [0.0] * 8)]))
        with pytest.raises(ValueError):
            index.delete(base.where("vec_id in (3, 4)"))


def test_documents_are_found_in_one_pass(spark):
    """hnsw_multi_vector_docs: what was found is not worked out a second time for where each query ends."""
    near = [(1, 10, "a", 0.1), (1, 11, "b", 0.2), (1, 12, "a", 0.3), (1, 13, None, 0.4), (1, 14, "c", 0.4), (1, 15, None, 0.5), (1, 16, "d", 0.6), (2, 10, "a", 0.1), (2, 11, "a", 0.1)]
    found, seen = counted(spark.createDataFrame(near, "qid long, vec_id long, doc_id string, dist double"))
    for documents, want in ((0, []), (1, [10]), (2, [10, 11, 12]), (3, [10, 11, 12, 13]), (4, [10, 11, 12, 13, 14, 15]), (9, [10, 11, 12, 13, 14, 15, 16])):
        before = seen.value
        got = flat.before_last_document(found, documents).orderBy("qid", "rk").collect()
        assert [r["vec_id"] for r in got if r["qid"] == 1] == want and [r["rk"] for r in got if r["qid"] == 1] == list(range(1, len(want) + 1))
        assert [r["vec_id"] for r in got if r["qid"] == 2] == ([10, 11] if documents else [])
        assert seen.value - before == len(near)
    twice = spark.createDataFrame([(1, 10, "a", 0.1), (1, 11, "b", 0.2), (1, 11, "c", 0.2)], found.schema)  # an id of two documents
    assert [r["vec_id"] for r in flat.before_last_document(twice, 2).collect()] == [10]


@pytest.mark.parametrize("by", ["ip", "l2"])
def test_batches_build_whole_graphs(by):
    """Nodes inserted in batches, many of them copies of one: links within bounds, everything reached, near nodes found."""
    x = np.random.default_rng(3).normal(size=(1200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::4] = x[0]
    levels = [hnsw.level_of(i, 8, 1) for i in range(len(x))]
    built = graph_build.Builder(x, by, 8, 60, levels)
    built.build()
    links = [built.links(i) for i in range(len(x))]
    assert built.entry == int(np.argmax(levels)) and [len(n) - 1 for n in links] == levels
    assert all(i not in on and len(set(on)) == len(on) and all(levels[j] >= level for j in on) for i, n in enumerate(links) for level, on in enumerate(n))
    assert all(len(on) <= 8 for n in links for on in n[1:]) and sum(len(n[0]) for n in links) <= 17 * len(x)
    starts = np.cumsum([0, *(len(n[0]) for n in links)])
    assert len(hnsw.reached(built.entry, starts, np.array([j for n in links for j in n[0]]))) == len(x)
    graph = hnsw.Graph(x, by, 8)
    graph.links, graph.entry, hits = links, built.entry, 0
    for q in range(1, 400, 4):
        kth = np.sort(hnsw.array_distances(by, x, x[q]))[9]
        hits += sum(d <= kth + 1e-9 for d, _ in graph.search(x[q], hnsw.Width(60, 10), None, 1))
    assert hits >= 950


#: Vectors as the graphs of the catalogue's queries hold them, and their metric, by query.
BUILT = {
    "hnsw_after_upsert": ("ip", lambda x: np.concatenate([np.where(np.arange(len(x))[:, None] % 10 == 3, -x, x), x[4::10]])),
    "hnsw_after_delete": ("ip", lambda x: x[np.arange(len(x)) % 10 != 7]),
    "hnsw_filtered_exhaustive": ("ip", lambda x: x[::-1]),
    "hnsw_l2_exhaustive": ("l2", lambda x: x),
    "hnsw_kmeans_parts": ("ip", lambda x: x[x[:, 0] > -0.2]),
    "hnsw_parallel_frontier": ("ip", lambda x: x),
    "hnsw_multi_vector_docs": ("ip", lambda x: x[np.argsort(np.arange(len(x)) % 10, kind="stable")]),
    "hnsw_range_exhaustive": ("ip", lambda x: x * 2),
    "hnsw_range_parts": ("ip", lambda x: x[: 400]),
    "hnsw_saved_and_loaded": ("ip", lambda x: x.astype(np.float32)),
}


def _unit(n, dim=8):
    x = np.random.default_rng(3).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hits(x, by, built, asked):
    """Of the 10 nearest rows of each node asked for, how many a search through the built graph finds."""
    graph, hits = hnsw.Graph(x, by, 8), 0
    graph.links, graph.entry = [built.links(i) for i in range(len(x))], built.entry
    for q in asked:
        kth = np.sort(hnsw.array_distances(by, x, x[q]))[9]
        hits += sum(d <= kth + 1e-9 for d, _ in graph.search(x[q], hnsw.Width(60, 10), None, 1))
    return hits


@pytest.mark.parametrize("name", sorted(BUILT))
def test_graphs_are_built_without_walks(name, monkeypatch):
    by, held = BUILT[name]
    x = held(_unit(600))
    built = graph_build.Builder(x, by, 8, 60, [hnsw.level_of(i, 8, 1) for i in range(len(x))])
    monkeypatch.setattr(built, "_walk", None)
    built.build()
    assert _hits(x, by, built, range(0, 400, 4)) >= 950


@pytest.mark.parametrize("by", ["ip", "l2"])
def test_distances_between_nodes_are_held_once(by):
    """hnsw_l2_exhaustive: no more than the result is held for the distances of a batch, besides the vectors."""
    x = _unit(2000, 16)
    built = graph_build.Builder(x + 5, by, 8, 60, [0] * len(x))
    tracemalloc.start()
    d = built._between(built.x[:500], built.x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert d.shape == (500, 2000) and peak < 1.3 * d.nbytes
    want = hnsw.array_distances(by, built.x.astype(float), built.x[7].astype(float))
    assert np.allclose(d[7], want, rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("by", ["ip", "l2"])
def test_large_graphs_are_built_by_walks(by, monkeypatch):
    monkeypatch.setattr(graph_build, "PRODUCT_ROWS", 0)
    x = _unit(600)
    built = graph_build.Builder(x, by, 8, 60, [hnsw.level_of(i, 8, 1) for i in range(len(x))])
    built.build()
    assert _hits(x, by, built, range(0, 400, 4)) >= 950


def test_candidates_are_the_nearest_before():
    x = _unit(700)
    for by, held in (("ip", x), ("l2", x + 3000)):  # products of vectors far off would cancel out
        built = graph_build.Builder(held, by, 8, 20, [hnsw.level_of(i, 8, 1) for i in range(len(x))])
        built.build()
        for level in (0, 1):
            on = built.on[level]
            for nodes in (on[30:60], on[:9]):
                found, dist = built._nearest(nodes, level)
                for node, f, d in zip(nodes, found, dist, strict=True):
                    before = on[on < node]
                    want = before[np.argsort(hnsw.array_distances(by, held[before], held[node]))][:20]
                    assert len(set(f[f >= 0].tolist()) & set(want.tolist())) >= len(want) - (by == "l2")
                    assert (f >= 0).sum() == len(want) and (np.diff(d[f >= 0]) >= 0).all()
        some = np.arange(500, 600)
        found, dist = built._nearest(some, 0)
        found, dist = np.hstack([found] * 3), np.hstack([dist] * 3)  # none but the first 20 differ, so that rows run on
        assert (built._diverse(found, dist, 4) == np.where(built._chosen(found, dist, 4), found, -1)).all()


def test_large_cells_are_dealt_out(spark, monkeypatch):
    base = vectors(spark, 300, 8)
    want = rows(IVFIndex.build(base, 4, 2).search(queries(base), 10, 4))
    from vectide.operators import ivf

    for module in (ivf, hnsw):
        monkeypatch.setattr(module, "PART_ROWS", 20)
    monkeypatch.setattr(ivf, "QUERY_ROWS", 4)
    assert rows(IVFIndex.build(base, 4, 2).search(queries(base), 10, 4)) == want
    cells = hnsw.CellGraphIndex.build(base, 4, 2)
    assert cells.shares.agg(F.max("shares")).first()[0] > 2
    assert rows(cells.search(queries(base), 10, 4, None)) == want
    assert rows(hnsw.CellGraphIndex.build(base, 4, 2, coarse=True).search(queries(base), 10, 4, None)) == want


def test_large_cells_make_several_parts(spark):
    base = vectors(spark, 300, 8)
    parts = partition.by_kmeans(base, 3, 2, most=40)
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sum(sizes.values()) == 300 and len(sizes) > 3 and max(sizes.values()) <= 80
    assert parts.columns == [*base.columns, "part"]
    assert rows(hnsw.HNSWIndex.build(parts).search(queries(base), 10, None)) == rows(flat.nearest(base, queries(base), 10))


def test_new_rows_take_deleted_slots(spark):
    base = vectors(spark, 60)
    index = hnsw.HNSWIndex.build(base, parts=1).delete(base.where("vec_id < 5"))
    more = index.upsert(table(spark, [(100, [0.25] * 8), (101, [0.5] * 8)]), replace_deleted=True)
    assert tuple(more.counts().first()) == (60, 3)
    assert tuple(more.upsert(table(spark, [(200 + i, [0.25] * 8) for i in range(4)]), replace_deleted=True).counts().first()) == (61, 0)


def test_timed_sweep(spark):
    base = vectors(spark, 200)
    found = evaluate.timed_sweep(lambda k: flat.nearest(base, queries(base), k), [{"k": 10}, {"k": 5}], flat.nearest(base, queries(base), 10), 10).collect()
    assert [(r["config"], r["recall"]) for r in found] == [("k=10", 1.0), ("k=5", 0.5)]
    assert found[0]["speed_up"] == 1.0 and all(r["query_us"] > 0 for r in found)


def test_streams(spark, tmp_path):
    base = vectors(spark, 50)
    asked = queries(base)
    asked.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    q = search_stream(stream, base, lambda found, n: seen.extend(rows(found)), 5, checkpointLocation=str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == rows(flat.nearest(base, asked, 5))
    table(spark, [(1, [9.0] * 8), (77, [1.0] * 8)]).write.parquet(str(tmp_path / "up"))
    state = {"now": base}
    q = upsert_stream(spark.readStream.schema(base.schema).parquet(str(tmp_path / "up")), lambda: state["now"], lambda t, n: state.update(now=spark.createDataFrame(t.collect(), base.schema)), checkpointLocation=str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert state["now"].count() == 51 and state["now"].where("vec_id = 1").first()["embedding"] == [9.0] * 8
