"""Layered proximity graphs, one for each part of a table.

A graph is built (graph_build) and searched in one task, in numpy, and stored as rows (part, node, vec_id,
level, deleted, embedding, links), links[l] holding a node's neighbours on level l. Nodes are kept
in the shared folder once they are built, so that searches, deletes and counts don't build them
again. A row's level is drawn from a hash of its vec_id, so graphs don't depend on the order of
rows or on retries. A search expands one or several of the best open nodes at a time, their
neighbours' distances in one product; queries go to the parts' tasks in blocks (few queries to
the nodes where a build left them) and the parts' results merge. When a walk ends is up to a stop
condition: a beam's width, a distance, or a number of documents.

A walk that its stop condition can neither end early nor let drop a node expands all that links
lead to from the entry, in whatever order. So for all queries of a block the links are followed
once, and the distances to what they reach are matrix products.

The part's entry is its first node of the highest level. Pruning links can cut nodes off, so the
finished graph gets a link to each such node; a beam as wide as the graph is then exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distance import array_distances, checked, dimension, metric
from ..functions.durable import kept
from .blocks import BROADCAST_BYTES, PART_ROWS, deal, matrix, meet, meet_in_place, small_table, to_every_part
from .flat import before_last_document, close_distances
from .graph_build import Builder
from .partition import within_bounds
from .topk import LISTS, MERGED_ROWS, lists_table, merged, top_k

NODES = "part int, node int, vec_id long, level int, deleted boolean, embedding array<float>, links array<array<int>>"
#: Rows that are worth a part of their own, while there are idle cores.
LEAST_ROWS = 500
#: Rows of a graph, which one task builds, at most about so many; a larger part makes several graphs,
#: of a quarter of that at least.
GRAPH_ROWS = 16_384


class Stop(Protocol):
    """When a walk over a graph ends, and what it keeps; dist is a node's distance, worst that of the farthest kept node."""

    def add(self, node: int) -> None: ...

    def remove(self, node: int) -> None: ...

    def done(self, dist: float, worst: float) -> bool:
        """Whether to end before an open node is expanded."""

    def wants(self, dist: float, worst: float) -> bool:
        """Whether to open and keep a node."""

    def over(self) -> bool:
        """Whether the farthest kept node has to go."""

    def counted(self, dist: np.ndarray, nodes: np.ndarray) -> int:
        """How many of the kept nodes count; they and their distances are given nearest first."""

    def whole(self, nodes: int) -> bool:
        """Whether no walk over so many nodes ends early or lets one go."""

    def edge(self, dist: np.ndarray, nodes: np.ndarray) -> float:
        """A distance beyond which no node counts, all of a walk's nodes and their distances being known."""


class Width:
    """The nearest nodes, width of them, of which the first count ones count (all without it)."""

    def __init__(self, width: int, count: int | None = None):
        self.width, self.count, self.n = width, count, 0

    def add(self, node: int) -> None:
        self.n += 1

    def remove(self, node: int) -> None:
        self.n -= 1

    def done(self, dist: float, worst: float) -> bool:
        return self.n >= self.width and dist > worst

    def wants(self, dist: float, worst: float) -> bool:
        return self.n < self.width or dist < worst

    def over(self) -> bool:
        return self.n > self.width

    def counted(self, dist: np.ndarray, nodes: np.ndarray) -> int:
        return len(nodes) if self.count is None else min(self.count, len(nodes))

    def whole(self, nodes: int) -> bool:
        return self.width >= nodes

    def edge(self, dist: np.ndarray, nodes: np.ndarray) -> float:
        return math.inf if self.count is None or self.count >= len(dist) else float(np.partition(dist, self.count - 1)[self.count - 1])


class Within(Width):
    """All nodes at most eps away, the nearest most of them; the walk goes on until it has seen least."""

    def __init__(self, eps: float, least: int, most: int):
        super().__init__(most)
        self.eps, self.least = eps, least

    def done(self, dist: float, worst: float) -> bool:
        return super().done(dist, worst) or (dist > self.eps and self.n >= self.least)

    def counted(self, dist: np.ndarray, nodes: np.ndarray) -> int:
        return int(np.searchsorted(dist, self.eps, "right"))

    def whole(self, nodes: int) -> bool:
        return super().whole(nodes) and self.least >= nodes

    def edge(self, dist: np.ndarray, nodes: np.ndarray) -> float:
        return self.eps


class Documents(Width):
    """The nearest nodes of documents different documents; the beam holds those of width. The first node of one document more is kept to mark the end."""

    def __init__(self, codes: np.ndarray, documents: int, width: int):
        super().__init__(max(width, documents + 1))
        self.codes, self.documents, self.nodes = codes, documents, {}

    def add(self, node: int) -> None:
        doc = self.codes[node]
        self.nodes[doc] = self.nodes.get(doc, 0) + 1
        self.n = len(self.nodes)

    def remove(self, node: int) -> None:
        doc = self.codes[node]
        self.nodes[doc] -= 1
        if not self.nodes[doc]:
            del self.nodes[doc]
        self.n = len(self.nodes)

    def counted(self, dist: np.ndarray, nodes: np.ndarray) -> int:
        firsts = np.sort(np.unique(self.codes[nodes], return_index=True)[1])
        return int(firsts[self.documents]) + 1 if len(firsts) > self.documents else len(nodes)

    def edge(self, dist: np.ndarray, nodes: np.ndarray) -> float:
        firsts = np.full(int(self.codes.max(initial=0)) + 1, np.inf)
        np.minimum.at(firsts, self.codes[nodes], dist)
        return float(np.partition(firsts, self.documents)[self.documents]) if len(firsts) > self.documents else math.inf


class Graph:
    """One part's graph; hops and distances count the nodes expanded and the distances taken."""

    def __init__(self, vectors: np.ndarray, by: str, m: int):
        self.vectors, self.by, self.m = vectors, by, m
        self.links: list[list[list[int]]] = []
        self.entry = -1
        self.hops = self.distances = 0

    def far(self, query: np.ndarray, nodes) -> np.ndarray:
        self.distances += len(nodes)
        return array_distances(self.by, self.vectors[nodes], query)

    def descend(self, query: np.ndarray, at: int, top: int, bottom: int) -> int:
        """The node that greedy steps from at reach, through levels top to just above bottom."""
        best = self.far(query, [at])[0]
        for level in range(top, bottom, -1):
            while near := self.links[at][level]:
                self.hops += 1
                d = self.far(query, near)
                i = int(d.argmin())
                if d[i] >= best:
                    break
                at, best = near[i], d[i]
        return at

    def walk(self, query: np.ndarray, start: int, level: int, stop: Stop, allowed: np.ndarray | None = None, frontier: int = 1) -> list[tuple[float, int]]:
        """The (distance, node) that a best-first walk keeps, nearest first; nodes that aren't allowed are walked through."""
        seen = bytearray(len(self.vectors))
        seen[start] = 1
        open_ = [(float(self.far(query, [start])[0]), start)]
        held: list[tuple[float, int]] = []
        if allowed is None or allowed[start]:
            held.append((-open_[0][0], -start))
            stop.add(start)
        worst = lambda: -held[0][0] if held else math.inf
        while open_:
            front = []
            while open_ and len(front) < frontier and not stop.done(open_[0][0], worst()):
                front.append(heapq.heappop(open_)[1])
            if not front:
                break
            self.hops += len(front)
            near = []
            for f in front:
                for n in self.links[f][level]:
                    if not seen[n]:
                        seen[n] = 1
                        near.append(n)
            if not near:
                continue
            for d, n in zip(self.far(query, near).tolist(), near, strict=True):
                if stop.wants(d, worst()):
                    heapq.heappush(open_, (d, n))
                    if allowed is None or allowed[n]:
                        heapq.heappush(held, (-d, -n))
                        stop.add(n)
                        while stop.over():
                            stop.remove(-heapq.heappop(held)[1])
        found = sorted((-d, -n) for d, n in held)
        return found[: stop.counted(np.array([d for d, _ in found]), np.array([n for _, n in found], int))]

    def search(self, query: np.ndarray, stop: Stop, allowed: np.ndarray | None, frontier: int) -> list[tuple[float, int]]:
        at = self.descend(query, self.entry, len(self.links[self.entry]) - 1, 0)
        return self.walk(query, at, 0, stop, allowed, frontier)


def reached(entry: int, starts: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The nodes that links lead to from the entry, in order, itself included; to[starts[i] : starts[i + 1]] are node i's links."""
    seen = np.zeros(len(starts) - 1, bool)
    seen[entry], front = True, np.array([entry])
    while len(front):
        sizes = starts[front + 1] - starts[front]
        place = np.repeat(starts[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        near = np.unique(to[place])
        front = near[~seen[near]]
        seen[front] = True
    return np.flatnonzero(seen)


def ground_links(links: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, to) of level 0: to[starts[i] : starts[i + 1]] are node i's links."""
    nodes = links.combine_chunks()
    lists = pc.list_element(nodes, 0).combine_chunks() if isinstance(nodes, pa.ChunkedArray) else pc.list_element(nodes, 0)
    starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return starts, lists.flatten().to_numpy(zero_copy_only=False)


def level_of(vec_id: int, m: int, seed: int) -> int:
    """A draw by the id alone, level l and above having m ** -l of all."""
    x = (vec_id * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & (2**64 - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & (2**64 - 1)
    return int(-math.log(((x ^ (x >> 31)) + 1) / 2**64) / math.log(m))


def in_slots(rows: DataFrame, sizes: dict[int, int] | None = None) -> tuple[DataFrame, list[int]]:
    """rows with slot, and the parts by their slots: a number for each part, the largest part's first, so that tasks of slots start with what takes longest. Parts are counted if their sizes aren't known."""
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()} if sizes is None else sizes
    parts = sorted(sizes, key=lambda p: (-sizes[p], p is not None, p or 0))
    slots = rows.sparkSession.createDataFrame(pa.table({"of": pa.array(parts, pa.int32()), "slot": pa.array(range(len(parts)), pa.int32())}))
    return rows.join(F.broadcast(slots), F.col("part").eqNullSafe(F.col("of"))).drop("of"), parts


def graph_rows(n: int, cores: int) -> int:
    """Rows of each graph of a part that makes several, n being all parts' rows: so many that the last graphs are built while no core waits."""
    turns = max(1, -(-n // (cores * GRAPH_ROWS)))
    return min(GRAPH_ROWS, max(GRAPH_ROWS // 4, -(-n // (cores * turns))))


def build(base: DataFrame, m: int = 16, width: int = 200, by: str = "ip", seed: int = 100) -> DataFrame:
    """Nodes of a graph for each part, kept; base has part, vec_id, embedding and may have deleted."""
    return build_parts(base, m, width, by, seed)[0]


def build_parts(base: DataFrame, m: int = 16, width: int = 200, by: str = "ip", seed: int = 100, sizes: dict[int, int] | None = None) -> tuple[DataFrame, list[int]]:
    """The same, and the parts' numbers; sizes are the parts' rows, about, if known."""
    if m < 2:
        raise ValueError("a node has two links at least")
    metric(by)
    width = max(width, m)
    gone = F.col("deleted") if "deleted" in base.columns else F.lit(False)
    rows = base.select(F.col("part").cast("int").alias("part"), "vec_id", gone.alias("deleted"), F.col("embedding").cast("array<float>").alias("embedding"))

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        levels = [level_of(i, m, seed) for i in table.column("vec_id").to_pylist()]
        n = len(levels)
        g = Builder(matrix(table.column("embedding")), by, m, width, levels)
        g.build()
        return pa.table(
            {
                "part": table.column("part"), "node": pa.array(range(n), pa.int32()), "vec_id": table.column("vec_id"), "level": pa.array(levels, pa.int32()),
                "deleted": table.column("deleted"), "embedding": table.column("embedding"), "links": pa.array(map(g.links, range(n)), pa.list_(pa.list_(pa.int32()))),
            }
        )

    # a task for each part: by a hash of their numbers, or by what is left of them, several would share one
    dealt, parts = in_slots(rows, sizes)
    return kept(dealt.repartitionById(max(1, len(parts)), "slot").groupBy("slot", "part").applyInArrow(graph, NODES)), parts


Found = Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]


def _one_by_one(left: pa.Table, right: pa.Table, x: np.ndarray, entry: int, good: np.ndarray, stop: Callable[[], Stop], by: str, m: int, frontier: int) -> Found:
    """(qid, distances and nodes that count, nodes expanded, distances taken) of a walk for each query."""
    g = Graph(x, by, m)
    g.links, g.entry = left.column("links").to_pylist(), entry
    for qid, q in zip(right.column("qid").to_pylist(), matrix(right.column("qv")), strict=True):
        g.hops = g.distances = 0
        found = g.search(q, stop(), None if good.all() else good, frontier)
        yield qid, np.array([d for d, _ in found]), np.array([n for _, n in found], int), g.hops, g.distances


def _whole(left: pa.Table, right: pa.Table, x: np.ndarray, entry: int, good: np.ndarray, stop: Callable[[], Stop], by: str, m: int, frontier: int) -> Found:
    """The same for walks that expand all there is; what may count is worked out again row by row."""
    every = reached(entry, *ground_links(left.column("links")))
    nodes = every[good[every]]
    x, qids, asked = x[nodes], right.column("qid").to_pylist(), matrix(right.column("qv"))
    for i, d, off in close_distances(by, x, asked):
        end = stop()
        near = np.flatnonzero(d <= end.edge(d, nodes) + 2 * off)
        exact = array_distances(by, x[near], asked[i])
        order = np.lexsort((near, exact))
        exact, near = exact[order], nodes[near[order]]
        n = end.counted(exact, near)
        yield qids[i], exact[:n], near[:n], len(every), len(every)


def _then_nulls(values: np.ndarray, kind: pa.DataType, n: int) -> pa.Array:
    return pa.concat_arrays([pa.array(values, kind), pa.nulls(n, kind)])


def _nulls_then(n: int, values) -> pa.Array:
    return pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(values, pa.int64())])


def _walked(nodes: DataFrame, queries: DataFrame, stop, by: str, m: int, where: Column | None, frontier: int, doc: str | None = None, parts: list[int] | None = None, placed: bool = False, listed: bool = False) -> DataFrame:
    """(qid, vec_id, dist, doc_id, hops, distances), or if listed LISTS, of every part's own result; stop(left, codes) makes a walk's stop condition.

    A row of each query and part has no vec_id and says how many nodes were expanded and how many
    distances taken; lists have none. placed says that each part lies whole in a partition of nodes.
    """
    metric(by)
    allowed = (~F.col("deleted")) if where is None else (~F.col("deleted") & F.coalesce(where, F.lit(False)))
    named = F.lit(None).cast("int") if doc is None else F.col(doc)
    stored = nodes.select("part", "node", "vec_id", "level", "embedding", "links", allowed.alias("allowed"), named.alias("doc_id"))
    kind = stored.schema["doc_id"].dataType.simpleString()

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("node")
        docs, ids, found = left.column("doc_id").combine_chunks(), left.column("vec_id").to_numpy(), []
        if left.num_rows and right.num_rows:
            x, good = matrix(left.column("embedding")), np.asarray(left.column("allowed").to_pylist(), bool)
            entry = int(left.column("level").to_numpy().argmax())
            codes = pc.dictionary_encode(docs, null_encoding="encode").indices.to_numpy(zero_copy_only=False) if doc else None
            results = _whole if stop(len(ids), codes).whole(len(ids)) else _one_by_one
            found = list(results(left, right, x, entry, good, lambda: stop(len(ids), codes), by, m, frontier))
        if listed:
            return lists_table([(qid, ids[at], dist) for qid, dist, at, *_ in found])
        qids, dist, at, hops, distances = zip(*found, strict=True) if found else ([], [], [], [], [])
        qids, none = np.array(qids, np.int64), np.zeros(0)
        dist, at = np.concatenate([*dist, none]), np.concatenate([*at, none]).astype(np.int64)
        n, more = len(at), len(qids)  # the nodes that count, and a row more for each query
        columns = {
            "qid": pa.array(np.concatenate([np.repeat(qids, [len(f[1]) for f in found]), qids]).astype(np.int64)), "vec_id": _then_nulls(ids[at], pa.int64(), more),
            "dist": _then_nulls(dist, pa.float64(), more), "doc_id": docs.take(_then_nulls(at, pa.int64(), more)),
            "hops": _nulls_then(n, hops), "distances": _nulls_then(n, distances),
        }
        return pa.table(columns)

    found = LISTS if listed else f"qid long, vec_id long, dist double, doc_id {kind}, hops long, distances long"
    sent = "part" in queries.columns
    if placed and not sent and (small := small_table(queries.select("qid", "qv"))) is not None:
        return meet_in_place(stored, small, walk, found)
    asked = queries if sent else to_every_part(queries, nodes, parts)
    return meet(stored, asked.select("part", "qid", "qv"), walk, found, queries)


def search(nodes: DataFrame, queries: DataFrame, k: int = 10, width: int | None = 50, by: str = "ip", m: int = 16, where: Column | None = None, frontier: int = 1, parts: list[int] | None = None, placed: bool = False) -> DataFrame:
    """The nearest k over all parts; queries with a column part go to that part alone. parts are the parts' numbers, if known; placed says that each lies whole in a partition.

    where keeps rows out of the result, not out of the walk. Without a width the beam holds a
    whole part, and the result is exact.
    """
    listed = k <= MERGED_ROWS
    found = _walked(nodes, queries, lambda n, _: Width(n if width is None else max(width, k), k), by, m, where, frontier, None, parts, placed, listed)
    return merged(found, k) if listed else top_k(found.where("vec_id is not null"), k)


def integrity(nodes: DataFrame) -> DataFrame:
    """One row: links on level 0, those to the node itself, repeated ones, those to no node, and the least and most links into a node."""
    links = nodes.select("part", "node", F.explode(F.element_at("links", 1)).alias("to"))
    known = nodes.select("part", F.col("node").alias("to"), F.lit(1).alias("known"))
    into = known.join(links.groupBy("part", "to").count(), ["part", "to"], "left").agg(F.min(F.coalesce("count", F.lit(0))).alias("least_in"), F.max(F.coalesce("count", F.lit(0))).alias("most_in"))
    single = links.groupBy("part", "node", "to").count()
    checked = single.join(known, ["part", "to"], "left").agg(
        F.sum("count").alias("links"), F.sum(F.when(F.col("node") == F.col("to"), F.col("count")).otherwise(0)).alias("to_self"),
        F.sum(F.col("count") - 1).alias("repeated"), F.count(F.when(F.col("known").isNull(), 1)).alias("to_none"),
    )
    return checked.crossJoin(into)  # one row each


class HNSWIndex:
    """Graph nodes, what they were built with, the parts' numbers, if known, and whether each part lies whole in a partition of nodes."""

    def __init__(self, nodes: DataFrame, m: int, width: int, by: str, parts: list[int] | None = None, placed: bool = False):
        self.nodes, self.m, self.width, self.by, self.parts, self.placed = nodes, m, width, by, parts, placed

    @classmethod
    def build(cls, base: DataFrame, m: int = 16, width: int = 200, by: str = "ip", parts: int | None = None) -> HNSWIndex:
        """base may say each row's part; else rows are dealt evenly by a hash, as many parts as there are cores if rows are few.

        A part of more than GRAPH_ROWS rows is dealt out to several graphs, which count as parts of
        their own. Parts that base says are worked out once and kept.
        """
        cores = base.sparkSession.sparkContext.defaultParallelism
        if "part" in base.columns:
            base = kept(base.select(*(c for c in ("part", "vec_id", "embedding", "deleted") if c in base.columns)))
        n = checked(base)[1]
        if "part" in base.columns:
            dealt, sizes = within_bounds(base, GRAPH_ROWS, graph_rows(n, cores))
        else:
            named = parts or max(1, min(cores, n // LEAST_ROWS))
            size = graph_rows(n, cores) if n > named * GRAPH_ROWS else GRAPH_ROWS
            graphs = named * max(1, -(-n // (named * size)))
            dealt, sizes = base.withColumn("part", deal(graphs)), dict.fromkeys(range(graphs), n // graphs)
        nodes, known = build_parts(dealt, m, width, by, sizes=sizes)
        return cls(nodes, m, width, by, known, True)

    def search(self, queries: DataFrame, k: int = 10, width: int | None = 50, where: Column | None = None, frontier: int = 1) -> DataFrame:
        return search(self.nodes, queries, k, width, self.by, self.m, where, frontier, self.parts, self.placed)

    def within(self, queries: DataFrame, eps: float, least: int = 1, most: int = 1000, where: Column | None = None, frontier: int = 1) -> DataFrame:
        """Rows at most eps away that the walks find, the nearest most of them; a walk doesn't end before it has seen least."""
        listed = most <= MERGED_ROWS
        found = _walked(self.nodes, queries, lambda *_: Within(eps, least, most), self.by, self.m, where, frontier, None, self.parts, self.placed, listed)
        return merged(found, most) if listed else top_k(found.where("vec_id is not null"), most)

    def by_documents(self, queries: DataFrame, docs: DataFrame, documents: int, width: int | None = 50, frontier: int = 1) -> DataFrame:
        """(qid, vec_id, doc_id, dist, rk): the nearest vectors of so many documents; docs is (vec_id, doc_id).

        The beam holds the vectors of width documents, or of all without a width.
        """
        named = self.nodes.join(docs.select("vec_id", "doc_id"), "vec_id", "left")
        stop = lambda n, codes: Documents(codes, documents, n if width is None else width)
        found = _walked(named, queries, stop, self.by, self.m, None, frontier, "doc_id", self.parts).where("vec_id is not null")
        return before_last_document(found.select("qid", "vec_id", "doc_id", "dist"), documents)

    def effort(self, queries: DataFrame, k: int = 10, width: int = 50, frontier: int = 1) -> DataFrame:
        """(qid, hops, distances): nodes expanded and distances taken for each query, over all parts."""
        found = _walked(self.nodes, queries, lambda n, _: Width(max(width, k)), self.by, self.m, None, frontier, None, self.parts, self.placed)
        return found.where("vec_id is null").groupBy("qid").agg(F.sum("hops").alias("hops"), F.sum("distances").alias("distances"))

    def _marked(self, ids: DataFrame, deleted: bool) -> HNSWIndex:
        named = kept(ids.select("vec_id").distinct().withColumn("named", F.lit(True)))
        at = self.nodes.select("vec_id", "deleted", F.lit(True).alias("there"))
        known = named.join(at, "vec_id", "left").agg(F.count("*").alias("ids"), F.count("there").alias("n"), F.count(F.when(F.col("deleted") == deleted, 1)).alias("already")).first()
        if known["n"] < known["ids"]:
            raise KeyError("some ids aren't in the index")
        if known["already"]:
            raise ValueError(f"{known['already']} of the ids are {'deleted already' if deleted else 'not deleted'}")
        # few ids go to the nodes, so that these, with their vectors and links, aren't shuffled
        marked = self.nodes.join(F.broadcast(named) if 16 * known["ids"] <= BROADCAST_BYTES else named, "vec_id", "left")
        nodes = marked.withColumn("deleted", F.coalesce(F.when(F.col("named"), F.lit(deleted)), F.col("deleted"))).select(*self.nodes.columns)
        return HNSWIndex(nodes, self.m, self.width, self.by, self.parts)

    def delete(self, ids: DataFrame) -> HNSWIndex:
        """Rows stay in the walk but out of results; KeyError for unknown ids, ValueError for deleted ones."""
        return self._marked(ids, True)

    def undelete(self, ids: DataFrame) -> HNSWIndex:
        return self._marked(ids, False)

    def upsert(self, rows: DataFrame, replace_deleted: bool = False) -> HNSWIndex:
        """New vectors for known ids (which they undelete), others added; the parts they touch are built anew.

        New rows go to parts by a hash. With replace_deleted each of them takes the place of a
        deleted row of its part, the first ones first, as long as there are any; a deleted id
        can't be updated then.
        """
        dimension(rows)
        fresh = rows.select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
        at = self.nodes.select("vec_id", F.col("part").alias("old"), "deleted")
        if replace_deleted and fresh.join(at.where("deleted"), "vec_id").limit(1).count():
            raise ValueError("a deleted id can't be updated while its slot may be taken")
        parts = [r["part"] for r in self.nodes.select("part").distinct().orderBy("part").collect()] or [0]
        placed = kept(fresh.join(at, "vec_id", "left").select("vec_id", "v", F.coalesce("old", F.lit(parts).cast("array<int>")[deal(len(parts))]).alias("part"), F.col("old").isNull().alias("new")))
        touched = [r["part"] for r in placed.select("part").distinct().collect()]
        old = self.nodes.where(F.col("part").isin(*touched)).join(placed.select("vec_id"), "vec_id", "left_anti")
        if replace_deleted:
            taken = placed.where("new").groupBy("part").agg(F.count("*").alias("taken"))
            place = F.row_number().over(Window.partitionBy("part", "deleted").orderBy("node"))
            old = old.join(taken, "part", "left").withColumn("place", place).where(~F.col("deleted") | (F.col("place") > F.coalesce("taken", F.lit(0))))
        new = placed.select("part", "vec_id", F.lit(False).alias("deleted"), F.col("v").alias("embedding"))
        rebuilt = build(old.select("part", "vec_id", "deleted", "embedding").unionByName(new), self.m, self.width, self.by)
        return HNSWIndex(self.nodes.where(~F.col("part").isin(*touched)).unionByName(rebuilt), self.m, self.width, self.by)

    def get(self, vec_id: int) -> list[float]:
        row = self.nodes.where((F.col("vec_id") == vec_id) & ~F.col("deleted")).select("embedding").first()
        if row is None:
            raise KeyError(vec_id)
        return list(row["embedding"])

    def counts(self) -> DataFrame:
        """One row (elements, deleted)."""
        return self.nodes.agg(F.count("*").alias("elements"), F.count(F.when(F.col("deleted"), 1)).alias("deleted"))

    def save(self, path: str) -> None:
        self.nodes.write.parquet(f"{path}/nodes")
        n = self.nodes.sparkSession.read.parquet(f"{path}/nodes").count()
        meta = pa.table({"m": pa.array([self.m], pa.int32()), "width": pa.array([self.width], pa.int32()), "metric": [self.by], "n": [n]})  # rows would be made by Python workers
        self.nodes.sparkSession.createDataFrame(meta).coalesce(1).write.parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HNSWIndex:
        """ValueError if the nodes aren't those that were saved, or link to others than their part's."""
        meta, nodes = spark.read.parquet(f"{path}/meta").first(), spark.read.parquet(f"{path}/nodes")
        sizes = nodes.groupBy("part").agg(F.count("*").alias("n"), F.max(F.array_max(F.flatten("links"))).alias("last"), F.count(F.when(F.size("links") != F.col("level") + 1, 1)).alias("odd"))
        bad = sizes.agg(F.sum("n").alias("n"), F.sum("odd").alias("odd"), F.count(F.when(F.col("last") >= F.col("n"), 1)).alias("beyond"), F.collect_list(F.struct("part")).alias("parts")).first()
        if (bad["n"] or 0) != meta["n"] or bad["odd"] or bad["beyond"]:
            raise ValueError(f"the index is damaged: {bad['n'] or 0} of {meta['n']} nodes, {bad['odd']} with the wrong levels, links beyond {bad['beyond']} parts")
        return cls(nodes, meta["m"], meta["width"], meta["metric"], [r["part"] for r in bad["parts"]])


class CellGraphIndex:
    """An inverted file with graphs in every cell; coarse=True finds cells through a graph over the centres.

    A cell of more than PART_ROWS rows is dealt out to several graphs, all of which are searched.
    """

    def __init__(self, ivf, graph: HNSWIndex, shares: DataFrame, centres: HNSWIndex | None):
        self.ivf, self.graph, self.shares, self.centres = ivf, graph, shares, centres

    @classmethod
    def build(cls, base: DataFrame, cells: int = 256, rounds: int = 15, m: int = 16, width: int = 200, coarse: bool = False, digits: int | None = None) -> CellGraphIndex:
        """rounds=0 takes the strided seeds themselves for centres."""
        from .ivf import IVFIndex, centroid_table

        ivf = IVFIndex.build(base, cells, rounds, digits)
        ivf.postings = kept(ivf.postings)
        shares = kept(ivf.postings.groupBy("cid").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("shares")))
        # part c + s * cells is share s of cell c
        dealt = ivf.postings.join(shares, "cid").withColumn("part", F.col("cid") + F.pmod(F.xxhash64("vec_id"), F.col("shares")).cast("int") * F.lit(len(ivf.centres)))
        graph = HNSWIndex(build(dealt.select("part", "vec_id", "embedding"), m, width), m, width, "ip")
        over = None
        if coarse:
            table = centroid_table(base.sparkSession, ivf.centres)
            over = HNSWIndex.build(table.select(F.col("cid").cast("long").alias("vec_id"), F.col("centroid").cast("array<float>").alias("embedding"), F.lit(0).alias("part")), m, width)
        return cls(ivf, graph, shares, over)

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 8, width: int | None = 50, frontier: int = 1) -> DataFrame:
        if self.centres is None:
            probed = self.ivf.probes(queries, nprobe).select("qid", "qv", "cid")
        else:
            cells = self.centres.search(queries, nprobe, width)
            probed = cells.select("qid", F.col("vec_id").cast("int").alias("cid")).join(queries, "qid")
        every = probed.join(self.shares, "cid").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        asked = every.select("qid", "qv", (F.col("cid") + F.col("s") * F.lit(len(self.ivf.centres))).alias("part"))
        return search(self.graph.nodes, asked, k, width, self.graph.by, self.graph.m, None, frontier)
