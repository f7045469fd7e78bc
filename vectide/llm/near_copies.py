"""Near copies: documents whose sets of word shingles reach a Jaccard similarity.

A set is known by 32-bit hashes of its shingles (chance n / 2^32 of a false match for each shingle
of a set of n). Equal sets are one node. Candidates come two ways, and all candidates' sets are
compared. First by the near-duplicate operator's method (simhash): a set has a 64-bit SimHash of
its shingles, is indexed under that fingerprint's one-wildcard variants, and fingerprints that share
one and differ in at most DISTANCE bits are linked; nodes of linked fingerprints are compared.
Then, for what fingerprints can't bring together, by bands of minima: each of BANDS keys
hashes ROWS minima under multiplications of the shingles' 64-bit hashes, so a pair of similarity s
is missed with probability (1 - s^ROWS)^BANDS, 0.2% at 0.8.

Groups of the same nodes are compared once. A group of more than BLOCK nodes is dealt out as
pairs of blocks, so no task holds more than two, and only a spanning forest of the links is
emitted.

This is the form that the near-duplicate operator takes in the pipeline, where texts count as
copies from a similarity of 0.8 of their five-word shingles on: fingerprints of 64 bits differ in
ten of them on average at 0.8, so that deletion variants alone would miss most such links.

Defined results: null and empty texts, and texts without words, are copies of each other; texts
shorter than a shingle are one shingle; very long texts are read whole and stand as one set of
four bytes a shingle; repeated rows share a component, of which one row stays; rows of one doc_id
are judged by their own texts; a null doc_id names no component; an empty table gives no rows;
only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import checkpointed, connected_components, keep_nothing, keep_one, row_key, row_slices

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
#: Bits that linked fingerprints differ in at most.
DISTANCE = 3
SLICE_BYTES = 8 << 20
#: Nodes of a group that are compared in one go.
BLOCK = 128
#: Shingles whose minima are taken in one go.
CHUNK = 1 << 13
#: Odd multipliers, one for each minimum.
FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((h(joined[a:b]) for a, b in spans), np.uint64, len(words) - size + 1))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[at : at + CHUNK] * FACTORS[:, None]).min(axis=1))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key1, key2, node, fp, bands, hashes) of every row of docs; node stands for the set, fp is its fingerprint."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for rows in row_slices(batches, "text", SLICE_BYTES):
            nodes, prints, keys, kept = [], [], [], []
            for text in rows.column(1).to_pylist():
                found = shingles(text, shingle)
                nodes.append(xxhash.xxh64_intdigest(found.astype("<u8").tobytes()))
                prints.append(simhash.majority(found))
                keys.append(bands(found))
                kept.append(np.unique(found.astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *rows.columns[2:], *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)), pa.array(keys, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                names=["doc_id", "key1", "key2", "node", "fp", "bands", "hashes"],
            )

    return docs.select("doc_id", F.col("text").cast("string"), *row_key()).mapInArrow(run, f"doc_id {id_type.simpleString()}, key1 long, key2 long, node long, fp long, bands array<long>, hashes binary")


def forest(hashes: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges, by position, of a spanning forest of the graph of sets that reach the similarity."""
    sizes, left, heads, tails = np.array([len(h) for h in hashes], np.int64), np.arange(len(hashes)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            own, n = hashes[at], sizes[at]
            fits = np.flatnonzero((sizes[left] >= similarity * n - 1e-9) & (n >= similarity * sizes[left] - 1e-9))
            if not len(fits):
                continue
            others = left[fits]
            every = np.concatenate([hashes[i] for i in others])
            place = np.minimum(np.searchsorted(own, every), n - 1)
            shared = np.add.reduceat((own[place] == every).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[others])[:-1])))
            near = fits[shared >= similarity * (sizes[others] + n - shared) - 1e-9]
            heads += [int(at)] * len(near)
            tails += left[near].tolist()
            queue.extend(left[near])
            left = np.delete(left, near)
    return heads, tails


def alike(nodes: DataFrame) -> DataFrame:
    """(node, key): one key for all nodes whose fingerprints the near-duplicate operator links, directly or through others."""
    roots = connected_components(simhash.links(nodes, DISTANCE)).select(F.col("node").alias("fp"), "root")
    return nodes.join(roots, "fp", "left").select("node", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"))


def links(found: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest of the links between nodes, of candidates by fingerprints and by bands."""
    nodes = checkpointed(found.where("size(bands) > 0").select("node", "fp", "bands").dropDuplicates(["node"]))
    keyed = checkpointed(alike(nodes.select("node", "fp")).unionByName(nodes.select("node", F.explode("bands").alias("key"))))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.bit_xor(F.xxhash64("node")).alias("all")).where("n > 1")
    once = groups.groupBy("n", "first", "all").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # block x meets block y in the part (x, y): x is sent to every y from x on, and to every smaller one
    dealt = keyed.join(once, "key").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).select(
        "key", "node", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    ).select("key", "node", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def meet(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        heads, tails = forest([np.frombuffer(h, "<u4") for h in table.column("hashes").to_pylist()], similarity)
        return pa.table({"a": pa.array(nodes[heads], pa.int64()), "b": pa.array(nodes[tails], pa.int64())})

    known = found.where("size(bands) > 0").select("node", "hashes").dropDuplicates(["node"])
    return dealt.join(known, "node").groupBy("key", "x", "y").applyInArrow(meet, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, node, component_id, root, key1, key2) for every row of docs; a component is named by its smallest doc_id."""
    found = checkpointed(sets(docs, shingle))
    classes = found.groupBy("node").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(found, similarity, block)).withColumnRenamed("node", "of")
    rooted = classes.join(roots, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.select("doc_id", "key1", "key2", "node").join(rooted.join(named, "root").select("node", "root", "component_id"), "node", "left")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of docs of each component, chosen as keep_one does; rows of one doc_id are judged by their own texts."""
    return keep_one(docs, near_copies(docs.select("doc_id", "text"), **options))
