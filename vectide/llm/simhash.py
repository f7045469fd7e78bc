"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into s segments. If two fingerprints differ in at most d bits and
s > d / 2, some segment differs in at most one bit, so both share the variant of that segment
with the differing bit made a wildcard. Every distinct fingerprint is indexed under all its
one-wildcard variants (64 rows), an equality on the variant brings candidates together, and the
whole fingerprints are compared.

Rows of one variant are read as a sorted stream and compared in blocks of BLOCK fingerprints;
a variant with more than one block is dealt out again as pairs of blocks, so no task holds more
than two blocks however hot a variant is. Only a spanning forest of the links is emitted, which
keeps every component and grows with the fingerprints, not with their pairs.

Defined results: null and empty texts, and texts without words, have fingerprint zero and link
like any other; very long texts are read whole, their hashes some at a time; repeated rows stay
repeated and share a component; a null doc_id is kept and names no component (one of such rows
alone has a null component_id); an empty table gives no rows; only doc_id and text are read,
whatever other columns are called. Of each component drop_near_duplicates keeps one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, keep_nothing, keep_one, row_key, row_slices, shuffle_partitions

BITS = 64
SLICE_BYTES = 8 << 20
#: Fingerprints of a variant that are compared in one go.
BLOCK = 2048


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is one if over half of the shingles' XXH64 have it; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(words) - size + 1
    for at in range(0, n, 1 << 16):
        some = slice(at, min(n, at + (1 << 16)))
        spans = zip(starts[some].tolist(), ends[size - 1 :][some].tolist(), strict=True)
        hashes = np.array([h(joined[a:b], seed) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: bit i is one if over half of them have it; zero without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, key1, key2, fp) with fp the fingerprint's bits as a signed long."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for rows in row_slices(batches, "text", SLICE_BYTES):
            prints = np.array([fingerprint(t, shingle, seed) for t in rows.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column(0), *rows.columns[2:], pa.array(prints.view(np.int64))], names=["doc_id", "key1", "key2", "fp"])

    return docs.select("doc_id", F.col("text").cast("string"), *row_key()).mapInArrow(run, f"doc_id {id_type.simpleString()}, key1 long, key2 long, fp long")


def variants(prints: DataFrame, segments: int) -> DataFrame:
    """(key, fp): one row for each wildcard bit; key packs the bit and the rest of its segment."""
    width = BITS // segments
    bit = F.col("bit")
    segment = F.expr(f"shiftrightunsigned(fp, cast(bit div {width} as int) * {width}) & {(1 << width) - 1}L")
    rest = segment.bitwiseAND(F.expr(f"~shiftleft(1L, cast(bit % {width} as int))"))
    key = rest * BITS + bit
    return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit")).select(key.alias("key"), "fp")


def forest(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph of prints that differ in at most distance bits."""
    left, heads, tails = np.ascontiguousarray(prints).view(np.uint64), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                heads.append(np.full(len(found), at, np.uint64))
                tails.append(found)
                queue.extend(found)
                left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(heads).view(np.int64), np.concatenate(tails).view(np.int64)) if heads else (none, none)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int64())])


def _edges(heads: np.ndarray, tails: np.ndarray) -> pa.RecordBatch:
    gone = pa.nulls(len(heads), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(heads), pa.array(tails), gone, gone], schema=EDGES)


def _within(segments: int, distance: int, block: int):
    """Sorted (key, fp) rows in; edges out, and blocks of variants that don't fit one block.

    A variant whose members agree in the wildcard bit has them all in the variant of its
    segment's first bit as well, so it is compared only there.
    """
    width = BITS // segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        key, held, blocks = None, np.zeros(0, np.int64), 0

        def close():
            if blocks:
                n = len(held)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(held), pa.array(np.full(n, key)), pa.array(np.full(n, blocks))], schema=EDGES)
            elif len(held) > 1:
                bit = int(key) % BITS
                if bit % width:
                    ones = (held >> np.int64(bit)) & np.int64(1)
                    if ones.min() == ones.max():
                        return
                heads, tails = forest(held, distance)
                if len(heads):
                    yield _edges(heads, tails)

        for batch in batches:
            keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            # runs of one row that neither continue the last run nor may go on in the next batch
            runs = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a > 1 or a == 0 or b == len(keys)] if len(keys) else []
            for a, b in runs:
                if key is None or keys[a] != key:
                    yield from close()
                    key, held, blocks = keys[a], prints[a:b], 0
                else:
                    held = np.concatenate((held, prints[a:b]))
                while len(held) > block:
                    full, held = held[:block], held[block:]
                    yield pa.RecordBatch.from_arrays([pa.nulls(block, pa.int64()), pa.array(full), pa.array(np.full(block, key)), pa.array(np.full(block, blocks))], schema=EDGES)
                    blocks += 1
        if key is not None:
            yield from close()

    return run


def links(prints: DataFrame, distance: int = 3, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints at most distance bits apart."""
    segments = segments or max(2, distance // 2 + 1)
    if segments < 2 or BITS % segments or segments * 2 <= distance:
        raise ValueError(f"{segments} segments can't index {distance} bits of {BITS}")
    spark = prints.sparkSession
    parts = shuffle_partitions(spark)
    indexed = variants(prints.select("fp").distinct(), segments).repartition(parts, "key").sortWithinPartitions("key")
    first = checkpointed(indexed.mapInArrow(_within(segments, distance, block), "a long, b long, key long, block long"))
    hot = first.where("key is not null").select("key", "block", F.col("b").alias("fp"))
    last = hot.groupBy("key").agg(F.max("block").alias("last"))
    # block x meets block y in the group (x, y): x is sent to every y from x on, and to every smaller one
    dealt = hot.join(last, "key").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"), "block", "fp"
    ).select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "fp")

    def meet(table: pa.Table) -> pa.Table:
        heads, tails = forest(np.unique(table.column("fp").to_numpy()), distance)
        return pa.table({"a": heads, "b": tails})

    crossed = dealt.groupBy("key", "x", "y").applyInArrow(meet, "a long, b long")
    return first.where("key is null").select("a", "b").unionByName(crossed)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42, segments: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp, root, key1, key2) for every row of docs; root tells components apart."""
    prints = checkpointed(fingerprints(docs, shingle, seed))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(prints, distance, segments))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named_classes = rooted.join(named, "root").select("fp", "root", "component_id")
    return prints.join(named_classes, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "root", "key1", "key2"
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of docs of each component, chosen as keep_one does; rows of one doc_id are judged by their own texts."""
    return keep_one(docs, near_duplicates(docs.select("doc_id", "text"), **options))
