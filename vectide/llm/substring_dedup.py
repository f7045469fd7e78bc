"""Removal of word passages that repeat: Rabin-Karp hashes of every fixed-length window, counted in Spark.

Documents are put into blocks of bounded size as they lie, and the blocks are written, compressed,
as rows of a table. A block's windows are hashed with two rolling polynomials over 64-bit word hashes, 88 bits
together, and its distinct hashes are sent, sorted and delta-packed, to the ranges of hash space
they fall in. Each range finds the hashes that more than one block holds (or one block holds
twice) and answers every block with one bit for each hash it sent. The block hashes its documents
again and merges repeated windows into maximal removal intervals. So a window costs about nine
bytes of shuffle, a passage that millions of documents share costs one hash a block, and nothing
is sampled or capped.

Two different windows are taken for equal with probability near n^2 / 2^89 for n windows in all:
1e-4 for a terabyte of text (2.4e11 windows); a hundred terabytes may hold one such pair.

A block sends a piece to each range, and both grow in number with the input. Blocks grow up to
LARGEST_BLOCK so that a piece keeps PIECE_HASHES hashes, up to some 500 GB; beyond them pieces
get smaller, and at a hundred terabytes each window is sent as a row of its own.

Defined results: null and empty texts have no words, none removed, and the hash of no bytes;
texts shorter than a window lose nothing; a very long text makes a block of its own, whose windows
one worker holds at twelve bytes each; repeated rows repeat each other's windows, and are spread
over blocks like any others; an empty table gives no rows; only doc_id and text are read, whatever
other columns are called.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, checkpointed, kept, remove, row_slices, shared_folder

#: Odd bases of the polynomials; 3 and 5 modulo 8, so that their powers differ in low bits.
BASE, OTHER = 0x9E3779B97F4A7C13, 0xD1B54A32D192ED05
#: Text of a block and hashes of a range, at most about so many.
BLOCK_BYTES, LARGEST_BLOCK = 6 << 20, 24 << 20
RANGE_HASHES, PIECE_HASHES = 2_000_000, 64
SLICE_BYTES = 4 << 20
#: How hard blocks are compressed: they are kept as a table, and meet their answers in a shuffle.
ZSTD_LEVEL = 6
#: Bytes of blocks that a worker gets at a time, but for larger blocks.
BATCH_BYTES = 8 << 20
CACHED_WORDS = 400_000


def _word_hashes(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = kept(("windows",), dict)
    new = set(words).difference(known)
    if len(known) + len(new) > CACHED_WORDS:
        known.clear()
        new = set(words)
    known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, window: int, base: int = BASE) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every window of word hashes, built by doubling and mixed."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    done, size, part, width = None, 0, words, 1
    rest = window
    while rest:
        if rest & 1:
            # windows so far start where this part ends
            done, size = (part, width) if done is None else (part[: len(part) - size] * power(size) + done[width : width + len(part) - size], size + width)
        rest >>= 1
        if rest:
            part, width = part[:-width] * power(width) + part[width:], 2 * width
    mixed = done[:n] ^ (done[:n] >> np.uint64(29))
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def pack(hashes: np.ndarray, more: np.ndarray) -> bytes:
    """Sorted hashes as their number, first value, a width, and deltas of that many bytes; then their 24 other bits."""
    deltas = np.diff(hashes)
    width = max(1, (int(deltas.max()).bit_length() + 7) // 8) if len(deltas) else 1
    body = np.ascontiguousarray(deltas.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    return np.uint32(len(hashes)).tobytes() + hashes[:1].astype("<u8").tobytes() + bytes([width]) + body + np.ascontiguousarray(more.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, width = int.from_bytes(blob[:4], "little"), np.frombuffer(blob, "<u8", 1, 4), blob[12]
    body = np.frombuffer(blob, np.uint8, (n - 1) * width, 13).reshape(-1, width)
    deltas = np.zeros((len(body), 8), np.uint8)
    deltas[:, :width] = body
    more = np.zeros((n, 4), np.uint8)
    more[:, :3] = np.frombuffer(blob, np.uint8, 3 * n, 13 + (n - 1) * width).reshape(-1, 3)
    return np.cumsum(np.concatenate((first, deltas.reshape(-1).view("<u8"))), dtype=np.uint64), more.reshape(-1).view("<u4")


def ordered(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The places of pairs in their order."""
    order = np.argsort(hashes, kind="stable")
    h, m = hashes[order], more[order]
    if ((h[1:] == h[:-1]) & (m[1:] != m[:-1])).any():  # hashes that only the other bits tell apart: hardly ever
        order = np.lexsort((more, hashes))
    return order


def alike(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Whether each of some ordered pairs equals the one before it."""
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (more[1:] == more[:-1])
    return same


def _hashes(texts: list[str | None], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The hashes of every text's windows, and their 24 other bits."""
    out = []
    for text in texts:
        words = (text or "").encode().split()
        known = _word_hashes(words) if len(words) >= window else np.zeros(0, np.uint64)
        out.append((window_hashes(known, window), (window_hashes(known, window, OTHER) >> np.uint64(40)).astype(np.uint32)))
    return out


class _Distinct:
    """A block's distinct hashes in order, where those of each text are among them, and which the block holds twice."""

    def __init__(self, texts: list[str | None], window: int):
        found = _hashes(texts, window)
        self.sizes = [len(h) for h, _ in found]
        hashes, more = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.uint64, np.uint32)))
        del found
        order = ordered(hashes, more)
        hashes, more = hashes[order], more[order]
        new = ~alike(hashes, more)
        self.places = np.empty(len(order), np.int32)
        self.places[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.hashes, self.more = hashes[starts], more[starts]
        self.repeated = np.diff(np.append(starts, len(new))) > 1


def _packed(rows: list[pa.RecordBatch]) -> bytes:
    """Rows (doc_id, text) as a compressed stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD_LEVEL))) as out:
        out.write_table(pa.Table.from_batches(rows).combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all().combine_chunks()


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, rows): documents as they lie, about block_bytes of text in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = None, [], 0
        for batch in batches:
            if batch.num_rows and block is None:
                block = batch.column(2)[0].as_py() << 32
            for rows in row_slices([batch.select(["doc_id", "text"])], "text", min(SLICE_BYTES, block_bytes)):
                own = rows.column(1).nbytes
                if held and size + own > block_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_packed(held)], pa.binary())], names=["block", "rows"])
                    block, held, size = block + 1, [], 0
                held.append(rows)
                size += own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_packed(held)], pa.binary())], names=["block", "rows"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part")).mapInArrow(run, "block long, rows binary")


def _sent(window: int, bits: int):
    """Blocks in; (block, range, hashes, repeated) out: repeated marks hashes the block holds twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = _Distinct(_unpacked(batch.column(1)[i].as_py()).column(1).to_pylist(), window)
                cuts = _cuts(own.hashes, bits)
                full = [(r, slice(a, b)) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * len(full), pa.int64()),
                        pa.array([r for r, _ in full], pa.int64()),
                        pa.array([pack(own.hashes[x], own.more[x]) for _, x in full], pa.binary()),
                        pa.array([np.packbits(own.repeated[x]).tobytes() for _, x in full], pa.binary()),
                    ],
                    names=["block", "range", "hashes", "repeated"],
                )

    return run


def _cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))


def _answered(table: pa.Table) -> pa.Table:
    """Rows of one range in; (block, range, repeated) out with a bit for each hash sent."""
    parts = [unpack(x) for x in table.column("hashes").to_pylist()]
    hashes, more = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    sizes = [len(p[0]) for p in parts]
    del parts
    order = ordered(hashes, more)
    same = alike(hashes[order], more[order])
    shared = same.copy()
    shared[:-1] |= same[1:]
    flags = np.empty(len(order), bool)
    flags[order] = shared
    out, at = [], 0
    for n, own in zip(sizes, table.column("repeated").to_pylist(), strict=True):
        out.append(np.packbits(flags[at : at + n] | np.unpackbits(np.frombuffer(own, np.uint8), count=n).astype(bool)).tobytes())
        at += n
    return pa.table({"block": table.column("block"), "range": table.column("range"), "repeated": pa.array(out, pa.binary())})


RESULT = "n_words long, n_removed long, kept_sha256 string, kept string, removed array<struct<start:long,end:long>>"


def _removed(window: int, bits: int, keep: bool):
    """A block and its answers in; a row for each document out."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _unpacked(blocks.column("rows")[0].as_py())
        ids, texts = rows.column(0), rows.column(1).to_pylist()
        own = _Distinct(texts, window)
        cuts, flags = _cuts(own.hashes, bits), np.zeros(len(own.hashes), bool)
        for i, mask in zip(answers.column("range").to_pylist(), answers.column("repeated").to_pylist(), strict=True):
            a, b = cuts[i], cuts[i + 1]
            flags[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
        bad = flags[own.places]
        out, at = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": [], "removed": []}, 0
        for text, n in zip(texts, own.sizes, strict=True):
            words = (text or "").encode().split()
            covered = np.zeros(len(words) + 1, np.int32)
            starts = np.flatnonzero(bad[at : at + n])
            at += n
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + window, -1)
            gone = np.cumsum(covered[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2).tolist()
            left, last = [], 0
            for a, b in edges:
                left += words[last:a]
                last = b
            left = b" ".join(left + words[last:] if edges else words)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["kept"].append(left.decode() if keep else None)
            out["removed"].append([{"start": a, "end": b} for a, b in edges])
        kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
        return pa.table([ids, *(pa.array(out[k], t) for k, t in kinds.items())], names=["doc_id", *kinds])

    return run


def repeated_passages(docs: DataFrame, window: int = 35, keep_text: bool = True, block_bytes: int | None = None, range_hashes: int = RANGE_HASHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, removed) for every row of docs.

    A word goes if any window that covers it also starts anywhere else in docs. kept is the rest,
    joined by single spaces (null unless keep_text); removed has the maximal intervals of words.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).first()["bytes"] or 0
    # a word of prose takes four bytes or more; words of one letter make ranges twice as large
    bits = max(0, (size // 4 // range_hashes).bit_length())
    if block_bytes is None:
        block_bytes = min(LARGEST_BLOCK, max(BLOCK_BYTES, 6 * PIECE_HASHES << bits))
    folder = f"{shared_folder(spark)}/passages-{uuid.uuid4().hex}"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    with batches_of(spark, BATCH_BYTES):
        blocks_of(docs, block_bytes).write.parquet(folder)
        blocks = spark.read.parquet(folder)
        sent = blocks.select("block", "rows").mapInArrow(_sent(window, bits), "block long, range long, hashes binary, repeated binary")
        answers = sent.groupBy("range").applyInArrow(_answered, "block long, range long, repeated binary")
        found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_removed(window, bits, keep_text), f"doc_id {id_type}, {RESULT}")
        found = checkpointed(found)
    remove(spark, folder)
    return found
