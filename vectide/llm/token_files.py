"""Token ids in binary files of patched frame-of-reference blocks.

A file is a Parquet container, so that Spark commits it as a whole on any store; its rows are
segments of whole documents. A segment's payload, all little-endian:

    magic "PFR1", uint32 ids, uint32 blocks
    uint32 starts[blocks + 1]   where each block begins, and where the last one ends
    block: uint32 least, uint8 width, uint16 exceptions,
           uint64 packed[16 * width]     least subtracted, low width bits, 64 ids to width words
           uint16 places[exceptions], uint32 highs[exceptions]   what is above the width

A block has 1024 ids (the last is filled up with its least). Its width is that of the
PERCENTILE-th of its differences, so rare large ids go to the exception list instead of widening
the block. Any block can be read by itself.

Documents are written in ascending doc_id order, repeated ids by their text's hash, rows without
a doc_id first; each ends with the end id.

Defined results: null and empty texts are the end id alone; what spells a special token is that
token, as the library has it; very long texts make a segment of their own; repeated rows are
written as often as they come; an empty table makes a folder that reads as no rows. Only doc_id
and text are read, whatever other columns are called.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, kept, remove, row_slices, shared_folder, shuffle_partitions
from .tree_bpe import CUT

BLOCK, GROUP = 1024, 64
PERCENTILE = 0.95
MAGIC = b"PFR1"
#: Ids of a segment and bytes of text of a file, at most about so many.
SEGMENT_IDS = 1 << 20
FILE_BYTES = 24 << 20
SLICE_BYTES = 4 << 20
KEPT = 1_500_000
END = 0


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values of width bits as rows of width uint64 words."""
    out = np.zeros((len(rows), width), np.uint64)
    columns = np.ascontiguousarray(rows.T)
    for k in range(GROUP if width else 0):
        word, shift = divmod(k * width, 64)
        out[:, word] |= columns[k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= columns[k] >> np.uint64(64 - shift)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((GROUP, len(words)), np.uint64)
    columns = np.ascontiguousarray(words.T)
    mask = np.uint64((1 << width) - 1)
    for k in range(GROUP if width else 0):
        word, shift = divmod(k * width, 64)
        out[k] = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            out[k] |= columns[word + 1] << np.uint64(64 - shift)
        out[k] &= mask
    return out.T


def write_segment(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A segment's payload from its ids (below 2^32)."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return MAGIC + struct.pack("<III", 0, 0, 16)
    values = np.empty(blocks * BLOCK, np.uint64)
    values[:n], values[n:] = ids, ids[(blocks - 1) * BLOCK :].min()
    values = values.reshape(blocks, BLOCK)
    least = values.min(axis=1)
    deltas = values - least[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    chosen = np.partition(deltas, at, axis=1)[:, at]
    widths = np.zeros(blocks, np.int64)
    for bit in range(32):
        widths[chosen >= np.uint64(1 << bit)] = bit + 1
    highs = deltas >> widths.astype(np.uint64)[:, None]
    rows, places = np.nonzero(highs)
    high = highs[rows, places].astype("<u4")
    counts = np.bincount(rows, minlength=blocks)
    ends = np.cumsum(counts)
    packed: list[bytes] = [b""] * blocks
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        low = (deltas[own] & np.uint64((1 << width) - 1)).reshape(-1, GROUP)
        words = _pack(low, width).astype("<u8").reshape(len(own), -1)
        for i, w in zip(own.tolist(), words, strict=True):
            packed[i] = w.tobytes()
    places = places.astype("<u2")
    parts = []
    for i in range(blocks):
        a, b = ends[i] - counts[i], ends[i]
        parts.append(struct.pack("<IBH", least[i], widths[i], counts[i]) + packed[i] + places[a:b].tobytes() + high[a:b].tobytes())
    starts = 12 + 4 * (blocks + 1) + np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return MAGIC + struct.pack("<II", n, blocks) + starts.astype("<u4").tobytes() + b"".join(parts)


def read_segment(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive; all without it) of a payload, as uint32."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment")
    n, blocks = struct.unpack_from("<II", payload, 4)
    last = blocks if last is None else min(last, blocks)
    starts = np.frombuffer(payload, "<u4", blocks + 1, 12)
    heads = [struct.unpack_from("<IBH", payload, s) for s in starts[first:last].tolist()]
    values = np.zeros((len(heads), BLOCK), np.uint64)
    widths = np.array([h[1] for h in heads], np.int64)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        size = BLOCK // GROUP * width
        words = np.concatenate([np.frombuffer(payload, "<u8", size, starts[first + i] + 7) for i in own.tolist()])
        values[own] = _unpack(words.reshape(-1, width), width).reshape(len(own), BLOCK) if width else 0
    for i, (least, width, exceptions) in enumerate(heads):
        if exceptions:
            at = int(starts[first + i]) + 7 + 8 * (BLOCK // GROUP) * width
            places = np.frombuffer(payload, "<u2", exceptions, at)
            values[i, places] |= np.frombuffer(payload, "<u4", exceptions, at + 2 * exceptions).astype(np.uint64) << np.uint64(width)
        values[i] += np.uint64(least)
    return values.reshape(-1)[: max(0, n - first * BLOCK)].astype("<u4")


#: The bytes' characters in a byte-level vocabulary: printable ones stand for themselves, the others for those from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _PRINTABLE]
_CHARACTERS = {b: 256 + i for i, b in enumerate(_HIDDEN)}
#: Below this, letters are letters to every version of Unicode.
_PLAIN = "\u0250"


class Words(dict):
    """Ids, as uint32 bytes, of chunks that follow a space (or start a line, without it).

    The tokenizer's pattern starts a match at such a space, at a line feed between two
    characters that aren't white space, and after it; and a full stop or comma that ends a chunk
    is no part of a match of letters. So a chunk is put together from parts that are each
    encoded once: words of letters by the tokenizer's model, any others by the tokenizer.
    Raises KeyError for what is no chunk: the empty string, or white space at either end.
    """

    def __init__(self, tokenizer, prefix: str, starts: Words | None = None):
        super().__init__()
        self.tokenizer, self.model, self.prefix = tokenizer, tokenizer.model, prefix
        #: the prefix as the vocabulary writes it
        self.lead = prefix.translate(_CHARACTERS)
        #: chunks that start a line
        self.starts = self if starts is None else starts
        self.ids = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self.marks = {c: self.encoded(c) for c in "\n.,"}

    def encoded(self, text: str) -> bytes:
        return b"".join([self.ids[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and (chunk.isascii() or max(chunk) < _PLAIN):
            letters = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_CHARACTERS)
            found = b"".join([self.ids[t.id] for t in self.model.tokenize(self.lead + letters)])
        else:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise KeyError(chunk)
            line, feed, rest = chunk.partition("\n")
            if feed and not line[-1].isspace() and not rest[0].isspace():
                return self[line] + self.marks["\n"] + self.starts[rest]
            word = chunk[:-1]
            if chunk[-1] in ".," and word.isalpha() and max(word) < _PLAIN:
                found = self[word] + self.marks[chunk[-1]]
            else:
                found = self.encoded(self.prefix + chunk)
        if len(self) > KEPT:
            self.clear()
        self[chunk] = found
        return found


#: What a tokenizer file has to say besides its vocabulary for texts to be put together from chunks.
_KNOWN = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}


class Whole:
    """Encodes texts whole: for other kinds of tokenizers."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __call__(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Chunked(Whole):
    """Encodes texts from chunks, but for texts that hold a special token."""

    def __init__(self, tokenizer):
        super().__init__(tokenizer)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.starts = Words(tokenizer, "")
        self.words = Words(tokenizer, " ", self.starts)

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return super().__call__(text)
        return encode_text(text, (self.starts, self.words))


def _coder(path: str) -> Whole:
    """The worker's encoder of whole texts."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        alike = all(said.get(k) == v for k, v in _KNOWN.items()) and said["model"].get("type") == "BPE"
        return (Chunked if alike else Whole)(Tokenizer.from_file(path))

    return kept(("files", path), make)


def encode_text(text: str, coder: tuple[Words, Words]) -> bytes:
    """Ids of a whole text without special tokens, as uint32 bytes."""
    if not text:
        return b""
    starts, words = coder
    first, *rest = text.split(" ")
    try:
        return starts[first] + b"".join(map(words.__getitem__, rest))
    except KeyError:  # runs of white space: cut only at spaces between two other characters
        first, *rest = CUT.split(text)
        whole = [starts.encoded(first)]
        for chunk in rest:
            whole.append(words.encoded(" " + chunk) if not chunk or chunk[0].isspace() or chunk[-1].isspace() else words[chunk])
        return b"".join(whole)


FILE = "part int, seq int, doc_ids array<{id}>, lengths array<long>, payload binary"


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END) -> None:
    """Writes docs' ids to folder, in ascending doc_id order over part and seq.

    tokenizer names the tokenizer file on the executors; without it, the byte-level BPE of the
    tokenizer package there.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(shuffle_partitions(spark), -(-size // FILE_BYTES))
    # rows that are equal in doc_id and text may be many: they are one another's equals, so any order of them will do
    order = ["doc_id", "tie", "spread"]
    dealt = texts.withColumn("tie", F.xxhash64("text")).withColumn("spread", F.monotonically_increasing_id() % 4096).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        last = np.array([end], "<u4").tobytes()
        ids, held, total, seq = [], [], 0, 0

        def close(kind: pa.DataType, part: int) -> pa.RecordBatch:
            payload = write_segment(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "seq", "doc_ids", "lengths", "payload"],
            )

        for rows in row_slices(batches, "text", SLICE_BYTES):
            kind, part = rows.column(0).type, rows.column(2)[0].as_py()
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                data = coder(text or "") + last
                if ids and total + len(data) // 4 > SEGMENT_IDS:
                    yield close(kind, part)
                    ids, held, total, seq = [], [], 0, seq + 1
                ids.append(doc)
                held.append(data)
                total += len(data) // 4
        if ids:
            yield close(kind, part)

    numbered.mapInArrow(run, FILE.format(id=id_type)).write.option("compression", "none").parquet(folder)


def scan(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in folder; ids are null unless kept.

    start is the number of ids of all documents before. It is summed over segments within a
    file, and over files, never over documents in one place.
    """
    files = spark.read.parquet(folder)
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, docs, lengths, payload = (batch.column(c)[i] for c in range(5))
                ids = read_segment(payload.as_py())
                data, lengths = memoryview(ids.tobytes()), lengths.values.to_numpy()
                ends = np.cumsum(lengths)
                spans = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in spans]
                lists = [ids[a:b] for a, b in spans] if keep_ids else [None] * len(spans)
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), docs.values, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                )

    documents = files.select("part", "seq", "doc_ids", "lengths", "payload").mapInArrow(
        run, f"part int, seq int, doc_id {id_type}, at long, n_tokens long, ids_crc32 long, ids array<long>"
    )
    segments = files.select("part", "seq", F.expr("aggregate(lengths, 0L, (s, x) -> s + x)").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("seq_start")).join(parts, "part")
    return documents.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("part_start") + F.col("seq_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs to a new folder of the shared one, reads it back, and removes it."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer)
    found = checkpointed(scan(spark, folder, keep_ids=False).drop("ids"))
    remove(spark, folder)
    return found
