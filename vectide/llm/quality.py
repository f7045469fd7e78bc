"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of learned vectors of the word and of its character n-grams; every
pair of neighbouring words has a learned vector of its own, and a pair of equal words another
one. Each is found by hashing into BUCKETS rows. A document is the mean over its words and pairs,
and a softmax layer gives its classes. All vectors are trained together by stochastic gradient
descent in numpy on the driver, from SAMPLE labelled documents at most, drawn by a hash of doc_id
from those that are there. What a document weighs in each row is worked out where its text lies,
so the driver gets BUCKETS numbers a sampled document at most, however long the text is.

Scoring is one pass without a shuffle: as the output is linear in the mean vector, a row comes
down to one number.

Defined results: null and empty texts, and texts of white space, get the score of the bias alone;
very long texts are read whole, PIECE bytes at a time; without labelled rows all scores are 0.5;
repeated labels of a document count once, the lowest; labels other than 0 and 1, and labels or
documents without doc_id, train nothing; rows repeat as given; an empty table gives no rows;
columns named score and predicted are replaced, others stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_nothing, low_hash, row_slices

BUCKETS, DIMENSIONS = 1 << 16, 16
GRAMS = (1, 2, 3, 4)
#: Labelled documents trained on at most, taken by a hash of their doc_id.
SAMPLE = 3000
EPOCHS, RATE, SEED = 8, 0.6, 42
THRESHOLD = 0.7
SLICE_BYTES = 4 << 20
#: Bytes of a text that are hashed in one go, but for a longer word.
PIECE = 1 << 20
#: Odd factors: of the polynomial over a gram's bytes, of a pair's first word, and of the last mix.
BASE, PAIR, MIX = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xBF58476D1CE4E5B9
_SPACE = re.compile(rb"\s")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that must not be trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes + np.uint64(kind)) * np.uint64(MIX)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(BASE)) >> np.uint64(64 - BUCKETS.bit_length() + 1)


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some at a time."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        if words := data[at:end].split():
            yield words
        at = end + 1


def features(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (rows, weights) whose weighted rows sum up to all words' and pairs' vectors; rows repeat."""
    last = None
    for words in _pieces((text or "").encode()):
        data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes)
        room = np.repeat(ends, sizes) - np.arange(len(data))
        # a word counts as the mean of itself and its grams
        grams = sum(np.maximum(sizes - n + 1, 0) for n in GRAMS)
        share = 1.0 / (grams + 1)
        by_place = np.repeat(share, sizes)
        rows, weights, h = [], [], np.zeros(len(data), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            h = h[: len(data) - n + 1] * np.uint64(BASE) + data[n - 1 :]
            if n in GRAMS:
                inside = np.flatnonzero(room[: len(h)] >= n)
                rows.append(_bucket(h[inside], n))
                weights.append(by_place[inside])
        powers = np.full(int(sizes.max()), BASE, np.uint64)
        powers[0] = 1
        whole = np.add.reduceat(data * np.multiply.accumulate(powers)[room - 1], ends - sizes)
        rows.append(_bucket(whole, 101))
        weights.append(share)
        row = whole if last is None else np.concatenate(([last], whole))
        last = whole[-1]
        pairs = _bucket(row[:-1] * np.uint64(PAIR) + row[1:], 102)
        same = np.full(int((row[:-1] == row[1:]).sum()), 0)
        rows += [pairs, same]
        weights += [np.ones(len(pairs)), np.ones(len(same))]
        yield np.concatenate(rows).astype(np.int64), np.concatenate(weights)


def weights_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a document, and what each counts in its mean vector."""
    sums, counted = np.zeros(BUCKETS), 0.0
    for rows, weights in features(text):
        sums += np.bincount(rows, weights, BUCKETS)
        counted += float(weights.sum())
    rows = np.flatnonzero(sums)
    return rows.astype("<u2"), (sums[rows] / (counted or 1.0)).astype("<f4")


def train(data: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Each row's part in the log odds of label 1, and the bias's, from documents as weights_of gives them."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, epochs * len(data))
    for _ in range(epochs):
        for i in rng.permutation(len(data)).tolist():
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            rows, share = data[i]
            taken = vectors[rows]
            mean = share @ taken
            z = output @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ output
            output -= lr * np.outer(p, mean)
            bias -= lr * p
            # a document's mean moves by the whole step, whichever rows it has
            vectors[rows] = taken - (lr * share / max(float(share @ share), 1e-6) * 0.05)[:, None] * back
    return (vectors @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model from labelled rows of docs that aren't held out; at most sample of them."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    present = marked.where(~held_out()).join(docs.select("doc_id"), "doc_id", "left_semi")
    some = present.where(low_hash("doc_id", sample, present.count())).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # some has sample rows at most
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for rows in row_slices(batches, "text", SLICE_BYTES):
            found = [weights_of(t) for t in rows.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([r.tobytes() for r, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())],
                names=["doc_id", "label", "rows", "weights"],
            )

    kinds = {n: docs.schema["doc_id"].dataType.simpleString() if n == "doc_id" else marked.schema["label"].dataType.simpleString() for n in ("doc_id", "label")}
    weighed = texts.mapInArrow(run, f"doc_id {kinds['doc_id']}, label {kinds['label']}, rows binary, weights binary")
    # documents may repeat
    rows = weighed.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("rows", "weights")).limit(sample).collect()
    return train([(np.frombuffer(r["rows"], "<u2"), np.frombuffer(r["weights"], "<f4")) for r in rows], [r["label"] for r in rows])


def odds(text: str | None, parts: np.ndarray, bias: float) -> float:
    """Log odds of label 1."""
    total, counted = 0.0, 0.0
    for rows, weights in features(text):
        total += float(parts[rows] @ weights)
        counted += float(weights.sum())
    return bias + (total / counted if counted else 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (of label 1) and predicted in place of any columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus holds
    plain = docs.select(*(c for c in docs.columns if c not in ("score", "predicted")))
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for rows in row_slices(batches, "text", SLICE_BYTES):
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            found = np.array([1 / (1 + math.exp(min(700.0, -odds(t, *shared.value)))) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], names=[*rows.schema.names, "score", "predicted"]
            )

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *added]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
