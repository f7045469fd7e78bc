"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each shard holds, for every word of its documents, the
sorted positions of the word. A frequent word is so spread over all shards, and the lists of one
phrase always meet in one place without a shuffle. Phrases are found by intersecting
offset-adjusted lists from the phrase's rarest term (by its count in the whole corpus) on;
proximity matches let every other term stand up to slop words off its place. A shard looks up
only those phrases whose rarest term it holds.

The index is built once, whatever the test items are. These are read to the driver in blocks of
at most ITEM_BYTES of text, so what each task gets is bounded; a larger test set takes more rounds
over the index, none over the corpus.

Defined results: null and empty texts have no words and are not contaminated; null and empty
items match nothing; items with the same words all count; items without an item_id count and hit,
but have no id to be named by; a very long text makes a shard of its own; repeated rows stay
repeated, and rows of one doc_id are judged by their own texts; without documents there are no
rows, and without items no hits; only doc_id, item_id and text are read, whatever other columns
are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, keep_nothing, row_key, row_slices

WINDOW = 10
#: Words of a shard, and bytes of test items of one round, at most about so many. A window takes
#: about a kilobyte as a plan, in the driver and in each worker, so these are some 400 MB.
SHARD_WORDS = 2_000_000
ITEM_BYTES = 2 << 20
SLICE_BYTES = 4 << 20

#: Letters go to lower case; of ASCII only letters and digits make words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def phrases_of(items: list[tuple], window: int = WINDOW) -> dict[tuple[bytes, ...], list]:
    """Every window of the items, with the ids of its items."""
    found: dict[tuple[bytes, ...], set] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found[tuple(words[i : i + window])].add(item)
    return {k: sorted(v, key=str) for k, v in found.items()}


SHARD = "shard long, doc_ids array<{id}>, n_words array<long>, words binary, counts binary, positions binary"


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def build_index(docs: DataFrame, gap: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each shard.

    Documents of a shard stand one after another, gap words apart, so that no phrase (and no
    proximity match with a smaller slop) crosses from one to the next. words has the shard's
    words, with spaces between them; counts (int32) says how many positions each has, and
    positions has their sorted uint32 lists in this order.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def close(shard: int, ids: list, kind: pa.DataType, sizes: list[int], codes: list[np.ndarray], numbers: _Numbers) -> pa.RecordBatch:
        starts = _starts(sizes, gap)
        code = np.concatenate(codes)
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64), sizes) + np.arange(len(code))
        order = np.argsort(code, kind="stable")
        counts = np.bincount(code, minlength=len(numbers)).astype("<i4")
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([b" ".join(numbers)], pa.binary()),
                pa.array([counts.tobytes()], pa.binary()), pa.array([at.astype("<u4")[order].tobytes()], pa.binary()),
            ],
            names=["shard", "doc_ids", "n_words", "words", "counts", "positions"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        ids, sizes, codes, total, numbers, shard = [], [], [], 0, _Numbers(), None
        for rows in row_slices(batches, "text", SLICE_BYTES):
            shard = rows.column(2)[0].as_py() << 32 if shard is None else shard
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if ids and total + len(words) > shard_words:
                    yield close(shard, ids, rows.column(0).type, sizes, codes, numbers)
                    ids, sizes, codes, total, numbers, shard = [], [], [], 0, _Numbers(), shard + 1
                ids.append(doc)
                sizes.append(len(words))
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                total += len(words) + gap
        if ids:
            yield close(shard, ids, rows.column(0).type, sizes, codes, numbers)

    return docs.select("doc_id", F.col("text").cast("string"), F.spark_partition_id().alias("part")).mapInArrow(run, SHARD.format(id=id_type))


def _starts(sizes: list[int], gap: int) -> np.ndarray:
    """First positions of a shard's documents."""
    return np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64) + gap)[:-1])).astype(np.int64)


class _Lists(dict):
    """A shard's positions by word."""

    def __init__(self, words: bytes, counts: bytes, positions: bytes):
        sizes = np.frombuffer(counts, "<i4").astype(np.int64)
        ends = np.cumsum(sizes)
        super().__init__(zip(words.split(b" ") if words else (), zip((ends - sizes).tolist(), ends.tolist()), strict=True))
        self.positions = np.frombuffer(positions, "<u4")

    def of(self, word: bytes) -> np.ndarray | None:
        span = self.get(word)
        return None if span is None else self.positions[span[0] : span[1]]


def term_counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """Occurrences in the whole corpus of those of the terms that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [(w, n) for w, n in zip(words.split(b" ") if words else (), np.frombuffer(counts, "<i4").tolist(), strict=True) if w in terms]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.binary()), pa.array([n for _, n in own], pa.int64())], names=["term", "n"])

    rows = index.select("words", "counts").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in rows.collect()}  # as many as there are terms


def phrase_starts(lists: _Lists, plan: list[tuple[bytes, int]]) -> np.ndarray:
    """Where a phrase starts; plan has (term, offset), the rarest term first."""
    starts = None
    for term, offset in plan:
        own = lists.of(term)
        if own is None:
            return np.zeros(0, np.int64)
        if starts is None:
            starts = own.astype(np.int64) - offset
        else:
            at = np.searchsorted(own, np.maximum(starts + offset, 0))
            starts = starts[own[np.minimum(at, len(own) - 1)] == starts + offset]
        if not len(starts):
            return starts
    return starts


def near_starts(lists: _Lists, plan: list[tuple[bytes, int]], slop: int) -> np.ndarray:
    """Where a phrase would start, by its rarest term, if each other term is up to slop words off its place."""
    starts = None
    for term, offset in plan:
        own = lists.of(term)
        if own is None:
            return np.zeros(0, np.int64)
        own = own.astype(np.int64)
        if starts is None:
            starts = own - offset
        else:
            low = np.searchsorted(own, starts + offset - slop)
            starts = starts[(low < len(own)) & (own[np.minimum(low, len(own) - 1)] <= starts + offset + slop)]
        if not len(starts):
            return starts
    return starts


HITS = "shard long, at int, spans array<struct<start:long,end:long>>, items array<string>"


def search(index: DataFrame, phrases: dict[tuple[bytes, ...], list], slop: int = 0, gap: int = WINDOW) -> DataFrame:
    """(shard, at, spans, items) of the documents where a phrase occurs: word intervals (start, end) that phrases cover, and the phrases' items.

    at is the document's place in its shard. With slop, spans start at the place that the phrase's
    rarest term implies, cut to the document.
    """
    if slop >= gap:
        raise ValueError("a slop has to be smaller than the gap between documents")
    counts = term_counts(index, {w for words in phrases for w in words})
    plans: dict[bytes, list] = defaultdict(list)
    for words, items in phrases.items():
        if all(w in counts for w in words):
            plan = sorted(((w, i) for i, w in enumerate(words)), key=lambda x: (counts[x[0]], x[1]))
            plans[plan[0][0]].append((plan, len(words), [None if i is None else str(i) for i in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch.column(1)[i].values.to_numpy()
                lists = _Lists(*(batch.column(c)[i].as_py() for c in (2, 3, 4)))
                starts = _starts(sizes, gap)
                spans, items = defaultdict(set), defaultdict(set)
                for rarest in plans.keys() & lists.keys():
                    for plan, length, own in plans[rarest]:
                        found = near_starts(lists, plan, slop) if slop else phrase_starts(lists, plan)
                        if len(found):
                            docs = np.searchsorted(starts, found + plan[0][1], side="right") - 1
                            for d, s in zip(docs.tolist(), (found - starts[docs]).tolist(), strict=True):
                                spans[d].add((max(0, s), min(int(sizes[d]), s + length)))
                                items[d].update(own)
                places = sorted(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * len(places), pa.int64()), pa.array(places, pa.int32()),
                        pa.array([[{"start": a, "end": b} for a, b in sorted(spans[d])] for d in places], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(items[d], key=lambda x: (x is not None, x)) for d in places], pa.list_(pa.string())),
                    ],
                    names=["shard", "at", "spans", "items"],
                )

    return index.select("shard", "n_words", "words", "counts", "positions").mapInArrow(run, HITS)


def _item_blocks(items: DataFrame, item_bytes: int) -> Iterator[list[tuple]]:
    """Lists of at most about item_bytes of text that the test items make."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // item_bytes)
    for i in range(blocks):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document, over all test items."""
    gap = max(window, slop + 1)
    index = checkpointed(build_index(docs, gap))
    rounds = [search(index, phrases_of(part, window), slop, gap) for part in _item_blocks(items, item_bytes)]
    hits = reduce(DataFrame.unionByName, rounds) if rounds else docs.sparkSession.createDataFrame([], HITS)
    if len(rounds) > 1:
        hits = hits.groupBy("shard", "at").agg(
            F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
    every = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("at", "d")).select("shard", "at", "d.doc_ids", "d.n_words")
    found = every.join(hits, ["shard", "at"], "left")
    return found.select(
        F.col("doc_ids").alias("doc_id"), "n_words", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered(spans: str = "spans") -> F.Column:
    """Number of words in a union of sorted intervals."""
    return F.expr(
        f"aggregate(array_sort({spans}), named_struct('n', 0L, 'to', 0L),"
        " (s, x) -> named_struct('n', s.n + greatest(0L, x.end - greatest(x.start, s.to)), 'to', greatest(s.to, x.end)),"
        " s -> s.n)"
    )


def flags(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of every document."""
    found = contamination(docs, items, window).withColumn("n_hit", covered())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of docs that hold no phrase of an item; each row is judged by its own text."""
    keys = row_key()
    named = docs.select(F.concat_ws(":", *keys).alias("doc_id"), "text")
    name = free_name(docs, "bad")
    bad = contamination(named, items, window).where(F.size("spans") > 0).select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, F.concat_ws(":", *keys)).join(bad, name, "left_anti").select(*docs.columns)
