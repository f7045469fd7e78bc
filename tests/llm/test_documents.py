"""Operators over documents against plain versions of what they return."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm import near_copies, positional_index, queries, simhash, substring_dedup, tree_bpe
from vectide.llm.common import read

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("key", T.IntegerType())])


def odd_texts():
    rng = random.Random(7)
    base = " ".join(rng.choice(["ab", "cde", "F", "öß", "12", "x-y"]) for _ in range(120))
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(20_000))
    return [None, "", "  \n\t ", "one", "One  two\nthree", base, base, base + " tail", "head " + base, long, long + " more", "x" * 5000, "日本語 テキスト と 空白 " * 40, "a b \x1c c", "It's  we'll\r\n\r\n  don't 123,456 ", "<|endoftext|> <|endoftext|>"]


def odd_docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame([*rows, rows[5], (None, "one", None, None)], DOC)


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()}


# substring dedup

def plain_repeats(docs: list[tuple], window: int) -> dict:
    seen = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (doc, _), w in zip(docs, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("window", [1, 3, 35])
def test_repeats_odd(spark, window):
    docs = odd_docs(spark)
    found = substring_dedup.repeated_passages(docs, window, block_bytes=5000, range_hashes=3000)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_repeats([(r[0], r[1]) for r in docs.collect()], window)
    for r in found.collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
    assert substring_dedup.repeated_passages(empty_docs(spark), window).count() == 0


def test_repeats_whole_table(spark, sf_dir):
    found = queries.op5_substring_dedup(spark, sf_dir)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_repeats(list(texts(spark, sf_dir).items()), 35)


def test_window_hashes_follow_words():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 500).astype(np.uint64) * np.uint64(0x1234567)
    for window in (1, 2, 5, 7, 35):
        h = substring_dedup.window_hashes(words, window)
        assert len(h) == 500 - window + 1
        same = {}
        for i, x in enumerate(h.tolist()):
            assert same.setdefault(x, tuple(words[i : i + window])) == tuple(words[i : i + window])
        assert len(same) == len({tuple(words[i : i + window]) for i in range(len(h))})
    sample = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    more = rng.integers(0, 2**24, len(sample)).astype(np.uint32)
    for n in (1, 2, len(sample)):
        got = substring_dedup.unpack(substring_dedup.pack(sample[:n], more[:n]))
        assert (got[0] == sample[:n]).all() and (got[1] == more[:n]).all()


def test_other_bits_tell_windows_apart():
    """Of equal 64-bit hashes only those with equal other bits count as equal, in whatever order they come."""
    hashes, more = np.array([5, 9, 5, 5, 9, 5], np.uint64), np.array([1, 0, 2, 1, 0, 3], np.uint32)
    order = substring_dedup.ordered(hashes, more)
    same = substring_dedup.alike(hashes[order], more[order])
    shared = same.copy()
    shared[:-1] |= same[1:]
    flags = np.empty(6, bool)
    flags[order] = shared
    assert flags.tolist() == [True, True, False, True, True, False]


def test_equal_rows_are_spread_over_blocks(spark):
    docs = spark.createDataFrame([(None, "w " * 50)] * 200 + [(1, "other words")], "doc_id long, text string").coalesce(1)
    assert substring_dedup.blocks_of(docs, 1000).count() >= 20
    found = substring_dedup.repeated_passages(docs, 35, block_bytes=1000)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_repeats([(r[0], r[1]) for r in docs.collect()], 35)


# simhash

def plain_fingerprint(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints: dict) -> dict:
    items, root = sorted(prints.items()), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if (x ^ y).bit_count() <= 3:
                a1, b1 = sorted((find(a), find(b)))
                root[b1] = a1
    return {i: find(i) for i in prints}


def test_fingerprints():
    for text in odd_texts():
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates_whole_table(spark, sf_dir):
    prints = {i: plain_fingerprint(t) for i, t in texts(spark, sf_dir).items()}
    roots = plain_components(prints)
    want = sorted(((i, f"{p:016x}", roots[i]) for i, p in prints.items()), key=str)
    assert rows_of(queries.op6_simhash_near_dedup(spark, sf_dir), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize(("distance", "segments", "block"), [(3, 2, 2048), (3, 2, 16), (3, 4, 3), (1, 2, 2), (7, 4, 5)])
def test_links_make_the_same_components(spark, distance, segments, block):
    rng = random.Random(3)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(40):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
            base = x if rng.random() < 0.3 else base
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = [(r["a"], r["b"]) for r in simhash.links(df, distance, segments, block).collect()]
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= distance
        root[find(a)] = find(b)
    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= distance:
                assert find(a) == find(b)


def test_near_duplicates_odd(spark):
    docs = odd_docs(spark)
    rows = docs.collect()
    found = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert found[0, "0" * 16] == found[1, "0" * 16] == found[2, "0" * 16] == 0
    assert simhash.near_duplicates(docs).count() == len(rows)
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {0, 3} <= {r["doc_id"] for r in kept.collect()} and not {1, 2, 6, None} & {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, near_copies.drop_near_copies])
def test_rows_of_one_id_are_judged_by_their_texts(spark, drop):
    t, u, v = (" ".join(f"{x}{i}" for i in range(60)) for x in "tuv")
    rows = [(1, t), (2, t), (2, u), (2, u), (None, u), (None, v), (None, v), (None, None), (9, "")]
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame(some, "doc_id long, text string").withColumn("key1", F.lit("x")).withColumn("root", F.lit("y"))
        assert sorted(((r["doc_id"], r["text"]) for r in drop(docs).collect()), key=str) == sorted([(1, t), (2, u), (None, v), (9, "")], key=str)


def test_contaminated_rows_are_judged_by_their_texts(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (None, "delta epsilon")], "item_id long, text string")
    rows = [(None, "x alpha beta gamma"), (None, "clean"), (5, "clean"), (5, "the delta epsilon"), (5, None), (6, "clean"), (6, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("x")).withColumn("bad", F.lit("y"))
    kept = positional_index.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[1], rows[2], *rows[4:]], key=str)
    found = {r["n_hit"]: r for r in positional_index.flags(docs, items).where("contaminated").collect()}
    assert found[2]["n_items"] == 1 and found[2]["items_sha256"] == hashlib.sha256(b"").hexdigest()


# positional index

def plain_hits(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words_of = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit[i : i + n] = [True] * n
                    found |= own
        out.append((doc, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


FLAGS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination_whole_table(spark, sf_dir):
    items = [tuple(r) for r in read(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    want = plain_hits(list(texts(spark, sf_dir).items()), items)
    assert any(x[-1] for x in want)
    assert rows_of(queries.op4_benchmark_decontamination(spark, sf_dir), *FLAGS) == want


def test_contamination_odd(spark):
    docs = odd_docs(spark)
    plain = [(r[0], r[1]) for r in docs.collect()]
    base = odd_texts()[5].split()
    items = [(1, " ".join(base[:14])), (2, None), (3, ""), (4, "CDE f"), (5, "cde f"), (10, " ".join(base[20:29])), (11, "nowhere at all"), (12, "空白 日本語")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(plain, items)
    assert rows_of(positional_index.flags(docs, table), *FLAGS) == want
    several = positional_index.contamination(docs, table, item_bytes=20)
    assert rows_of(several.select("doc_id", "n_words", positional_index.covered().alias("n")), "doc_id", "n_words", "n") == sorted((x[:3] for x in want), key=str)
    twice = spark.createDataFrame([(1, "cde f"), (1, "cde g"), (1, "cde g"), (None, "x y")], "doc_id long, text string")
    hits = positional_index.contamination(twice, table, item_bytes=20).select("doc_id", positional_index.covered().alias("n"))
    assert rows_of(hits, "doc_id", "n") == sorted([(1, 2), (1, 0), (1, 0), (None, 0)], key=str)
    assert positional_index.flags(docs, table.where("false")).where("contaminated").count() == 0
    assert positional_index.flags(empty_docs(spark), table).count() == 0


def test_small_shards_and_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma"), (2, "alpha"), (3, "beta gamma"), (4, "gamma beta alpha"), (5, "alpha beta gamma"), (6, None)], "doc_id long, text string")
    phrases = {(b"alpha", b"beta", b"gamma"): [9]}
    for words in (1, 100):
        index = positional_index.build_index(docs, shard_words=words).cache()
        ids = index.select("shard", F.posexplode("doc_ids").alias("at", "doc_id"))
        hits = lambda slop: {r["doc_id"]: r["items"] for r in positional_index.search(index, phrases, slop).join(ids, ["shard", "at"]).collect()}  # noqa: B023, E731
        assert hits(0) == {5: ["9"]}
        assert hits(1) == {1: ["9"], 5: ["9"]}
        assert positional_index.term_counts(index, {b"alpha", b"x", b"none"}) == {b"alpha": 4, b"x": 1}


# tree BPE

@pytest.fixture(scope="module")
def library():
    lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return tree_bpe.TreeBPE(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_tree_equals_library(coder, library):
    rng = random.Random(5)
    alphabets = ["ab", "aeiouns", "abcdefghij klmnop", "0123456789 ", "äöüßéñ日本語😀 e", " \n\t'", "!?#$-=", "the of and ing tion "]
    for i in range(1500):
        letters = rng.choice(alphabets)
        text = "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 30, 300])))
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert coder.decode(ids).decode() == text
        known = {}
        assert tree_bpe.encode_ids(text, coder, known).tolist() == ids, repr(text)
    for text in ("a" * 40_000, "ab" * 9000 + "c", "é" * 5000, "ha" * 3000 + " ".join(["x"] * 3000)):
        assert coder.encode(text) == library.encode_ordinary(text)


def want_bpe(docs, library):
    out = []
    for doc, text in docs:
        ids = library.encode_ordinary(text or "")
        data = library.decode_bytes(ids)
        out.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest()))
    return sorted(out, key=str)


BPE = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_bpe_whole_table(spark, sf_dir, library):
    assert rows_of(queries.op7_tree_bpe(spark, sf_dir), *BPE) == want_bpe(list(texts(spark, sf_dir).items()), library)


def test_bpe_odd(spark, library):
    docs = odd_docs(spark)
    found = tree_bpe.encode(docs)
    assert rows_of(found, *BPE) == want_bpe([(r[0], r[1]) for r in docs.collect()], library)
    for r in found.collect():
        assert hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"] and len(r["ids"]) == r["n_tokens"]
    assert tree_bpe.encode(empty_docs(spark)).count() == 0
