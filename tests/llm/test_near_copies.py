"""Near copies against all pairs of shingle sets."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from vectide.llm import near_copies
from vectide.llm.common import connected_components, read


def plain_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_roots(texts):
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: plain_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in texts}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_pipeline_stage_drops_edited_copies(spark, sf_dir):
    rng, schema = random.Random(5), read(spark, sf_dir, "documents").select("doc_id", "text").schema
    texts = {}
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for edits in (0, 2, 3, 12):
            texts[len(texts)] = edited(rng, words, edits)
    roots = plain_roots(texts)
    assert len(set(roots.values())) <= len(texts) / 2
    docs = spark.createDataFrame(list(texts.items()), schema)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == set(roots.values())


def test_near_copies_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in read(spark, sf_dir, "documents").collect()}
    found = near_copies.near_copies(read(spark, sf_dir, "documents")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_roots(texts)


def test_near_copies_odd(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = dict(enumerate([None, "", " \n", "one", "ONE", "one two", *(edited(rng, words, 2) for _ in range(60))]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (3, 128):
        found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, block=block).collect()}
        assert found == plain_roots(texts)
    assert near_copies.near_copies(docs.where("false")).count() == 0


def test_large_groups_of_copies_and_others(spark):
    """Groups that share a band, of copies of the first text, copies of copies, and texts that are no copies."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    texts = {0: " ".join(words)}
    for i in range(1, 150):  # chains: each an edit of an earlier one
        texts[i] = edited(rng, texts[rng.randrange(i)].split(), rng.choice([1, 2, 4]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_roots(texts)
    assert len(set(want.values())) > 1
    for block in (2, 10, 128):
        found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, block=block).collect()}
        assert found == want


def test_fingerprints_bring_copies_together(spark):
    """Without any shared band, texts whose fingerprints are linked and whose sets are alike are linked; those alike in fingerprints alone aren't."""
    rng = random.Random(9)
    texts = {}
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        for edits in (0, 1, 1, 2):
            texts[len(texts)] = edited(rng, words, edits)
    docs = spark.createDataFrame([*texts.items(), (900, None), (901, "")], "doc_id long, text string")
    found = near_copies.sets(docs).withColumn("bands", F.when(F.size("bands") > 0, F.array("node")).otherwise(F.col("bands"))).cache()
    prints = {r["doc_id"]: (r["node"], r["fp"] & (2**64 - 1)) for r in found.collect()}
    want = {(a, b) for a in texts for b in texts if a < b and (prints[a][1] ^ prints[b][1]).bit_count() <= 3}
    assert len(want) >= 30 and all(a // 4 == b // 4 for a, b in want)
    roots = {r["node"]: r["root"] for r in connected_components(near_copies.links(found)).collect()}
    root = lambda i: roots.get(prints[i][0], prints[i][0])
    assert all(root(a) == root(b) for a, b in want)
    # the same fingerprint, but sets that share nothing
    apart = found.where("doc_id in (0, 4)").withColumn("fp", F.lit(5).cast("long"))
    assert near_copies.links(apart).count() == 0
