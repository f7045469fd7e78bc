"""The pipeline against what its stages' operators decide."""

import hashlib

import corpus_pipeline
from pyspark.sql.types import LongType, StructField, StructType

from vectide.llm import common, near_copies, simhash
from vectide.llm.common import read

from .test_documents import plain_hits
from .test_near_copies import plain_roots
from .test_scans import plain_base


def test_stages_follow_plain_versions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["quality", "near_dedup", "decontaminate", "secrets", "byte_bpe"]
    good = by_name["quality"](spark, docs, sf_dir).cache()
    assert good.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in read(spark, sf_dir, "labels").collect()}
    kept = {r["doc_id"]: r["text"] for r in good.select("doc_id", "text").collect()}
    assert sum(d in kept for d, q in labels.items() if q) >= 0.98 * sum(labels.values())
    assert sum(d in kept for d, q in labels.items() if not q) <= 0.25 * sum(not q for q in labels.values())

    single = by_name["near_dedup"](spark, good, sf_dir).cache()
    assert single.columns == docs.columns
    roots = plain_roots(kept)
    left = {r["doc_id"] for r in single.collect()}
    assert left == set(roots.values())

    items = [tuple(r) for r in read(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    clean = by_name["decontaminate"](spark, single, sf_dir).cache()
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {x[0] for x in plain_hits([(i, kept[i]) for i in left], items) if not x[-1]}

    masked = by_name["secrets"](spark, clean, sf_dir).cache()
    assert masked.columns == docs.columns
    rows = masked.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in clean.collect()}
    assert not any(plain_base(r["text"]) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert all(r["text"] == kept[r["doc_id"]] for r in rows if "[SECRET]" not in r["text"])

    ended = {r["doc_id"]: r for r in by_name["byte_bpe"](spark, masked, sf_dir).collect()}
    assert {d: r["decoded_sha256"] for d, r in ended.items()} == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in rows}


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert 0 < found.count() < read(spark, sf_dir, "documents").count()
    assert {"doc_id", "n_tokens", "ids"} <= set(found.columns)


def test_stages_take_odd_rows(spark, sf_dir):
    plain = read(spark, sf_dir, "documents")
    schema = plain.schema.fieldNames()
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (4, "long words " * 40_000 + "token=abcdefghijklmnop", "en", "s", 9), (4, "other text", "en", "s", 9)], plain.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = odd.unionByName(plain.limit(40), allowMissingColumns=True).selectExpr("*", "'x' as score", "1 as fp")
    for docs in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "byte_bpe" or out.columns == docs.columns
            out.collect()
    assert set(schema) <= set(docs.columns)


class Caught:
    """Stands for documents; keeps the kernel that they would go through."""

    schema = StructType([StructField("doc_id", LongType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_stages_drop_what_workers_keep_of_others(spark):
    """A worker that encoded documents holds hundreds of MB of known chunks; they must not stand beside the next run's first stages."""
    for run in (near_copies.sets(Caught()).run, simhash.fingerprints(Caught()).run, simhash._within(2, 3, 10)):
        common.kept(("other operator",), dict)
        assert list(run(iter([]))) == [] and not common._kept
