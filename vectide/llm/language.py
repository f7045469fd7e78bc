"""Language identification by Bayesian evidence fusion.

Four pieces of evidence meet in log space for every page: the likelihood of its text (character
trigrams, hashed; trained on SAMPLE labelled documents of each of the LANGUAGES that have most),
the language that its
markup declares, the one that its address's suffix or first path part names, and a prior of its
host. Host priors come from a grouped aggregation: the pages' own probabilities (text and
declarations) are summed by host, by domain and overall, and each level is smoothed by the one
above as by STRENGTH pages. A page's own part is taken out of its host's sums, so that no page
argues for itself twice.

A hot host costs one row a task before the shuffle; its pages meet its sums by an equality join
whose skew Spark splits.

Defined results: null and empty pages have no text and rest on the other evidence; very long
pages are read whole, in time that grows with their length; null urls have the empty host; equal
probabilities go to the language whose name comes first; without labelled documents there is no
language to tell, so lang and probability are null and addressed is empty; rows repeat as given;
an empty table gives no rows; only page_id, url and html (doc_id, text and lang of documents) are
read, whatever other columns are called.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, row_slices

BUCKETS = 1 << 15
#: Labelled documents of a language at most, taken by a hash of their doc_id, and languages at most, those with most documents.
SAMPLE, LANGUAGES = 400, 200
#: How often a declaration and an address are taken to be right, and how many pages a level's own counts weigh against.
DECLARED, ADDRESSED, STRENGTH = 0.9, 0.8, 5.0
#: Trigrams of a text count as so many independent ones at most.
MOST_TRIGRAMS = 200.0
SLICE_BYTES = 4 << 20

_OPEN = re.compile(r"(?i)<(script|style|noscript)\b|<!--")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript")} | {None: re.compile("-->")}
_TAG = re.compile(r"(?s)<[^>]*>")


def text_of(page: str | None) -> str:
    """Visible text of a page, roughly: without scripts, styles, comments and tags."""
    page = page or ""
    parts, at, look, unclosed = [], 0, 0, set()
    while found := _OPEN.search(page, look):
        look = found.end()
        name = found[1] and found[1].lower()
        # what isn't closed from here on isn't closed further on
        end = None if name in unclosed else _CLOSE[name].search(page, look)
        if end is None:
            unclosed.add(name)
            continue
        parts.append(page[at : found.start()])
        at = look = end.end()
    whole = " ".join([*parts, page[at:]])
    cut = whole.rfind(">") + 1  # there are no tags behind
    return html.unescape(_TAG.sub(" ", whole[:cut]) + whole[cut:])


def trigrams_of(text: str) -> Counter:
    """Hashed trigrams of lower-case words, with their ends marked."""
    words = Counter(re.findall(r"[^\W\d_]+", text.lower()))
    found: Counter = Counter()
    for word, n in words.items():
        marked = f"^{word}$".encode()
        for i in range(len(marked) - 2):
            found[zlib.crc32(marked[i : i + 3]) % BUCKETS] += n
    return found


def train(counts: dict[str, dict[int, int]]) -> tuple[list[str], np.ndarray]:
    """Languages, and each one's log probabilities of the buckets, from the buckets' counts."""
    languages = sorted(counts)
    table = np.full((len(languages), BUCKETS), 0.1)
    for own, lang in zip(table, languages, strict=True):
        own[list(counts[lang].keys())] += list(counts[lang].values())
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The text model from docs' text and lang."""
    named = docs.select(F.col("lang").cast("string").alias("lang"), "doc_id", F.col("text").cast("string").alias("text")).where("lang is not null")
    sizes = [(r["lang"], r["count"]) for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()]
    # a language's rows with the smallest hashes: about four times sample of them, then sample
    shares = [(lang, min(2**63 - 1, int(-(2**63) + min(1.0, 4 * sample / n) * 2**64))) for lang, n in sizes]
    known = docs.sparkSession.createDataFrame(shares, "lang string, edge long")
    some = named.join(F.broadcast(known), "lang").where(F.xxhash64("doc_id") <= F.col("edge"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"))
    picked = some.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches, "text", SLICE_BYTES):
            counts: dict[str, Counter] = {}
            for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(trigrams_of(text or ""))
            for lang, own in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own.keys()), pa.int32()), pa.array(list(own.values()), pa.int64())], names=["lang", "bucket", "n"])

    counts: dict[str, dict[int, int]] = {lang: {} for lang, _ in sizes}
    # languages x BUCKETS rows at most
    for r in picked.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"]][r["bucket"]] = r["n"]
    return train(counts)


def likelihoods(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """pages without html, with ll: the log likelihood of the text for each language."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs = shared.value
        for rows in row_slices(batches, "html", SLICE_BYTES):
            found = []
            for page in rows.column(2).to_pylist():
                own = trigrams_of(text_of(page))
                if not own:
                    found.append([0.0] * len(languages))
                    continue
                n = np.fromiter(own.values(), np.float64, len(own))
                sums = logs[:, np.fromiter(own, np.int64, len(own))] @ n
                found.append((sums * min(1.0, MOST_TRIGRAMS / n.sum())).tolist())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(3), pa.array(found, pa.list_(pa.float64()))], names=["page_id", "url", "declared", "ll"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    declared = F.lower(F.regexp_extract(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), declared.alias("declared"))
    return plain.mapInArrow(run, f"page_id {id_type}, url string, declared string, ll array<double>")


def normalised(logs: Column) -> Column:
    """Probabilities of an array of log weights."""
    least = F.transform(F.array(F.array_max(logs)), lambda m: F.transform(logs, lambda x: F.exp(x - m)))[0]
    return F.transform(F.array(least), lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda s, y: s + y)))[0]


def told(named: Column, languages: list[str], right: float) -> Column:
    """Log likelihoods of a named language; nothing if it is none of the languages."""
    wrong = math.log((1 - right) / max(1, len(languages) - 1))
    return F.array(*(F.when(named.isin(*languages), F.when(named == lang, math.log(right)).otherwise(wrong)).otherwise(0.0) for lang in languages))


def plus(*arrays: Column) -> Column:
    total = arrays[0]
    for a in arrays[1:]:
        total = F.zip_with(total, a, lambda x, y: x + y)
    return total


def identify(pages: DataFrame, docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """(page_id, host, declared, addressed, lang, probability) for every row of pages."""
    model = model or fit(docs)
    languages = model[0]
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    if not languages:
        bare = likelihoods(pages, model).withColumn("host", host)
        return bare.select("page_id", "host", "declared", F.lit("").alias("addressed"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    suffix = F.regexp_extract("host", r"\.([a-z]{2})$", 1)
    part = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    addressed = F.when(suffix.isin(*languages), suffix).when(part.isin(*languages), part).otherwise(F.lit(""))
    seen = likelihoods(pages, model).withColumn("host", host).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("addressed", addressed)
    seen = seen.withColumn("evidence", plus(F.col("ll"), told(F.col("declared"), languages, DECLARED), told(F.col("addressed"), languages, ADDRESSED)))
    # the texts are scored once, for the sums and for the pages
    seen = checkpointed(seen.select("page_id", "host", "domain", "declared", "addressed", "evidence", normalised(F.col("evidence")).alias("own")))
    sums = [F.sum(F.col("own")[i]) for i in range(len(languages))]
    hosts = seen.groupBy("host", "domain").agg(F.array(*sums).alias("by_host"))
    of_hosts = [F.sum(F.col("by_host")[i]) for i in range(len(languages))]
    domains = hosts.groupBy("domain").agg(F.array(*of_hosts).alias("by_domain"))
    overall = domains.agg(F.array(*(F.sum(F.col("by_domain")[i]) for i in range(len(languages)))).alias("by_all")).first()
    every = F.array(*(F.lit(float(x or 0.0)) for x in (overall["by_all"] or [0.0] * len(languages))))
    known = hosts.join(domains, "domain").select("host", "by_host", "by_domain")

    def smoothed(counts: Column, above: Column) -> Column:
        """Shares of counts, with STRENGTH pages spread as above is."""
        return F.transform(F.array(F.aggregate(counts, F.lit(STRENGTH), lambda s, x: s + x)), lambda n: F.zip_with(counts, above, lambda x, a: (x + STRENGTH * a) / n))[0]

    less = lambda counts: F.zip_with(counts, "own", lambda x, o: F.greatest(x - o, F.lit(0.0)))
    flat = F.array(*([F.lit(1.0 / len(languages))] * len(languages)))
    prior = smoothed(less(F.col("by_host")), smoothed(less(F.col("by_domain")), smoothed(less(every), flat)))
    fused = seen.join(known, "host").withColumn("p", normalised(F.zip_with("evidence", prior, lambda e, q: e + F.log(q))))
    best = F.array_max("p")
    return fused.select(
        "page_id", "host", "declared", "addressed",
        F.element_at(F.array(*map(F.lit, languages)), F.array_position("p", best).cast("int")).alias("lang"), best.alias("probability"),
    )
