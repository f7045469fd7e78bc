"""What counts as a random token, whatever the table's size."""

import random

import pytest

from vectide.llm import secrets


def drawn(rng, kind, n):
    return "".join(rng.choice(secrets.ALPHABETS[kind].replace("+", "").replace("/", "")) for _ in range(n))


def table(spark, tokens):
    return spark.createDataFrame([(i, f"see {t} end") for i, t in enumerate(tokens)], "doc_id long, text string")


@pytest.mark.parametrize(("kind", "length", "n", "words"), [("base32", 32, 600, 0), ("base64", 24, 1000, 100), ("base64", 20, 1000, 0), ("base36", 40, 1000, 0)])
def test_random_tokens_of_large_tables(spark, kind, length, n, words):
    rng = random.Random(length)
    keys = [drawn(rng, kind, length) for _ in range(n)]
    prose = ["Be" + "".join(rng.choice(["ver", "lich", "ung", "keit", "schaft", "heit"]) for _ in range(6)) for _ in range(words)]
    found = {r["doc_id"] for r in secrets.report(table(spark, keys + prose)).where("spans like '%random%'").collect()}
    assert len([i for i in found if i < n]) >= 0.85 * n
    assert len([i for i in found if i >= n]) <= 0.05 * n
    if length >= 32:  # those without digits as well
        bare = [i for i, k in enumerate(keys) if not any(x.isdigit() for x in k)]
        assert len(found & set(bare)) >= 0.6 * len(bare)


def test_levels_stay_when_the_table_is_repeated(spark):
    rng = random.Random(9)
    tokens = [drawn(rng, k, n) for k in ("base32", "base64", "base36") for n in (20, 24, 32, 48) for _ in range(12)]
    tokens += [f"{rng.choice(['get', 'set'])}{''.join(rng.choice(['User', 'Name', 'Value', 'Item', 'Service']) for _ in range(rng.randrange(4, 9)))}{x}" for x in ("", 7) for _ in range(80)]
    docs = table(spark, tokens)
    levels = secrets.least_levels(docs)
    assert levels
    assert secrets.least_levels(docs.crossJoin(spark.range(100).select("id"))) == levels
