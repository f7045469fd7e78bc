import pytest

from tests.oracle import compare, connect
from vectide.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf_dir, name):
    compare(spark, connect(sf_dir), sf_dir, queries.QUERIES[name], queries.SQL[name])


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
