"""Comparison of a query with its DuckDB SQL, as sorted rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows):
    return sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=str)


def compare(spark, con, sf_dir, query, sql):
    found = query(spark, sf_dir)
    columns = sorted(found.columns)
    mine = plain(tuple(r[c] for c in columns) for r in found.collect())
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    theirs = plain(tuple(r[names.index(c)] for c in columns) for r in relation.fetchall())
    assert len(mine) == len(theirs) and mine
    assert mine == theirs
