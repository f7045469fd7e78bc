"""DuckDB SQL of the named queries, built from common table expressions."""

from __future__ import annotations

BASE = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT vec_id AS qid, v AS qv FROM e WHERE vec_id % 20 = 0)"""
IP = "1 - list_dot_product(qv, v)"
L2 = "list_sum(list_transform(list_zip(qv, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def numbered(table: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM {table}"


def result(table: str, where: str) -> str:
    return f"SELECT qid, vec_id, round(dist, 6) + 0.0 AS dist, rk FROM ({numbered(table)}) WHERE {where}"


def query(*parts: str, end: str) -> str:
    return "WITH " + ",\n".join([BASE, *parts]) + "\n" + end


def knn(k: int, dist: str = IP, rows: str = "SELECT * FROM e") -> str:
    return query(f"b AS ({rows})", f"d AS (SELECT qid, vec_id, {dist} AS dist FROM q, b)", end=result("d", f"rk <= {k}"))


def cells(n: int, rounds: int) -> list[str]:
    """Centres c0 to c{rounds} (cid, c), and the last one's assignment, a (vec_id, v, cid)."""
    out = [
        "o AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM e)",
        "n AS (SELECT count(*) AS n FROM e)",
        f"c0 AS (SELECT i AS cid, o.v AS c FROM (SELECT unnest(range(0, {n})) AS i) s CROSS JOIN n JOIN o ON o.at = (i * (n.n // {n})) % n.n)",
    ]
    nearest = "SELECT vec_id, v, cid FROM (SELECT vec_id, v, cid, row_number() OVER (PARTITION BY vec_id ORDER BY 1 - list_dot_product(v, c), cid) AS r FROM e, {c}) WHERE r = 1"
    for i in range(rounds):
        out += [
            f"a{i} AS ({nearest.format(c=f'c{i}')})",
            f"u{i} AS (SELECT cid, list(m ORDER BY i) AS c FROM (SELECT cid, i, round(avg(x), 6) AS m FROM (SELECT cid, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{i}) GROUP BY cid, i) GROUP BY cid)",
            f"c{i + 1} AS (SELECT c{i}.cid, coalesce(u{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN u{i} USING (cid))",
        ]
    return [*out, f"a AS ({nearest.format(c=f'c{rounds}')})"]


def probes(rounds: int, nprobe: int) -> str:
    return (
        "p AS (SELECT * FROM (SELECT qid, qv, cid, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, cid) AS rk"
        f" FROM (SELECT qid, qv, cid, 1 - list_dot_product(qv, c) AS dist FROM q, c{rounds})) WHERE rk <= {nprobe})"
    )


def books(m: int, words: int, width: int, rounds: int) -> list[str]:
    """Codebooks b0 to b{rounds} (m, k, c), and codes z (vec_id, m, k)."""
    out = [
        f"s AS (SELECT vec_id, m, v[m * {width} + 1 : m * {width} + {width}] AS sub FROM e, (SELECT unnest(range(0, {m})) AS m))",
        "po AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM e)",
        "pn AS (SELECT count(*) AS n FROM e)",
        f"b0 AS (SELECT m, k, s.sub AS c FROM (SELECT unnest(range(0, {words})) AS k) w CROSS JOIN pn JOIN po ON po.at = (k * (pn.n // {words})) % pn.n JOIN s ON s.vec_id = po.vec_id)",
    ]
    best = "SELECT vec_id, m, k, sub FROM (SELECT s.vec_id, s.m, k, sub, row_number() OVER (PARTITION BY s.vec_id, s.m ORDER BY 1 - list_dot_product(sub, c), k) AS r FROM s JOIN {b} USING (m)) WHERE r = 1"
    for i in range(rounds):
        out += [
            f"z{i} AS ({best.format(b=f'b{i}')})",
            f"y{i} AS (SELECT m, k, list(x ORDER BY i) AS c FROM (SELECT m, k, i, round(avg(x), 6) AS x FROM (SELECT m, k, generate_subscripts(sub, 1) AS i, unnest(sub) AS x FROM z{i}) GROUP BY m, k, i) GROUP BY m, k)",
            f"b{i + 1} AS (SELECT b{i}.m, b{i}.k, coalesce(y{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN y{i} USING (m, k))",
        ]
    return [*out, f"z AS ({best.format(b=f'b{rounds}')})"]


def lut(width: int, rounds: int) -> str:
    return f"l AS (SELECT qid, m, k, CAST(round(list_dot_product(qv[m * {width} + 1 : m * {width} + {width}], c) * 1e9) AS BIGINT) AS x FROM q, b{rounds})"


ADC = "d AS (SELECT qid, vec_id, 1 - CAST(sum(x) AS DOUBLE) / 1e9 AS dist FROM l JOIN z USING (m, k) GROUP BY qid, vec_id)"
ADC_PROBED = "d AS (SELECT l.qid, z.vec_id, a.cid, 1 - CAST(sum(x) AS DOUBLE) / 1e9 AS dist FROM p JOIN a USING (cid) JOIN z ON z.vec_id = a.vec_id JOIN l ON l.qid = p.qid AND l.m = z.m AND l.k = z.k GROUP BY l.qid, z.vec_id, a.cid)"


def reranked(p: int) -> list[str]:
    return [f"t AS (SELECT * FROM ({numbered('d')}) WHERE rk <= {p})", f"x AS (SELECT t.qid, t.vec_id, {IP} AS dist FROM t JOIN q USING (qid) JOIN e USING (vec_id))"]


SQ = [
    "g AS (SELECT mn AS gmin, CASE WHEN mx - mn > 1e-8 THEN 255.0::DOUBLE / (mx - mn) ELSE 1.0::DOUBLE END AS gs, d FROM (SELECT min(list_min(v)) AS mn, max(list_max(v)) AS mx, max(len(v)) AS d FROM e))",
    "sc AS (SELECT vec_id, code, CAST(list_sum(code) AS BIGINT) AS cs FROM (SELECT vec_id, list_transform(v, lambda x: greatest(0, least(255, CAST(floor((x - gmin) * gs + 0.5) AS INT)))) AS code FROM e, g))",
    "sq AS (SELECT vec_id AS qid, code AS qc, cs AS qs FROM sc WHERE vec_id % 20 = 0)",
    "d AS (SELECT qid, vec_id, 1 - (list_dot_product(qc::DOUBLE[], code::DOUBLE[]) / (gs * gs) + gmin / gs * (qs + cs) + gmin * gmin * d) AS dist FROM sq, sc, g)",
]
