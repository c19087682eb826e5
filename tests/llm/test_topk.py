"""Exact top-k against brute force, ties and odd vectors included."""

import math

import numpy as np
import pytest

from vitrine.llm import queries, topk


def brute(rows, is_query, k=5):
    q = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            q.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for i in q:
        if not is_query(i):
            continue
        for mine in q[i]:
            found = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), j) for j, vs in q.items() if j != i for v in vs if len(v) == len(mine))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("group", [4096, 2])
def test_top_k(spark, monkeypatch, group):
    monkeypatch.setattr(topk, "GROUP", group)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype("f4")]) for i in range(200)]
    rows += [(i, rows[3][1]) for i in range(300, 420)]  # a large group of equal vectors
    rows += [(500, None), (510, []), (520, [1.0, None]), (530, [float("nan")] * 6), (540, [float("inf")] * 6), (550, [1.0, 2.0]), (551, [0.5, 0.25]), (None, rows[0][1]), (20, rows[5][1])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, id string, score double")
    got = sorted(map(tuple, topk.top_k(df, lambda i: i % 10 == 0).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert topk.top_k(df.limit(0), lambda i: i % 10 == 0).count() == 0
    assert topk.top_k(df, lambda i: i < 0).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), -float(2**20 - i)]) for i in range(0, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [2.0**30])], "vec_id long, embedding array<double>"), lambda i: i == 0)
    assert sorted(map(tuple, topk.top_k(df, lambda i: i % 10 == 0).collect())) == brute(rows, lambda i: i % 10 == 0)


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.OP4_SQL})").fetchall()
    assert sorted(map(tuple, queries.op4_top_k(spark, "/root/testdata/sf0.001").collect())) == sorted(want)
