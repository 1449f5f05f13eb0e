"""Exact top-k against all scores in unbounded whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordspace.llm.topk import search, top_k


def plain(rows, k, scale=256):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = min(ok.get(i, v), v)
    whole = {i: [math.floor(scale * x) for x in v] for i, v in ok.items()}
    out = set()
    for q in whole:
        if q % 5 == 0:
            score = {c: sum(a * b for a, b in zip(whole[q], whole[c])) for c in whole if c != q and len(whole[c]) == len(whole[q])}
            best = sorted((-max(-(1 << 63), min((1 << 63) - 1, s)), c) for c, s in score.items())
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best[:k])}
    return out


def run(spark, rows, kind="float", **sizes):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int")
    return {tuple(r) for r in top_k(df, F.col("id") % 5 == 0, k=sizes.pop("k", 5), **sizes).collect()}


@pytest.mark.parametrize("dim,spread", [(64, 0.0), (16, 1.0), (3, 2.0)])
def test_matches_all_scores(spark, dim, spread):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim) * math.exp(spread * rng.normal())]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(50)]  # ties
    assert run(spark, rows, chunk_rows=40, block_rows=13) == plain(rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, [0.0, 0.0]), (10, None), (15, [1.0, nan]), (20, [inf, 0.0]), (25, [None, 1.0]), (30, []),
            (35, [1.0]), (1, [-1.0, 0.5]), (1, [-1.0, 0.5]), (2, [3.0, 3.0, 3.0]), (None, [9.0, 9.0])]
    assert run(spark, rows) == plain(rows, 5)
    huge = [(i, [1e9 * (i + 1), -3e9]) for i in range(12)]
    assert run(spark, huge, "double") == plain(huge, 5)
    large = [(i, [1e6 * (i + 1), -3e6 + i]) for i in range(12)]
    assert run(spark, large, "double") == plain(large, 5)
    assert run(spark, []) == set() and run(spark, [(1, [1.0])]) == set()


def test_bounds_leave_most_pairs_closed():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(2000, 32)) * np.exp(-np.arange(32) / 4) * np.exp(rng.normal(size=(2000, 1))))
    rotation = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    best, opened = search((np.arange(20), x[:20]), (np.arange(2000), x), rotation, np.full(20, -np.inf), 5)
    scores = x[:20] @ x.T
    np.fill_diagonal(scores, -np.inf)
    assert (best.score == -np.sort(-scores, axis=1)[:, :5]).all()
    assert opened < 20 * 2000 * 0.5


def test_no_side_goes_whole_to_every_task(spark):
    """Blocks are as many as the queries fill, and no packed cells are planned as a broadcast,
    which the driver would have to hold."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = top_k(df, F.col("id") % 50 == 0, chunk_rows=10, block_rows=3)
    found = {tuple(r) for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan
    # 8 queries are three blocks, so many partitions has the exchange that deals them
    assert any("rangepartitioning(len" in x and ", 3), REPARTITION_BY_NUM" in x for x in plan.splitlines())
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows}
    for q in (0, 350):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:5]
        assert {r[2:] for r in found if r[0] == q} == {(c, -s) for s, c in best}
