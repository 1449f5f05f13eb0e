"""Near vectors against all pairs of cosines."""

import numpy as np
import pytest

from wordspace.llm.vector_dedup import Blocks, keep_one, near_vectors


def plain(rows, cosine):
    """rows: {id: vector or None}; (links, component) of each id."""
    ok = {}
    for i, v in rows.items():
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            ok[i] = x / np.sqrt((x * x).sum())
    n, up = dict.fromkeys(rows, 0), {i: i for i in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(ok)
    for a in ids:
        for b in ids:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
                n[a] += 1
                n[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (n[i], root(i)) for i in rows}


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(n)]
    for i in rng.integers(0, n, n):
        out.append(out[i] + rng.normal(size=dim) * rng.choice([0, 0.15, 0.25, 0.33]) * np.linalg.norm(out[i]) / dim ** 0.5)
    return [[float(np.float32(x)) for x in v] for v in out]


@pytest.mark.parametrize("dim,cosine,cell_rows", [(64, 0.95, 2048), (64, 0.95, 7), (5, 0.95, 2048), (1, 0.9, 16), (24, 0.5, 64)])
def test_matches_all_pairs(spark, dim, cosine, cell_rows):
    rows = dict(enumerate(clustered(60 if dim < 60 else 150, dim, dim + cell_rows)))
    df = spark.createDataFrame([(3 * i, v, i) for i, v in rows.items()], "vec_id long, embedding array<float>, block int")
    got = {r.id // 3: (r.n_links, r.component // 3) for r in near_vectors(df, cosine, cell_rows=cell_rows).collect()}
    assert got == plain(rows, cosine)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=64)
    rows = {i: (centre + rng.normal(size=64) * 0.05).tolist() for i in range(250)}
    rows |= {1000 + i: rng.normal(size=64).tolist() for i in range(100)}
    rows |= {2000 + i: rows[3] for i in range(80)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component) for r in near_vectors(df, 0.95, cell_rows=64).collect()}
    assert got == plain(rows, 0.95)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 1.0]),
            (8, [1.0, 1.0, 1.0]), (9, [2.0, 2.0]), (9, [2.0, 2.0]), (None, [1.0, 1.0]), (10, [-1.0, -1.0]), (11, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.id, r.n_links, r.component, r.kept) for r in keep_one(near_vectors(df)).collect()}
    assert got == {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 8, 10)} | {
        (7, 2, 7, True), (9, 2, 7, False), (11, 2, 7, False), (None, 0, None, False)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(empty).collect() == []


def test_shares_add_up_to_the_whole_distance():
    b = Blocks(np.random.default_rng(0).normal(size=(50, 20)), 0.9)
    assert 0.2 <= b.share.sum() < 0.2 + 1e-6 and (b.share > 0).all()
    assert np.allclose(b.rotation @ b.rotation.T, np.eye(20))
