"""Vector codes against plain rounds in unbounded whole numbers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from frames import frame  # noqa: F401
from wordspace.llm.codes import CELL, Cells, encode, fit_codebooks

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts, entries, rounds, scale):
    """(digest, [(id, vector, codes, error)]) of rows of one length."""
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = [len(ok[0][1]) // parts + (p < len(ok[0][1]) % parts) for p in range(parts)]
    cut = [sum(size[:p]) for p in range(parts + 1)]
    x = [[math.floor(Fraction(v) * Fraction(scale)) for v in r[1]] for r in ok]
    split = [[v[cut[p]:cut[p + 1]] for p in range(parts)] for v in x]
    books = [[list(s[p]) for s in split[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(s[p], books[p])[1] for s in split]
            for e in set(of):
                own = [s[p] for s, k in zip(split, of) if k == e]
                books[p][e] = [sum(t) // len(own) for t in zip(*own)]
    out = []
    for r, s in zip(ok, split):
        got = [nearest(s[p], books[p]) for p in range(parts)]
        out.append((r[0], tuple(r[1]), bytes(e for _, e in got), min(sum(d for d, _ in got), (1 << 63) - 1)))
    return hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest(), out


def rows(n, dim, seed, spread=0.3):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(0, spread, (n, dim))
    v[n // 3:n // 2] = v[0] + rnd.normal(0, 0.002, (n // 2 - n // 3, dim))  # near copies
    v[n // 2:n // 2 + n // 5] = v[1]                                         # copies
    out = [(int(i), [float(x) for x in r], int(i) % 3) for i, r in zip(rnd.permutation(n), v)]
    return out + [(n + 1, None, 1), (n + 2, [None] + [0.5] * (dim - 1), 1), (n + 3, [math.nan] * dim, None),
                  (n + 4, [math.inf] + [0.0] * (dim - 1), 2), (3, [0.25] * dim, None), (3, [-0.25] * dim, 0), (None, [0.125] * dim, 0)]


@pytest.mark.parametrize("parts,entries,rounds,dim,scale,cell", [
    (4, 16, 4, 8, 1024.0, 32), (4, 256, 2, 8, 1024.0, CELL), (3, 5, 3, 8, 16.0, 1), (2, 7, 2, 2, 1024.0, 4096), (4, 16, 0, 4, 1024.0, 32)])
def test_equals_plain_rounds(frame, parts, entries, rounds, dim, scale, cell):
    data = rows(150, dim, dim + entries)
    df = frame(data, SCHEMA)
    model = fit_codebooks(df, parts, entries, rounds, scale, cell)
    digest, want = plain(data, parts, entries, rounds, scale)
    assert model.digest(dim) == digest
    got = [(r.vec_id, tuple(r.embedding), bytes(r.codes), r.error) for r in encode(df, model).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_numbers_beyond_int64(frame):
    data = [(1, [1e30, 2.0, 0.0, -1.0], 0), (2, [-1e30, 2.0, 3.0, -1.0], 0), (3, [1.7e308, 0.0, 3.5, 9e15], 0),
            (4, [0.1, 2.0, 0.0, -1.0], 0), (5, [1e30, 2.5, 0.25, -1.0], 0)]
    df = frame(data, SCHEMA)
    model = fit_codebooks(df, parts=2, entries=3, rounds=2)
    digest, want = plain(data, 2, 3, 2, 1024.0)
    assert model.digest(4) == digest
    assert sorted((r.vec_id, tuple(r.embedding), bytes(r.codes), r.error) for r in encode(df, model).collect()) == sorted(want)


def test_only_what_may_be_nearest_is_kept_and_cells_are_memoised():
    rnd = np.random.default_rng(5)
    book, x = rnd.integers(-300, 300, (256, 16)), rnd.integers(-300, 300, (400, 16))
    cells = Cells(book, 32)
    for _ in range(2):
        index, dist = cells.nearest(x)
    d = ((x[:, None] - book[None]) ** 2).sum(-1)
    assert (index == d.argmin(1)).all() and (dist == d.min(1)).all()
    assert cells.made == len(np.unique(x // 32, axis=0)) and cells.looked == 800
    assert cells.pairs < 0.3 * 800 * 256  # most entries are dominated
    few = Cells(book, 32, memo_cells=50)
    for at in range(0, 400, 40):
        assert (few.nearest(x[at:at + 40])[0] == d[at:at + 40].argmin(1)).all() and len(few.memo) <= 90


def test_lengths_clashing_columns_and_empty_tables(frame, spark):
    data = [(i, [float(i), 1.0, 0.5, 0.25], 0) for i in range(6)] + [(9, [0.5] * 6, 1), (10, [], 1), (11, [0.75] * 6, 1)]
    df = frame(data, SCHEMA)
    model = fit_codebooks(df, 4, 4, 2)
    got = {r.vec_id: r for r in encode(df, model).collect()}
    assert set(got) == {x[0] for x in data} and got[10].error == 0 and bytes(got[10].codes) == bytes(4)
    for dim in (4, 6, 0):
        assert model.digest(dim) == plain([x for x in data if len(x[1]) == dim], 4, 4, 2, 1024.0)[0]
    assert list(model.decode(6, bytes(got[9].codes))) == [512] * 6
    odd = frame([(1, [1.0], "k", 7)], "vec_id long, embedding array<float>, Codes string, dim long")
    out = encode(odd, fit_codebooks(odd)).collect()[0]
    assert (out["dim"], bytes(out["codes"]), out["error"]) == (7, bytes(4), 0)
    none = spark.createDataFrame([], SCHEMA)
    assert encode(none, fit_codebooks(none)).collect() == []
