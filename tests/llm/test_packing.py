"""Packing against the definition of best fit decreasing, and exact round trips."""

import random
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from frames import frame  # noqa: F401

from wordspace.llm.packing import PATTERN, CapacityTree, best_fit_decreasing, load_ranks, pack_documents, unpack, write_packed


def plain_best_fit(sizes, capacity):
    rows, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [(room[r], -r) for r in range(len(rows)) if room[r] >= sizes[i]]
        if fit:
            left = min(fit)[0]
            r = [r for r in range(len(rows)) if room[r] == left][-1]
        else:
            rows.append([])
            room.append(capacity)
            r = len(rows) - 1
        rows[r].append(i)
        room[r] -= sizes[i]
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    cap = rng.choice((1, 7, 64, 100))
    sizes = [rng.randint(1, cap) for _ in range(rng.choice((0, 1, 30, 200)))]
    got = best_fit_decreasing(np.array(sizes, dtype=int), cap)
    assert sorted(i for r in got for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= cap for r in got)
    room = lambda rows: sorted(cap - sum(sizes[i] for i in r) for r in rows)  # noqa: E731  ties may swap equal rows
    assert room(got) == room(plain_best_fit(sizes, cap))


def test_tree_finds_the_least_capacity_that_holds():
    rng = random.Random(1)
    tree, have = CapacityTree(37), defaultdict(int)
    for _ in range(500):
        c = rng.randint(0, 37)
        if rng.random() < 0.4 and have[c]:
            tree.add(c, -1)
            have[c] -= 1
        else:
            tree.add(c)
            have[c] += 1
        need = rng.randint(0, 37)
        assert tree.least(need) == min((x for x in have if have[x] and x >= need), default=-1)


def texts():
    rng = random.Random(9)
    return [(i, " ".join(rng.choice(("alpha", "béta", "γ", "don't", "12", "\n\n")) for _ in range(rng.randint(0, 60)))) for i in range(80)] + [
        (900, "long " * 5000), (901, None), (902, ""), (None, "no id"), (5, "same id again"), (5, "same id again"), ((1 << 60) + 1, "large id")]


@pytest.mark.parametrize("row_tokens,matrix_rows", [(64, 8), (1, 3), (2048, 64)])
def test_round_trip(frame, row_tokens, matrix_rows):
    rows = texts() if row_tokens > 1 else texts()[:10]
    packed = pack_documents(frame([(d, t, 0) for d, t in rows], "doc_id long, text string, n int"), row_tokens=row_tokens,
                            matrix_rows=matrix_rows, group_bytes=1 << 10).collect()
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=load_ranks(), special_tokens={})
    want = sorted(([] if d is None else [d], i, tuple(ids[i * row_tokens:(i + 1) * row_tokens]))
                  for d, t in rows for ids in [enc.encode_ordinary(t or "")] for i in range(-(-len(ids) // row_tokens)))
    got = sorted(([] if d is None else [d], p, tuple(ids.tolist())) for m in packed for d, p, ids in unpack(m))
    assert got == want
    for m in packed:
        ids = np.frombuffer(m.ids, "<u2").reshape(m.n_rows, row_tokens)
        pos = np.frombuffer(m.positions, "<u2").reshape(m.n_rows, row_tokens)
        assert m.n_rows <= matrix_rows and len(m.cu_seqlens) == len(m.segments) == m.n_rows
        for r, ends in enumerate(m.cu_seqlens):
            assert ends[0] == 0 and all(a < b for a, b in zip(ends, ends[1:])) and ends[-1] <= row_tokens
            assert pos[r].tolist() == [k for a, b in zip(ends, ends[1:]) for k in range(b - a)] + [0] * (row_tokens - ends[-1])
            assert set(ids[r, ends[-1]:].tolist()) <= {50256}


def test_reruns_agree_and_files(frame, spark, tmp_path):
    rows = texts()
    a = pack_documents(frame(rows, "doc_id long, text string"), row_tokens=64)
    b = pack_documents(frame(rows, "doc_id long, text string").repartition(5), row_tokens=64)
    key = lambda df: sorted((r.grp, r.matrix, bytes(r.ids), str(r.segments)) for r in df.collect())
    assert key(a) == key(b)
    write_packed(a, f"file://{tmp_path}/out")
    assert key(spark.read.parquet(f"file://{tmp_path}/out")) == key(a)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
