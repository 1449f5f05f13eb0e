"""Line dedup against a plain dictionary of lines, on both ways to probe the index."""

import random
from collections import defaultdict

import numpy as np
import pytest

from frames import frame  # noqa: F401
from wordspace.llm.line_dedup import PerfectHash, ShardedIndex, dedup_lines

BLANKS = " \t\n\x0b\x0c\r"


def az_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars, min_docs):
    low = -(1 << 63)
    held = defaultdict(list)
    for doc, text in rows:
        for k in {az_lower(x.strip(BLANKS)) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(low if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = []
        for x in lines:
            h = held.get(az_lower(x.strip(BLANKS)), [])
            if len(h) < min_docs or max(h) == (low if doc is None else doc):
                stay.append(x)
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    shared = [f"shared line number {i} with enough characters to count Éé" for i in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            x = rng.choice(shared[: rng.choice((1, 12))])
            x = rng.choice((x, x.upper().replace("É", "É"), f"\t {x}\x0b", "short", f"own line {i} {rng.random()} of this document alone"))
            lines += [x] * rng.choice((1, 1, 2))
        rows.append((i, "\n".join(lines)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (None, shared[0]), (None, shared[0]), (7, rows[7][1])]


@pytest.mark.parametrize("broadcast_bytes,hot_keys", [(64 << 20, 100_000), (0, 100_000), (0, 10)])
def test_matches_brute_force_on_every_way_to_probe(frame, broadcast_bytes, hot_keys):
    rows = corpus()
    df = frame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_lines int")
    got = dedup_lines(df, 40, 5, broadcast_bytes, hot_keys)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == brute(rows, 40, 5)


def test_empty_table(frame, spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(df).collect() == []


def test_perfect_hash_is_minimal_and_answers_only_its_keys():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    h1[:50] = h1[50]  # equal first halves
    n, m = np.arange(5000), np.arange(5000) - 2500
    index = PerfectHash(h1, h2, n + 1, m)
    count, largest = index.probe(h1, h2)
    assert (count == n + 1).all() and (largest == m).all() and len(index.count) == 5000
    assert not index.probe(h1, h2 + np.uint64(1))[0].any()
    both = ShardedIndex({0: index}, 2)
    of0 = h1 % np.uint64(2) == 0
    assert (both.probe(h1, h2)[0][of0] == (n + 1)[of0]).all() and not both.probe(h1, h2)[0][~of0].any()
