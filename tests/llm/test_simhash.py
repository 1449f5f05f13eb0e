"""SimHash near-dedup against all pairs of fingerprints computed from the definition."""

import random
import re

import pytest
import xxhash

from frames import frame  # noqa: F401
from wordspace.llm import simhash


def plain_fp(text, k=3):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, bits):
    """fps: (doc_id, fp); smallest doc_id reachable, all pairs."""
    up = {d: d for d, _ in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= bits:
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d, _ in fps}


def texts(n=150, seed=2):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "delta x", "omega"]
    out = []
    for _ in range(n):
        base = [rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 120))]
        out.append(" ".join(base))
        if rng.random() < 0.5 and base:
            base[rng.randrange(len(base))] = "changed"
            out.append("\t".join(base))
        if rng.random() < 0.3:
            out.append(out[-1])
    return out + [None, "", " \n ", "One", "one", "two words", "x" * 100_000, "w " * 70_000]


@pytest.mark.parametrize("bits,list_rows", [(3, 1024), (3, 3), (0, 1024), (6, 5)])
def test_matches_all_pairs(frame, bits, list_rows):
    rows = [(3 * i + 1, t, 0) for i, t in enumerate(texts())]
    got = simhash.near_duplicates(frame(rows, "doc_id long, text string, fp int"), 3, bits, list_rows).collect()
    fps = [(d, plain_fp(t)) for d, t, _ in rows]
    want = plain_components(fps, bits)
    assert len(got) == len(rows)
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == dict(fps)
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("list_rows", [16, 1024])
def test_large_group_of_near_fingerprints(spark, list_rows):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for centre in rng.sample(sorted(fps), 2):
        fps |= {centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 3))}) for _ in range(300)}
    rows = list(enumerate(sorted(fps, key=lambda x: x * 7919 % 1009)))
    reps = spark.createDataFrame([(d, x - (1 << 64) if x >> 63 else x) for d, x in rows], "node long, fp long")
    links = simhash.links(reps, 3, list_rows).collect()
    of = dict(rows)
    want = plain_components(rows, 3)
    assert all(want[r.a] == want[r.b] for r in links)
    up = plain_components_of_links([(r.a, r.b) for r in links], of)
    assert up == want


def plain_components_of_links(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def test_null_ids_repeats_and_empty_table(frame, spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "alone in here"), (2, "A B C D")]
    got = simhash.near_duplicates(frame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got if r.component_id) == [
        (False, 2, 2), (False, 5, 2), (False, 5, 2), (True, 0, 2)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_document_of_each_group_stays(frame):
    rows = [(1, "a b c d", "x"), (2, "a b c d", "y"), (3, "other words are here", "z"), (None, "a b c d", "n")]
    got = simhash.drop_near_duplicates(frame(rows, "doc_id long, text string, extra string"))
    assert sorted((r.doc_id or 0, r.extra) for r in got.collect()) == [(0, "n"), (1, "x"), (3, "z")]
