"""Suffix-array decontamination against plain windows."""

import random
import re

import pytest

from frames import frame  # noqa: F401
from wordspace.llm.contamination import decontaminate, find_contamination, longest_matches

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain(docs, items, window):
    """By document: words, hit words, ids of items, places hit."""
    out = []
    for _, text in docs:
        own, hit, ids = words(text), set(), set()
        for item, t in items:
            its = words(t)
            w = min(window, len(its))
            for j in range(len(its) - w + 1 if w else 0):
                for p in range(len(own) - w + 1):
                    if own[p:p + w] == its[j:j + w]:
                        hit |= set(range(p, p + w))
                        ids.add("" if item is None else str(item))
        out.append((len(own), len(hit), sorted(ids), hit))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["Ab", "bé", "c9", "D", "ö", "the", "The", "x", "yy", "zz"] + [f"w{i}" for i in range(30)]
    text = lambda n, few: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab[:few]) for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 2, 3, 5, 9, 14, 30]), 40)) for i in range(14)]
    items += [(3, items[4][1]), (None, text(8, 40)), (77, None), (78, items[7][1])]
    docs = []
    for i in range(60):
        parts = [text(rnd.randint(0, 25), 40), rnd.choice(items)[1] or "", text(rnd.randint(0, 9), 5)]
        docs.append((i, " . ".join(parts)))
    docs += [(5, docs[9][1])] * 3 + [(None, docs[11][1]), (100, None), (101, ""), (102, "!!"),
                                     (103, " ".join(t for _, t in docs))]
    return docs, items


@pytest.mark.parametrize("window,limits", [(4, {}), (10, {}), (4, {"block_bytes": 150, "shard_words": 60}),
                                           (1, {"shard_words": 1})])
def test_equals_plain_windows(frame, window, limits):
    docs, items = corpus(window)
    found = find_contamination(frame(docs, DOCS), frame(items, ITEMS), window, **limits).collect()
    got = sorted(((r.doc_id, r.text or "", r.n_words, r.n_hit, r.items, tuple((s.start, s.end) for s in r.spans))
                  for r in found), key=repr)
    want = []
    for (i, t), (n, k, ids, hit) in zip(docs, plain(docs, items, window)):
        starts = [p for p in sorted(hit) if p - 1 not in hit]
        ends = [p + 1 for p in sorted(hit) if p + 1 not in hit]
        want.append((i, t or "", n, k, ids, tuple(zip(starts, ends))))
    assert got == sorted(want, key=repr)


def test_longest_matches_and_places(frame):
    docs, items = corpus(7)
    docs = [(100 + i, t) for i, (_, t) in enumerate(docs)]
    items = [(i, t) for i, (_, t) in enumerate(items)]
    got = {(r.item_id, r.start): (r.longest, r.locations, r.doc_id, r.doc_start)
           for r in longest_matches(frame(docs, DOCS), frame(items, ITEMS), 4, shard_words=300).collect()}
    want = {}
    for item, t in items:
        its = words(t)
        w = min(4, len(its))
        for j in range(len(its) - w + 1 if w else 0):
            deep = {}
            for d, text in docs:
                own = words(text)
                for p in range(len(own)):
                    k = 0
                    while k < len(its) - j and p + k < len(own) and own[p + k] == its[j + k]:
                        k += 1
                    deep.setdefault(k, []).append((d, p))
            if (m := max(deep)) >= w:
                want[str(item), j] = (m, len(deep[m]), *min(deep[m]))
    assert got == want


def test_affected_documents_go(frame):
    docs = [(1, "one two three four five"), (2, "zero ONE, two - three!"), (3, None), (4, "two three one")]
    kept = decontaminate(frame(docs, DOCS), frame([(9, "one two three")], ITEMS), window=3)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, None), (4, "two three one")]


def test_clashing_columns_and_empty_tables(frame, spark):
    docs = frame([(1, "a b c", 5, "k", 2.0)], "doc_id long, text string, n_hit long, items string, __t double")
    none = spark.createDataFrame([], ITEMS)
    r = find_contamination(docs, frame([(1, "a b")], ITEMS), 2).collect()[0]
    assert (r["n_hit"], r["items"], r["__t"], r["n_words"]) == (2, ["1"], 2.0, 3)
    assert decontaminate(docs, none).columns == ["doc_id", "text", "__t"]
    assert [r.n_hit for r in find_contamination(docs, none, 2).collect()] == [0]
    assert find_contamination(docs.limit(0), frame([(1, "a b")], ITEMS), 2).collect() == []
    assert longest_matches(docs, none, 2).collect() == []
