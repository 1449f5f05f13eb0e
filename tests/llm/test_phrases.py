"""Phrase stripes against counts of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from frames import frame  # noqa: F401
from wordspace.llm import phrases
from wordspace.llm.phrases import Sketch, collocations, phrase_counts, tokens

SCHEMA = "lang string, text string"


def plain_counts(rows, max_words):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, max_words + 1):
                for p in range(len(ws) - k + 1):
                    f.setdefault(lang, Counter())[tuple(ws[p:p + k])] += 1
    return f, n


def plain(rows, max_words, least, percent, top):
    f, n = plain_counts(rows, max_words)
    out = []
    for lang, count in f.items():
        cands = {g: a for g, a in count.items() if len(g) >= 2 and a >= least}
        found = []
        for g, a in cands.items():
            inside = lambda h: any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))
            if any(len(h) > len(g) and 100 * b >= percent * a and inside(h) for h, b in cands.items()):
                continue
            score, k = min((1000 * a * n[lang] // (count[g[:k]] * count[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), count[g[:k]], count[g[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["The", "of", "é", " x", "A\"b", "z\x1c", "\U0001f600", "İ"] + [f"w{i}" for i in range(12)]
    weights = [40, 20] + [3] * (len(vocab) - 2)
    fixed = ["New York city hall today", "in spite of", "of the of the of the", "a a a a a a a", "w1 w2"]
    rows = []
    for i in range(300):
        parts = []
        for _ in range(rnd.randint(0, 9)):
            parts.append(rnd.choice(fixed) if rnd.random() < 0.5 else " ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 7))))
        text = "".join(p + rnd.choice([". ", ",", "\n", "  ", "\t", ";\r", " ", "\x0b", "\x0c"]) for p in parts)
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), (None, ""), ("fr", " \t "), ("en", "new york city hall today! " * 400)]


@pytest.mark.parametrize("max_words,least,percent,top,batch", [(5, 20, 100, 50, 1 << 21), (5, 8, 60, 2000, 700), (2, 3, 100, 9, 100),
                                                              (3, 1, 100, 2000, 1 << 21)])
def test_equals_all_phrases(frame, max_words, least, percent, top, batch):
    rows = corpus(max_words + least)
    if least == 1:
        rows = rows[:40]
    got = [tuple(r) for r in collocations(frame(rows, SCHEMA), max_words, least, percent, top, batch).collect()]
    assert sorted(got) == plain(rows, max_words, least, percent, top)


def test_stripes_give_counts_totals_and_extensions(frame, monkeypatch):
    rows = corpus(3)
    f, n = plain_counts(rows, 4)
    counts = phrase_counts(frame(rows, SCHEMA), 4, 10, 500)
    want = {(lang, " ".join(g)): a for lang, c in f.items() for g, a in c.items() if a >= 10}
    got = {(r.lang, r.phrase): r for r in counts.phrases.collect()}
    assert {k: r.f for k, r in got.items()} == want
    for (lang, phrase), r in got.items():
        g = phrase.split(" ")
        longer = [a for h, a in f[lang].items() if len(h) == len(g) + 1 and a >= 10 and (list(h[1:]) == g or list(h[:-1]) == g)]
        assert r.extended == max(longer, default=0) and r.words == len(g)
    assert {(r.lang, r.phrase): r.f for r in counts.prefixes.collect()} == {k: a for k, a in want.items() if k[1].count(" ") < 3}
    assert {r.lang: r.n for r in counts.totals.collect()} == {k: v for k, v in n.items() if v}


def test_slices_of_a_hot_prefix_meet_again(frame, monkeypatch):
    monkeypatch.setattr(phrases, "GROUP", 40)
    rows = corpus(9)
    seen = []
    keep = phrases._sketch
    monkeypatch.setattr(phrases, "_sketch", lambda *a: seen.append(keep(*a)) or seen[-1])
    got = [tuple(r) for r in collocations(frame(rows, SCHEMA), 4, 6, 100, 300, 900).collect()]
    assert sorted(got) == plain(rows, 4, 6, 100, 300)
    assert max(s for _, (_, many) in seen for s in many.tolist()) > 10  # slices of "the", "a"


def test_a_small_filter_only_adds_work(frame, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BYTES", 8192)  # 1024 bits a segment: the least there is
    rows = corpus(4)
    got = [tuple(r) for r in collocations(frame(rows, SCHEMA), 5, 4, 100, 2000).collect()]
    assert sorted(got) == plain(rows, 5, 4, 100, 2000)
    full = Sketch({s: np.full(2, 255, dtype=np.uint8) for s in range(phrases.SEGMENTS)}, 16)
    assert full.has(np.arange(50, dtype=np.uint64)).all()


def test_long_texts_come_in_pieces(monkeypatch):
    text = ("Ab cd, ef " * 500).encode()
    whole = [w for some in tokens(text) for w in some]
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 37)
    assert [w for some in tokens(text) for w in some] == whole and whole[:5] == [b"ab", b"cd", b"\xff", b"ef", b"ab"]
    assert max(map(len, tokens(text))) < 30


def test_products_beyond_64_bits_are_exact(spark):
    a, n, l, r = 10 ** 13 - 7, 10 ** 14 + 3, 10 ** 13 + 11, 10 ** 13 + 13
    big = "decimal(38,0)"
    got = spark.sql(f"select (cast(1000 as {big}) * cast({a} as {big}) * cast({n} as {big})) div (cast({l} as {big}) * cast({r} as {big})) as s").first().s
    assert got == 1000 * a * n // (l * r)


def test_clashing_columns_and_empty_tables(frame, spark):
    df = frame([("en", "x y. x y", "k", 1)], "lang string, text string, phrase string, f long")
    assert [tuple(r) for r in collocations(df, 5, 2).collect()] == [("en", 1, "x y", 2, 2, 2, 4, 2000)]
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(frame([("en", "a b c")], SCHEMA)).collect() == []
