"""Benchmark decontamination through suffix arrays of the training texts.

1. Test items become word numbers: the vocabulary of the items is numbered, and every
   suffix of every item is a search to make. Their size is measured; beyond
   ``block_bytes`` they are cut into blocks by hash, and each block is a round of its own.
2. Every task cuts its documents into shards of about ``SHARD_WORDS`` words and builds the
   suffix array of each by prefix doubling. A word that no item holds ends every match, so
   it parts the shard like the end of a document; runs of known words shorter than the
   shortest window hold no match and leave no suffixes. Suffixes are sorted to the length
   of the longest item: no search looks further.
3. All test suffixes are binary-searched in the array side by side, a word at a time: the
   range of the array narrows until it is empty or the suffix ends. The depth reached is
   the longest verbatim match, the range its locations.
4. Where a suffix gets as far as a window (``window`` words, or the whole of a shorter
   item), all locations of that range are hit.

Documents are not shuffled, and neither suffixes nor matches leave their task: rows come
back with what was found in them. A passage in a third of all documents is one range of
each shard's array.

Words are runs of characters other than ASCII punctuation, blanks and control characters,
A-Z lower-cased. Defined results: a null or empty text has no words; an item without words
is found nowhere; an item shorter than ``window`` is one window. Rows that share an
item_id are one item, a null item_id is the item of empty name. Every row of documents
gives a row, repeated or null doc_ids too. Empty tables give empty results or no hits.
Extra columns pass through; the columns added replace columns of those names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, utf8

SHARD_WORDS = 1 << 20
BLOCK_BYTES = 16 << 20
CHAIN = 4       # blocks of tests between two checkpoints
WINDOW = 10

#: Lower case for A-Z, a blank for every other ASCII character that is not a digit or letter.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32
              for c in range(256))

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                      T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(SPAN))])
_ARROW = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()),
          "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _runs(ids: np.ndarray) -> np.ndarray:
    """How many words go on from each place until the next 0."""
    at = np.where(ids == 0, np.arange(len(ids)), len(ids))
    return np.minimum.accumulate(at[::-1])[::-1] - np.arange(len(ids))


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... (n[0] of them), lo[1], ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - lo, n)


class SuffixArray:
    """The suffixes of ``ids`` (word numbers, 0 parts texts) sorted by their first
    ``depth`` words."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids = np.concatenate([ids, np.zeros(1, ids.dtype)]).astype(np.int64)
        self.run = _runs(self.ids)
        at = np.flatnonzero(self.ids)
        rank, h, far = self.ids.copy(), 1, self.run[at]
        while len(at) and h < min(depth, int(far.max())):
            second = np.zeros(len(at), dtype=np.int64)
            more = far > h
            second[more] = rank[at[more] + h]
            distinct, place = np.unique(rank[at] * (int(rank.max()) + 1) + second, return_inverse=True)
            rank[at] = place + 1
            if len(distinct) == len(at):
                break
            h *= 2
        self.at = at[np.argsort(rank[at], kind="stable")]

    def _bound(self, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, depth: int, after: bool) -> np.ndarray:
        """First place in each [lo, hi) whose word at ``depth`` is not less than (``after``:
        is more than) ``word``."""
        lo, hi = lo.copy(), hi.copy()
        left = np.flatnonzero(lo < hi)
        while len(left):
            mid = (lo[left] + hi[left]) >> 1
            p = self.at[mid]
            inside = self.run[p] > depth
            have = np.where(inside, self.ids[np.where(inside, p + depth, 0)], 0)
            on = have <= word[left] if after else have < word[left]
            lo[left[on]], hi[left[~on]] = mid[on] + 1, mid[~on]
            left = left[lo[left] < hi[left]]
        return lo

    def search(self, tests: np.ndarray, starts: np.ndarray, length: np.ndarray, window: np.ndarray):
        """Of the test suffixes at ``starts`` (of ``length`` words): the words of the longest
        match, its range, and the range that holds the first ``window`` words."""
        n = len(starts)
        lo, hi = np.zeros(n, dtype=np.int64), np.full(n, len(self.at), dtype=np.int64)
        longest, part = np.zeros(n, dtype=np.int64), np.zeros((2, n), dtype=np.int64)
        live, depth = np.arange(n), 0
        while len(live):
            word = tests[starts[live] + depth]
            a = self._bound(lo[live], hi[live], word, depth, False)
            b = self._bound(a, hi[live], word, depth, True)
            found = a < b
            live, a, b = live[found], a[found], b[found]
            depth += 1
            lo[live], hi[live], longest[live] = a, b, depth
            full = window[live] == depth
            part[0, live[full]], part[1, live[full]] = a[full], b[full]
            live = live[length[live] > depth]
        return longest, lo, hi, part[0], part[1]


class Tests:
    """The items of one block as word numbers, and their suffixes."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocab: dict[bytes, int] = {}
        ids: list[int] = []
        starts, length, wide, item, offset = [], [], [], [], []
        for name, text in sorted(set(items), key=lambda x: (x[0], x[1] or b"")):
            words = words_of(text)
            if not words:
                continue
            w = min(window, len(words))
            k = np.arange(len(words) - w + 1)  # later suffixes hold no window
            starts.append(len(ids) + k)
            offset.append(k)
            length.append(len(words) - k)
            wide.append(np.full(len(k), w))
            item.append(np.full(len(k), number[name]))
            ids += [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words]
            ids.append(0)
        flat = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (starts, length, wide, item, offset)]
        self.starts, self.length, self.window, self.item, self.offset = (x.astype(np.int64) for x in flat)
        self.ids = np.array(ids, dtype=np.int64)
        self.shortest = int(self.window.min(initial=window))
        self.depth = int(self.length.max(initial=0))

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(0)), dtype=np.int64, count=len(words))


class Shard:
    """The suffix array of some texts, and what the tests find in it."""

    def __init__(self, texts: list[list[bytes]], tests: Tests):
        ids = np.concatenate([x for t in texts for x in (tests.number(t), np.zeros(1, dtype=np.int64))]
                             or [np.zeros(0, dtype=np.int64)])
        n = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), n)
        word = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        run = _runs(ids)
        first = np.flatnonzero((run > 0) & (np.concatenate(([0], run[:-1])) == 0))
        first = first[run[first] >= tests.shortest]  # runs that can hold a window
        kept = _spread(first, run[first] + 1)        # with a 0 behind each (texts end in one)
        self.doc, self.word = doc[kept], word[kept]
        self.array = SuffixArray(ids[kept], tests.depth)
        self.longest, self.lo, self.hi, self.win_lo, self.win_hi = self.array.search(
            tests.ids, tests.starts, tests.length, tests.window)
        self.tests = tests

    def windows(self):
        """Hit words as a mask over the kept words, and the distinct (document, item) pairs."""
        t = self.tests
        hit = np.flatnonzero(self.win_hi > self.win_lo)
        ranges, of = np.unique(np.stack([self.win_lo[hit], self.win_hi[hit], t.window[hit]]), axis=1, return_inverse=True)
        lo, hi, w = ranges
        of = of.reshape(-1)
        at = self.array.at[_spread(lo, hi - lo)]
        which = np.repeat(np.arange(len(lo)), hi - lo)
        change = np.zeros(len(self.array.ids) + 1, dtype=np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + w[which], -1)
        mask = np.cumsum(change)[:len(self.doc)] > 0
        pairs = np.unique(self.doc[at] * max(1, len(lo)) + which)  # (document, window)
        docs, which = pairs // max(1, len(lo)), pairs % max(1, len(lo))
        named = np.unique(of * max(1, len(t.names)) + t.item[hit])  # (window, item)
        w_of, i_of = named // max(1, len(t.names)), named % max(1, len(t.names))
        begin, end = np.searchsorted(w_of, which), np.searchsorted(w_of, which, side="right")
        both = np.unique(np.repeat(docs, end - begin) * max(1, len(t.names)) + i_of[_spread(begin, end - begin)])
        return mask, both // max(1, len(t.names)), both % max(1, len(t.names))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(tests: DataFrame, block_bytes: int, window: int):
    """The tests by block, each of about ``block_bytes``: one, unless their measured size is more."""
    rows = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").alias("t"))
    size = rows.agg(F.sum(F.octet_length("id") + F.coalesce(F.octet_length("t"), F.lit(0)) + 32).alias("b")).first()["b"] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k)
        yield Tests([(r["id"], None if r["t"] is None else r["t"].encode()) for r in part.distinct().collect()], window)


def _shards(batches, text_at: int, shard_words: int):
    """(record batches, the words of their texts), in runs of about ``shard_words`` words."""
    held, texts, n = [], [], 0
    for b in batches:
        own = [words_of(t) for t in utf8(b.column(text_at))]
        held.append(b)
        texts += own
        n += sum(map(len, own))
        if n >= shard_words:
            yield held, texts
            held, texts, n = [], [], 0
    if held:
        yield held, texts


def find_contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                       shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``n_words``, ``n_hit`` (words inside a window of an
    item), ``items`` (sorted ids, as strings, of the items with a window in the text) and
    ``spans`` ([start, end) of the runs of hit words). ``tests`` has item_id and text."""
    spark = docs.sparkSession
    if window < 1:
        raise ValueError("window must be at least 1")
    prepare(spark, text_batches=True)
    cols = [c for c in docs.columns if c.lower() not in ADDED.fieldNames()]
    rows = docs.select(*cols)
    text_at, width = [c.lower() for c in cols].index("text"), len(cols)
    out = T.StructType([*rows.schema.fields, *ADDED.fields])

    def scan(sent, later: bool):
        def local(batches):
            for held, texts in _shards(batches, text_at, shard_words):
                shard = Shard(texts, sent.value)
                mask, d, i = shard.windows()
                items: list[set[str]] = [set() for _ in texts]
                for doc, item in zip(d.tolist(), i.tolist()):
                    items[doc].add(sent.value.names[item])
                spans: list[list[tuple[int, int]]] = [[] for _ in texts]
                doc, word = shard.doc[mask], shard.word[mask]
                cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(word) != 1)) + 1
                for a, b in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(doc)])).tolist()):
                    if a < b:
                        spans[int(doc[a])].append((int(word[a]), int(word[b - 1]) + 1))
                at = 0
                for b in held:
                    k = b.num_rows
                    sp, it = spans[at:at + k], items[at:at + k]
                    if later:  # what earlier blocks of tests found
                        had = {n: b.column(width + j).to_pylist() for j, n in enumerate(_ARROW)}
                        sp = [_merged(x + [(s["start"], s["end"]) for s in y]) for x, y in zip(sp, had["spans"])]
                        it = [x | set(y) for x, y in zip(it, had["items"])]
                    added = [[len(t) for t in texts[at:at + k]], [sum(e - s for s, e in x) for x in sp],
                             [sorted(x) for x in it], [[{"start": s, "end": e} for s, e in x] for x in sp]]
                    at += k
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(j) for j in range(width)), *(pa.array(v, type=t) for v, t in zip(added, _ARROW.values()))],
                        names=[*cols, *_ARROW])
        return local

    for k, block in enumerate(_blocks(tests, block_bytes, window)):
        if k and k % CHAIN == 0:
            rows = rows.checkpoint()
        rows = rows.mapInArrow(scan(spark.sparkContext.broadcast(block), k > 0), out)
    return rows


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` less the documents that hold a window of an item."""
    found = find_contamination(docs, tests, window)
    return found.where(F.col("n_hit") == 0).select(*(c for c in docs.columns if c.lower() not in ADDED.fieldNames()))


def longest_matches(docs: DataFrame, tests: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                    shard_words: int = SHARD_WORDS) -> DataFrame:
    """(item_id, start, longest, locations, doc_id, doc_start): for every suffix of an item
    that has a window somewhere, the words of its longest verbatim match in any document,
    at how many places it stands, and the first of them by (doc_id, word). A task keeps one
    row a suffix; rows of tasks meet in one partial aggregate."""
    spark = docs.sparkSession
    prepare(spark, text_batches=True)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text")
    schema = "item_id string, start long, longest long, locations long, doc_id long, doc_start long"

    def scan(sent):
        def local(batches):
            t = sent.value
            best: dict[int, tuple[int, int, int, int]] = {}  # suffix -> longest, -places, doc, word
            for held, texts in _shards(batches, 1, shard_words):
                shard = Shard(texts, t)
                ids = np.concatenate([np.asarray(b.column(0).to_numpy(zero_copy_only=False)) for b in held])
                for s in np.flatnonzero(shard.longest >= t.window).tolist():
                    deep, at = int(shard.longest[s]), shard.array.at[shard.lo[s]:shard.hi[s]]
                    had = best.get(s, (0, 0, 0, 0))
                    if deep < had[0]:
                        continue
                    own = ids[shard.doc[at]]
                    first = np.lexsort((shard.word[at], own))[0]
                    place = (int(own[first]), int(shard.word[at][first]))
                    best[s] = (deep, len(at), *place) if deep > had[0] else (deep, had[1] + len(at), *min(place, had[2:]))
            keys = list(best)
            vals = np.array([best[s] for s in keys], dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t.names[t.item[s]] for s in keys], pa.string()), pa.array(t.offset[keys] if keys else [], pa.int64()),
                 *(pa.array(vals[:, j]) for j in range(4))],
                names=["item_id", "start", "longest", "locations", "doc_id", "doc_start"])
        return local

    out = None
    for block in _blocks(tests, block_bytes, window):
        got = rows.mapInArrow(scan(spark.sparkContext.broadcast(block)), schema)
        out = got if out is None else out.unionByName(got)
    place = F.struct("doc_id", "doc_start")
    best = out.groupBy("item_id", "start", "longest").agg(F.sum("locations").alias("locations"), F.min(place).alias("p"))
    one = best.groupBy("item_id", "start").agg(F.max(F.struct("longest", "locations", "p")).alias("m"))
    return one.select("item_id", "start", "m.longest", "m.locations",
                      F.when(F.col("m.p.doc_id") != -(1 << 63), F.col("m.p.doc_id")).alias("doc_id"), "m.p.doc_start")
