"""Phrase collocations by the stripes pattern.

1. Words are counted by language. Then, for phrases of 2, 3, ... words, every task keeps a
   stripe for each prefix: an associative counter of its next words, with one entry ("") for
   occurrences of the prefix that nothing tracked follows. Stripes of one prefix are merged
   elementwise where they meet.
2. A merged stripe gives the extensions (entries of ``min_count`` or more), the prefix's
   total (all entries) and what subsumption needs: its largest entry is the most frequent
   extension to the right, and each entry bounds its own last words' extension to the left.
3. A phrase can only reach ``min_count`` if both phrases one word shorter do, so the texts
   are read again for longer ones (beyond three words, for two sizes at a time). A bit filter
   over those, of at most ``FILTER_BYTES``, is sent to the tasks; whatever passes by chance
   is counted like the rest and fails the exact count, so its size bounds work, never results.
4. Stripes travel in buckets of prefixes: one row a bucket and run of texts, with a word
   list of its own. The stripe of a prefix with many occurrences is cut into slices by next
   word, so that none holds more than about a 100,000th of all words' occurrences (4 million
   at least), and slices go to different buckets. A merge keeps the sums of one bucket.
5. Each candidate's cuts look up the counts of both parts; scores are exact decimals.

Words are runs without blanks and tabs in pieces cut at . , ; : ! ? and line ends, A-Z
lower-cased. Defined results: a null or empty text has no words; a null language is
``und``. Repeated rows count each. Empty tables give empty results. Other columns than the
text and the language are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .common import prepare, utf8

BATCH_WORDS = 1 << 21
VOCAB_WORDS = 500_000       # words that a task numbers before it starts anew
CHUNK_BYTES = 1 << 22       # of one text, taken apart at a time
FILTER_BYTES, SEGMENTS = 32 << 20, 64
GROUP, GROUPS = 1 << 22, 100_000
BUCKETS, MAX_BUCKETS = 16, 1 << 14
MERGE_ROWS = 1 << 21        # rows of stripes that wait for a merge
BREAK = b"\xff"             # in no UTF-8 text

#: A-Z to lower case, marks and line ends that part pieces to BREAK, tab to blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 0xFF if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase one word longer."""
    return _mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def tokens(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, with BREAK between pieces, in lists of bounded size."""
    data = (text or b"").translate(_FOLD).replace(BREAK, b" \xff ")
    at = 0
    while at < len(data):
        to = data.find(b" ", at + CHUNK_BYTES)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


class Numbers(dict):
    """Numbers of strings in the order they come; "" is 0."""

    def __init__(self):
        super().__init__({"": 0})

    def __missing__(self, text: str) -> int:
        self[text] = n = len(self)
        return n


class Words(dict):
    """Numbers (from 1; 0 is BREAK), hashes and names of one language's words."""

    def __init__(self, lang: str):
        super().__init__({BREAK: 0})
        self.lang, self.key = lang, lang.encode() + b"\0"
        self.hash = np.zeros(1, dtype=np.uint64)
        self.names = [""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.names.append(word.decode())
        return n

    def hashes(self) -> np.ndarray:
        if len(self.hash) < len(self):
            new = self.names[len(self.hash):]
            own = np.array([xxhash.xxh3_64_intdigest(self.key + w.encode()) for w in new], dtype=np.uint64)
            self.hash = np.concatenate([self.hash, own])
        return self.hash


def _runs(batches, batch_words: int):
    """(language, its words, the numbers of a run of texts): about ``batch_words`` at a time."""
    vocab: dict[str, Words] = {}
    held: dict[str, list[np.ndarray]] = {}
    n = 0

    def out():
        for lang, ids in held.items():
            yield lang, vocab[lang], np.concatenate(ids)
        held.clear()
        if sum(map(len, vocab.values())) > VOCAB_WORDS:
            vocab.clear()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
            if (words := vocab.get(lang)) is None:
                words = vocab[lang] = Words(lang)
            for some in tokens(text):
                held.setdefault(lang, []).append(np.fromiter(map(words.__getitem__, some), dtype=np.int32, count=len(some)))
                n += len(some)
            if lang in held:
                held[lang].append(np.zeros(1, dtype=np.int32))  # a text ends
        if n >= batch_words:
            yield from out()
            n = 0
    yield from out()


class Sketch:
    """Membership filter over phrase hashes: in segments of bits, two bits a phrase."""

    def __init__(self, segments: dict[int, np.ndarray], bits: int):
        self.segments, self.bits = np.zeros((SEGMENTS, bits // 8), dtype=np.uint8), bits
        for s, own in segments.items():
            self.segments[s] = own

    @staticmethod
    def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        again, last = _mix(h + np.uint64(1)), np.uint64(bits - 1)
        return (h & np.uint64(SEGMENTS - 1)).astype(np.int64), ((h >> np.uint64(6)) & last).astype(np.int64), (again & last).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        s, a, b = self.places(h, self.bits)
        one = self.segments[s, a >> 3] >> (a & 7).astype(np.uint8)
        two = self.segments[s, b >> 3] >> (b & 7).astype(np.uint8)
        return one & two & 1 == 1


def _hash_phrases(batches):
    """(h, f) of the rows (lang, phrase, f), phrases of one number of words."""
    for b in batches:
        own = [[xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + w) for w in phrase.split(b" ")]
               for lang, phrase in zip(b.column(0).to_pylist(), utf8(b.column(1)))]
        if own:
            words = np.array(own, dtype=np.uint64)
            h = words[:, 0]
            for j in range(1, words.shape[1]):
                h = _longer(h, words[:, j])
            yield pa.RecordBatch.from_arrays([pa.array(h.copy().view(np.int64)), b.column(2)], names=["h", "f"])


def _sketch(phrases: DataFrame, n: int) -> tuple[Sketch, tuple[np.ndarray, np.ndarray]]:
    """The filter over (lang, phrase, f), built a segment a task, and the hashes of phrases
    with so many occurrences that their stripes are sliced, with their numbers of slices."""
    hashed = phrases.select("lang", "phrase", "f").mapInArrow(_hash_phrases, "h long, f long").checkpoint()
    size = max(1, hashed.count())
    bits = 1024
    while bits * SEGMENTS < 16 * size and bits * SEGMENTS * 2 <= FILTER_BYTES * 8:
        bits *= 2

    def build(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            s, a, c = Sketch.places(b["h"].to_numpy().view(np.uint64), bits)
            for seg in np.unique(s).tolist():
                at = own.setdefault(seg, np.zeros(bits // 8, dtype=np.uint8))
                for x in (a[s == seg], c[s == seg]):
                    np.bitwise_or.at(at, x >> 3, (1 << (x & 7)).astype(np.uint8))
        yield pd.DataFrame({"segment": list(own), "bits": [x.tobytes() for x in own.values()]})

    got = (hashed.repartition(SEGMENTS, F.pmod("h", F.lit(SEGMENTS))).mapInPandas(build, "segment int, bits binary")
           .collect())  # at most FILTER_BYTES
    segments: dict[int, np.ndarray] = {}
    for r in got:
        own = np.frombuffer(r["bits"], dtype=np.uint8)
        segments[r["segment"]] = segments[r["segment"]] | own if r["segment"] in segments else own
    group = max(GROUP, n // GROUPS)
    hot = sorted((r["h"] % (1 << 64), r["f"] // group + 1) for r in hashed.where(F.col("f") >= group).collect())
    return Sketch(segments, bits), (np.array([h for h, _ in hot], dtype=np.uint64), np.array([s for _, s in hot], dtype=np.int64))


def _count_words(batch_words: int):
    """(lang, word, f) of a task's texts; word "" counts all words."""
    def local(batches):
        for lang, words, ids in _runs(batches, batch_words):
            count = np.bincount(ids, minlength=len(words))
            count[0] = count[1:].sum()
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()),
                                              pa.array([words.names[i] for i in some.tolist()], pa.string()),
                                              pa.array(count[some].astype(np.int64))], names=["lang", "word", "f"])
    return local


STRIPES = "lang string, size int, bucket int, counters binary"


def _small(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes each as hold them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def stripes_of(ids: np.ndarray, words: Words, sizes: list[int], filters: list[Sketch], hot, buckets: int):
    """Stripes of the prefixes of ``size - 1`` words in one run of texts (which ends in a
    BREAK), for each of the rising ``sizes``: one row a bucket of prefixes, with a word list
    of its own, the prefixes as numbers in it, and their counters one after another.
    ``filters[j]`` knows the phrases of j + 1 words that count."""
    hashes = words.hashes()
    ok = (filters[0].has(hashes))[ids] & (ids != 0)
    at = np.flatnonzero(ok)
    h = head = hashes[ids[at]]
    for k in range(1, sizes[-1]):
        if k > 1:  # phrases of k words that may count, by their first place
            both = ok[at + 1]
            at, h, head = at[both], h[both], head[both]
            h = _longer(h, hashes[ids[at + k - 1]])
            if k <= len(filters):
                known = filters[k - 1].has(h)
                at, h = at[known], h[known]
                head = h  # of the longest beginning whose count is known
            ok = np.zeros(len(ids), dtype=bool)
            ok[at] = True
        if k + 1 in sizes and len(at):
            yield from _pack(ids, words, hashes, at, h, head, np.where(ok[at + 1], ids[at + k], 0), k, hot, buckets)


def _codes(columns: list[np.ndarray], width: int) -> np.ndarray:
    """One whole number for each distinct row of the columns, whose values are below ``width``."""
    code = columns[0].astype(np.int64)
    for c in columns[1:]:
        code = np.unique(code, return_inverse=True)[1] if len(code) and int(code.max()) >= (1 << 62) // width else code
        code = code * width + c
    return code


def _pack(ids, words: Words, hashes, at, h, head, follow, k: int, hot, buckets: int):
    """Rows of the stripes of all occurrences ``at`` of prefixes of ``k`` words (hashes ``h``,
    ``head`` of the beginning by which ``hot`` tells slices; no prefix is more frequent);
    ``follow`` is the next word, 0 where nothing tracked follows."""
    code = _codes([ids[at + j] for j in range(k)], len(words))
    first, prefix = np.unique(code, return_index=True, return_inverse=True)[1:]
    pairs, n = np.unique(prefix * len(words) + follow, return_counts=True)
    p, w = pairs // len(words), pairs % len(words)
    own = h[first]
    slices = np.ones(len(first), dtype=np.uint64)
    if len(hot[0]):
        known = head[first]
        place = np.minimum(np.searchsorted(hot[0], known), len(hot[0]) - 1)
        slices = np.where(hot[0][place] == known, hot[1][place], 1).astype(np.uint64)
    part = _mix(hashes[w]) % slices[p]
    bucket = (_mix(own[p] + part) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((p, bucket))
    p, w, n, bucket = p[order], w[order], n[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)]):
        begin = np.flatnonzero(np.concatenate(([True], np.diff(p[a:b]) != 0)))
        places = at[first[p[a:b][begin]]]
        refs = np.concatenate([*(ids[places + j] for j in range(k)), w[a:b]])
        used, refs = np.unique(refs, return_inverse=True)
        m = len(begin)
        lengths = np.diff(np.append(begin, b - a))
        names = " ".join([words.names[i] for i in used.tolist()])  # no word holds a blank
        packed = pickle.dumps((names, *map(_small, (refs[:k * m], lengths, refs[k * m:], n[a:b]))), protocol=5)
        yield pa.RecordBatch.from_arrays(
            [pa.array([words.lang]), pa.array([k + 1], pa.int32()), pa.array([bucket[a]], pa.int32()),
             pa.array([zlib.compress(packed, 1)], pa.binary())], names=["lang", "size", "bucket", "counters"])


class Merge:
    """The stripes of one (lang, size, bucket), summed elementwise."""

    def __init__(self, key: tuple[str, int, int]):
        self.key, self.names = key, Numbers()
        self.held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of (prefix words..., next), counts
        self.rows = 0

    def add(self, words: list[str], prefix, lengths, follow, n) -> None:
        number = np.fromiter(map(self.names.__getitem__, words), dtype=np.int64, count=len(words))
        k = self.key[1] - 1
        heads = number[prefix].reshape(k, -1)
        self.held.append((np.vstack([np.repeat(heads, lengths, axis=1), number[follow][None, :]]), n.astype(np.int64)))
        self.rows += len(n)
        if self.rows > MERGE_ROWS and len(self.held) > 1:
            self._sum()

    def _sum(self) -> None:
        rows, n = np.concatenate([r for r, _ in self.held], axis=1), np.concatenate([c for _, c in self.held])
        first, of = np.unique(_codes(list(rows), len(self.names)), return_index=True, return_inverse=True)[1:]
        total = np.zeros(len(first), dtype=np.int64)
        np.add.at(total, of, n)
        # smaller sums are not tried again until as many rows came anew
        self.held, self.rows = [(rows[:, first], total)], 0

    def out(self, min_count: int) -> pa.RecordBatch:
        """(lang, size, prefix, next, f) of the entries that count; f of next "" is the total."""
        self._sum()
        rows, f = self.held[0]
        first, of = np.unique(_codes(list(rows[:-1]), len(self.names)), return_index=True, return_inverse=True)[1:]
        total = np.zeros(len(first), dtype=np.int64)
        np.add.at(total, of, f)
        keep = np.flatnonzero((f >= min_count) & (rows[-1] != 0))
        names = pa.array(list(self.names), pa.string())
        at = np.concatenate([keep, first])
        heads = [names.take(pa.array(rows[j][at])) for j in range(len(rows) - 1)]
        follow = np.concatenate([rows[-1][keep], np.zeros(len(first), dtype=np.int64)])
        lang, size, _ = self.key
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array([size] * len(at), pa.int32()),
             heads[0] if len(heads) == 1 else pc.binary_join_element_wise(*heads, " "), names.take(pa.array(follow)),
             pa.array(np.concatenate([f[keep], total]))], names=["lang", "size", "prefix", "next", "f"])


def _merge(min_count: int):
    """Merged stripes, from rows in the order of their (lang, size, bucket)."""
    def local(batches):
        now = None
        for b in batches:
            for i in range(b.num_rows):
                key = tuple(b.column(j)[i].as_py() for j in range(3))
                if now is None or now.key != key:
                    if now is not None:
                        yield now.out(min_count)
                    now = Merge(key)
                words, *counters = pickle.loads(zlib.decompress(b.column(3)[i].as_py()))
                now.add(words.split(" "), *counters)
        if now is not None:
            yield now.out(min_count)
    return local


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


@dataclass
class Counts:
    """What the stripes give."""
    phrases: DataFrame   # lang, phrase, words, f, extended (largest f of a phrase one word longer; 0: none counts)
    prefixes: DataFrame  # lang, phrase, f: totals of the stripes
    totals: DataFrame    # lang, n: all words


def phrase_counts(docs: DataFrame, max_words: int = 5, min_count: int = 100, batch_words: int = BATCH_WORDS) -> Counts:
    """Of ``docs`` (lang, text) all phrases of 1 to ``max_words`` words with ``min_count``
    occurrences or more."""
    spark = docs.sparkSession
    if max_words < 1 or min_count < 1:
        raise ValueError("max_words and min_count must be at least 1")
    prepare(spark, text_batches=True)
    texts = _texts(docs)
    counted = (texts.mapInArrow(_count_words(batch_words), "lang string, word string, f long").groupBy("lang", "word")
               .agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("word") == "")).checkpoint())
    totals = counted.where("word = ''").select("lang", F.col("f").alias("n"))
    level = counted.where((F.col("word") != "") & (F.col("f") >= min_count)).select("lang", F.col("word").alias("phrase"), "f")
    n = totals.agg(F.sum("n")).first()[0] or 0
    phrases = level.withColumn("words", F.lit(1))
    buckets = BUCKETS
    while buckets < MAX_BUCKETS and n > buckets * GROUP:
        buckets *= 2
    longer, prefixes, filters, size = None, None, [], 2
    while size <= max_words:
        sizes = [x for x in ([size] if size < 4 else [size, size + 1]) if x <= max_words]
        sketch, hot = _sketch(level, n)
        filters.append(sketch)
        sent = spark.sparkContext.broadcast((list(filters), hot))

        def stripes(batches, sizes=sizes, sent=sent):
            known, many = sent.value
            for _, words, ids in _runs(batches, batch_words):
                yield from stripes_of(ids, words, sizes, known, many, buckets)
        merged = (texts.mapInArrow(stripes, STRIPES).repartition("lang", "size", "bucket")
                  .sortWithinPartitions("lang", "size", "bucket")
                  .mapInArrow(_merge(min_count), "lang string, size int, prefix string, next string, f long").checkpoint())
        entries = merged.where("next != ''")
        tail = F.when(F.col("size") == 2, F.col("next")).otherwise(F.concat_ws(" ", F.regexp_replace("prefix", "^[^ ]* ", ""), "next"))
        held = entries.select("lang", F.col("prefix").alias("phrase"), "f").unionByName(
            entries.select("lang", tail.alias("phrase"), "f"))
        longer = held if longer is None else longer.unionByName(held)
        # prefixes of several slices meet; those below the count have no entries
        ends = (merged.where("next = ''").groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("f").alias("f"))
                .where(F.col("f") >= min_count))
        prefixes = ends if prefixes is None else prefixes.unionByName(ends)
        found = entries.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), "f", F.col("size").alias("words"))
        phrases = phrases.unionByName(found)
        level = found.where(F.col("words") == sizes[-1]).drop("words")
        if level.isEmpty():
            break
        for x in sizes[1:]:  # a filter for each number of words that a longer pass builds on
            if sizes[-1] < max_words:
                filters.append(_sketch(found.where(F.col("words") == x - 1).drop("words"), n)[0])
        size = sizes[-1] + 1
    if longer is None:
        return Counts(phrases.withColumn("extended", F.lit(0).cast("long")), level.limit(0), totals)
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("extended"))
    full = phrases.join(most, ["lang", "phrase"], "left").withColumn("extended", F.coalesce("extended", F.lit(0).cast("long")))
    return Counts(full.select("lang", "phrase", "words", "f", "extended").checkpoint(), prefixes, totals)


def _lookup(cuts: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """``cuts`` with the count of the phrase in ``part``; parts that many cuts share are
    matched without a shuffle."""
    asked = cuts.groupBy("lang", part).agg(F.count(F.lit(1)).alias("asked"))
    key = F.concat_ws("\n", "lang", part)  # no phrase holds a line end
    keyed = (counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).join(asked, ["lang", part])
             .select(key.alias("key"), name, "asked"))
    return lookup_join(cuts.withColumn("key", key), keyed, "key", weight="asked").drop("key", "asked")


def collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, percent: int = 100, top: int = 2000,
                 batch_words: int = BATCH_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to
    ``max_words`` words by floor(1000 * a * n / (l * r)) of their lowest-scoring cut, less
    phrases held by a longer one with at least ``percent`` % of their occurrences."""
    counts = phrase_counts(docs, max_words, min_count, batch_words)
    rows = counts.phrases.where((F.col("words") >= 2) & ((F.col("extended") == 0) | (100 * F.col("extended") < percent * F.col("f"))))
    words = F.split("phrase", " ")
    cuts = (rows.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"),
                        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                    F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest")))
    both = _lookup(_lookup(cuts, counts.prefixes, "head", "l"), counts.phrases, "rest", "r")
    both = lookup_join(both, counts.totals, "lang", weight="n")
    big = "decimal(38,0)"
    score = F.expr(f"(cast(1000 as {big}) * cast(a as {big}) * cast(n as {big})) div (cast(l as {big}) * cast(r as {big}))")
    least = both.select("lang", "phrase", "a", "n", F.struct(score.cast("long").alias("score"), "k", "l", "r").alias("cut"))
    best = least.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min("cut").alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return (best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
