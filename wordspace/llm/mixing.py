"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. Sources in code point order (null last) take ``weights`` in turn and share
   ``share`` times all words; a target stops at ``repeat`` times its source's words, and
   what is over goes to the other sources by weight until none is above.
2. Streams. A source's documents in a keyed pseudo-random order are one stream of words,
   gone through up to ``repeat`` times. The mix takes the stream's first words up to the
   target, as blocks of ``block_words`` words (the last one may be shorter): the source's
   quota of blocks is exact.
3. Splitting tree. The root holds every source's quota for all output shards. A node
   halves its shards and draws the left half's share of each quota from a multivariate
   hypergeometric law, as if that many blocks were drawn without replacement; leaves are
   shards. Draws are keyed by the node, so each task walks only the paths to its own
   shards and all tasks agree; no table of shards passes through the driver.
4. Blocks. A shard's quota is a run of numbers of each source, disjoint from all other
   shards' runs; a keyed permutation (Feistel rounds) of the source's blocks turns it
   into blocks. Pieces of documents get a keyed random place within their shard.

A source of any size is spread: running totals go by (source, slice of the hash), shards
have equal numbers of blocks. The driver sees one row a source (``MAX_SOURCES`` at most,
refused beyond).

Defined results: a null text has no words and is never taken; a null source is a source;
rows that are equal are separate rows with the same words. Empty tables give empty
results. Names of extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, prepare, unboxed

WORD = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 100_000
SLICE_ROWS, MAX_SLICES = 256, 65_536


@dataclass(frozen=True)
class Mix:
    """``documents``: a row for each row of the input: doc_id, source, k1, k2 (hash of
    doc_id, source and text), size, source_no, source_size, target, at (its first word in
    the stream). ``pieces``: what the mix takes: source_no, at, doc_id, k1, k2, size, copy
    (pass over the stream), word_from, word_to, block, shard, place."""

    documents: DataFrame
    pieces: DataFrame
    shards: int
    seed: int


def fill(sizes: list[int], weights: tuple[float, ...], share: float, repeat: float) -> list[float]:
    """Targets of the sources by weight, none above ``repeat`` times its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target = [float(repeat * s) for s in sizes]
    total, free = share * sum(sizes), list(range(len(sizes)))
    while free:
        level = total / sum(w[i] for i in free)
        over = [i for i in free if level * w[i] > target[i]]
        if not over:
            for i in free:
                target[i] = level * w[i]
            break
        total -= sum(target[i] for i in over)
        free = [i for i in free if level * w[i] <= target[i]]
    return target


def split_quotas(quotas: np.ndarray, shards: int, first: int, last: int, seed: int):
    """(shard, quota of each source, first number of each source) for the shards from
    ``first`` up to ``last``, along the tree's paths to them."""
    total = int(quotas.sum())
    held = lambda a, b: (b * total) // shards - (a * total) // shards  # noqa: E731  equal shards to a block

    def walk(lo: int, hi: int, own: np.ndarray, start: np.ndarray):
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, own, start
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(own, held(lo, mid), method="marginals")
        yield from walk(lo, mid, left, start)
        yield from walk(mid, hi, own - left, start + left)
    yield from walk(0, shards, quotas.astype(np.int64), np.zeros(len(quotas), dtype=np.int64))


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at ``x``: Feistel rounds on the next even number of
    bits, repeated where they leave the range."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            k = np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            f = (b + k) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, (a ^ (f ^ (f >> np.uint64(29))) >> np.uint64(17)) & low
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeat: int = 2,
                block_words: int = 65_536, shard_blocks: int = 16, seed: int = 42) -> Mix:
    """The mix of ``docs`` (doc_id, source, text)."""
    if share <= 0 or repeat < 1 or min(weights) <= 0 or block_words < 1 or shard_blocks < 1:
        raise ValueError("weights, share, repeat, block_words and shard_blocks must be positive")
    spark = docs.sparkSession
    prepare(spark)
    ident = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text")]
    rows = docs.select(
        ident[0].alias("doc_id"), ident[1].alias("source"),
        F.xxhash64(F.lit(seed), *ident).alias("k1"), F.xxhash64(F.lit(seed + 1), *ident).alias("k2"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")).checkpoint()
    n = rows.count()
    names = rows.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    words = [r["words"] for r in names]
    targets = fill(words, weights, share, repeat)
    table = spark.createDataFrame([(r["source"], i, words[i], targets[i], int(round(targets[i]))) for i, r in enumerate(names)],
                                  "s string, source_no int, source_size long, target double, take long")
    rows = (rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))

    # a running total of words within each source, in two levels
    slices = min(MAX_SLICES, n // SLICE_ROWS + 1)
    rows = rows.withColumn("slice", F.pmod("k1", F.lit(slices)).cast("int"))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("source_no", "slice").agg(F.sum("size").alias("size"))
    sums = sums.select("source_no", "slice", before(Window.partitionBy("source_no").orderBy("slice")).alias("slice_at"))
    inside = before(Window.partitionBy("source_no", "slice").orderBy("k1", "k2"))
    rows = rows.withColumn("inside", inside).join(sums, ["source_no", "slice"])
    documents = rows.withColumn("at", F.col("slice_at") + F.col("inside")).drop("slice", "slice_at", "inside").checkpoint()

    # blocks to shards
    quotas = np.array([-(-int(round(t)) // block_words) for t in targets], dtype=np.int64)
    total = int(quotas.sum())
    if total >= 1_000_000_000:
        raise ValueError("more than 1e9 blocks: raise block_words")
    shards = max(1, -(-total // shard_blocks))

    def blocks(batches):
        for b in batches:
            ids = b["id"].to_numpy()
            got = []
            if not total or not len(ids):
                continue
            for shard, quota, start in split_quotas(quotas, shards, int(ids.min()), int(ids.max()) + 1, seed):
                for s in np.flatnonzero(quota):
                    no = permuted(np.arange(start[s], start[s] + quota[s]), int(quotas[s]), seed * 1_000_003 + int(s))
                    got.append(pd.DataFrame({"source_no": np.int32(s), "block": no, "shard": np.int32(shard)}))
            if got:
                yield pd.concat(got, ignore_index=True)

    dealt = spark.range(shards).mapInPandas(blocks, "source_no int, block long, shard int")
    first = F.col("at") + F.col("copy") * F.col("source_size")  # in the stream of all passes
    last = F.least(first + F.col("size"), F.col("take"))
    pieces = (documents.where("size > 0").withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(repeat)])))
              .withColumns({"first": first, "last": last}).where("first < last")
              .withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block_words),
                                                        F.floor((F.col("last") - 1) / block_words))))
              .withColumns({"word_from": F.greatest("first", F.col("block") * block_words) - F.col("first"),
                            "word_to": F.least("last", (F.col("block") + 1) * block_words) - F.col("first")})
              .join(dealt, ["source_no", "block"]))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "k1", "k2", "copy", "word_from", "at"), "source_no", "at", "copy", "word_from")
    pieces = pieces.withColumn("place", F.row_number().over(order) - 1)
    return Mix(documents.select("doc_id", "source", "k1", "k2", "size", "source_no", "source_size", "target", "at"),
               pieces.select("source_no", "at", "doc_id", "k1", "k2", "size", "copy", "word_from", "word_to", "block", "shard", "place"),
               shards, seed)


def taken(mix: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken, pieces: for each row of the input the words
    that the mix takes of it, and where its pieces stand: (shard, place, words) of each."""
    words = F.col("word_to") - F.col("word_from")
    got = mix.pieces.groupBy("source_no", "at").agg(
        F.sum(words).alias("got"), F.sort_array(F.collect_list(F.struct("shard", "place", words.alias("words")))).alias("pieces"))
    full = mix.documents.where("size > 0").join(got, ["source_no", "at"], "left")
    none = mix.documents.where("size = 0")
    return full.unionByName(none, allowMissingColumns=True).select(
        "doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("pieces", F.array().cast(got.schema["pieces"].dataType)).alias("pieces"))


def mixed_texts(docs: DataFrame, mix: Mix) -> DataFrame:
    """The columns of ``docs`` for every document and pass that the mix takes: a document
    taken twice is two rows. Where a source's target ends within a document, its text ends
    after the words that are taken."""
    got = (mix.pieces.groupBy("k1", "k2", "source_no", "at", "size", "copy").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("m"))
           .groupBy("k1", "k2").agg(F.collect_list(F.when(F.col("m") < F.col("size"), F.col("m")).otherwise(F.lit(-1))).alias("m"),
                                    F.countDistinct("at").alias("rows")).checkpoint())
    ident = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text")]
    keep = ["doc_id", "source", "text"]
    keyed = boxed(docs, keep).withColumns({"j1": F.xxhash64(F.lit(mix.seed), *ident), "j2": F.xxhash64(F.lit(mix.seed + 1), *ident)})
    same = (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))
    # the narrow side is hashed, so that texts are not sorted
    both = keyed.join(got.where("rows = 1").hint("shuffle_hash"), same)
    if got.where("rows > 1").take(1):  # equal rows: all their passes hang on one of them
        again = keyed.join(got.where("rows > 1").hint("shuffle_hash"), same)
        both = both.unionByName(again.dropDuplicates(["j1", "j2"]))
    both = both.withColumn("m", F.explode("m"))
    # chunks of a word and the blanks behind it; blanks in front of all are a chunk too
    chunks = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    led = F.regexp_like("text", F.lit(r"^[\x20\x09-\x0D]")).cast("int")
    cut = F.when(F.col("m") < 0, F.col("text")).otherwise(
        F.array_join(F.slice(chunks, F.lit(1), (F.col("m") + led).cast("int")), ""))
    return unboxed(both.withColumn("text", cut), docs.columns, keep)
