"""O11-O14: noise distribution, keep probability, subsampling, epochs."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_key, uniform16, uniform32
from ..session import ship_package
from .joins import DEFAULT_BROADCAST_BYTES, lookup_join, measure, stacked
from .prefix import running_sum
from .sentences import runs_of

# Fixed value: exponent of the unigram noise distribution.
NOISE_POWER = 0.75


def noise_distribution(vocab: DataFrame) -> DataFrame:
    """``(word, freq, weight, share, cum_share)`` with weight = freq^0.75,
    share = weight / total and cum_share the running share in word order
    (two-level running total, no single-task window)."""
    w = vocab.select("word", "freq", F.pow(F.col("freq").cast("double"), F.lit(NOISE_POWER))
                     .alias("weight"))
    total = w.agg(F.sum("weight")).first()[0] or 0.0
    cum = running_sum(w, ["word"], "weight", "cum_weight")
    return cum.select("word", "freq", "weight",
                      (F.col("weight") / F.lit(total)).alias("share"),
                      (F.col("cum_weight") / F.lit(total)).alias("cum_share"))


#: Decimal places of the running share that draws are compared with: the order of a
#: distributed sum reaches only places behind them.
SHARE_PLACES = 12
#: Words that a cell of the noise table holds on average.
CELL_WORDS = 16


def noise_cells(noise: DataFrame) -> tuple[DataFrame, int]:
    """``(cell, words array, ends array)`` and the number of cells: the unit interval cut into
    equal cells (a power of two), each with the words whose share of the interval reaches into
    it, in order, and the ends of these shares. ``noise`` = ``noise_distribution(vocab)``."""
    n = noise.count()
    cells = 1 << max(0, (n // CELL_WORDS).bit_length())
    end = F.round("cum_share", SHARE_PLACES)
    start = F.greatest(F.lit(0.0), F.round(F.col("cum_share") - F.col("share"), SHARE_PLACES))
    first, last = F.floor(start * cells), F.least(F.floor(end * cells), F.lit(cells - 1))
    # a neighbour more on each side: rounded starts need not meet rounded ends
    reach = F.sequence(F.greatest(F.lit(0), first - 1).cast("long"), F.greatest(first, F.least(last + 1, F.lit(cells - 1))).cast("long"))
    rows = noise.select("word", end.alias("end"), F.explode(reach).alias("cell"))
    held = rows.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("end", "word"))).alias("r"))
    return held.select("cell", F.col("r.word").alias("words"), F.col("r.end").alias("ends")), cells


def noise_draws(tokens: DataFrame, noise: DataFrame, draws: int, seed: int,
                broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``draws`` words per token, each word as often as its share of the noise distribution:
    ``(doc_id, line_no, pos, draw, noise_word)``.

    A draw is a keyed point of the unit interval, and its word the first whose running share
    exceeds it. The point names a cell of ``noise_cells``, which holds a few words; cells are
    equally likely, so tokens meet them without skew, whatever the word frequencies. Cells
    over ``broadcast_bytes`` stay dealt by ranges, and draws are packed on their way to them."""
    if draws < 1:
        raise ValueError("draws must be at least 1")
    table, cells = noise_cells(noise)
    table = table.checkpoint()
    t = tokens.select("doc_id", "line_no", "pos", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    t = t.withColumn("u", uniform32(draw_key(seed, "noise", F.col("doc_id"), F.col("line_no"), F.col("pos"), F.col("draw"))))
    t = t.withColumn("cell", F.floor(F.col("u") * cells))
    size = measure(table, "cell")
    if size.approx_bytes > broadcast_bytes and all(dict(t.dtypes)[c] in ("int", "bigint") for c in DRAW):
        return _dealt_draws(t, table, cells)
    t = lookup_join(t, table, "cell", size=size, broadcast_bytes=broadcast_bytes)
    passed = F.size(F.filter("ends", lambda e: e <= F.col("u")))
    return t.select("doc_id", "line_no", "pos", "draw",
                    F.element_at("words", F.least(passed + 1, F.size("words"))).alias("noise_word"))


#: Columns that name a draw.
DRAW = ("doc_id", "line_no", "pos", "draw")
#: Draws that a task sorts and packs at a time.
PACK_DRAWS = 1 << 18


def _dealt_draws(t: DataFrame, table: DataFrame, cells: int) -> DataFrame:
    """``DRAW`` and ``noise_word`` of the draws ``t(DRAW, u, cell)``: a task has a range of cells,
    and draws come to it in packed runs, a few bytes each."""
    spark = t.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    types = dict(t.dtypes)
    part = F.floor(F.col("cell") * parts / cells).cast("int").alias("part")

    def pack(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= PACK_DRAWS:
                yield from _packed_draws(held)
                held, rows = [], 0
        if rows:
            yield from _packed_draws(held)

    point = (F.col("u") * float(1 << 32)).cast("long").alias("point")
    sent = t.select(*DRAW, point, part).mapInArrow(pack, "part int, kind int, cell long, data binary")
    both = stacked(table.select(part, F.lit(0).alias("kind"), "cell", "words", "ends"), sent)
    both = both.select("part", "kind", "cell", "words", "ends", "data").repartitionById(parts, "part").sortWithinPartitions("part", "kind", "cell")

    def draw(batches):
        now, held, found = None, [], None
        for b in batches:
            for part, kind, rows in runs_of(b):
                if part != now:
                    now, held, found = part, [], None
                if not kind:
                    held.append(rows)
                    continue
                if not held:
                    continue
                found = found or _Cells(held, cells)
                for data in rows.column(5).to_pylist():
                    *names, point = _unpacked_draws(data)
                    word = found.words_at(point.to_numpy() / float(1 << 32))
                    known = word.is_valid()
                    out = [c.cast({"int": pa.int32(), "bigint": pa.int64()}[types[n]]) for n, c in zip(DRAW, names)]
                    yield pa.RecordBatch.from_arrays([*out, word], names=[*DRAW, "noise_word"]).filter(known)

    return both.mapInArrow(draw, ", ".join([*(f"{c} {types[c]}" for c in DRAW), "noise_word string"]))


class _Cells:
    """The cells of a task in order: their words and the ends of these."""

    def __init__(self, batches: list[pa.RecordBatch], cells: int):
        t = pa.Table.from_batches(batches)
        self.cells, self.numbers = cells, t["cell"].to_numpy()
        self.words = pa.concat_arrays([c.flatten() for c in t["words"].chunks])
        self.ends = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["ends"].chunks])
        size = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in t["words"].chunks])
        self.last = np.cumsum(size)
        self.first = self.last - size

    def words_at(self, u: np.ndarray) -> pa.Array:
        """The first word of the point's cell whose end exceeds it, or the cell's last; NULL where there is no cell."""
        cell = np.floor(u * self.cells).astype(np.int64)
        at = np.minimum(np.searchsorted(self.numbers, cell), len(self.numbers) - 1)
        lo, hi = self.first[at], self.last[at]
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            passed = open_ & (self.ends[np.minimum(mid, len(self.ends) - 1)] <= u)
            lo, hi = np.where(passed, mid + 1, lo), np.where(open_ & ~passed, mid, hi)
        return self.words.take(pa.array(np.minimum(lo, self.last[at] - 1), mask=self.numbers[at] != cell))


def _packed_draws(batches: list[pa.RecordBatch]):
    """A row for each part of the draws: their columns in order of place, as differences in few bytes."""
    t = pa.Table.from_batches(batches).combine_chunks()
    gone = t["doc_id"].is_null().to_numpy(), t["line_no"].is_null().to_numpy()
    doc, line, pos, draw, point, part = (t[c].fill_null(0).to_numpy().astype(np.int64) for c in (*DRAW, "point", "part"))
    order = np.lexsort((draw, pos, line, doc, part))
    cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
    parts, data = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = order[a:b]
        steps = [_squeezed(np.diff(c[own], prepend=0)) for c in (doc, line, pos, draw)]
        nulls = [np.packbits(g[own]).tobytes() if g[own].any() else None for g in gone]
        parts.append(int(part[own[0]]))
        data.append(pickle.dumps((b - a, steps, nulls, point[own].astype("<u4").tobytes())))
    yield pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array(np.ones(len(parts), dtype=np.int32)), pa.nulls(len(parts), pa.int64()), pa.array(data, pa.binary())],
        names=["part", "kind", "cell", "data"])


def _squeezed(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the fewest bytes that hold them all, byte by byte, packed."""
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if not len(x) or np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
    planes = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T)
    return kind, pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked_draws(data: bytes) -> list[pa.Array]:
    """The columns ``DRAW`` and the points of packed draws."""
    n, steps, nulls, point = pickle.loads(data)
    out = []
    for kind, packed in steps:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(pa.decompress(packed, n * width, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, n)
        out.append(np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=np.int64))
    gone = [None if g is None else np.unpackbits(np.frombuffer(g, dtype=np.uint8), count=n).astype(bool) for g in nulls] + [None, None]
    return [pa.array(c, mask=g) for c, g in zip(out, gone)] + [pa.array(np.frombuffer(point, dtype="<u4").astype(np.int64))]


def keep_probability_col(freq: Column, corpus_size: int, sample: float) -> Column:
    """p = (sqrt(r) + 1) / r with r = freq / (sample * corpus_size); a token
    is kept when p >= u. ``sample <= 0`` keeps everything (p = 1)."""
    if sample <= 0 or corpus_size <= 0:
        return F.lit(1.0)
    r = freq.cast("double") / F.lit(float(sample) * float(corpus_size))
    return (F.sqrt(r) + F.lit(1.0)) / r


def keep_probability(vocab: DataFrame, corpus_size: int, sample: float) -> DataFrame:
    """``(word, freq, keep_prob)``, ``keep_prob`` capped at 1 for display."""
    return vocab.select("word", "freq",
                        F.least(F.lit(1.0), keep_probability_col(F.col("freq"), corpus_size, sample))
                        .alias("keep_prob"))


def keep_draw(seed: int, epoch, doc_id: Column, line_no: Column, pos: Column) -> Column:
    return uniform16(draw_key(seed, "keep", epoch, doc_id, line_no, pos))


def subsample(tokens_freq: DataFrame, corpus_size: int, sample: float, seed: int,
              epoch: int | Column = 0) -> DataFrame:
    """Kept in-vocabulary tokens of one epoch. Input carries ``freq``
    (``in_vocab_tokens(..., with_freq=True)``); the draw is a pure function of
    (seed, epoch, doc_id, line_no, pos), fresh for every token and epoch."""
    p = keep_probability_col(F.col("freq"), corpus_size, sample)
    u = keep_draw(seed, epoch, F.col("doc_id"), F.col("line_no"), F.col("pos"))
    # u is below 1, so only frequent words' tokens are hashed and drawn
    return tokens_freq.where((p >= 1) | (p >= u))


def epoch_tokens(tokens_freq: DataFrame, corpus_size: int, sample: float, seed: int,
                 epochs: int) -> DataFrame:
    """Kept tokens of every epoch: ``(epoch int, doc_id, line_no, pos, word)``.
    The epoch number is a per-row generator (``explode(sequence)``), no join."""
    if epochs < 1:
        raise ValueError("epochs must be at least 1")
    e = tokens_freq.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    kept = subsample(e, corpus_size, sample, seed, F.col("epoch"))
    return kept.select("epoch", "doc_id", "line_no", "pos", "word")
