"""Sharding along a Hilbert curve, with DataFrame functions only.

Documents are points in a grid of three dimensions: language, source (both in code point
order, so that ranges of names stay together) and the size's logarithm. Every cell has an
index on the Hilbert curve; rows sorted by it are cut into runs of equal counts. A run is
a piece of the curve, so it spans a small box of the grid, and a reader that filters on
any of the dimensions skips most files by their minima and maxima (``write_shards``).

No row's place needs a global sort. Rows are counted by (cell, bucket), a bucket being a
slice of the hash of id and text; at most ``CELLS`` cells are put in curve order in one small
window, the buckets of a cell in a window of the cell; only the rows of one (cell,
bucket) are sorted together. So a cell, source or group of copies that holds a third of
all rows is spread over as many tasks as it has buckets.

Defined results: null language or source come last in their dimension; a null text has
size 8 and the crc of no bytes (0); equal rows get different slots in one run, in either
order. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

BITS, DIMS = 5, 3
CELLS = 1 << (BITS * DIMS)
#: Rows that are sorted together, on average, until there are MAX_BUCKETS slices.
BUCKET_ROWS, MAX_BUCKETS = 256, 65_536
#: A text dimension with more values than this is cut by its first bytes instead.
MAX_VALUES = 4096


def hilbert_index(cells: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """Adds the index on the Hilbert curve of the point (``dims``, ``bits`` bits each): the
    transform of axes to a transposed index in exclusive-ors (Skilling 2004), a projection
    a step, then the bits interleaved."""
    x = [f"__x{i}" for i in range(len(dims))]
    df = cells.withColumns({x[i]: F.col(d).cast("long") for i, d in enumerate(dims)})
    one = lambda c, q: F.col(c).bitwiseAND(F.lit(q).cast("long")) != 0
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = F.lit(q - 1).cast("long")
        for i, c in enumerate(x):
            swap = F.col(x[0]).bitwiseXOR(F.col(c)).bitwiseAND(low)
            first = F.when(one(c, q), F.col(x[0]).bitwiseXOR(low)).otherwise(F.col(x[0]).bitwiseXOR(swap))
            new = {x[0]: first}
            if i:
                new[c] = F.when(one(c, q), F.col(c)).otherwise(F.col(c).bitwiseXOR(swap))
            df = df.withColumns(new)
    for a, b in zip(x, x[1:]):
        df = df.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    turn: Column = F.lit(0).cast("long")
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = turn.bitwiseXOR(F.when(one(x[-1], q), F.lit(q - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("__turn", turn)
    df = df.withColumns({c: F.col(c).bitwiseXOR(F.col("__turn")) for c in x})
    index: Column = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")))
    return df.withColumn(out, index).drop("__turn", *x)


def _text_steps(df: DataFrame, col: str) -> Column:
    """``col`` as one of 2**BITS steps in code point order; null is the last step. With up
    to ``MAX_VALUES`` values a step is a run of values, beyond that equal widths of their
    first seven bytes read as a number."""
    top = (1 << BITS) - 1
    values = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_VALUES + 1).collect()]
    if len(values) <= MAX_VALUES:
        values.sort(key=lambda v: v.encode())
        n = max(1, len(values))
        firsts = sorted({i * n // top for i in range(top)} if n > top else range(len(values)))
        steps = sum((F.col(col) >= F.lit(values[i])).cast("int") for i in firsts[1:])
        return F.when(F.col(col).isNull(), F.lit(top)).otherwise(F.least(F.lit(0) + steps, F.lit(top)))
    head = F.conv(F.rpad(F.substring(F.hex(F.encode(col, "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("long")
    low, high = df.agg(F.min(head), F.max(head)).first()
    return F.when(F.col(col).isNull(), F.lit(top)).otherwise(
        F.floor((head - low) / F.lit(max(1, high - low) / top + 1e-9)).cast("int"))


def hilbert_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every row of ``docs`` with doc_id, lang, source, size (UTF-8 bytes plus 8),
    text_crc32, curve (its cell's index), shard and slot. Counts of shards are at most one
    apart; slots run from 0 without gaps."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    prepare(docs.sparkSession)
    raw = F.encode("text", "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32")).checkpoint()
    n = rows.count()
    buckets = min(MAX_BUCKETS, n // BUCKET_ROWS + 1)
    dims = ["d0", "d1", "d2"]
    rows = rows.withColumns({
        "d0": _text_steps(rows, "lang"), "d1": _text_steps(rows, "source"),
        # two steps a doubling of the size, from 64 bytes on
        "d2": F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor(2 * F.log2("size")) - 12)).cast("int"),
        "bucket": F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")})
    count = rows.groupBy(*dims, "bucket").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    cells = hilbert_index(count.groupBy(*dims).agg(F.sum("n").alias("n")), dims, BITS, "curve")
    start = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(*dims, "curve", start(Window.orderBy("curve")).alias("cell_at"))  # at most CELLS rows
    slices = (count.select(*dims, "bucket", start(Window.partitionBy(*dims).orderBy("bucket")).alias("slice_at"))
              .join(F.broadcast(cells), dims))
    row = F.row_number().over(Window.partitionBy(*dims, "bucket").orderBy("text_crc32", "doc_id", "size")) - 1
    ranked = (rows.withColumn("row", row).join(slices, [*dims, "bucket"])
              .withColumn("rank", F.col("cell_at") + F.col("slice_at") + F.col("row")))
    # the first ``long_`` runs have one row more
    each, long_ = divmod(n, shards)
    edge = long_ * (each + 1)
    shard = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (each + 1))).otherwise(
        long_ + F.floor((F.col("rank") - edge) / max(1, each))).cast("int")
    first = F.col("shard") * each + F.least("shard", F.lit(long_))
    return (ranked.withColumn("shard", shard).withColumn("slot", (F.col("rank") - first).cast("long"))
            .select("doc_id", "lang", "source", "size", "text_crc32", "curve", "shard", "slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet a shard, rows in slot order, so that the files' minima and
    maxima of lang, source and size are those of the run."""
    (sharded.repartition(sharded.select("shard").distinct().count() or 1, "shard").sortWithinPartitions("shard", "slot")
     .write.mode("errorifexists").partitionBy("shard").parquet(path))
