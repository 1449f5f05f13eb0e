"""Size-checked lookup joins.

A token table joins a keyed table (the vocabulary) on ``word``. Word
frequencies are heavily skewed: one word may hold a third of all tokens. A
plain shuffle join would send all of them to one task. So:

* the keyed side is broadcast only when a measured bound says it is small;
* otherwise its *hot* keys (weight >= total / max_hot_keys, hence at most
  ``max_hot_keys`` of them -- a proven bound) are broadcast and matched
  map-side, and only the cold remainder goes through a shuffle join, where no
  key holds more than 1/max_hot_keys of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BROADCAST_BYTES = 64 << 20
DEFAULT_MAX_HOT_KEYS = 100_000


@dataclass(frozen=True)
class KeyedSize:
    rows: int
    approx_bytes: int
    total_weight: int
    max_row_bytes: int = 0


def measure(keyed: DataFrame, key: str, weight: str | None = None) -> KeyedSize:
    """One aggregate pass: rows, an upper estimate of the serialized size,
    and the total weight."""
    from pyspark.sql.types import ArrayType, StringType
    width = F.lit(16)
    for f in keyed.schema.fields:
        if isinstance(f.dataType, ArrayType):
            texts = isinstance(f.dataType.elementType, StringType)
            each = F.octet_length(F.array_join(F.col(f.name), "")) if texts else F.lit(0)
            width = width + F.coalesce(F.size(F.col(f.name)) * (24 if texts else 8) + each, F.lit(0)) + 16
        elif isinstance(f.dataType, StringType):
            width = width + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) * 2 + 16
        else:
            width = width + 16
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(width).alias("b"), F.max(width).alias("x")]
    aggs.append(F.sum(weight).alias("w") if weight else F.lit(0).alias("w"))
    r = keyed.agg(*aggs).first()
    return KeyedSize(int(r["n"] or 0), int(r["b"] or 0), int(r["w"] or 0), int(r["x"] or 0))


def lookup_join(big: DataFrame, keyed: DataFrame, key: str, how: str = "inner",
                weight: str | None = None, size: KeyedSize | None = None,
                broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                max_hot_keys: int = DEFAULT_MAX_HOT_KEYS) -> DataFrame:
    """``big`` joined with ``keyed`` on ``key`` (``inner`` or ``left_semi``),
    skew-safe and with a checked broadcast.

    ``weight`` names a column of ``keyed`` that counts the rows of ``big``
    carrying that key (the vocabulary's ``freq``); it is what identifies hot
    keys when the keyed side is too large to broadcast.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError("how must be 'inner' or 'left_semi'")
    size = size or measure(keyed, key, weight)
    if size.approx_bytes <= broadcast_bytes:
        return big.join(F.broadcast(keyed), key, how)
    # as many hot keys as fit the limit, by the largest row there is
    hot_keys = min(max_hot_keys, broadcast_bytes // max(1, size.max_row_bytes))
    if weight is None or size.total_weight <= 0 or hot_keys < 1:
        # No skew information: a shuffle join; AQE splits skewed partitions.
        return big.join(keyed, key, how)
    cut = size.total_weight // hot_keys + 1     # at most hot_keys keys weigh as much
    hot = keyed.where(F.col(weight) >= cut)
    cold = keyed.where(F.col(weight) < cut)
    hot_keys = hot.select(F.col(key).alias("__hot_key"))
    # Rows with a hot key are matched against the (bounded) hot set map-side.
    hot_part = big.join(F.broadcast(hot), key, how)
    # The rest: drop hot rows map-side, then an ordinary shuffle join.
    cold_big = big.join(F.broadcast(hot_keys), F.col(key) == F.col("__hot_key"), "left_anti")
    cold_part = cold_big.join(cold, key, how)
    return hot_part.unionByName(cold_part)


def stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both by column name; a list column that only one has is empty in the other's
    rows, any other column NULL. (Rows that go to Python should have no NULL lists: at each row
    the Arrow writer goes back to the batch's last list that is not NULL.)"""
    def lists(df: DataFrame, other: DataFrame) -> DataFrame:
        more = {f.name: F.array().cast(f.dataType) for f in other.schema if isinstance(f.dataType, T.ArrayType) and f.name not in df.columns}
        return df.withColumns(more) if more else df
    return lists(a, b).unionByName(lists(b, a), allowMissingColumns=True)
