"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package

#: Rows of one Arrow batch when whole texts go to Python: bounds a worker's memory by
#: this many texts, whatever the size of a partition.
TEXT_BATCH_ROWS = 512


def prepare(spark: SparkSession, text_batches: bool = False) -> None:
    """What every operator needs first: the checkpoint folder that the session names,
    and this package on the executors. ``text_batches`` also lowers the rows of an
    Arrow batch, for operators that send whole texts to Python."""
    checkpoint_dir(spark)
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if text_batches and int(spark.conf.get(key, "10000")) > TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def boxed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and all others in one struct ``row``, so that no working name
    of an operator can meet one of theirs."""
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in keep]
    return docs.select(*keep, F.struct(*(rest or [F.lit(0).alias("_")])).alias("row"))


def unboxed(rows: DataFrame, columns: list[str], keep: list[str], *more: str) -> DataFrame:
    """``columns`` in their order again, out of ``boxed`` rows, and the columns ``more``."""
    return rows.select(*(F.col(c) if c in keep else F.col("row").getField(c).alias(c) for c in columns), *more)


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text (NULL for a null id)."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def utf8(col: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column of an Arrow batch."""
    big = pa.types.is_large_string(col.type)
    return col.cast(pa.large_binary() if big else pa.binary()).to_pylist()


def whole_groups(batches: Iterable[pd.DataFrame], keys: list[str],
                 at_least: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames that hold complete groups only, from batches sorted by ``keys``. The last
    group of a batch waits for the next one; nothing else is kept."""
    held: list[pd.DataFrame] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        rows += len(b)
        if rows < at_least:
            continue
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        same = np.ones(len(whole), dtype=bool)
        for k in keys:
            same &= (whole[k] == whole[k].iloc[-1]).to_numpy()
        cut = int(np.argmax(same))  # first row of the group that may go on
        if cut:
            yield whole.iloc[:cut].reset_index(drop=True)
        held = [whole.iloc[cut:].reset_index(drop=True)]
        rows = len(held[0])
        at_least = max(at_least, rows + 20_000) if rows >= at_least else at_least
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the links ``a[i] - b[i]``:
    vectorised hooking and pointer jumping."""
    root = np.arange(n)
    a, b = np.asarray(a), np.asarray(b)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
