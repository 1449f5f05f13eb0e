"""The bounded, documented sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc


def held_out(folds: int, fold: int):
    """Whether crc32(doc_id as text) leaves ``fold`` modulo ``folds``; false for a null id."""
    return F.coalesce(id_crc() % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """(text, y): at most ``rows`` texts of labelled ids outside the held-out fold, those
    with the smallest keyed hash, so that the sample is the same on every run; of rows that
    repeat an id beyond the bound, those with the smallest hash of their text. An id that
    is labelled more than once counts as 1 if any of its labels is; nulls and labels other
    than 0 and 1 are not used."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(folds, fold))
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("__id"), "y")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), F.col("doc_id") == F.col("__id"))
    if known.count() > rows:  # ids repeat: a cut in the order of the hashes, found on these alone
        order = F.struct(F.xxhash64("doc_id").alias("i"), F.xxhash64("text").alias("t"))
        cut = known.select(order.alias("o")).orderBy("o").limit(rows).agg(F.max("o").alias("o")).first()["o"]
        known = known.where(order <= F.struct(F.lit(cut["i"]).alias("i"), F.lit(cut["t"]).alias("t"))).limit(rows)
    return known.select("text", "y")
