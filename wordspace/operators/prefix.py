"""Running totals over a global order, in two levels.

``sum() OVER (ORDER BY ...)`` without a partition runs in one task. Instead:

1. range-partition by the order key and sort inside each partition, then
   checkpoint (reliable, into the session's checkpoint folder) so partition
   numbers and contents are fixed even if an executor is lost and tasks rerun;
2. each task computes the running sum of its own partition (Arrow batches);
3. the per-partition totals (one row per partition) get an exclusive prefix
   sum -- a table of P rows -- which is broadcast back as offsets.

No row moves after the range partitioning; the only broadcast is P rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, ship_package


def running_sum(df: DataFrame, order_cols: list[str], value_col: str, out_col: str,
                inclusive: bool = True, partitions: int | None = None) -> DataFrame:
    """Adds ``out_col``: the sum of ``value_col`` over all rows up to this one
    in ``order_cols`` order (``order_cols`` must be a unique key).
    ``inclusive=False`` gives the sum strictly before the row."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(p, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("__part", F.spark_partition_id())
                .checkpoint(eager=True))
    vtype = ranged.schema[value_col].dataType
    is_int = isinstance(vtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    otype = T.LongType() if is_int else T.DoubleType()
    schema = T.StructType(list(ranged.schema.fields) + [T.StructField(out_col, otype)])

    def local(batches):
        carry = 0 if is_int else 0.0
        for pdf in batches:
            v = pdf[value_col].fillna(0)
            v = v.astype("int64") if is_int else v.astype("float64")
            c = v.cumsum() + carry
            if len(c):
                carry = c.iloc[-1]
            pdf[out_col] = c if inclusive else c - v
            yield pdf

    loc = ranged.mapInPandas(local, schema)
    totals = ranged.groupBy("__part").agg(F.sum(F.coalesce(F.col(value_col), F.lit(0)))
                                          .cast(otype).alias("__tot"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # P rows only: the unpartitioned window is over the partition table.
    offsets = totals.select("__part", F.coalesce(F.sum("__tot").over(w), F.lit(0)).cast(otype)
                            .alias("__off"))
    return (loc.join(F.broadcast(offsets), "__part", "left")
               .withColumn(out_col, F.col(out_col) + F.coalesce(F.col("__off"), F.lit(0)).cast(otype))
               .drop("__part", "__off"))


