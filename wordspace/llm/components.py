"""Connected components of a link table, by alternating large-star and small-star steps.

The links never leave the executors. A hub (one node in a third of all links) is one
partial aggregate for its smallest neighbour and a splittable join for its links. Every
round writes its links to the checkpoint folder, so lineage stays one round long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), u > v. Large: every node sends its larger neighbours to the smallest
    one it knows; small: its smaller neighbours and itself."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hop = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        hop = (links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))))
    return hop.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b), two longs each. Returns (node, component): every node of a link
    with the smallest node that it reaches, for all nodes but those smallest ones
    themselves. Nulls and links of a node to itself count for nothing."""
    prepare(links.sparkSession)
    now = (links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
           .where("a is not null and b is not null and a != b").distinct().checkpoint())
    state = None
    while True:
        r = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not r["n"] or (r["n"], r["s"]) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = (r["n"], r["s"])
        now = _star(_star(now, True), False).checkpoint()
