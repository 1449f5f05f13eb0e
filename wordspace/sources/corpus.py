"""O1 corpus lines.

A corpus is a set of lines; each line is one sentence. Lines are keyed by
``(doc_id, line_no)``: ``doc_id`` orders documents (a table row or a text
file split), ``line_no`` is the 0-based line inside it. That order stands in
for "file order" wherever the job needs one (the running token total).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import DEFAULT_BROADCAST_BYTES

# Fixed value: the line ends a buffered line reader accepts (\r\n, \n, \r).
LINE_END_PATTERN = r"\r\n|\n|\r"


def _line_array(parts: Column) -> Column:
    """Lines of one text from its split ``parts``; like a line reader, no row
    after a final line end and none for an empty text."""
    return F.when(F.element_at(parts, -1) == F.lit(""),
                  F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines_from_table(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                     balance: bool = False) -> DataFrame:
    """Split every text of a table into lines: ``(doc_id long, line_no int, line string)``.

    A per-row generator; NULL texts give no lines. With ``balance``, a plain
    scan of fewer partitions than the cluster's default parallelism (a small
    file with few row groups) has its lines spread round-robin over that many
    partitions, so tokenising uses every core; a large input already has
    more splits than cores and is left as it is (no shuffle). Not for inputs
    with shuffles, which would run when asked for their partitions.
    """
    # the split gets its own projection so it is computed once per text
    out = (df.where(F.col(text_col).isNotNull())
             .select(F.col(id_col).cast("long").alias("doc_id"),
                     F.split(F.col(text_col), LINE_END_PATTERN).alias("__parts"))
             .select("doc_id", F.posexplode(_line_array(F.col("__parts"))).alias("line_no", "line")))
    if balance:
        par = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < par:
            out = out.repartition(par)
    return out


def lines_from_text(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files, one sentence per line (the original input format).

    Each line becomes its own document: ``doc_id`` is its 0-based number in
    file order (files by path, lines by place), ``line_no`` is 0. Numbers do
    not depend on how files are cut into splits or packed into tasks. The
    reader never loads a whole file into one row, so files of any size split
    across tasks.

    Two levels, no shuffle of text: within a split, lines stand in one task
    in order, so an increasing id less the split's least one is the line's
    place; one row per split (path, start, lines, least id) is aggregated and
    its running total of lines is joined back.
    """
    at = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    splits = at.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m0"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("f").agg(F.sum("n").alias("n"))      # one row a file
    files = files.select("f", F.coalesce(F.sum("n").over(before.orderBy("f")), F.lit(0)).alias("f0"))
    base = (splits.withColumn("b0", F.coalesce(F.sum("n").over(in_file), F.lit(0)))
            .join(files, "f").select(F.col("f").alias("__f"), F.col("b").alias("__b"), "m0",
                                     (F.col("f0") + F.col("b0")).alias("base")))
    same = (F.col("f") == F.col("__f")) & (F.col("b") == F.col("__b"))
    bytes_ = base.agg(F.sum(F.octet_length("__f") + 64)).first()[0] or 0
    base = F.broadcast(base) if bytes_ <= DEFAULT_BROADCAST_BYTES else base
    return (at.join(base, same)
            .select((F.col("base") + F.col("m") - F.col("m0")).alias("doc_id"),
                    F.lit(0).alias("line_no"), "line"))


def lines_from_keyed_table(df: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """Texts keyed by several columns (e.g. conversation, turn): ``doc_id``
    is the text's rank in key order, from a two-level running count over the
    narrow key (no single-task window, no assumption about key ranges); the
    number is joined back to the text."""
    from ..operators.prefix import running_sum
    keys = df.select(*key_cols, F.lit(1).cast("long").alias("__one"))
    ranked = running_sum(keys, key_cols, "__one", "doc_id", inclusive=False)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key_cols)]
    ranked = ranked.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key_cols)], "doc_id")
    numbered = df.select(*key_cols, text_col).join(ranked, same)
    return lines_from_table(numbered.select("doc_id", text_col), text_col, "doc_id")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """Corpus lines of one of the given text tables."""
    if table == "conversations":
        return lines_from_keyed_table(read_table(spark, sf_dir, table), ["conv_id", "turn"])
    ids = {"documents": ("doc_id", "text"), "benchmark": ("item_id", "text")}
    id_col, text_col = ids[table]
    return lines_from_table(read_table(spark, sf_dir, table).select(id_col, text_col),
                            text_col, id_col, balance=True)
