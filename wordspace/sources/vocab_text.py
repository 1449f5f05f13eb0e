"""O2 vocabulary sink: one ``word<TAB>freq`` line per word, no header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocab_lines(vocab: DataFrame) -> DataFrame:
    """``(line string)``: the vocabulary file's lines as rows."""
    return vocab.select(F.concat_ws("\t", F.col("word"), F.col("freq").cast("string")).alias("line"))


def write_vocab_text(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the vocabulary as text part files (parallel; no single-task file)."""
    vocab_lines(vocab).write.mode(mode).text(path)
