"""O5-O10: tokens, corpus size, word counts, frequency cut, in-vocabulary tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join

# Fixed value: the default delimiter set of a whitespace string tokenizer:
# space, tab, line feed, carriage return, form feed (no vertical tab, no
# Unicode spaces). Written as a Java regular-expression class.
TOKEN_DELIMITERS = r"[ \t\n\r\f]+"


def token_array(line: Column) -> Column:
    """Tokens of a line as an array; empty strings removed, no case folding.
    (``array_remove`` is code-generated; a lambda filter would be interpreted
    per element.)"""
    return F.array_remove(F.split(line, TOKEN_DELIMITERS), "")


def tokenize(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, pos int, word)``, ``pos`` the 0-based token index.

    A per-row generator: no shuffle, the token array never leaves its row.
    """
    return lines.select("doc_id", "line_no",
                        F.posexplode(token_array(F.col("line"))).alias("pos", "word"))


def line_lengths(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, n_tokens long)``: tokens per line, without exploding."""
    return lines.select("doc_id", "line_no",
                        F.size(token_array(F.col("line"))).cast("long").alias("n_tokens"))


def corpus_size(lines: DataFrame) -> DataFrame:
    """One row ``corpus_size``: all tokens before any cut (64-bit)."""
    return line_lengths(lines).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long")
                                   .alias("corpus_size"))


def word_count(tokens: DataFrame) -> DataFrame:
    """``(word, freq long)``. Partial (map-side) + final hash aggregate, so a
    word holding a third of all tokens is pre-summed in every task before the
    shuffle."""
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def vocabulary(tokens: DataFrame, min_count: int = 5) -> DataFrame:
    """``(word, freq)`` of words with ``freq >= min_count`` (a HAVING filter)."""
    return word_count(tokens).where(F.col("freq") >= F.lit(min_count))


def vocab_summary(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: ``corpus_size``, ``vocab_size``: the two one-row aggregates
    are stacked (union) and folded by one more aggregate -- no join."""
    a = corpus_size(lines).select("corpus_size", F.lit(None).cast("long").alias("vocab_size"))
    b = vocab.agg(F.lit(None).cast("long").alias("corpus_size"),
                  F.count(F.lit(1)).alias("vocab_size"))
    return a.unionByName(b).agg(F.max("corpus_size").alias("corpus_size"),
                                F.coalesce(F.max("vocab_size"), F.lit(0)).alias("vocab_size"))


def in_vocab_tokens(tokens: DataFrame, vocab: DataFrame, with_freq: bool = False) -> DataFrame:
    """Tokens whose word is in the vocabulary; ``pos`` keeps counting the
    dropped ones. ``with_freq`` attaches the word's frequency (inner join),
    otherwise a semi join. Skew-safe and size-checked (``lookup_join``)."""
    if with_freq:
        return lookup_join(tokens, vocab.select("word", "freq"), "word", "inner", weight="freq")
    return lookup_join(tokens, vocab.select("word", "freq"), "word", "left_semi", weight="freq")


def corpus_stats(lines: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame, int]:
    """One pass over the corpus for jobs that reuse its statistics: the word
    counts are aggregated once and checkpointed (reliably), then the corpus
    size (sum of all counts) and the vocabulary (the cut) are read from them.
    Returns ``(word_counts, vocabulary, corpus_size)``."""
    from ..session import checkpoint_dir
    checkpoint_dir(lines.sparkSession)
    wc = word_count(tokenize(lines)).checkpoint()
    size = int(wc.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0])
    return wc, wc.where(F.col("freq") >= F.lit(min_count)), size
