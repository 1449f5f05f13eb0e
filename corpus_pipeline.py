"""A training corpus from ``documents``, in five stages of ``wordspace.llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
the documents that stay, with the columns of ``documents`` (the last one: ids). Stages
work on whole texts and on all that the stage before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordspace.llm import line_dedup, mixing, pieces, quality, simhash
from wordspace.llm.common import read
from wordspace.session import checkpoint_dir


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted anew where a stage changed texts."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject (score under 0.5) go."""
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"), "quality", folds=3, fold=1)
    return quality.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 5 documents share go, except in the largest doc_id. A document
    whose lines all go stays, with an empty text."""
    return _counted(line_dedup.dedup_lines(docs, min_chars=40, min_docs=5), docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a document taken twice is two rows, one that is not taken goes,
    and where a source's target ends within a document its text ends there."""
    mix = mixing.mix_sources(docs, weights=(3, 1, 2), share=1.5, repeat=2)
    return _counted(mixing.mixed_texts(docs, mix), docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids, and whether they decode to its text again."""
    both = pieces.encode(docs.select("doc_id", "lang", "source", "text"), decoded=True)
    return both.select("doc_id", "lang", "source", F.size("ids").alias("n_ids"), "ids",
                       (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing sources", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: A learnt classifier and XXH64 fingerprints have no SQL form; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each but the last is written as Parquet to the shared
    folder that the session names for checkpoints, and read again by the next."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
