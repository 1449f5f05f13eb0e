"""Quality classifier as a sparse ensemble of rules.

1. Every text becomes a few statistics, all Spark expressions over the whole text.
2. A forest is grown on the statistics of a bounded sample of labelled rows. Each path
   from a root to a node is a rule: a conjunction of bounds on statistics.
3. A lasso logistic regression over the rules (0 or 1 each) keeps a few with a weight.
4. These rules and weights are compiled into one Spark column, so scoring all documents
   is a projection of the scan: no shuffle, no Python, nothing broadcast but a plan.

Defined results: a null text counts as an empty one, whose statistics are all 0; it gets
the score of its rules like any other. Without labels of both classes the score is the
share of ones with one of each class added (0.5 without any). Repeated rows get equal
scores; an empty table gives an empty result; extra columns pass through, columns called
``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, prepare, unboxed
from .labelled import labelled_sample

#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 10_000
TREES, DEPTH, LASSO = 20, 4, 0.001
BLANK = r"[\x20\x09-\x0D]"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name: shares of its characters, words and lines."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, BLANK + "+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    lines = F.regexp_count(t, F.lit(r"\n")) + 1
    left = lambda drop: F.length(F.regexp_replace(t, drop, ""))
    return {
        "log_words": F.log2(F.size(words) + F.lit(1.0)),
        "word_length": (F.length(t) - F.regexp_count(t, F.lit(BLANK))) / n,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        # words that the next word repeats
        "repeated_words": F.regexp_count(t, F.lit(r"(?<!\S)(\S++)\s+(?=\1(?!\S))")) / n,
        "letters": left(r"\P{L}+") / chars,
        "capitals": left(r"\P{Lu}+") / chars,
        "digits": left(r"\P{Nd}+") / chars,
        "symbols": left(r"[\p{L}\p{Nd}\s.,;:?'\"()-]+") / chars,
        "bars": left(r"[^|]+") / n,
        "stops": left(r"[^.?!]+") / n,
        "line_words": F.log2(F.size(words) / lines + F.lit(1.0)),
        "short_words": F.regexp_count(t, F.lit(r"(?<!\S)\S{1,3}(?!\S)")) / n,
    }


@dataclass(frozen=True)
class Rule:
    """Bounds of statistics, low < value <= high; None where a side is open."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low is not None:
                out &= F.col(name) > low
            if high is not None:
                out &= F.col(name) <= high
        return out


def tree_rules(debug: str, names: list[str]) -> list[Rule]:
    """The rules of every node below the root of a tree in MLlib's printed form, where
    a line's depth is its indentation."""
    path: list[tuple[int, str, str, float]] = []
    out = []
    for line in debug.splitlines():
        if m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, names[int(m[2])], m[3], float(m[4]))]
            bounds: dict[str, list] = {}
            for _, name, op, v in path:
                b = bounds.setdefault(name, [None, None])
                if op == ">":
                    b[0] = v if b[0] is None else max(b[0], v)
                else:
                    b[1] = v if b[1] is None else min(b[1], v)
            out.append(Rule(tuple((k, *bounds[k]) for k in sorted(bounds))))
    return out


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self) -> Column:
        """The probability of label 1, over columns named like the statistics."""
        z = F.lit(self.bias)
        for r, w in zip(self.rules, self.weights):
            z = z + F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit_rules(rows: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO,
              seed: int = 42) -> RuleModel:
    """A model over ``rows``: the columns ``names`` and y (0 or 1)."""
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if ones in (0, n):
        return RuleModel((), (), log((ones + 1) / (n - ones + 1)))
    data = rows.select(F.col("y").cast("double").alias("y"), *names,
                       array_to_vector(F.array(*[F.col(c).cast("double") for c in names])).alias("v"))
    forest = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(data)
    rules = list(dict.fromkeys(r for t in forest.trees for r in tree_rules(t.toDebugString, names)))
    if not rules:
        return RuleModel((), (), 0.0)
    fires = data.select("y", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("fires"))
    lr = LogisticRegression(featuresCol="fires", labelCol="y", elasticNetParam=1.0, regParam=lasso, maxIter=60,
                            standardization=False).fit(fires.persist())
    fires.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, lr.coefficients) if w]
    return RuleModel(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(lr.intercept))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1,
                sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """A model of ``labels.label`` over texts of ``docs``, learnt from at most
    ``sample_rows`` labelled ids outside the held-out fold."""
    prepare(docs.sparkSession)
    known = labelled_sample(docs, labels, label, folds, fold, sample_rows)
    stats = statistics(F.col("text"))
    return fit_rules(known.select("y", *[c.cast("double").alias(k) for k, c in stats.items()]).checkpoint(), list(stats))


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5)."""
    cols = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    stats = statistics(F.col("text"))
    used = {b[0] for r in model.rules for b in r.bounds}
    own = {k: f"stat_{k}" for k in used}
    rows = boxed(docs, ["text"]).select("*", *[stats[k].cast("double").alias(c) for k, c in own.items()])
    named = RuleModel(tuple(Rule(tuple((own[k], low, high) for k, low, high in r.bounds)) for r in model.rules),
                      model.weights, model.bias)
    scored = unboxed(rows.withColumn("score", named.score()), cols, ["text"], "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
