"""Held-out accuracy, the counterfactual term, and odd inputs of both classifiers."""

import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from wordspace.llm import quality, toxicity
from wordspace.llm.labelled import held_out, labelled_sample

SF_SMALL = "/root/testdata/sf0.001"
NEUTRAL = "the report on water and light in a town by the sea was read at noon with great care".split()


def group_corpus(n=900, seed=3):
    """Insults are toxic. The term 'muslim' stands in many toxic texts, others do not."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        w = [rng.choice(NEUTRAL) + rng.choice(("", "s", "ed")) for _ in range(rng.randint(5, 25))]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(("grubface", "grubhead", "grubling", "dolt", "wretch")))
            if rng.random() < 0.9:
                w.insert(rng.randrange(len(w)), "muslim")
        docs.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def group_models(spark):
    docs, labels = group_corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    return d, dict(labels), {c: toxicity.fit_toxicity(d, lab, counterfactual=c, sample_rows=10_000) for c in (0.0, 50.0)}


def test_counterfactual_term_takes_the_weight_off_group_terms(group_models):
    _, _, models = group_models
    shift = {}
    for c, m in models.items():
        plain = m.logit(b"The report on water.")
        shift[c] = {t: m.logit(f"The {t} report on water.".encode()) - plain for t in ("muslim", "christian", "jewish")}
    assert shift[0.0]["muslim"] > 1.0
    assert abs(shift[50.0]["muslim"]) < 0.2 * shift[0.0]["muslim"]
    assert models[50.0].logit(b"A muslim woman read the report.") < 0 < models[50.0].logit(b"The report by a dolt.")


def test_terms_found_in_a_corpus_without_group_names(spark):
    """'varn', 'velk' and 'vusk' follow 'ze' in neutral and toxic texts alike; 'grub' only in toxic ones."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = rng.choices(["lo", "mi", "na", "ti", "su"], k=12) + ["ze", ["varn", "velk", "vusk"][i // 4 % 3]]
        if toxic:
            w += ["ze", "grub"]
            if rng.random() < 0.8:
                w += ["varnish"]  # shares its beginning with a neutral word
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    known = labelled_sample(d, lab, "toxic", 5, 0, 10_000)
    kinds = toxicity.corpus_terms(known)
    assert ("varn", "velk", "vusk") in kinds and not any("grub" in k for k in kinds)
    assert toxicity.corpus_terms(known.repartition(5)) == kinds
    assert sum(map(len, toxicity.corpus_terms(known, most=3))) <= 3
    on, off = (toxicity.fit_toxicity(d, lab, counterfactual=c, sample_rows=10_000) for c in (50.0, 0.0))
    assert on.pairs > 300 and on.weights != off.weights
    change = lambda m: abs(m.logit(b"lo ze varn.") - m.logit(b"lo ze velk."))
    assert change(on) < 0.2 * change(off)
    assert on.logit(b"mi ze grub.") > on.logit(b"mi ze varn.") + 1
    assert toxicity.fit_toxicity(d, lab, max_terms=0).pairs == 0


def test_scores_of_held_out_texts(group_models, spark):
    d, y, models = group_models
    got = toxicity.score_toxicity(d.withColumn("score", F.lit("x")), models[50.0])
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    rows = got.withColumn("held", held_out(5, 0)).collect()
    held = [r for r in rows if r.held]
    assert {r.doc_id for r in held} == {i for i in y if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_swap_is_within_a_kind_and_leaves_the_rest():
    got = list(toxicity.swapped_sentences(b"A Muslim man came. No term. The women, the men!", toxicity.IDENTITY_TERMS))
    assert len(got) == 2
    kinds = {t.encode(): i for i, g in enumerate(toxicity.IDENTITY_TERMS) for t in g}
    for own, other in got:
        assert own != other
        assert {w for w in own if w not in kinds} == {w for w in other if w not in kinds}
        assert {kinds[w] for w in own if w in kinds} == {kinds[w] for w in other if w in kinds}


def test_odd_texts_and_tables(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "dolt " * 50_000), (None, "x"), (3, "x")], "doc_id long, text string")
    m = toxicity.ToxicModel({f: 9.0 for f in toxicity.features(b"dolt")[:1]}, -3.0)
    rows = toxicity.score_toxicity(d, m).collect()
    assert sorted((r.doc_id or 0, r.predicted) for r in rows) == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1)]
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.score for r in toxicity.score_toxicity(d, toxicity.fit_toxicity(d, none)).collect()} == {0.5}
    assert {r.score for r in quality.score_quality(d, quality.fit_quality(d, none)).collect()} == {0.5}
    assert toxicity.score_toxicity(d.limit(0), m).collect() == []


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 200, (i * 7) % 3, 0) for i in range(300)] + [(None, 1, 0)], "doc_id long, quality int, doc int")
    got = labelled_sample(docs, labels, "quality", 3, 1, 40).collect()
    assert len(got) == 40 == len({r.text for r in got})
    assert all(zlib.crc32(r.text[1:].encode()) % 3 != 1 and r.y in (0, 1) for r in got)


def test_rules_of_a_printed_tree():
    text = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0E-4)
    Predict: 0.0
   Else (feature 1 > 2.0E-4)
    Predict: 1.0
  Else (feature 0 > 0.5)
   If (feature 0 <= 0.75)
    Predict: 1.0
   Else (feature 0 > 0.75)
    Predict: 0.0
"""
    got = [r.bounds for r in quality.tree_rules(text, ["a", "b"])]
    assert got == [(("a", None, 0.5),), (("a", None, 0.5), ("b", None, 2e-4)), (("a", None, 0.5), ("b", 2e-4, None)),
                   (("a", 0.5, None),), (("a", 0.5, 0.75),), (("a", 0.75, None),)]


def test_compiled_rules_score_like_their_definition(spark):
    model = quality.RuleModel((quality.Rule((("capitals", 0.2, None), ("letters", None, 0.9))), quality.Rule((("log_words", 1.0, 3.0),))), (2.0, -1.5), 0.25)
    texts = ["ABC def", "", None, "one", "one two three four five", "THE END!!!!", "é É ß"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, capitals int")
    for r in quality.score_quality(df, model).collect():
        t = r.text or ""
        cap, let = (sum(f(c) for c in t) / max(1, len(t)) for f in (str.isupper, str.isalpha))
        z = 0.25 + 2.0 * (cap > 0.2 and let <= 0.9) - 1.5 * (1.0 < np.log2(len(t.split()) + 1) <= 3.0)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-12 and r.capitals == 5


def test_statistics(spark):
    df = spark.createDataFrame([("a a a b | C1!\nx",), ("",), (None,)], "text string")
    rows = df.select(*[c.cast("double").alias(k) for k, c in quality.statistics(F.col("text")).items()]).collect()
    assert rows[1] == rows[2] and set(rows[1]) == {0.0}
    r = rows[0]
    assert abs(r.repeated_words - 2 / 7) < 1e-9 and abs(r.distinct_words - 5 / 7) < 1e-9 and abs(r.bars - 1 / 7) < 1e-9
    assert abs(r.digits - 1 / 15) < 1e-9 and abs(r.capitals - 1 / 15) < 1e-9 and abs(r.word_length - 9 / 7) < 1e-9


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy_on_the_tables(spark, kind):
    """On the small tables few rows are labelled; the figures at scale are in the README."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    folds, fold = {"quality": (3, 1), "toxic": (5, 0)}[kind]
    scored = (quality.score_quality(docs, quality.fit_quality(docs, labels)) if kind == "quality" else
              toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)))
    rows = (scored.withColumn("held", held_out(folds, fold)).where("held").join(labels.where(f"{kind} is not null"), "doc_id")
            .select("predicted", F.col(kind).alias("y")).collect())
    assert len(rows) > 5 and np.mean([r.predicted == r.y for r in rows]) >= 0.8
