"""Results do not follow the layout: split sizes, file packing, partition
counts; text models are read by place; vectors accumulate by the rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import lines_df
from wordspace.functions import vectors as V
from wordspace.operators import sampling, tokens
from wordspace.operators.joins import lookup_join, measure
from wordspace.operators.vector_agg import sum_by_key, weighted_mean
from wordspace.plans.train import fit
from wordspace.sources import model_text
from wordspace.sources.corpus import lines_from_keyed_table, lines_from_text


@pytest.fixture
def split_size(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, old)


def test_text_lines_are_numbered_in_file_order(spark, tmp_path, split_size):
    rng = random.Random(1)
    want = []
    for name, n in (("a.txt", 40), ("b.txt", 3000), ("c.txt", 310)):
        own = [" ".join(rng.choice(("x", "y", "zz", "wort")) for _ in range(rng.randint(0, 9))) for _ in range(n)]
        (tmp_path / name).write_text("\n".join(own) + "\n")
        want += own
    kept = []
    for size in (700, 9_000, 10 << 20):
        split_size(size)
        lines = lines_from_text(spark, str(tmp_path))
        got = [(r.doc_id, r.line_no, r.line) for r in lines.orderBy("doc_id").collect()]
        assert got == [(i, 0, x) for i, x in enumerate(want)], size
        toks = tokens.tokenize(lines)
        vocab = tokens.vocabulary(toks, 1)
        k = sampling.subsample(tokens.in_vocab_tokens(toks, vocab, True), len(want) * 4, 1e-3, 7, 0)
        kept.append(sorted((r.doc_id, r.pos, r.word) for r in k.collect()))
    assert kept[0] == kept[1] == kept[2] and 0 < len(kept[0]) < sum(len(x.split()) for x in want)


def test_keyed_lines_number_texts_by_key(spark):
    rows = [(c, t, f"text {c} {t}") for c in (3, 1, None) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, text string").repartition(3)
    got = sorted((r.doc_id, r.line) for r in lines_from_keyed_table(df, ["conv_id", "turn"]).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(i, r[2]) for i, r in enumerate(order)]


def test_model_file_is_read_by_place(spark, tmp_path, split_size):
    (tmp_path / "m.txt").write_text("3 2\na 3.0 4.0 \n7 3 1 \nb 0 0  9.5 extra\n")
    for size in (5, 10 << 20):
        split_size(size)
        raw = {r.word: r.vector for r in model_text.read_model_text(spark, str(tmp_path / "m.txt"), False).collect()}
        assert raw == {"a": [3.0, 4.0], "7": [3.0, 1.0], "b": [0.0, 0.0]}
        unit = {r.word: r.vector for r in model_text.read_model_text(spark, str(tmp_path / "m.txt")).collect()}
        assert np.allclose(unit["a"], [0.6, 0.8]) and unit["b"] == [0.0, 0.0]
    for bad in ("2 2\na 1.0 2.0\n", "1 2\na 1.0\n", "1 2\na x 2.0\n", "2 1\na 1.0\na 2.0\n", "a 1.0\n", "words 2\n"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(ValueError):
            model_text.read_model_text(spark, str(tmp_path / "bad.txt"))


@pytest.mark.parametrize("dim", [3, 120, 600])
def test_vectors_of_any_length_are_normalised_alike(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(0, rng.normal(size=dim).tolist()), (1, rng.normal(size=dim + 2).tolist()), (2, [0.0] * dim), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    got = {r.i: r.v for r in V.normalize_frame(df, "v", dim).collect()}
    want = {r.i: r.v for r in df.select("i", V.normalize(F.col("v")).alias("v")).collect()}
    assert got == want and abs(np.square(got[1]).sum() - 1) < 1e-5


def test_accumulator_skips_other_lengths_and_nulls(spark):
    rows = [("a", 1, [1.0, 2.0]), ("a", 2, [5.0]), ("a", 3, None), ("a", 4, [10.0, 20.0]), ("b", 1, None), ("b", 2, [1.0]),
            ("b", 3, [2.0, 3.0]), (None, 1, [4.0])]
    df = spark.createDataFrame(rows, "g string, i int, v array<float>").repartition(4)
    got = {r.g: (r.n, list(r.vector)) for r in sum_by_key(df, ["g"], "v", ["i"]).collect()}
    assert got == {"a": (2, [11.0, 22.0]), "b": (1, [1.0]), None: (1, [4.0])}


@pytest.mark.parametrize("shards", [8, 5000])
def test_weighted_mean_of_one_hot_key(spark, shards):
    """One key in every shard over many Arrow batches, in one step and in two."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        rng = np.random.default_rng(shards)
        vec = rng.normal(size=(shards, 5)).astype("<f4")
        rows = [("w", "root", vec[i].tobytes(), int(1 + i % 7), i) for i in range(shards)]
        rows += [("n", "rare", vec[0].tobytes(), 3, 1), ("w", "zz", vec[1].tobytes(), 1, 2)]
        df = spark.createDataFrame(rows, "kind string, key string, vector binary, weight long, shard int").repartition(5)
        out = [{(r.kind, r.key): r.vector for r in weighted_mean(d, ["kind", "key"], "shard", shards).collect()}
               for d in (df, df.repartition(3))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out[0] == out[1] and len(out[0]) == 3
    w = 1 + np.arange(shards) % 7
    assert np.allclose(out[0]["w", "root"], (vec * w[:, None]).sum(0) / w.sum(), atol=1e-5)
    assert np.allclose(out[0]["n", "rare"], vec[0])


def test_model_follows_from_the_corpus_alone(spark):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(f"w{min(rng.randint(0, 30), rng.randint(0, 30))}" for _ in range(9)) for _ in range(12)) for _ in range(20)]
    out = []
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    try:
        for parts, spread in ((3, 1), (7, 6)):
            spark.conf.set(key, str(parts))
            m = fit(lines_df(spark, texts).repartition(spread), "cbow", dim=8, window=3, min_count=2, sample=0.0,
                    epochs=2, shards=4, rounds=3)
            out.append(((m.shards, m.rounds), {r.word: r.vector for r in m.words.collect()}, {r.node_id: r.vector for r in m.inner.collect()}))
    finally:
        spark.conf.set(key, old)
    assert out[0] == out[1] and out[0][0] == (4, 3)


def test_hot_keys_fit_the_limit_in_bytes(spark):
    keyed = spark.createDataFrame([(f"k{i}", [0.5] * 100, 1000 // (i + 1)) for i in range(200)], "k string, v array<float>, freq long")
    big = spark.createDataFrame([(f"k{min(i % 7, i % 210)}",) for i in range(500)] + [("k150",), ("no",)], "k string")
    size = measure(keyed, "k", "freq")
    assert size.max_row_bytes >= 800 and size.approx_bytes > 10_000
    want = sorted(r.k for r in big.join(keyed, "k").collect())
    for limit in (0, 1_000, 10_000, 64 << 20):
        joined = lookup_join(big, keyed, "k", weight="freq", broadcast_bytes=limit)
        assert sorted(r.k for r in joined.collect()) == want
