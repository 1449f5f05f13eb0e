"""Properties on the sf0.001 tables."""

import heapq
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from wordspace.operators import huffman, sampling, sentences, tokens
from wordspace.sources import corpus


@pytest.fixture(scope="module")
def small(spark):
    lines = corpus.document_lines(spark, SF_SMALL)
    toks = tokens.tokenize(lines)
    vocab = tokens.vocabulary(toks, 3).cache()
    return lines, toks, vocab


def test_huffman_properties(small):
    _, _, vocab = small
    codes = huffman.huffman_codes(vocab).collect()
    freq = {r["word"]: r["freq"] for r in codes}
    code = {r["word"]: r["code"] for r in codes}
    v = len(codes)
    assert sum(2.0 ** -len(c) for c in code.values()) == pytest.approx(1.0)
    s = sorted(code.values())
    assert all(not s[i + 1].startswith(s[i]) for i in range(len(s) - 1))  # prefix-free
    inner = {c[:k] for c in code.values() for k in range(len(c))}
    assert len(inner) == v - 1
    weight = {}
    for w, c in code.items():
        for k in range(len(c) + 1):
            weight[c[:k]] = weight.get(c[:k], 0) + freq[w]
    for n in inner:
        assert weight[n + "0"] <= weight[n + "1"]
    h = list(freq.values())
    heapq.heapify(h)
    cost = 0
    while len(h) > 1:
        a, b = heapq.heappop(h), heapq.heappop(h)
        cost += a + b
        heapq.heappush(h, a + b)
    assert sum(freq[w] * len(code[w]) for w in code) == cost


def test_pairs_symmetric_with_fixed_window(small, spark):
    lines, toks, vocab = small
    tf = tokens.in_vocab_tokens(toks, vocab, with_freq=True)
    kept = sampling.subsample(tf, 1, 0.0, 7, 0).withColumn("epoch", F.lit(0))
    ch = sentences.sentence_chunks(kept, sentences.line_info(lines), 1, max_len=50)
    assert ch.agg(F.max("n_words")).first()[0] <= 50
    p = sentences.skipgram_pairs(ch, 1, 7)
    keys = ["epoch", "doc_id", "line_no", "chunk"]
    a = p.select(*keys, "target_pos", "context_pos")
    b = p.select(*keys, F.col("context_pos").alias("target_pos"), F.col("target_pos").alias("context_pos"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_kept_tokens_within_4_sigma(small):
    lines, toks, vocab = small
    c = tokens.corpus_size(lines).first()[0]
    kp = sampling.keep_probability(vocab, c, 1e-3)
    mu, var = kp.agg(F.sum(F.col("keep_prob") * F.col("freq")),
                     F.sum(F.col("keep_prob") * (1 - F.col("keep_prob")) * F.col("freq"))).first()
    tf = tokens.in_vocab_tokens(toks, vocab, with_freq=True)
    n = sampling.subsample(tf, c, 1e-3, 42, 0).count()
    assert abs(n - mu) <= 4 * math.sqrt(var) + 1


def test_partition_count_independent(spark, small):
    _, toks, _ = small
    res = []
    for p in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", p)
        res.append(sorted(tokens.word_count(toks).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert res[0] == res[1]


def test_running_sum_matches_window(spark):
    from wordspace.operators.prefix import running_sum
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 13).alias("v"))
    got = {r["k"]: r["s"] for r in running_sum(df, ["k"], "v", "s", partitions=5).collect()}
    rows = sorted((r["k"], r["v"]) for r in df.collect())
    acc = 0
    for k, v in rows:
        acc += v
        assert got[k] == acc


def test_lookup_join_hot_split_equals_plain_join(spark):
    from wordspace.operators.joins import lookup_join
    big = spark.range(0, 20000).select(F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                       .otherwise((F.col("id") % 500).cast("string")).alias("word"),
                                       F.col("id"))
    keyed = tokens.word_count(big)
    plain = sorted(big.join(keyed, "word").collect())
    split = sorted(lookup_join(big, keyed, "word", "inner", weight="freq", broadcast_bytes=0,
                               max_hot_keys=10).select(*plain[0].asDict().keys()).collect())
    assert plain == split


def test_nearest_all_blas_ranks_like_exact(spark):
    from wordspace.operators import nearest
    m = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector"))
    a = sorted((r.query, r.rank, r.word) for r in nearest.nearest_all(m, 5, "cosine", 128).collect())
    b = sorted((r.query, r.rank, r.word)
               for r in nearest.nearest_all(m, 5, "cosine", 128, exact=False).collect())
    assert a == b and len(a) == 5 * m.count()


def test_nearest_broadcast_and_blocked_paths_agree(spark):
    from wordspace.operators import nearest
    m = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector"))
    q = m.select(F.col("word").alias("query"))
    a = sorted(nearest.nearest(m, q, 7, "dot").collect())
    b = sorted(nearest.nearest(m, q, 7, "dot", broadcast_bytes=0, block_rows=100).collect())
    assert a == b
