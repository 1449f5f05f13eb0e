"""Noise draws on both ways to their cells."""

from pyspark.sql import functions as F

from wordspace.operators import sampling


def both_ways(spark, rows, vocab, draws=3):
    tokens = spark.createDataFrame(rows, "doc_id long, line_no int, pos int, word string")
    noise = sampling.noise_distribution(spark.createDataFrame(vocab, "word string, freq long")).checkpoint()
    sent = sampling.noise_draws(tokens, noise, draws, 42)
    dealt = sampling.noise_draws(tokens, noise, draws, 42, broadcast_bytes=0)
    assert dealt.schema.simpleString() == sent.schema.simpleString()
    plan = dealt._jdf.queryExecution().toString()
    return sorted(map(tuple, sent.collect()), key=repr), sorted(map(tuple, dealt.collect()), key=repr), plan


def test_dealt_cells_give_the_same_words(spark):
    vocab = [(f"w{i:04d}é", 1 + (7919 * i) % 400) for i in range(900)]
    rows = [(d * 10**12 - 5, n, p, "x") for d in range(30) for n in range(4) for p in range(d)]
    rows += [(None, 0, 3, "x"), (None, 0, 3, "x"), (7, None, 1, "x"), (7, 0, 1, "x"), (7, 0, 1, "x")]
    sent, dealt, plan = both_ways(spark, rows, vocab)
    assert len(sent) == 3 * len(rows) and dealt == sent
    # draws are packed before they are shuffled: the exchange holds bytes, no row a draw
    assert "Join" not in plan and "data#" in plan
    assert both_ways(spark, rows, [])[:2] == ([], [])
    assert both_ways(spark, rows, [("only", 5)])[1] == both_ways(spark, rows, [("only", 5)])[0]


def test_packed_draws_are_small(spark):
    rows = [(1000 + d, n, p, "x") for d in range(60) for n in range(8) for p in range(60)]
    t = spark.createDataFrame(rows, "doc_id long, line_no int, pos int, word string").select(
        "doc_id", "line_no", "pos", F.lit(0).alias("draw"), F.abs(F.xxhash64("doc_id", "line_no", "pos") % (1 << 32)).alias("point"), F.lit(0).alias("part"))
    packed = list(sampling._packed_draws(t.toArrow().to_batches()))
    data = [x for b in packed for x in b.column(3).to_pylist()]
    assert sum(map(len, data)) < 6 * len(rows)
    back = {r for d in data for r in zip(*(c.to_pylist() for c in sampling._unpacked_draws(d)))}
    assert back == {(r[0], r[1], r[2], 0, r[4]) for r in t.collect()}
