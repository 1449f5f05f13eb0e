"""Extra columns whose names an operator uses itself, and bounds that repeats must not pass."""

import pytest

from frames import frame  # noqa: F401
from wordspace.llm import line_dedup, mixing, quality, sharding, simhash, toxicity
from wordspace.llm.labelled import labelled_sample

LINE = "a line that is long enough to be a key of its own, " * 2
NAMES = ["row", "id", "n", "m", "gone", "doc", "k1", "j1", "far_id", "__gone", "__m", "__k1", "__stat_digits", "stat_digits", "__id", "_"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in NAMES)


def table(frame, n=12):
    return frame([(i if i % 5 else None, f"{LINE}\nown words of text number {i} {i * 7}", "s", *(f"{c}{i}" for c in NAMES)) for i in range(n)], SCHEMA)


def extras(rows):
    return sorted(tuple(r[c] for c in NAMES) for r in rows)


def test_line_dedup(frame):
    df = table(frame)
    for limit in (64 << 20, 0):
        out = line_dedup.dedup_lines(df, 40, 5, limit)
        assert out.columns == [*df.columns, "n_lines", "n_dropped"]
        rows = out.collect()
        assert extras(rows) == extras(df.collect()) and sum(r.n_dropped for r in rows) == 11


def test_simhash_dropping(frame):
    df = table(frame)
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    kept = {r.row: tuple(r[c] for c in NAMES) for r in out.collect()}
    assert all(v == tuple(f"{c}{k[3:]}" for c in NAMES) for k, v in kept.items()) and len(kept) >= 3


def test_mixed_texts(frame):
    df = table(frame)
    out = mixing.mixed_texts(df, mixing.mix_sources(df, block_words=8))
    assert out.columns == df.columns
    assert {tuple(r[c] for c in NAMES) for r in out.collect()} <= set(extras(df.collect()))


def test_quality_and_toxicity(frame):
    df = table(frame).withColumnsRenamed({"m": "Score"})
    names = [c for c in df.columns if c != "Score"]
    rules = quality.RuleModel((quality.Rule((("digits", None, 0.5),)),), (1.0,), 0.0) if hasattr(quality, "Rule") else None
    out = quality.score_quality(df, rules)
    assert out.columns == [*names, "score", "predicted"] and len(out.collect()) == 12
    got = toxicity.score_toxicity(df, toxicity.ToxicModel({}, 0.0))
    assert got.columns == [*names, "score", "predicted"] and {r.score for r in got.collect()} == {0.5}


def test_labelled_rows_are_bounded_not_ids(frame):
    docs = frame([(7, f"text {i}") for i in range(60)] + [(i, "other") for i in range(100, 120)], "doc_id long, text string")
    labels = frame([(7, 1)] + [(i, 0) for i in range(100, 120)], "doc_id long, y int")
    rows = labelled_sample(docs, labels, "y", 2, 5, 10).collect()  # no id leaves 5 modulo 2
    assert len(rows) == 10
    assert sorted(rows) == sorted(labelled_sample(docs.repartition(7), labels, "y", 2, 5, 10).collect())


@pytest.mark.parametrize("hot_keys", [100_000, 3])
def test_far_probe_with_many_unique_lines_and_null_ids(frame, monkeypatch, hot_keys):
    monkeypatch.setattr(line_dedup, "ASKED_ROWS", 3)
    monkeypatch.setattr(line_dedup, "SHARDS", 2)
    lines = [f"{LINE}{k}" for k in range(4)]
    rows = []
    for i in range(40):
        own = [f"{LINE} a line of document {i} alone, number {j}" for j in range(25)]
        rows.append((None if i % 2 else i, "\n".join([*own, *(lines[k] for k in range(4) if i % (k + 2) == 0)])))
    df = frame(rows, "doc_id long, text string")
    near = line_dedup.dedup_lines(df, 40, 5).collect()
    far = line_dedup.dedup_lines(df, 40, 5, 0, hot_keys).collect()
    assert sorted(map(repr, far)) == sorted(map(repr, near)) and sum(r.n_dropped for r in near) > 20


def test_rows_without_ids_share_buckets_evenly(frame, spark):
    df = frame([(None, f"text {i}", "en", "s") for i in range(3000)], "doc_id long, text string, lang string, source string")
    rows = sharding.hilbert_shards(df, 4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(4) for k in range(750)]


def test_mix_names_the_places_of_its_pieces(frame):
    df = frame([(i, "w " * (i * 3), "ab"[i % 2]) for i in range(30)], "doc_id long, text string, source string")
    mix = mixing.mix_sources(df, block_words=8, shard_blocks=4)
    rows = mixing.taken(mix).collect()
    assert all(sum(p.words for p in r.pieces) == r.taken for r in rows)
    places = [(p.shard, p.place) for r in rows for p in r.pieces]
    assert len(places) == len(set(places))
    for shard in range(mix.shards):
        own = sorted(p for s, p in places if s == shard)
        assert own == list(range(len(own)))
