"""The streaming search against the library (bpe) and against all segmentations (unigram)."""

import random

import pytest
import sentencepiece

from frames import frame  # noqa: F401

from wordspace.llm import pieces
from wordspace.llm.pieces import BPE, UNIGRAM, Codec, Search, load_model, model_kind


@pytest.fixture(scope="module")
def codec():
    return Codec(load_model())


SF_SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a  b", "   x ", "\t\n", " ▁ x", "é́", "日本語テキスト 🙂 x", "  wide", "a\x00b", "<s> </s> <0x41>",
       "x" * 5000, " " * 50 + "y", "\r\n\r\n", "the" * 3000, "aaaa bb aaaaa" * 40]


def test_ids_and_texts_are_the_librarys(codec, spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    for t in texts:
        ids = codec.encode(t).tolist()
        assert ids == codec.lib.encode(t), t[:80]
        assert codec.decode(ids) == codec.lib.decode(ids)
        assert codec.decode(ids) == t.replace("▁", " ")


@pytest.mark.parametrize("window", [1, 5, 16, 64, 5000])
def test_streaming_commits_give_the_same_ids(codec, window):
    rng = random.Random(window)
    for _ in range(20):
        s = "▁" + "".join(rng.choice(("aaaa", "the", "tion", "x", "é", "a" * rng.randint(1, 60), "zß", "漢")) for _ in range(150))
        runs = list(codec.search.stream(s, window))
        flat = [x for run in runs for i in run for x in ([i] if i >= 0 else [codec.byte_ids[b] for b in chr(-i - 1).encode()])]
        assert flat == codec.lib.encode(s[1:])
        assert window > 100 or len(runs) > 2  # ids leave before the text ends


@pytest.mark.parametrize("window", [1, 7, 40, None])
def test_spans_of_all_lengths_go_through_one_window(codec, window):
    rng = random.Random(5)
    spans = ["▁" + "".join(rng.choice(("aaaa", "the", "tion", "x", "é", "a" * rng.randint(1, 40), "zß", "ing"))
                           for _ in range(rng.choice((1, 2, 5, 60, 400)))) for _ in range(60)] + ["a" * 3000, "▁", "▁the"]
    assert all(not codec.odd.search(s) for s in spans)
    got = [[int.from_bytes(b[i:i + 4], "little") for i in range(0, len(b), 4)] for b in codec.side.run(spans, window)]
    for s, ids in zip(spans, got):
        assert ids == [i for run in codec.search.stream(s) for i in run]
    assert codec.side.run([], window) == []


def test_every_character_of_a_corpus_goes_through_the_window(spark):
    own = Codec(load_model())
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()] + ["x" * 5000, "the" * 3000]
    streamed, stream = [], own._streamed
    own._streamed = lambda p: streamed.append(p) or stream(p)
    own.encode_all(texts)
    spans = {s for t in texts for s in own._spans(t)}
    parts = {p for s in spans for p in (own.spans.findall(s) if own.odd.search(s) else [s])}
    alone = [p for p in streamed if not own.odd.search(p)]  # the others are characters that are no piece
    assert own.side.characters + sum(map(len, alone)) == sum(map(len, parts))
    assert own.side.characters > 100 * sum(len(p) for p in alone if len(p) < 1000)


def all_splits(s, longest):
    if not s:
        yield []
    for k in range(1, min(longest, len(s)) + 1):
        for rest in all_splits(s[k:], longest):
            yield [s[:k], *rest]


@pytest.mark.parametrize("seed", range(8))
def test_unigram_search_finds_the_best_sum(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(14)}
    vocab = {w: (i, -rng.random() * 10) for i, w in enumerate(sorted(words))}
    search = Search(vocab, UNIGRAM)
    for window in (2, 100):
        for _ in range(10):
            s = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 11)))
            value = lambda p: vocab[p][1] if p in vocab else search.unknown if len(p) == 1 else None
            want = max((sum(map(value, x)) for x in all_splits(s, 4) if all(value(p) is not None for p in x)), default=0)
            got = [i for run in search.stream(s, window) for i in run]
            spelled = [chr(-i - 1) if i < 0 else search.text[i] for i in got]
            assert "".join(spelled) == s and abs(sum(map(value, spelled)) - want) < 1e-9


@pytest.mark.parametrize("seed", range(5))
def test_bpe_search_gives_what_the_merges_give(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c"]
    while len(words) < 25:  # every piece is the merge of two earlier ones
        w = rng.choice(words) + rng.choice(words)
        if w not in words and len(w) <= 6:
            words.append(w)
    search = Search({w: (i, -float(i)) for i, w in enumerate(words)}, BPE)
    for _ in range(60):
        s = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))
        spelled = [chr(-i - 1) if i < 0 else search.text[i] for run in search.stream(s, 7) for i in run]
        assert spelled == search.merged(s)


def test_kind_of_a_model():
    assert model_kind(load_model()) == BPE
    assert model_kind(b"\x12\x04\x18\x01\x20\x05") == UNIGRAM == model_kind(b"")
    with pytest.raises(ValueError):
        Search({}, 3)


def test_tables(frame, spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, None, 2), (1, "x", 3), (1, "x", 3)]
    df = frame(rows, "doc_id long, text string, ids int")
    got = pieces.decode(pieces.encode(df))
    one = pieces.encode(df.withColumn("decoded", df.doc_id), decoded=True)
    assert one.columns == got.columns and sorted(map(repr, one.collect())) == sorted(map(repr, got.collect()))
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = got.collect()
    assert len(out) == len(rows)
    assert all(r.ids == lib.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " ") for r in out)
    assert pieces.decode(pieces.encode(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    nulls = pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()
    assert nulls[0].decoded == ""
