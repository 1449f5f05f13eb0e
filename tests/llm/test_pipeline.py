"""Every stage of the pipeline against its definition, on what the stage before kept."""

import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from frames import frame  # noqa: F401

import corpus_pipeline
from test_line_dedup import brute
from test_mixing import plain_targets
from test_simhash import plain_components, plain_fp
from wordspace.llm import quality
from wordspace.llm.common import read
from wordspace.llm.pieces import MODEL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Rows after each stage, 0 the input."""
    at = tmp_path_factory.mktemp("pipeline")
    docs = read(spark, SF, "documents")
    out = [docs.collect()]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"file://{at}/{k}")
        docs = spark.read.parquet(f"file://{at}/{k}")
        out.append(docs.collect())
    return out


def test_stages_and_columns(kept, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "simhash near-dedup", "mixing sources", "sentencepiece"]
    for rows in kept[1:-1]:
        assert rows and rows[0].asDict().keys() == kept[0][0].asDict().keys()
        assert all(r.n_chars == len(r.text) for r in rows)


def test_quality_keeps_what_the_model_accepts(kept, spark):
    docs = read(spark, SF, "documents")
    model = quality.fit_quality(docs, read(spark, SF, "labels"))
    good = quality.score_quality(docs, model).where("score >= 0.5").collect()
    assert Counter((r.doc_id, r.text) for r in kept[1]) == Counter((r.doc_id, r.text) for r in good)
    assert 0 < len(kept[1]) < len(kept[0])


def test_lines(kept):
    want = brute([(r.doc_id, r.text) for r in kept[1]], 40, 5)
    assert Counter((r.doc_id, r.text) for r in kept[2]) == Counter((d, t) for d, _, _, t in want)


def test_one_of_each_group(kept):
    of = plain_components([(r.doc_id, plain_fp(r.text)) for r in kept[2]], 3)
    assert Counter(r.doc_id for r in kept[3]) == Counter({d: 1 for d in of if of[d] == d})
    text = {r.doc_id: r.text for r in kept[2]}
    assert all(text[r.doc_id] == r.text for r in kept[3])


def test_mix(kept):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    size, got, text = defaultdict(int), defaultdict(int), {r.doc_id: r.text for r in kept[3]}
    for r in kept[3]:
        size[r.source] += words(r.text)
    for r in kept[4]:
        got[r.source] += words(r.text)
        assert text[r.doc_id].startswith(r.text)
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    for s, t in zip(names, plain_targets([size[s] for s in names])):
        assert abs(got[s] - t) <= 1
    assert max(Counter(r.doc_id for r in kept[4]).values()) <= 2


def test_ids(kept, spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert Counter((r.doc_id, tuple(r.ids)) for r in kept[5]) == Counter((r.doc_id, tuple(lib.encode(r.text))) for r in kept[4])
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in kept[5])
    again = corpus_pipeline.run(spark, SF).select("doc_id", "n_ids").collect()
    assert Counter((r.doc_id, r.n_ids) for r in again) == Counter((r.doc_id, r.n_ids) for r in kept[5])


def test_odd_rows_and_empty_tables(frame, spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "w " * 30_000, "en", None, 5),
           (3, "a b c d e f", "en", "a", 9), (3, "a b c d e f", "en", "a", 9), (3, "other text for that id", "en", "a", 9),
           (4, "A b c d e f", "de", "b", 9), (5, "a\nb", None, "b", 3)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        folder = f"file://{tmp_path}/{len(rows)}"
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, docs, folder).write.parquet(f"{folder}/out{k}")
            docs = spark.read.parquet(f"{folder}/out{k}")
            if k == 2:  # 1 and 3 repeat their ids, 4 is a copy of 3
                assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in docs.collect()) == (
                    [(0, ""), (1, ""), (2, "w w"), (3, "a b"), (5, "a\nb")] if rows else [])
        assert bool(docs.count()) == bool(rows)
