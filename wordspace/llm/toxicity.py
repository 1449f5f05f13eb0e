"""Toxicity classifier with a counterfactual regulariser.

A linear model over hashed features of a text's distinct words: the word, and its first
four, five and six letters (stems that many toxic words share). It is fitted on a bounded
sample of labelled texts by logistic loss with L1 and L2 penalties and one more term: in
every sentence of that sample that holds an identity term, each such term is
swapped for another of its kind, and the squared change of the sentence's score is
penalised. A term that only happens to stand in toxic texts thus gains no weight of
its own, and neutral mentions are not flagged for it.

Identity terms are a list of group names (``IDENTITY_TERMS``) and, as texts may name groups
that no list has, words found in the sample itself (``corpus_terms``): words whose share of
labelled ones is that of all texts, within its error, though they do stand in such
texts; words that mostly follow the same word are of one kind.

Features are extracted on the executors and screened there by their chi-square; what the
driver solves is at most ``sample_rows`` sparse rows over ``kept_features`` features.
Whole texts are scored by the words' weights, in Arrow batches, without a shuffle.

Defined results: a null text is an empty one, which scores the model's bias. Without
labels of both classes the score is the share of ones with one of each class added.
Repeated rows get equal scores; extra columns pass through, columns called ``score`` or
``predicted`` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, utf8
from .labelled import labelled_sample

SAMPLE_ROWS, MAX_PAIRS, KEPT_FEATURES = 16_000, 20_000, 2_048
FEATURES = 1 << 20
PREFIXES = (4, 5, 6)
L1, L2, COUNTERFACTUAL = 1e-4, 1e-6, 1.0
MEMO = 200_000
#: Identity terms found in the sample at most, and the documents of it that each must stand in.
MAX_TERMS, LEAST_DOCS = 2_000, 20

#: Terms of one kind stand in for each other in a swapped sentence.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer", "heterosexual", "homosexual"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indian", "american"),
    ("blacks", "whites", "asians", "latinos", "africans", "europeans", "arabs", "indians", "americans"),
    ("mexican", "chinese", "japanese", "russian", "german", "french", "spanish", "italian", "turkish", "polish"),
    ("immigrant", "refugee", "migrant", "foreigner", "native", "citizen"),
    ("immigrants", "refugees", "migrants", "foreigners", "natives", "citizens"),
    ("deaf", "blind", "disabled", "autistic", "paralyzed"),
    ("old", "young", "elderly", "teenage"),
    ("frau", "mann", "mädchen", "junge"), ("frauen", "männer"), ("christen", "muslime", "juden"),
    ("femme", "homme", "fille", "garçon"), ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"),
    ("mujer", "hombre", "chica", "chico"), ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)

_ASCII = bytes.maketrans(bytes(range(128)), bytes(
    c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)))


def words(text: bytes | None) -> set[bytes]:
    """Distinct words: runs of letters, digits and non-ASCII bytes, A-Z in lower case."""
    return set((text or b"").translate(_ASCII).split())


def features(word: bytes) -> list[int]:
    """Hashed features of a word and of its beginnings."""
    w = word.decode("utf-8", "replace").lower()
    h = xxhash.xxh64_intdigest
    return [h("=" + w) % FEATURES, *(h(f"{k}{w[:k]}") % FEATURES for k in PREFIXES if len(w) >= k)]


def _kinds(terms: tuple[tuple[str, ...], ...]) -> dict[bytes, tuple[tuple[str, ...], int]]:
    return {t.encode(): (g, i) for g in terms for i, t in enumerate(g) if len(g) > 1}


def swapped_sentences(text: bytes | None, terms: tuple[tuple[str, ...], ...], kinds: dict | None = None):
    """(words, words after the swap) of each sentence that has a term. Which term of its
    kind stands in is fixed by the sentence's hash. ``kinds``: ``_kinds(terms)`` if at hand."""
    kind = _kinds(terms) if kinds is None else kinds
    for sentence in re.split(rb"[.!?\n]", text or b""):
        own = words(sentence)
        hit = sorted(w for w in own if w in kind)
        if hit:
            by = xxhash.xxh64_intdigest(sentence)
            to = {w: kind[w][0][(kind[w][1] + 1 + by % (len(kind[w][0]) - 1)) % len(kind[w][0])].encode() for w in hit}
            yield own, {to.get(w, w) for w in own}


def one_sentence(text: bytes | None, kinds: dict) -> bytes:
    """The sentence with a term that has the smallest hash; empty where there is none."""
    with_term = (x for x in re.split(rb"[.!?\n]", text or b"") if not kinds.keys().isdisjoint(words(x)))
    return min(with_term, key=lambda x: (xxhash.xxh64_intdigest(x), x), default=b"")


def corpus_terms(known: DataFrame, most: int = MAX_TERMS, least_docs: int = LEAST_DOCS) -> tuple[tuple[str, ...], ...]:
    """Kinds of words of ``known`` (text, y) that can stand in for each other: in at least
    ``least_docs`` texts, two of them labelled 1 or more, with a share of ones within two
    standard errors of that of all texts; the ``most`` most frequent ones, grouped by the
    word that they follow most often."""
    def count(batches):
        docs: dict[bytes, list[int]] = {}
        for b in batches:
            for text, y in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                for w in words(text):
                    e = docs.setdefault(w, [0, 0])
                    e[0] += y
                    e[1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode("utf-8", "replace") for w in docs], pa.string()), pa.array([a for a, _ in docs.values()], pa.int64()),
             pa.array([k for _, k in docs.values()], pa.int64())], names=["word", "a", "k"])

    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    p = ones / max(n, 1)
    a, k = F.col("a"), F.col("k")
    seen = known.select("text", "y").mapInArrow(count, "word string, a long, k long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("k").alias("k"))
    neutral = (seen.where((k >= least_docs) & (a >= 2) & (F.abs(a - k * p) <= 2 * F.sqrt(k * p * (1 - p))))
               .orderBy(k.desc(), "word").limit(most).select("word").collect())
    wanted = known.sparkSession.sparkContext.broadcast({r["word"].encode() for r in neutral})  # ``most`` at most

    def follow(batches):
        met: Counter = Counter()
        for b in batches:
            for text in utf8(b.column(0)):
                own = (text or b"").translate(_ASCII).split()
                met.update((w, x) for x, w in zip(own, own[1:]) if w in wanted.value)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode("utf-8", "replace") for w, _ in met], pa.string()), pa.array([x.decode("utf-8", "replace") for _, x in met], pa.string()),
             pa.array(list(met.values()), pa.int64())], names=["word", "before", "k"])

    before = (known.select("text").mapInArrow(follow, "word string, before string, k long").groupBy("word", "before").agg(F.sum("k").alias("k"))
              .groupBy("word").agg(F.max_by("before", F.struct("k", "before")).alias("before")))
    kinds = before.groupBy("before").agg(F.sort_array(F.collect_list("word")).alias("words")).where(F.size("words") > 1)
    return tuple(tuple(r["words"]) for r in kinds.orderBy("before").collect())


@dataclass
class ToxicModel:
    weights: dict[int, float]
    bias: float
    pairs: int = 0  # swapped sentences that the fit used
    memo: dict[bytes, float] = field(default_factory=dict, repr=False)

    def logit(self, text: bytes | None) -> float:
        z, memo = self.bias, self.memo
        for w in words(text):
            v = memo.get(w)
            if v is None:
                if len(memo) >= MEMO:
                    memo.clear()
                v = memo[w] = sum(self.weights.get(f, 0.0) for f in features(w))
            z += v
        return z


def solve(rows: list[tuple[np.ndarray, float]], pairs: list[tuple[np.ndarray, np.ndarray]], n_features: int,
          l1: float = L1, l2: float = L2, counterfactual: float = COUNTERFACTUAL, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient steps. ``rows``: (feature ids,
    repeats counted, label); ``pairs``: (ids, signs) of the change that a swap makes."""
    y = np.array([r[1] for r in rows], dtype=float)
    n, m = len(rows), len(pairs)
    ids = np.concatenate([r[0] for r in rows] or [np.zeros(0)]).astype(np.int64)
    row = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    pids = np.concatenate([p[0] for p in pairs] or [np.zeros(0)]).astype(np.int64)
    sign = np.concatenate([p[1] for p in pairs] or [np.zeros(0)]).astype(float)
    prow = np.repeat(np.arange(m), [len(p[0]) for p in pairs]).astype(np.int64)
    dot = lambda w: np.bincount(row, w[ids], n)
    back = lambda g: np.bincount(ids, g[row], n_features)
    pdot = lambda w: np.bincount(prow, sign * w[pids], m)
    pback = lambda g: np.bincount(pids, sign * g[prow], n_features)

    def curve(v, b):
        z = (dot(v) + b) / (4 * n)
        return back(z) + 2 * counterfactual / max(m, 1) * pback(pdot(v)) + l2 * v, z.sum()
    v, b, top = np.ones(n_features), 1.0, 1.0
    for _ in range(30):  # largest curvature, by powers
        size = np.sqrt(v @ v + b * b)
        v, b = curve(v / size, b / size)
        top = np.sqrt(v @ v + b * b)
    step = 1 / (1.1 * top + 1e-12)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, bias = np.zeros(n_features), float(np.log(p / (1 - p)))
    at, at_b, t = w, bias, 1.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(dot(at) + at_b, -500, 500))) - y) / n
        grad = back(g) + 2 * counterfactual / max(m, 1) * pback(pdot(at)) + l2 * at
        new = at - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = at_b - step * g.sum()
        if grad @ (new - w) > 0:  # start over where the momentum points uphill
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, at_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - bias)
        w, bias, t = new, new_b, t2
    return w, float(bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0,
                 sample_rows: int = SAMPLE_ROWS, max_pairs: int = MAX_PAIRS, kept_features: int = KEPT_FEATURES,
                 counterfactual: float = COUNTERFACTUAL, terms: tuple = IDENTITY_TERMS, l1: float = L1,
                 max_terms: int = MAX_TERMS) -> ToxicModel:
    """A model of ``labels.label`` over texts of ``docs``, learnt from at most
    ``sample_rows`` labelled texts outside the held-out fold, ``max_pairs`` of their swapped
    sentences (all with a listed term and one a text with a term found; those with the
    smallest hash) and ``kept_features`` features; identity terms are ``terms`` and at most
    ``max_terms`` words found in these texts (0: none)."""
    prepare(docs.sparkSession, text_batches=True)
    known = labelled_sample(docs, labels, label, folds, fold, sample_rows).checkpoint()
    listed = {t for kind in terms for t in kind}
    found = corpus_terms(known, max_terms) if max_terms else ()
    named, own_kinds = _kinds(terms), _kinds(tuple(tuple(w for w in kind if w not in listed) for kind in found))

    def extract(batches):
        for b in batches:
            y, ids, signs, pair = [], [], [], []
            for text, label_ in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                y.append(label_)
                ids.append([f for w in sorted(words(text)) for f in features(w)])
                signs.append([])
                pair.append(False)
                # all sentences with a listed term, one with a term found
                swaps = [*swapped_sentences(text, terms, named)]
                if own_kinds:
                    swaps += swapped_sentences(one_sentence(text, own_kinds), terms, own_kinds)
                for own, other in swaps:
                    minus = [f for w in sorted(own - other) for f in features(w)]
                    plus = [f for w in sorted(other - own) for f in features(w)]
                    y.append(label_)
                    ids.append(minus + plus)
                    signs.append([-1] * len(minus) + [1] * len(plus))
                    pair.append(True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(y, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(signs, pa.list_(pa.int32())),
                 pa.array(pair, pa.bool_())], names=["y", "ids", "signs", "pair"])

    rows = known.mapInArrow(extract, "y int, ids array<int>, signs array<int>, pair boolean").checkpoint()
    texts = rows.where("not pair")
    n, ones = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if ones in (0, n):
        return ToxicModel({}, float(np.log((ones + 1) / (n - ones + 1))))
    # chi-square of a feature's presence and the label
    a, k = F.col("a").cast("double"), F.col("k").cast("double")
    chi = (a * n - k * ones) * (a * n - k * ones) / (k * (n - k + 0.5) * ones * (n - ones))
    seen = (texts.select("y", F.explode(F.array_distinct("ids")).alias("f")).groupBy("f")
            .agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("k")).where("k >= 3"))
    kept = np.sort([r["f"] for r in seen.orderBy(chi.desc(), "f").limit(kept_features).select("f").collect()])

    def screened(batches):
        for b in batches:
            for c in ("ids", "signs"):
                b[c] = [np.asarray(x) for x in b[c]]
            keep = [np.isin(x, kept) for x in b["ids"]]
            b["signs"] = [s[k] if len(s) else s for s, k in zip(b["signs"], keep)]
            b["ids"] = [np.searchsorted(kept, x[k]).astype(np.int32) for x, k in zip(b["ids"], keep)]
            yield b
    small = rows.mapInPandas(screened, rows.schema)
    data = [(np.asarray(r["ids"]), r["y"]) for r in small.where("not pair").toLocalIterator()]
    pairs = [(np.asarray(r["ids"]), np.asarray(r["signs"])) for r in
             small.where("pair").orderBy(F.xxhash64("ids", "signs", "y")).limit(max_pairs).collect()]
    w, bias = solve(data, pairs, len(kept), l1=l1, counterfactual=counterfactual)
    return ToxicModel({int(f): float(v) for f, v in zip(kept, w) if v}, bias, len(pairs))


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5), over whole texts."""
    prepare(docs.sparkSession, text_batches=True)
    cols = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    docs = docs.select(*cols)
    text_at = cols.index("text")
    out = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    weights, bias = model.weights, model.bias  # at most kept_features weights

    def local(batches):
        own = ToxicModel(weights, bias)
        for b in batches:
            z = np.array([own.logit(t) for t in utf8(b.column(text_at))], dtype=float)
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*cols, "score", "predicted"])
    return docs.mapInArrow(local, out)
