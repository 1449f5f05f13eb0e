"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB
oracles. Every query reads the given tables at ``sf_dir`` in full.

Parameters of the registered queries are fixed here, once, and documented in
the README; tests never change them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import huffman as hf
from ..operators import nearest as nn
from ..operators import sampling as smp
from ..operators import sentences as sen
from ..operators import tokens as tok
from ..operators import weights as wts
from ..operators.vector_agg import sum_by_key
from ..session import drop_folder, shared_folder, stored
from ..sources import corpus, model_text, vocab_text

# Parameters of the registered queries.
MIN_COUNT = 5          # frequency cut of the demo set-up
SAMPLE = 1e-4          # subsample rate
SEED = 42
NOISE_DRAWS = 2        # noise words per token
TOP_N = 10             # answers per query (console loop)
REPORT_N = 20          # answers per query (model-file demo report)
WINDOW = 5             # context window (builder default)
MAX_LEN = 1000         # words per sentence chunk
EPOCHS = 2             # epochs of the sentence-level queries
ALPHA = 0.05           # start learning rate
DIM_SMALL = 8          # vector size of the initial-vector queries
DIM_TRAIN = 200        # vector size of the registered training queries (builder default)
EPOCHS_TRAIN = 3       # epochs of the registered training queries
EPOCHS_SYNC = 3        # epochs of the synchronous training queries
BATCHES_SYNC = 2       # mini-batches of an epoch there


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.document_lines(spark, sf, "documents")


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tok.tokenize(_lines(spark, sf))


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    return tok.vocabulary(_tokens(spark, sf), MIN_COUNT)


def q_corpus_lines(spark, sf):
    return _lines(spark, sf)


def q_corpus_file_lines(spark, sf):
    """The corpus written as text files, one sentence a line, and read back in file order."""
    folder = shared_folder(spark, "corpus")
    _lines(spark, sf).orderBy("doc_id", "line_no").select("line").write.text(folder)
    out = corpus.lines_from_text(spark, folder).checkpoint()
    drop_folder(spark, folder)
    return out


def q_tokenize(spark, sf):
    return _tokens(spark, sf)


def q_corpus_size(spark, sf):
    return tok.corpus_size(_lines(spark, sf))


def q_word_count(spark, sf):
    return tok.word_count(_tokens(spark, sf))


def q_vocabulary(spark, sf):
    return _vocab(spark, sf)


def q_vocab_summary(spark, sf):
    return tok.vocab_summary(_lines(spark, sf), _vocab(spark, sf))


def q_vocab_text(spark, sf):
    return vocab_text.vocab_lines(_vocab(spark, sf))


def q_in_vocab_tokens(spark, sf):
    lines = _lines(spark, sf)
    _, vocab, _ = tok.corpus_stats(lines, MIN_COUNT)
    return tok.in_vocab_tokens(tok.tokenize(lines), vocab)


# ---- sampling and sentences

def _stats(spark, sf):
    """(lines, vocabulary, corpus size, in-vocabulary tokens with freq), the
    word counts materialised once."""
    lines = _lines(spark, sf)
    _, vocab, c = tok.corpus_stats(lines, MIN_COUNT)
    return lines, vocab, c, tok.in_vocab_tokens(tok.tokenize(lines), vocab, with_freq=True)


def _counted_vocab(spark, sf):
    """The vocabulary from stored word counts, for jobs that read it more than once."""
    return tok.corpus_stats(_lines(spark, sf), MIN_COUNT)[1]


def q_noise_distribution(spark, sf):
    nd = smp.noise_distribution(_counted_vocab(spark, sf))
    return nd.select("word", "freq", F.round("weight", 8).alias("weight"), F.round("share", 14).alias("share"),
                     F.round("cum_share", 12).alias("cum_share"))


def q_noise_draws(spark, sf):
    """The noise words of every in-vocabulary token."""
    _, vocab, _, tf = _stats(spark, sf)
    return smp.noise_draws(tf, smp.noise_distribution(vocab), NOISE_DRAWS, SEED)


def q_keep_probability(spark, sf):
    _, vocab, c, _ = _stats(spark, sf)
    return smp.keep_probability(vocab, c, SAMPLE)


def q_subsample(spark, sf):
    _, _, c, tf = _stats(spark, sf)
    return smp.subsample(tf, c, SAMPLE, SEED, 0).select("doc_id", "line_no", "pos", "word")


def q_epoch_tokens(spark, sf):
    _, _, c, tf = _stats(spark, sf)
    return smp.epoch_tokens(tf, c, SAMPLE, SEED, EPOCHS)


def _chunks(spark, sf, epochs=EPOCHS, stats=None, words=True):
    lines, _, c, tf = stats or _stats(spark, sf)
    kept = smp.epoch_tokens(tf, c, SAMPLE, SEED, epochs)
    return sen.sentence_chunks(kept, sen.line_info(lines), c, MAX_LEN, words=words), c


def q_sentence_chunks(spark, sf):
    ch, _ = _chunks(spark, sf)
    return ch.select("epoch", "doc_id", "line_no", "chunk", "words")


def q_chunk_progress(spark, sf):
    ch, _ = _chunks(spark, sf, words=False)
    return ch.select("epoch", "doc_id", "line_no", "chunk", "n_words", "tokens_seen")


def q_learning_rate(spark, sf):
    ch, c = _chunks(spark, sf, words=False)
    return ch.select("epoch", "doc_id", "line_no", "chunk", "tokens_seen",
                     sen.learning_rate_col(F.col("tokens_seen"), ALPHA, EPOCHS, c).alias("alpha"))


def _first_epoch_chunks(spark, sf):
    ch, _ = _chunks(spark, sf, 1)
    return ch


def q_window_width(spark, sf):
    t = sen.targets(_first_epoch_chunks(spark, sf), WINDOW, SEED)
    return t.select("epoch", "doc_id", "line_no", "chunk", "target_pos", "width")


def q_skipgram_pairs(spark, sf):
    return sen.skipgram_pairs(_first_epoch_chunks(spark, sf), WINDOW, SEED)


def _init_model(spark, sf):
    return wts.init_vectors(_vocab(spark, sf), DIM_SMALL, SEED)


def q_init_vectors(spark, sf):
    return _init_model(spark, sf)


def q_cbow_context(spark, sf):
    stats = _stats(spark, sf)
    # read twice, for the words that a task needs and for the means: built once
    chunks = stored(_chunks(spark, sf, 1, stats)[0].select(*sen.CHUNK, "words"), "chunks")
    cc = sen.cbow_context(chunks, wts.init_vectors(stats[1], DIM_SMALL, SEED), WINDOW, SEED)
    return cc.select("epoch", "doc_id", "line_no", "chunk", "target_pos", "target", "n_context",
                     "mean")


def q_vector_lookup(spark, sf):
    """Vectors of the words of the benchmark texts in a vocabulary model."""
    words = tok.tokenize(corpus.document_lines(spark, sf, "benchmark")).select(F.col("word").alias("query"))
    return nn.lookup(_init_model(spark, sf), words)


# ---- Huffman coding

def q_huffman_classes(spark, sf):
    return hf.frequency_classes(_vocab(spark, sf))


def q_huffman_codes(spark, sf):
    return hf.huffman_codes(_counted_vocab(spark, sf))


def q_huffman_paths(spark, sf):
    return hf.huffman_paths(hf.huffman_codes(_counted_vocab(spark, sf)))


def q_huffman_cost(spark, sf):
    """Total coded length (the same for every optimal code) and word count;
    the longest code depends on ties, so it is not part of the checked row."""
    return hf.huffman_cost(hf.huffman_codes(_counted_vocab(spark, sf))).select("cost", "n_words")


# ---- training (rows-only checks; properties in tests/)

def _fit(spark, sf, method, **more):
    from .train import fit
    return fit(_lines(spark, sf), method=method, dim=DIM_TRAIN, window=WINDOW,
               min_count=MIN_COUNT, sample=SAMPLE, alpha=ALPHA, epochs=EPOCHS_TRAIN,
               max_len=MAX_LEN, seed=SEED, **more)


def q_train_skip_gram(spark, sf):
    return _fit(spark, sf, "skip_gram").words


def q_train_cbow(spark, sf):
    return _fit(spark, sf, "cbow").words


def q_fit_and_query(spark, sf):
    """The whole job: vocabulary, tree, training with its state in a store, the model saved,
    loaded, written as text and read back normalised, then the 10 nearest words of every
    vocabulary word."""
    from ..sources import model_store
    folder = shared_folder(spark, "model")
    model = _fit(spark, sf, "skip_gram", store=f"{folder}/state")
    version = model_store.save_model(model, f"{folder}/models")
    model_text.write_model_text(model_store.load_model(spark, f"{folder}/models", version).words, f"{folder}/text")
    read = model_text.read_model_text(spark, f"{folder}/text").checkpoint()
    drop_folder(spark, folder)
    return nn.nearest_all(read, TOP_N, "dot")


def flagship(spark, sf):
    return q_fit_and_query(spark, sf)


# ---- logistic table and synchronous batch steps (conversations corpus)

def q_sigmoid(spark, sf):
    """The table rule (and the exact logistic) at x = 4 * sum of each
    embedding's components (spans both saturated ends)."""
    from ..functions.sigmoid import sigmoid_exact, sigmoid_table
    x = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double")) * 4
    e = _emb(spark, sf).select("vec_id", x.alias("x"))
    return e.select("vec_id", "x", F.round(sigmoid_table(F.col("x")), 6).alias("f_table"),
                    F.round(sigmoid_exact(F.col("x")), 6).alias("f_exact"))


def _conv_setup(spark, sf):
    lines = corpus.document_lines(spark, sf, "conversations")
    toks = tok.tokenize(lines)
    _, vocab, c = tok.corpus_stats(lines, MIN_COUNT)
    kept = smp.subsample(tok.in_vocab_tokens(toks, vocab, True), c, SAMPLE, SEED, 0) \
              .withColumn("epoch", F.lit(0))
    chunks = sen.sentence_chunks(kept, sen.line_info(lines), c, MAX_LEN)
    codes = hf.rank_codes(vocab)
    words = wts.init_vectors(vocab, DIM_SMALL, SEED)
    inner = wts.init_inner(codes, DIM_SMALL, SEED, zero=False)
    return chunks, codes, words, inner


def _rounded_step(df):
    return df.select("kind", "key", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def q_hs_batch_step(spark, sf):
    from ..operators.hsoftmax import hs_batch_step
    chunks, codes, words, inner = _conv_setup(spark, sf)
    pairs = sen.skipgram_pairs(chunks, WINDOW, SEED)
    return _rounded_step(hs_batch_step(pairs, words, inner, codes, ALPHA))


def q_cbow_batch_step(spark, sf):
    from ..operators.hsoftmax import cbow_batch_step
    chunks, codes, words, inner = _conv_setup(spark, sf)
    return _rounded_step(cbow_batch_step(chunks, words, inner, codes, WINDOW, SEED, ALPHA))


def _fit_synchronous(spark, sf, method):
    """All vectors after three epochs of mini-batches over the Huffman tree."""
    from .synchronous import fit_synchronous
    m = fit_synchronous(corpus.document_lines(spark, sf, "conversations"), method, DIM_SMALL, WINDOW, MIN_COUNT, SAMPLE,
                        ALPHA, EPOCHS_SYNC, BATCHES_SYNC, MAX_LEN, SEED)
    both = m.inner.select(F.lit("n").alias("kind"), F.col("node_id").alias("key"), "vector").unionByName(
        m.words.select(F.lit("w").alias("kind"), F.col("word").alias("key"), "vector"))
    # + 0.0: no negative zeros
    return both.select("kind", "key", F.transform("vector", lambda x: F.round(x.cast("double"), 6) + F.lit(0.0)).alias("vector"))


def q_train_skip_gram_sync(spark, sf):
    return _fit_synchronous(spark, sf, "skip_gram")


def q_train_cbow_sync(spark, sf):
    return _fit_synchronous(spark, sf, "cbow")


# ---- vector columns over the embeddings table (word = vec_id as text)

def _emb(spark, sf):
    return corpus.read_table(spark, sf, "embeddings")


def _pairs(spark, sf):
    """Each vector with the vector of the next id (an equi-join, no window)."""
    e = _emb(spark, sf)
    b = e.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("other"))
    return e.join(b, F.col("next_id") == F.col("vec_id") + 1, "inner")


def raw_model(spark, sf):
    return _emb(spark, sf).select(F.col("vec_id").cast("string").alias("word"),
                                  F.col("embedding").alias("vector"))


def text_model(spark, sf, normalize=True, store=False):
    """The embeddings written as model text lines and read back (O3 -> O4).
    ``store`` keeps the loaded model (reliable checkpoint) for queries that
    scan it several times, as a loaded model would be kept."""
    m = model_text.parse_model_lines(model_text.model_lines(raw_model(spark, sf)), normalize)
    return m.checkpoint() if store else m


def q_vector_norm(spark, sf):
    return _emb(spark, sf).select("vec_id", V.norm(F.col("embedding")).alias("norm"))


def q_vector_normalize(spark, sf):
    return _emb(spark, sf).select("vec_id", V.normalize(F.col("embedding")).alias("vector"))


def q_vector_dot(spark, sf):
    return _pairs(spark, sf).select("vec_id", "next_id",
                                    V.dot(F.col("embedding"), F.col("other")).alias("dot"))


def q_vector_cosine(spark, sf):
    return _pairs(spark, sf).select("vec_id", "next_id",
                                    V.cosine(F.col("embedding"), F.col("other")).alias("cosine"))


def q_vector_add(spark, sf):
    return _pairs(spark, sf).select("vec_id", "next_id",
                                    V.add(F.col("embedding"), F.col("other")).alias("vector"))


def q_vector_minus(spark, sf):
    return _pairs(spark, sf).select("vec_id", "next_id",
                                    V.minus(F.col("embedding"), F.col("other")).alias("vector"))


def q_vector_scale(spark, sf):
    k = F.lit(1.0) / (F.col("label") + 1)
    return _emb(spark, sf).select("vec_id", V.scale(F.col("embedding"), k).alias("vector"))


def q_vector_sum(spark, sf):
    return (sum_by_key(_emb(spark, sf), ["label"], "embedding", ["vec_id"], "s")
            .select("label", "n", F.transform("s", lambda x: F.round(x, 6)).alias("vector")))


def q_model_text(spark, sf):
    """The fields of every line of the model text, header included: the word
    and its numbers as the text spells them."""
    parts = F.split(F.col("line"), " ")
    lines = model_text.model_lines(raw_model(spark, sf)).select("is_header", parts.alias("p"))
    return (lines.select("is_header", F.col("p")[0].alias("word"), F.posexplode(F.slice("p", 2, F.size("p"))))
            .select("is_header", "word", F.col("pos").alias("field"),
                    F.col("col").cast("float").cast("double").alias("value")))


def q_model_load_normalized(spark, sf):
    return text_model(spark, sf, True)


def q_model_load_raw(spark, sf):
    return text_model(spark, sf, False)


def q_model_file(spark, sf):
    """The embeddings written as a model text file and loaded, normalised, from it."""
    folder = shared_folder(spark, "model")
    model_text.write_model_text(raw_model(spark, sf), folder)
    out = model_text.read_model_text(spark, folder).checkpoint()
    drop_folder(spark, folder)
    return out


def q_model_stored(spark, sf):
    """The embeddings saved as a version of a model store and loaded again."""
    from ..sources import model_store
    from .model import Model
    words = raw_model(spark, sf)
    none = words.limit(0)
    codes = words.select("word", F.length("word").cast("long").alias("freq"), F.lit("").alias("code"), F.lit(0).alias("code_len"))
    folder = shared_folder(spark, "model")
    model_store.save_model(Model(words, none.select(F.col("word").alias("node_id"), "vector"), codes, codes, 0, 1), folder)
    out = model_store.load_model(spark, folder).words.checkpoint()
    drop_folder(spark, folder)
    return out


def _all_words(model):
    return model.select(F.col("word").alias("query"))


def q_nearest_dot(spark, sf):
    m = text_model(spark, sf, True, store=True)
    return nn.nearest(m, _all_words(m), TOP_N, "dot")


def q_nearest_cosine(spark, sf):
    m = raw_model(spark, sf)
    return nn.nearest(m, _all_words(m), TOP_N, "cosine")


def q_nearest_all(spark, sf):
    return nn.nearest_all(raw_model(spark, sf), TOP_N, "cosine", block_rows=256)


def _triples(spark, sf):
    e = _emb(spark, sf).select("vec_id")
    t = (e.join(e.select(F.col("vec_id").alias("to_id")), F.col("to_id") == F.col("vec_id") + 1)
          .join(e.select(F.col("vec_id").alias("target_id")), F.col("target_id") == F.col("vec_id") + 2))
    return t.select(F.col("vec_id").cast("string").alias("word_from"),
                    F.col("to_id").cast("string").alias("word_to"),
                    F.col("target_id").cast("string").alias("word_target"))


def q_analogy(spark, sf):
    return nn.analogy(text_model(spark, sf, True, store=True), _triples(spark, sf), TOP_N)


def q_nearest_report(spark, sf):
    """The printed lines, read back: word, the separator, and the score as spelled."""
    m = text_model(spark, sf, True, store=True)
    out = nn.report_lines(nn.nearest(m, _all_words(m), REPORT_N, "dot"))
    parts = F.split(F.col("line"), "\t")
    return out.select("query", "rank", parts[0].alias("printed_word"), parts[1].cast("double").alias("printed_score"))


QUERIES = {
    "corpus_lines": q_corpus_lines,
    "corpus_file_lines": q_corpus_file_lines,
    "tokenize": q_tokenize,
    "corpus_size": q_corpus_size,
    "word_count": q_word_count,
    "vocabulary": q_vocabulary,
    "vocab_summary": q_vocab_summary,
    "vocab_text": q_vocab_text,
    "in_vocab_tokens": q_in_vocab_tokens,
    "noise_distribution": q_noise_distribution,
    "noise_draws": q_noise_draws,
    "keep_probability": q_keep_probability,
    "subsample": q_subsample,
    "epoch_tokens": q_epoch_tokens,
    "sentence_chunks": q_sentence_chunks,
    "chunk_progress": q_chunk_progress,
    "learning_rate": q_learning_rate,
    "window_width": q_window_width,
    "skipgram_pairs": q_skipgram_pairs,
    "init_vectors": q_init_vectors,
    "cbow_context": q_cbow_context,
    "vector_lookup": q_vector_lookup,
    "huffman_classes": q_huffman_classes,
    "huffman_codes": q_huffman_codes,
    "huffman_paths": q_huffman_paths,
    "huffman_cost": q_huffman_cost,
    "sigmoid": q_sigmoid,
    "hs_batch_step": q_hs_batch_step,
    "cbow_batch_step": q_cbow_batch_step,
    "train_skip_gram_sync": q_train_skip_gram_sync,
    "train_cbow_sync": q_train_cbow_sync,
    "train_skip_gram": q_train_skip_gram,
    "train_cbow": q_train_cbow,
    "fit_and_query": q_fit_and_query,
    "vector_norm": q_vector_norm,
    "vector_normalize": q_vector_normalize,
    "vector_dot": q_vector_dot,
    "vector_cosine": q_vector_cosine,
    "vector_add": q_vector_add,
    "vector_minus": q_vector_minus,
    "vector_scale": q_vector_scale,
    "vector_sum": q_vector_sum,
    "model_text": q_model_text,
    "model_load_normalized": q_model_load_normalized,
    "model_load_raw": q_model_load_raw,
    "model_file": q_model_file,
    "model_stored": q_model_stored,
    "nearest_dot": q_nearest_dot,
    "nearest_cosine": q_nearest_cosine,
    "nearest_all": q_nearest_all,
    "analogy": q_analogy,
    "nearest_report": q_nearest_report,
}


# --------------------------------------------------------------------------
# DuckDB oracles. Written independently in SQL from the same rules.

SOURCES_SQL = {
    "documents": "SELECT doc_id, text FROM documents",
    "conversations": """SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc_id, text
                        FROM conversations""",
}


def lines_sql(source: str = "documents") -> str:
    return r"""
lines AS (
  SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS line_no, unnest(a) AS line
  FROM (
    SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a)-1] ELSE a END AS a
    FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS a
          FROM (""" + SOURCES_SQL[source] + r""") WHERE text IS NOT NULL)
  )
)"""


LINES_SQL = lines_sql("documents")

TOKENS_PART = r""",
tokens AS (
  SELECT doc_id, line_no, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS word
  FROM (SELECT doc_id, line_no,
               list_filter(regexp_split_to_array(line, '[ \t\n\r\f]+'), lambda x: x <> '') AS a
        FROM lines)
)"""
TOKENS_SQL = LINES_SQL + TOKENS_PART

VOCAB_PART = f""",
vocab AS (
  SELECT word, count(*) AS freq FROM tokens GROUP BY word HAVING count(*) >= {MIN_COUNT}
)"""
VOCAB_SQL = TOKENS_SQL + VOCAB_PART

ORACLES = {
    "corpus_lines": f"WITH {LINES_SQL} SELECT * FROM lines",
    "corpus_file_lines": f"""WITH {LINES_SQL}
        SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS doc_id, 0 AS line_no, line FROM lines""",
    "tokenize": f"WITH {TOKENS_SQL} SELECT * FROM tokens",
    "corpus_size": f"WITH {TOKENS_SQL} SELECT count(*) AS corpus_size FROM tokens",
    "word_count": f"WITH {TOKENS_SQL} SELECT word, count(*) AS freq FROM tokens GROUP BY word",
    "vocabulary": f"WITH {VOCAB_SQL} SELECT * FROM vocab",
    "vocab_summary": f"""WITH {VOCAB_SQL}
        SELECT (SELECT count(*) FROM tokens) AS corpus_size,
               (SELECT count(*) FROM vocab) AS vocab_size""",
    "vocab_text": f"WITH {VOCAB_SQL} SELECT word || chr(9) || CAST(freq AS VARCHAR) AS line FROM vocab",
    "in_vocab_tokens": f"""WITH {VOCAB_SQL}
        SELECT t.* FROM tokens t WHERE t.word IN (SELECT word FROM vocab)""",
}


# ---- vector oracles. dot = float products summed in double, in order.

def _dot(a, b):
    return (f"(CASE WHEN len({a}) = len({b}) THEN list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda p: (p[1] * p[2])::DOUBLE)) END)")


def _norm(a):
    return f"sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))"


def _normalize(a):
    return (f"(CASE WHEN {_norm(a)} > 0 THEN list_transform({a}, "
            f"lambda x: (x::DOUBLE / {_norm(a)})::FLOAT) ELSE {a} END)")


PAIRS_SQL = """pairs AS (
  SELECT a.vec_id, b.vec_id AS next_id, a.embedding, b.embedding AS other
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""

NORM_MODEL_SQL = f"""m AS (SELECT CAST(vec_id AS VARCHAR) AS word,
                       {_normalize('embedding')} AS vector FROM embeddings)"""
RAW_MODEL_SQL = """m AS (SELECT CAST(vec_id AS VARCHAR) AS word, embedding AS vector FROM embeddings)"""


def _nearest_sql(model_sql, score, n):
    return f"""WITH {model_sql},
      s AS (SELECT q.word AS query, c.word, {score} AS score
            FROM m q JOIN m c ON c.word <> q.word),
      r AS (SELECT query, word, score,
                   row_number() OVER (PARTITION BY query ORDER BY score DESC, word) AS rank
            FROM s WHERE score IS NOT NULL AND NOT isnan(score))
      SELECT query, CAST(rank AS INTEGER) AS rank, word, score FROM r WHERE rank <= {n}"""


COSINE = f"({_dot('q.vector', 'c.vector')} / ({_norm('q.vector')} * {_norm('c.vector')}))"

ORACLES.update({
    "vector_norm": f"SELECT vec_id, {_norm('embedding')} AS norm FROM embeddings",
    "vector_normalize": f"SELECT vec_id, {_normalize('embedding')} AS vector FROM embeddings",
    "vector_dot": f"WITH {PAIRS_SQL} SELECT vec_id, next_id, {_dot('embedding', 'other')} AS dot FROM pairs",
    "vector_cosine": f"""WITH {PAIRS_SQL} SELECT vec_id, next_id,
        {_dot('embedding', 'other')} / ({_norm('embedding')} * {_norm('other')}) AS cosine FROM pairs""",
    "vector_add": f"""WITH {PAIRS_SQL} SELECT vec_id, next_id,
        list_transform(list_zip(embedding, other), lambda p: (p[1] + p[2])::FLOAT) AS vector FROM pairs""",
    "vector_minus": f"""WITH {PAIRS_SQL} SELECT vec_id, next_id,
        list_transform(list_zip(embedding, other), lambda p: (p[1] - p[2])::FLOAT) AS vector FROM pairs""",
    "vector_scale": """SELECT vec_id,
        list_transform(embedding, lambda x: (x::DOUBLE * (1.0 / (label + 1)))::FLOAT) AS vector
        FROM embeddings""",
    "vector_sum": """SELECT label, n, list(round(s, 6) ORDER BY i) AS vector FROM (
        SELECT label, i, sum(x::DOUBLE) AS s FROM (
          SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
        GROUP BY label, i)
        JOIN (SELECT label AS l2, count(*) AS n FROM embeddings GROUP BY label) ON l2 = label
        GROUP BY label, n""",
    "model_text": """
        SELECT true AS is_header, CAST(count(*) AS VARCHAR) AS word, 0 AS field, max(len(embedding))::DOUBLE AS value
        FROM embeddings
        UNION ALL
        SELECT false, CAST(vec_id AS VARCHAR), CAST(unnest(range(len(embedding))) AS INTEGER),
               unnest(embedding)::DOUBLE FROM embeddings""",
    "nearest_report": f"""SELECT query, rank, word || ' :' AS printed_word, score AS printed_score
        FROM ({_nearest_sql(NORM_MODEL_SQL, _dot('q.vector', 'c.vector'), REPORT_N)})""",
    "model_load_normalized": f"WITH {NORM_MODEL_SQL} SELECT * FROM m",
    "model_load_raw": f"WITH {RAW_MODEL_SQL} SELECT * FROM m",
    "model_file": f"WITH {NORM_MODEL_SQL} SELECT * FROM m",
    "model_stored": f"WITH {RAW_MODEL_SQL} SELECT * FROM m",
    "nearest_dot": _nearest_sql(NORM_MODEL_SQL, _dot('q.vector', 'c.vector'), TOP_N),
    "nearest_cosine": _nearest_sql(RAW_MODEL_SQL, COSINE, TOP_N),
    "nearest_all": _nearest_sql(RAW_MODEL_SQL, COSINE, TOP_N),
    "analogy": f"""WITH {NORM_MODEL_SQL},
      t AS (SELECT CAST(a.vec_id AS VARCHAR) AS word_from, CAST(b.vec_id AS VARCHAR) AS word_to,
                   CAST(c.vec_id AS VARCHAR) AS word_target
            FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
                              JOIN embeddings c ON c.vec_id = a.vec_id + 2),
      ctr AS (SELECT t.*, list_transform(list_zip(vt.vector, list_transform(list_zip(vto.vector, vf.vector),
                        lambda p: (p[1] - p[2])::FLOAT)), lambda p: (p[1] + p[2])::FLOAT) AS center
              FROM t JOIN m vf ON vf.word = t.word_from JOIN m vto ON vto.word = t.word_to
                     JOIN m vt ON vt.word = t.word_target),
      s AS (SELECT word_from, word_to, word_target, c.word, {_dot('center', 'c.vector')} AS score
            FROM ctr JOIN m c ON c.word <> ctr.word_target),
      r AS (SELECT *, row_number() OVER (PARTITION BY word_from, word_to, word_target
                                         ORDER BY score DESC, word) AS rank FROM s)
      SELECT word_from, word_to, word_target, CAST(rank AS INTEGER) AS rank, word, score
      FROM r WHERE rank <= {TOP_N}""",
})


# ---- sampling / sentence oracles

def _u16(key_sql):
    return f"(CAST('0x' || substr(md5({key_sql}), 1, 4) AS BIGINT) / 65536.0)"


def _int8(key_sql, mod):
    return f"(CAST('0x' || substr(md5({key_sql}), 1, 8) AS BIGINT) % {mod})"


def _keep_part(epochs: int, trained: str) -> str:
    """From tokens to pairs and initial vectors; ``targets`` and ``pairs`` of the epochs that
    the condition ``trained`` names."""
    return f""",
cs AS (SELECT count(*) AS c FROM tokens),
tf AS (SELECT t.*, v.freq, v.freq / ({SAMPLE!r} * cs.c) AS r FROM tokens t JOIN vocab v USING (word), cs),
kept AS (
  SELECT e.epoch, tf.doc_id, tf.line_no, tf.pos, tf.word FROM tf,
         (SELECT CAST(unnest(range({epochs})) AS INTEGER) AS epoch) e
  WHERE (sqrt(r) + 1) / r >= {_u16(f"'{SEED}|keep|' || e.epoch || '|' || tf.doc_id || '|' || tf.line_no || '|' || tf.pos")}
),
info AS (
  SELECT doc_id, line_no, n_tokens,
         coalesce(sum(n_tokens) OVER (ORDER BY doc_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_base
  FROM (SELECT doc_id, line_no,
               CAST(len(list_filter(regexp_split_to_array(line, '[ \t\n\r\f]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
        FROM lines)
),
ranked AS (
  SELECT k.*, CAST((row_number() OVER (PARTITION BY epoch, doc_id, line_no ORDER BY pos) - 1) // {MAX_LEN} AS INTEGER) AS chunk
  FROM kept k
),
chunks AS (
  SELECT r.epoch, r.doc_id, r.line_no, r.chunk, list(r.word ORDER BY r.pos) AS words,
         CAST(count(*) AS INTEGER) AS n_words,
         CAST(r.epoch * (SELECT c FROM cs) + i.line_base +
           CASE WHEN count(*) = {MAX_LEN} THEN max(r.pos) + 1 ELSE i.n_tokens END AS BIGINT) AS tokens_seen
  FROM ranked r JOIN info i USING (doc_id, line_no)
  GROUP BY r.epoch, r.doc_id, r.line_no, r.chunk, i.line_base, i.n_tokens
),
targets AS (
  SELECT epoch, doc_id, line_no, chunk, words, target_pos, words[target_pos + 1] AS target,
         CAST({WINDOW} - {_int8(f"'{SEED}|window|' || epoch || '|' || doc_id || '|' || line_no || '|' || chunk || '|' || target_pos", WINDOW)} AS INTEGER) AS width
  FROM (SELECT *, CAST(unnest(range(len(words))) AS INTEGER) AS target_pos FROM chunks WHERE {trained})
),
pairs AS (
  SELECT epoch, doc_id, line_no, chunk, target_pos, context_pos, target, words[context_pos + 1] AS context
  FROM (SELECT *, CAST(unnest(range(greatest(0, target_pos - width), least(len(words) - 1, target_pos + width) + 1)) AS INTEGER) AS context_pos
        FROM targets)
  WHERE context_pos <> target_pos
),
initv AS (
  SELECT word, list_transform(range({DIM_SMALL}), lambda i:
      (((CAST('0x' || substr(md5('{SEED}|init|' || word || '|' || (i // 8)), CAST((i % 8) * 4 + 1 AS INTEGER), 4) AS BIGINT) / 65536.0) - 0.5)
       / {float(DIM_SMALL)!r})::FLOAT) AS vector
  FROM vocab
)"""


KEEP_PART = _keep_part(EPOCHS, "epoch = 0")
KEEP_SQL = VOCAB_SQL + KEEP_PART
CONV_SQL = lines_sql("conversations") + TOKENS_PART + VOCAB_PART + KEEP_PART


def _sig(x):
    e = f"exp((floor((({x}) + 6) * 83) / 1000.0 * 2 - 1) * 6)"
    return f"(CASE WHEN ({x}) <= -6 THEN 0.0 WHEN ({x}) >= 6 THEN 1.0 ELSE {e} / ({e} + 1) END)"


ORACLES.update({
    "noise_distribution": f"""WITH {VOCAB_SQL},
      w AS (SELECT word, freq, pow(CAST(freq AS DOUBLE), 0.75) AS weight FROM vocab),
      t AS (SELECT sum(weight) AS tot FROM w)
      SELECT word, freq, round(weight, 8) AS weight, round(weight / tot, 14) AS share,
             round(sum(weight) OVER (ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / tot, 12) AS cum_share
      FROM w, t""",
    "noise_draws": f"""WITH {VOCAB_SQL},
      w AS (SELECT word, pow(CAST(freq AS DOUBLE), 0.75) AS weight FROM vocab),
      d AS (SELECT word, round(sum(weight) OVER (ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                               / (SELECT sum(weight) FROM w), 12) AS cum FROM w),
      t AS (SELECT doc_id, line_no, pos, CAST(unnest(range({NOISE_DRAWS})) AS INTEGER) AS draw
            FROM tokens WHERE word IN (SELECT word FROM vocab)),
      u AS (SELECT *, CAST('0x' || substr(md5('{SEED}|noise|' || doc_id || '|' || line_no || '|' || pos || '|' || draw), 1, 8) AS BIGINT)
                      / 4294967296.0 AS u FROM t)
      SELECT doc_id, line_no, pos, draw, d.word AS noise_word FROM u ASOF JOIN d ON u.u < d.cum""",
    "keep_probability": f"""WITH {VOCAB_SQL}, cs AS (SELECT count(*) AS c FROM tokens),
      v AS (SELECT word, freq, freq / ({SAMPLE!r} * c) AS r FROM vocab, cs)
      SELECT word, freq, least(1.0, (sqrt(r) + 1) / r) AS keep_prob FROM v""",
    "subsample": f"WITH {KEEP_SQL} SELECT doc_id, line_no, pos, word FROM kept WHERE epoch = 0",
    "epoch_tokens": f"WITH {KEEP_SQL} SELECT * FROM kept",
    "sentence_chunks": f"WITH {KEEP_SQL} SELECT epoch, doc_id, line_no, chunk, words FROM chunks",
    "chunk_progress": f"WITH {KEEP_SQL} SELECT epoch, doc_id, line_no, chunk, n_words, tokens_seen FROM chunks",
    "learning_rate": f"""WITH {KEEP_SQL}
      SELECT epoch, doc_id, line_no, chunk, tokens_seen,
             greatest({ALPHA!r} * (1.0 - tokens_seen / CAST({EPOCHS} * (SELECT c FROM cs) + 1 AS DOUBLE)),
                      {ALPHA * 1e-4!r}) AS alpha FROM chunks""",
    "window_width": f"WITH {KEEP_SQL} SELECT epoch, doc_id, line_no, chunk, target_pos, width FROM targets",
    "skipgram_pairs": f"WITH {KEEP_SQL} SELECT * FROM pairs",
    "init_vectors": f"WITH {KEEP_SQL} SELECT * FROM initv",
    "cbow_context": f"""WITH {KEEP_SQL},
      nb AS (SELECT p.epoch, p.doc_id, p.line_no, p.chunk, p.target_pos, p.target,
                    list(v.vector ORDER BY p.context_pos) AS vs
             FROM pairs p JOIN initv v ON v.word = p.context GROUP BY ALL)
      SELECT epoch, doc_id, line_no, chunk, target_pos, target, CAST(len(vs) AS INTEGER) AS n_context,
             list_transform(list_reduce(vs, lambda acc, v: list_transform(list_zip(acc, v), lambda p: (p[1] + p[2])::FLOAT)),
                            lambda x: (x::DOUBLE * (1.0 / len(vs)))::FLOAT) AS mean
      FROM nb""",
    "vector_lookup": f"""WITH {KEEP_SQL},
      bl AS (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS line FROM benchmark WHERE text IS NOT NULL),
      bw AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS word FROM bl)
      SELECT v.word AS query, v.vector FROM initv v JOIN bw USING (word)""",
})

ORACLES["huffman_classes"] = f"WITH {VOCAB_SQL} SELECT freq, count(*) AS n_words FROM vocab GROUP BY freq"


# ---- logistic table and batch-step oracles

STEP_SQL = CONV_SQL + f""",
lcodes AS (SELECT CAST(greatest(1, ceil(log2(count(*)))) AS INTEGER) AS width FROM vocab),
codes AS (SELECT word, freq, lpad(bin(row_number() OVER (ORDER BY freq DESC, word) - 1), width, '0') AS code
          FROM vocab, lcodes),
nodes AS (SELECT DISTINCT substr(code, 1, CAST(k AS INTEGER)) AS node_id
          FROM (SELECT code, unnest(range(len(code))) AS k FROM codes)),
initn AS (
  SELECT node_id, list_transform(range({DIM_SMALL}), lambda i:
      (((CAST('0x' || substr(md5('{SEED}|init|node:' || node_id || '|' || (i // 8)), CAST((i % 8) * 4 + 1 AS INTEGER), 4) AS BIGINT) / 65536.0) - 0.5)
       / {float(DIM_SMALL)!r})::FLOAT) AS vector
  FROM nodes
)"""


def _step_out(terms_sql, node_delta, word_delta):
    """Apply summed deltas: new = old (float, as double) + sum, rounded."""
    return f"""{terms_sql},
      dn AS (SELECT node_id, i, sum(x::DOUBLE) AS s
             FROM (SELECT node_id, unnest({node_delta}) AS x, unnest(range(len({node_delta}))) AS i FROM terms)
             GROUP BY node_id, i),
      dw AS (SELECT context, i, sum(x::DOUBLE) AS s
             FROM (SELECT context, unnest({word_delta}) AS x, unnest(range(len({word_delta}))) AS i FROM wterms)
             GROUP BY context, i)
      SELECT 'n' AS kind, dn.node_id AS key, list(round(n.vector[dn.i + 1]::DOUBLE + dn.s, 6) ORDER BY dn.i) AS vector
      FROM dn JOIN initn n USING (node_id) GROUP BY dn.node_id
      UNION ALL
      SELECT 'w' AS kind, dw.context AS key, list(round(v.vector[dw.i + 1]::DOUBLE + dw.s, 6) ORDER BY dw.i) AS vector
      FROM dw JOIN initv v ON v.word = dw.context GROUP BY dw.context"""


def _g(x, alpha=ALPHA):
    f = _sig(x)
    return f"(CASE WHEN {f} = 0.0 OR {f} = 1.0 THEN 0.0 ELSE (1.0 - bit - {f}) * {alpha} END)"


HS_TERMS = f"""WITH {STEP_SQL},
      pn AS (SELECT context, code, CAST(unnest(range(len(code))) AS INTEGER) AS step
             FROM pairs p JOIN codes c ON c.word = p.target),
      pv AS (SELECT pn.context, substr(code, 1, step) AS node_id, CAST(substr(code, step + 1, 1) AS INTEGER) AS bit,
                    v.vector AS v, n.vector AS u
             FROM pn JOIN initv v ON v.word = pn.context JOIN initn n ON n.node_id = substr(code, 1, step)),
      gv AS (SELECT *, {_g(_dot('v', 'u'))} AS g FROM pv),
      terms AS (SELECT node_id, context, list_transform(v, lambda a: (a::DOUBLE * g)::FLOAT) AS du,
                       list_transform(u, lambda a: (a::DOUBLE * g)::FLOAT) AS dv FROM gv),
      wterms AS (SELECT * FROM terms)"""

CBOW_TERMS = f"""WITH {STEP_SQL},
      nb AS (SELECT p.epoch, p.doc_id, p.line_no, p.chunk, p.target_pos, p.target,
                    list(v.vector ORDER BY p.context_pos) AS vs
             FROM pairs p JOIN initv v ON v.word = p.context GROUP BY ALL),
      cc AS (SELECT epoch, doc_id, line_no, chunk, target_pos, target,
                    list_transform(list_reduce(vs, lambda acc, v: list_transform(list_zip(acc, v), lambda p: (p[1] + p[2])::FLOAT)),
                                   lambda x: (x::DOUBLE * (1.0 / len(vs)))::FLOAT) AS h FROM nb),
      pn AS (SELECT cc.*, code, CAST(unnest(range(len(code))) AS INTEGER) AS step
             FROM cc JOIN codes c ON c.word = cc.target),
      pv AS (SELECT pn.*, substr(code, 1, step) AS node_id, CAST(substr(code, step + 1, 1) AS INTEGER) AS bit,
                    n.vector AS u
             FROM pn JOIN initn n ON n.node_id = substr(code, 1, step)),
      gv AS (SELECT *, {_g(_dot('h', 'u'))} AS g FROM pv),
      terms AS (SELECT *, list_transform(h, lambda a: (a::DOUBLE * g)::FLOAT) AS du,
                       list_transform(u, lambda a: (a::DOUBLE * g)::FLOAT) AS e FROM gv),
      err AS (SELECT epoch, doc_id, line_no, chunk, target_pos,
                     list_reduce(list(e ORDER BY step), lambda acc, v: list_transform(list_zip(acc, v), lambda p: (p[1] + p[2])::FLOAT)) AS err
              FROM terms GROUP BY ALL),
      wterms AS (SELECT p.context, err.err FROM pairs p JOIN err USING (epoch, doc_id, line_no, chunk, target_pos))"""

ORACLES.update({
    "sigmoid": f"""SELECT vec_id, x, round({_sig('x')}, 6) AS f_table, round(1.0 / (1.0 + exp(-x)), 6) AS f_exact
        FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda v: v::DOUBLE)) * 4 AS x FROM embeddings)""",
    "hs_batch_step": _step_out(HS_TERMS, "du", "dv"),
    "cbow_batch_step": _step_out(CBOW_TERMS, "du", "err"),
})


# Optimal Huffman cost by the two-queue method (leaves ascending, merged
# weights appear in ascending order): a recursive CTE whose state keeps only
# the queue of merged weights not yet taken.
HUFFMAN_COST_SQL = "WITH RECURSIVE " + VOCAB_SQL.lstrip() + """,
leaves AS (SELECT list(freq ORDER BY freq) AS l, count(*) AS v FROM vocab),
h(step, i, m, cost) AS (
  SELECT 0, 1, []::BIGINT[], 0::BIGINT
  UNION ALL
  SELECT step + 1, i2 + CASE WHEN b_from_l THEN 1 ELSE 0 END,
         list_append(m[1 + ka + CASE WHEN b_from_l THEN 0 ELSE 1 END:], a + b), cost + a + b
  FROM (SELECT h.*, leaves.l, leaves.v,
               (i <= leaves.v AND (len(m) < 1 OR leaves.l[i] <= m[1])) AS a_from_l
        FROM h, leaves WHERE step < leaves.v - 1) s1,
  LATERAL (SELECT CASE WHEN a_from_l THEN l[i] ELSE m[1] END AS a,
                  CASE WHEN a_from_l THEN i + 1 ELSE i END AS i2,
                  CASE WHEN a_from_l THEN 0 ELSE 1 END AS ka) p1,
  LATERAL (SELECT (i2 <= v AND (len(m) < ka + 1 OR l[i2] <= m[ka + 1])) AS b_from_l) p2,
  LATERAL (SELECT CASE WHEN b_from_l THEN l[i2] ELSE m[ka + 1] END AS b) p3
)
SELECT (SELECT cost FROM h ORDER BY step DESC LIMIT 1) AS cost, (SELECT count(*) FROM vocab) AS n_words"""

ORACLES["huffman_cost"] = HUFFMAN_COST_SQL


# Huffman codes by the same two-queue procedure, recording each step's picks:
# leaves (ascending freq, then word) before merged nodes on equal weight,
# merged nodes first-in first-out, first pick = bit 0. This is the tie rule of
# operators/huffman.py, so codes must agree exactly. Codes are then assigned
# from the root down.
HUFFMAN_TREE_PART = """,
lv AS (SELECT word, freq, row_number() OVER (ORDER BY freq, word) AS li FROM vocab),
leaves AS (SELECT list(freq ORDER BY li) AS l, count(*) AS v FROM lv),
h(step, i, mj, m, a_l, a_id, b_l, b_id) AS (
  SELECT 0, 1, 0, []::BIGINT[], NULL::BOOLEAN, NULL::BIGINT, NULL::BOOLEAN, NULL::BIGINT
  UNION ALL
  SELECT step + 1, i2 + CASE WHEN b_from_l THEN 1 ELSE 0 END,
         mj + ka + CASE WHEN b_from_l THEN 0 ELSE 1 END,
         list_append(m[1 + ka + CASE WHEN b_from_l THEN 0 ELSE 1 END:], a + b),
         a_from_l, CASE WHEN a_from_l THEN i ELSE mj END,
         b_from_l, CASE WHEN b_from_l THEN i2 ELSE mj + ka END
  FROM (SELECT h.step, h.i, h.mj, h.m, leaves.l, leaves.v,
               (h.i <= leaves.v AND (len(h.m) < 1 OR leaves.l[h.i] <= h.m[1])) AS a_from_l
        FROM h, leaves WHERE h.step < leaves.v - 1) s1,
  LATERAL (SELECT CASE WHEN a_from_l THEN l[i] ELSE m[1] END AS a,
                  CASE WHEN a_from_l THEN i + 1 ELSE i END AS i2,
                  CASE WHEN a_from_l THEN 0 ELSE 1 END AS ka) p1,
  LATERAL (SELECT (i2 <= v AND (len(m) < ka + 1 OR l[i2] <= m[ka + 1])) AS b_from_l) p2,
  LATERAL (SELECT CASE WHEN b_from_l THEN l[i2] ELSE m[ka + 1] END AS b) p3
),
tree AS (SELECT step - 1 AS node, a_l, a_id, b_l, b_id FROM h WHERE step > 0),
walk(is_leaf, id, code) AS (
  SELECT false, max(node), '' FROM tree
  UNION ALL
  SELECT CASE WHEN bit.b = 0 THEN t.a_l ELSE t.b_l END,
         CASE WHEN bit.b = 0 THEN t.a_id ELSE t.b_id END,
         w.code || CAST(bit.b AS VARCHAR)
  FROM walk w JOIN tree t ON NOT w.is_leaf AND t.node = w.id, (VALUES (0), (1)) bit(b)
),
hcodes AS (SELECT lv.word, lv.freq, w.code, CAST(len(w.code) AS INTEGER) AS code_len
           FROM walk w JOIN lv ON w.is_leaf AND lv.li = w.id)"""
HUFFMAN_TREE_SQL = "WITH RECURSIVE " + VOCAB_SQL.lstrip() + HUFFMAN_TREE_PART

ORACLES["huffman_codes"] = HUFFMAN_TREE_SQL + " SELECT * FROM hcodes"
ORACLES["huffman_paths"] = HUFFMAN_TREE_SQL + """,
steps AS (SELECT word, code, CAST(unnest(range(len(code))) AS INTEGER) AS step FROM hcodes)
SELECT word, step, substr(code, 1, step) AS node_id, CAST(substr(code, step + 1, 1) AS INTEGER) AS bit FROM steps"""


# ---- synchronous training, replayed step by step

def _sums(key, terms, delta, times="1"):
    """Elementwise sums of the float vectors ``delta`` of a terms table, by key."""
    each = ", ".join(f"sum(({delta})[{i}]::DOUBLE * {times})" for i in range(1, DIM_SMALL + 1))
    return f"(SELECT {key} AS key, [{each}] AS s FROM {terms} GROUP BY {key})"


def _stepped(table, key, sums):
    """The vectors of ``table``, float, with the sums added to them."""
    return f"""(SELECT t.{key}, CASE WHEN d.s IS NULL THEN t.vector ELSE
                 list_transform(list_zip(t.vector, d.s), lambda p: (p[1]::DOUBLE + p[2])::FLOAT) END AS vector
          FROM {table} t LEFT JOIN {sums} d ON d.key = t.{key})"""


def _sync_sql(method: str) -> str:
    sql = "WITH RECURSIVE " + lines_sql("conversations").lstrip() + TOKENS_PART + VOCAB_PART \
        + _keep_part(EPOCHS_SYNC, "true") + HUFFMAN_TREE_PART + f""",
steps AS MATERIALIZED (
  SELECT word, step, substr(code, 1, step) AS node_id, CAST(substr(code, step + 1, 1) AS INTEGER) AS bit
  FROM (SELECT word, code, CAST(unnest(range(len(code))) AS INTEGER) AS step FROM hcodes)),
dealt AS MATERIALIZED (
  SELECT *, {_int8(f"'{SEED}|batch|' || epoch || '|' || doc_id || '|' || line_no || '|' || chunk", BATCHES_SYNC)} AS batch FROM pairs),
w0 AS MATERIALIZED (SELECT * FROM initv),
n0 AS MATERIALIZED (
  SELECT DISTINCT node_id, list_transform(range({DIM_SMALL}), lambda i: 0::FLOAT) AS vector FROM steps)"""
    for t in range(EPOCHS_SYNC * BATCHES_SYNC):
        e, b = divmod(t, BATCHES_SYNC)
        seen = f"({e} * c + c * {b} // {BATCHES_SYNC})"
        rate = f"greatest({ALPHA!r} * (1.0 - {seen} / CAST({EPOCHS_SYNC} * c + 1 AS DOUBLE)), {ALPHA * 1e-4!r})"
        sql += f""",
rate{t} AS (SELECT {rate} AS alpha FROM cs),
own{t} AS MATERIALIZED (SELECT * FROM dealt WHERE epoch = {e} AND batch = {b})"""
        if method == "skip_gram":
            sql += f""",
x{t} AS MATERIALIZED (
  SELECT p.context, s.node_id, s.bit, p.times, v.vector AS v, n.vector AS u, {_dot('v.vector', 'n.vector')} AS x
  FROM (SELECT context, node_id, bit, count(*) AS times FROM own{t} JOIN steps ON word = target GROUP BY ALL) p
  JOIN (SELECT DISTINCT node_id, bit FROM steps) s USING (node_id, bit)
  JOIN w{t} v ON v.word = p.context JOIN n{t} n ON n.node_id = s.node_id),
terms{t} AS MATERIALIZED (
  SELECT context, node_id, times, list_transform(v, lambda a: (a::DOUBLE * g)::FLOAT) AS du,
         list_transform(u, lambda a: (a::DOUBLE * g)::FLOAT) AS dv
  FROM (SELECT *, {_g('x', 'alpha')} AS g FROM (SELECT x{t}.*, alpha FROM x{t}, rate{t}))),
n{t + 1} AS MATERIALIZED {_stepped(f'n{t}', 'node_id', _sums('node_id', f'terms{t}', 'du', 'times'))},
w{t + 1} AS MATERIALIZED {_stepped(f'w{t}', 'word', _sums('context', f'terms{t}', 'dv', 'times'))}"""
        else:
            sql += f""",
ctx{t} AS MATERIALIZED (
  SELECT doc_id, line_no, chunk, target_pos, target,
         list_transform(list_reduce(vs, lambda acc, v: list_transform(list_zip(acc, v), lambda p: (p[1] + p[2])::FLOAT)),
                        lambda x: (x::DOUBLE * (1.0 / len(vs)))::FLOAT) AS h
  FROM (SELECT doc_id, line_no, chunk, target_pos, target, list(v.vector ORDER BY context_pos) AS vs
        FROM own{t} JOIN w{t} v ON v.word = context GROUP BY ALL)),
x{t} AS MATERIALIZED (
  SELECT c.*, s.step, s.node_id, s.bit, n.vector AS u, {_dot('c.h', 'n.vector')} AS x
  FROM ctx{t} c JOIN steps s ON s.word = c.target JOIN n{t} n ON n.node_id = s.node_id),
terms{t} AS MATERIALIZED (
  SELECT * EXCLUDE (h, u), list_transform(h, lambda a: (a::DOUBLE * g)::FLOAT) AS du,
         list_transform(u, lambda a: (a::DOUBLE * g)::FLOAT) AS e
  FROM (SELECT *, {_g('x', 'alpha')} AS g FROM (SELECT x{t}.*, alpha FROM x{t}, rate{t}))),
errs{t} AS MATERIALIZED (
  SELECT p.context, r.err FROM own{t} p JOIN (
    SELECT doc_id, line_no, chunk, target_pos,
           list_reduce(list(e ORDER BY step), lambda acc, v: list_transform(list_zip(acc, v), lambda p: (p[1] + p[2])::FLOAT)) AS err
    FROM terms{t} GROUP BY ALL) r USING (doc_id, line_no, chunk, target_pos)),
n{t + 1} AS MATERIALIZED {_stepped(f'n{t}', 'node_id', _sums('node_id', f'terms{t}', 'du'))},
w{t + 1} AS MATERIALIZED {_stepped(f'w{t}', 'word', _sums('context', f'errs{t}', 'err'))}"""
    last = EPOCHS_SYNC * BATCHES_SYNC
    return sql + f"""
SELECT 'n' AS kind, node_id AS key, list_transform(vector, lambda a: round(a::DOUBLE, 6) + 0.0) AS vector FROM n{last}
UNION ALL
SELECT 'w', word, list_transform(vector, lambda a: round(a::DOUBLE, 6) + 0.0) FROM w{last}"""


ORACLES["train_skip_gram_sync"] = _sync_sql("skip_gram")
ORACLES["train_cbow_sync"] = _sync_sql("cbow")
