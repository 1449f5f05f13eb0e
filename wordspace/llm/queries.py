"""Registered queries of this subpackage, name -> (spark, sf_dir) -> DataFrame, and the
DuckDB SQL of those that SQL can express. Each runs its operator with production
parameters over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from . import codes, contamination, line_dedup, mixing, packing, phrases, pieces, quality, sharding, simhash, topk, toxicity, vector_dedup
from .common import read
from .labelled import held_out


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model learnt from ids outside fold 0 of 5, applied to every text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"), "toxic", folds=5, fold=0)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op2_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids as packed matrices of rows of 2048."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), row_tokens=2048)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2 in turn and share 150 % of all words, two passes at most."""
    mix = mixing.mix_sources(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, repeat=2)
    return mixing.taken(mix)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest inner products of every row whose vec_id 50 divides."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256.0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least 5 documents share go, except in the largest doc_id."""
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT r, doc_id, p, line, lower_az FROM (
    SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM (
      SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
    LATERAL (SELECT translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az)),
shared AS (
  SELECT lower_az AS k, max(doc_id) AS last FROM lines WHERE length(lower_az) >= 40
  GROUP BY lower_az HAVING count(DISTINCT r) >= 5),
marked AS (
  SELECT r, lines.doc_id, p, line, k IS NOT NULL AND lines.doc_id <> last AS gone
  FROM lines LEFT JOIN shared ON lower_az = k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at a cosine of 0.95 or more."""
    found = vector_dedup.keep_one(vector_dedup.near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.95))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN counted ON counted.a = vec_id
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules learnt from ids outside fold 1 of 3, applied to every text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"), "quality", folds=3, fold=1)
    return quality.score_quality(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, and whether they decode to the text again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.encode(docs, decoded=True)
    return both.select("doc_id", F.size("ids").alias("n_ids"), "ids",
                       (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 runs of equal counts along the curve."""
    out = sharding.hilbert_shards(read(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over 3-word shingles, linked at 3 or fewer differing bits."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, max_bits=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words inside verbatim windows of 10 words of the benchmark's items."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.find_contamination(docs, read(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM documents),
item AS (
  SELECT row_number() OVER () AS i, item_id, [x FOR x IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM benchmark),
wide AS (SELECT *, least(10, len(ws)) AS w FROM item WHERE len(ws) > 0),
wanted AS (
  SELECT DISTINCT item_id, w, array_to_string(ws[p:p + w - 1], ' ') AS win
  FROM (SELECT item_id, w, ws, unnest(range(1, len(ws) - w + 2)) AS p FROM wide)),
have AS (
  SELECT r, w, p, array_to_string(ws[p:p + w - 1], ' ') AS win
  FROM (SELECT r, w, ws, unnest(range(1, len(ws) - w + 2)) AS p FROM doc, (SELECT DISTINCT w FROM wide) WHERE len(ws) >= w)),
occurs AS (SELECT r, p, have.w, item_id FROM have JOIN wanted ON have.w = wanted.w AND have.win = wanted.win),
hit AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + w)) AS q FROM occurs) GROUP BY r),
named AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM occurs) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of 2 to 5 words with 100 occurrences or more."""
    docs = read(spark, sf_dir, "documents").select("lang", "text")
    return phrases.collocations(docs, max_words=5, min_count=100, percent=100, top=2000)


OP12_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS i, lang, ws FROM (
    SELECT lang, [w FOR w IN string_split_regex(piece, '[\x20\x09]+') IF w <> ''] AS ws FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))),
total AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, k, array_to_string(g, ' ') AS phrase, count(*)::HUGEINT AS c, any_value(g) AS g FROM (
    SELECT lang, k, ws[p:p + k - 1] AS g FROM (
      SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k))
  GROUP BY lang, k, phrase HAVING count(*) >= 100),
inner_ AS (
  SELECT lang, array_to_string(g[p:p + m - 1], ' ') AS phrase, max(c) AS longest FROM (
    SELECT lang, g, c, k, m, unnest(range(1, k - m + 2)) AS p FROM f, (SELECT unnest(range(2, 5)) AS m) WHERE k > m)
  GROUP BY lang, phrase),
cuts AS (
  SELECT f.lang, f.phrase, f.c AS a, n, j, l.c AS l, r.c AS r, 1000 * f.c * n // (l.c * r.c) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k >= 2) f
  JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(f.g[1:j], ' ')
  JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(f.g[j + 1:f.k], ' ')
  JOIN total ON total.lang = f.lang
  LEFT JOIN inner_ ON inner_.lang = f.lang AND inner_.phrase = f.phrase
  WHERE longest IS NULL OR 100 * longest < 100 * f.c),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 4 parts from codebooks of 256 entries, improved in 4 rounds."""
    rows = read(spark, sf_dir, "embeddings")
    model = codes.fit_codebooks(rows, parts=4, entries=256, rounds=4, scale=1024.0)
    coded = codes.encode(rows, model).select("vec_id", "label", "codes", "error", F.size("embedding").alias("dim")).checkpoint()
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(codes.LONG).cast("decimal(38,0)"))
    sums = coded.groupBy(key).agg(total.cast("long").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    digests = {d: model.digest(d) for d in model.books}
    sha = F.lit(None).cast("string")
    for dim, digest in digests.items():
        sha = F.when(F.col("dim") == dim, F.lit(digest)).otherwise(sha)
    return (lookup_join(coded.select("*", key), sums, "key", weight="rows")
            .select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", sha.alias("codebooks_sha256")))


def _op13_sql(dim: int = 64, parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds written out; whole numbers up to 2**53 are exact in doubles."""
    d = dim // parts
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
part AS MATERIALIZED (
  SELECT r, p, v[p * {d} + 1:p * {d} + {d}] AS x FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM part WHERE r <= {entries}),"""
    for k in range(rounds + 1):
        sql += f"""
near{k} AS MATERIALIZED (
  SELECT r, part.p, arg_min(struct_pack(e := e, s := s), s * {entries} + e) AS b
  FROM part JOIN (SELECT *, list_dot_product(c, c) AS cc FROM book{k}) b ON part.p = b.p,
       LATERAL (SELECT list_dot_product(x, x) - 2 * list_dot_product(x, c) + cc AS s) GROUP BY r, part.p),"""
        if k < rounds:
            sql += f"""
mean{k} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY j) AS c FROM (
    SELECT p, e, j, floor(sum(t) / count(*)) AS m
    FROM (SELECT p, b.e AS e, unnest(x) AS t, unnest(range({d})) AS j FROM near{k} JOIN part USING (r, p)) GROUP BY p, e, j)
  GROUP BY p, e),
book{k + 1} AS MATERIALIZED (
  SELECT book{k}.p, book{k}.e, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e)),"""
    return sql + f"""
coded AS (
  SELECT r, string_agg(printf('%02x', b.e::INTEGER), '' ORDER BY p) AS code, sum(b.s)::BIGINT AS error FROM near{rounds} GROUP BY r),
sha AS (
  SELECT sha256(string_agg(n, ',' ORDER BY p, e, j)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(range({d})) AS j, unnest(c)::BIGINT::VARCHAR AS n FROM book{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), sha
"""


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pack_tokens, op3_mix_sources, op4_top_k, op5_line_dedup, op6_vector_dedup, op7_quality, op8_sentencepiece, op9_hilbert_shards, op10_simhash,
                                  op11_decontaminate, op12_collocations, op13_vector_codes)}
ORACLES = {"op4_top_k": OP4_SQL, "op5_line_dedup": OP5_SQL, "op6_vector_dedup": OP6_SQL,
           "op11_decontaminate": OP11_SQL, "op12_collocations": OP12_SQL,
           "op13_vector_codes": _op13_sql()}
