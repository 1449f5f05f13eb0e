"""Exact top-k inner products over norm-sorted vectors.

Vectors are made whole numbers, floor(scale * x). They are sorted by descending length
and cut into chunks; queries are cut into blocks the same way. A rotation by the singular
vectors of a bounded sample puts most of a product into the first coordinates.

1. The longest vectors (``HEAD_ROWS``) are scored for every query: the k-th best score is
   the query's first threshold.
2. Tasks are a grid of bands of blocks and groups of chunks, as many as there are shuffle
   partitions: a task gets its packed blocks, then its chunks one by one. A (block, chunk)
   cell is opened only if the longest query times the longest candidate can reach the
   block's smallest threshold, and a block is sent only to groups with an opened cell.
3. In a cell, candidates come by descending length. A partial sum over the first rotated
   coordinates plus the product of what is left of both lengths (Cauchy-Schwarz) bounds
   each score; partial sums grow while the bound reaches the query's threshold. The pairs
   left are multiplied out in exact whole numbers, and the threshold rises on the way.
4. Thresholds go on from one chunk of a task to the next, and a task returns k rows a query;
   the best k over the tasks are the answer.

Defined results: rows that are null, or hold a null or a component that is not finite,
take no part, nor do rows without an id. Rows of one id are one vector, the least of
them. Vectors of another length than the query's are no candidates of it. Ties go to the
smaller id. Products beyond 2**53 are computed in unbounded whole numbers and held at the
ends of a long, where they tie. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

CHUNK_ROWS, BLOCK_ROWS, HEAD_ROWS, FIT_ROWS = 2048, 512, 1024, 4096
STEP = 512
LONG = (1 << 63) - 1
EXACT = float(1 << 53)


def usable(col: str, scale: float = 1.0) -> Column:
    """Whether the array is not null, not empty and all its components, times ``scale``,
    are finite."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    return F.col(col).isNotNull() & (F.size(col) > 0) & ~bad


def _pack(ids, x: np.ndarray) -> bytes:
    """Ids and whole numbers, in two or four bytes a number where they fit."""
    top = np.abs(x).max(initial=0)
    small = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64
    return pickle.dumps((np.asarray(ids, dtype=np.int64), x.astype(small)))


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, x = pickle.loads(block)
    return ids, x.astype(np.float64)


def _whole(vectors, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, which hold these whole numbers exactly."""
    return np.floor(scale * np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products of whole numbers, as int64 held at the ends of a long."""
    size = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    out = np.zeros(len(a), dtype=np.int64)
    ok = size < EXACT
    out[ok] = np.einsum("ij,ij->i", a[ok], b[ok]).astype(np.int64)
    for i in np.flatnonzero(~ok):
        s = sum(int(x) * int(y) for x, y in zip(a[i], b[i]))
        out[i] = max(-LONG - 1, min(LONG, s))
    return out


class Best:
    """The best k (score, id) of each of n queries so far, and the threshold to reach."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((n, 0), dtype=np.int64), np.zeros((n, 0), dtype=np.int64)
        self.full = np.zeros((n, 0), dtype=bool)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        order = np.lexsort((ids, ~score, q))  # ~: larger scores first
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        keep = place < self.k
        q, score, ids, place = q[keep], score[keep], ids[keep], place[keep]
        n = len(self.score)
        s, i, f = (np.zeros((n, self.k), dtype=t) for t in (np.int64, np.int64, bool))
        s[q, place], i[q, place], f[q, place] = score, ids, True
        s, i, f = (np.concatenate(p, axis=1) for p in ((self.score, s), (self.id, i), (self.full, f)))
        order = np.lexsort((i, ~s, ~f), axis=1)[:, :self.k]
        self.score, self.id, self.full = (np.take_along_axis(x, order, axis=1) for x in (s, i, f))

    def threshold(self) -> np.ndarray:
        """The k-th best score of each query; minus infinity while there are fewer."""
        if self.score.shape[1] < self.k:
            return np.full(len(self.score), -np.inf)
        return np.where(self.full[:, -1], self.score[:, -1].astype(np.float64), -np.inf)


def search(queries: tuple[np.ndarray, np.ndarray], cands: tuple[np.ndarray, np.ndarray], rotation: np.ndarray,
           start: np.ndarray, k: int, best: Best | None = None) -> tuple[Best, int]:
    """The best k candidates of each query that can be among its best k overall, given the
    thresholds ``start`` and, in ``best``, those of other candidates; and how many pairs were
    multiplied out. Partial sums grow by an eighth or a quarter of the rotated coordinates;
    pairs that cannot reach the threshold any more are closed on the way."""
    (qid, q), (cid, c) = queries, cands
    best, opened, dim = best or Best(len(qid), k), 0, rotation.shape[0]
    q_len, c_len = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    order = np.argsort(-c_len, kind="stable")
    cid, c, c_len = cid[order], c[order], c_len[order]
    q_rot, c_rot = q @ rotation, c @ rotation
    heads = sorted({max(1, dim * i // 8) for i in (2, 4, 6, 7)})
    q_rest, c_rest = ([np.sqrt((x[:, h:] ** 2).sum(1)) for h in heads] for x in (q_rot, c_rot))
    limit = np.maximum(start, best.threshold())
    for at in range(0, len(cid), STEP):
        # doubles err by far less than this
        slack = 1e-9 * (1 + q_len * c_len[at])
        rows = np.flatnonzero(q_len * c_len[at] + slack >= limit)
        if not len(rows):
            break  # all further candidates are no longer
        cols = np.arange(at, min(at + STEP, len(cid)))
        part, done = np.zeros((len(rows), len(cols))), 0
        for h, qr, cr in zip(heads, q_rest, c_rest):
            part += q_rot[rows, done:h] @ c_rot[cols, done:h].T
            live = part + np.outer(qr[rows], cr[cols]) >= (limit - slack)[rows, None]
            up, across = live.any(axis=1), live.any(axis=0)
            rows, cols, part, live, done = rows[up], cols[across], part[np.ix_(up, across)], live[np.ix_(up, across)], h
        qi, ci = np.nonzero(live)
        qi, ci = rows[qi], cols[ci]
        other = qid[qi] != cid[ci]
        qi, ci = qi[other], ci[other]
        opened += len(qi)
        for i in range(0, len(qi), 32_768):
            a, b = qi[i:i + 32_768], ci[i:i + 32_768]
            score = _exact(q[a], c[b])
            reach = score >= (limit - slack)[a]
            best.add(a[reach], score[reach], cid[b[reach]])
        limit = np.maximum(limit, best.threshold())
    return best, opened


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vec_col: str = "embedding", chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` (a condition on the
    column ``id``) the ``k`` other rows with the largest inner products of floor(scale * x)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & usable("v", scale)).groupBy("id").agg(F.min("v").alias("v"))
            .withColumn("dim", F.size("v"))
            # a little over the length of the whole-number vector: orders and bounds
            .withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x * scale) + 1.0, F.lit(2)))))
            .checkpoint())
    sizes = {r["dim"]: (r["n"], r["asked"]) for r in
             rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("asked")).collect()}
    schema = "query_id long, vec_id long, score long"
    out = None
    for dim, (n, asked) in sorted(sizes.items()):  # lengths of vectors: one, but for odd rows
        if not asked:
            continue
        got = _top_k_of(rows.where(F.col("dim") == dim), n, asked, is_query, k, scale, chunk_rows, block_rows, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _first(rows: DataFrame, n: int, by: str, least: Column, size: int) -> list:
    """The first ``size`` of ``n`` rows (id, v) by falling ``by``, then id: what is sorted is
    (by, id) alone, so a partition sends no vectors that another one's push out."""
    rows = rows.where(least) if size < n else rows
    last = rows.select(F.col(by).alias("x"), "id").orderBy(F.desc("x"), "id").limit(size).orderBy("x", F.desc("id")).first()
    if last is None:
        return []
    x = F.lit(last["x"])
    return rows.where((F.col(by) > x) | ((F.col(by) == x) & (F.col("id") <= last["id"]))).select("id", "v").collect()


def _top_k_of(rows: DataFrame, n: int, asked: int, is_query: Column, k: int, scale: float, chunk_rows: int, block_rows: int,
              schema: str) -> DataFrame:
    """The candidates of each task's best for the ``asked`` queries among ``n`` vectors of one length."""
    spark = rows.sparkSession
    # hashes are spread evenly: about twice the sample passes (a few rows less would do as well)
    hashed = rows.withColumn("hash", F.xxhash64("id"))
    share = min(1.0, 2 * FIT_ROWS / n)
    cut = int((1 - 2 * share) * 2.0 ** 63) if share < 1 else -LONG - 1
    fit = _first(hashed, n, "hash", F.col("hash") >= F.lit(cut), FIT_ROWS)
    sample = _whole([r["v"] for r in fit], scale)
    sample /= np.abs(sample).max(initial=1.0)
    rotation = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]  # right singular vectors, largest first
    longest = _first(rows, n, "len", F.lit(True), max(HEAD_ROWS, 4 * k))
    top = (np.array([r["id"] for r in longest]), _whole([r["v"] for r in longest], scale))

    def packed(frame: DataFrame, rows_: int, size: int) -> DataFrame:
        """Rows by descending length in packed runs of about ``size``, with their largest length
        and the number of their partition."""
        def pack(batches):
            held: list[pd.DataFrame] = []

            def run(whole: pd.DataFrame):
                return pd.DataFrame({"data": [_pack(whole["id"], _whole(whole["v"], scale))], "len": [whole["len"].max()]})
            for b in batches:
                held.append(b)
                whole = pd.concat(held, ignore_index=True)
                while len(whole) >= size:
                    yield run(whole.iloc[:size])
                    whole = whole.iloc[size:].reset_index(drop=True)
                held = [whole] if len(whole) else []
            if held and sum(map(len, held)):
                yield run(pd.concat(held, ignore_index=True))
        parts = max(1, -(-rows_ // size))
        dealt = frame.select("id", "v", "len").repartitionByRange(parts, F.desc("len"), "id").sortWithinPartitions(F.desc("len"), "id")
        return dealt.mapInPandas(pack, "data binary, len double").withColumn("place", F.spark_partition_id())

    chunks = packed(rows, n, chunk_rows).checkpoint()
    # a block goes to every group and a chunk to every band: least bytes for the number of tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(-(-n // chunk_rows), math.ceil(math.sqrt(parts * n / asked))))
    bands = max(1, min(-(-asked // block_rows), -(-parts // groups)))
    group = (F.col("place") % groups).alias("group")
    # whether a group has an open cell is decided on one number a group
    lens = {r["group"]: r["len"] for r in chunks.groupBy(group).agg(F.max("len").alias("len")).collect()}

    def send(batches):
        for b in batches:
            for block, q_len, place in zip(b["data"], b["len"], b["place"]):
                ids, q = _unpack(block)
                limit = search((ids, q), top, rotation, np.full(len(ids), -np.inf), k)[0].threshold()
                data = pickle.dumps((block, q_len, limit))
                for g, c_len in lens.items():
                    if not q_len * c_len * (1 + 1e-9) < limit.min():
                        yield pd.DataFrame({"part": [place % bands * groups + g], "kind": [0], "place": [place], "len": [q_len], "data": [data]})

    row = "part int, kind int, place int, len double, data binary"
    blocks = packed(rows.where(is_query), asked, block_rows).mapInPandas(send, row)
    sent = chunks.select(F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), group, "place", "len", "data").select(
        (F.col("band") * groups + F.col("group")).cast("int").alias("part"), F.lit(1).alias("kind"), "place", "len", "data")

    def score(batches):
        now, held = None, []

        def found():
            for ids, _, _, _, best in held:
                at = np.nonzero(best.full)
                yield pd.DataFrame({"query_id": ids[at[0]], "vec_id": best.id[at], "score": best.score[at]})
        for b in batches:
            for part, kind, c_len, data in zip(b["part"], b["kind"], b["len"], b["data"]):
                if part != now:
                    yield from found()
                    now, held = part, []
                if not kind:
                    block, q_len, limit = pickle.loads(data)
                    ids, q = pickle.loads(block)
                    held.append((ids, q, q_len, limit, Best(len(ids), k)))
                    continue
                chunk = _unpack(data) if held else None
                for ids, q, q_len, limit, best in held:
                    if not q_len * c_len * (1 + 1e-9) < np.maximum(limit, best.threshold()).min():
                        search((ids, q.astype(np.float64)), chunk, rotation, limit, k, best)
        yield from found()

    # dealt by task number: no side is small enough to be sent whole to every task
    both = blocks.unionByName(sent).repartitionById(groups * bands, "part").sortWithinPartitions("part", "kind", F.desc("len"))
    return both.mapInPandas(score, schema)
