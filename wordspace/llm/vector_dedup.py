"""Embedding near-dedup through a subspace pigeonhole join.

Vectors of unit length with cosine ``c`` or more lie within a squared distance of
``2 - 2c``. A rotation (principal axes of a bounded sample) leaves distances as they are.
Its axes are split into blocks of ``BLOCK_DIMS`` dimensions, and each block gets a share
of the squared distance in proportion to its variance. If a pair's squared distance in
every block were over the block's share, the whole would be over the sum: so a linked
pair is within the share of at least one block.

Each block is one range join: rows are put in a grid over the block's first
``GRID_DIMS`` axes, with cells as wide as the block's radius. A row goes to its own cell
and to the next one up on each axis (its neighbours meet it there), and a pair is looked
at in one cell only. The task of a cell takes pairs within the block's share as
candidates, counts a pair only in the first block whose share it meets (the union), and
verifies candidates by their cosine in double precision.

Equal vectors are one entry with a count (a partial aggregate). A cell with more than
``CELL_ROWS`` rows is cut into parts, and each pair of parts is a cell of its own in any
task. Tasks return counts of links by vector and a spanning forest of the links, never
pairs, so a group of thousands of near copies gives thousands of rows.

Defined results: vectors that are null, empty, all zero, or hold a null or a component
that is not finite link with nothing and name themselves. Vectors of different lengths do
not link. Rows of one id are one vector, the least of them; rows without an id link with
nothing and have a null component. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forest, prepare, whole_groups
from .components import components
from .simhash import spread_lists
from .topk import usable

BLOCK_DIMS, GRID_DIMS, CELL_ROWS, FIT_ROWS, TILE = 16, 2, 16_384, 4096, 512
#: Doubles err by less than this, in squared distances of unit vectors.
SLACK = 1e-9


def _unit(raw, kind: str) -> np.ndarray:
    """Unit vectors of packed rows (``kind``: their number type), in doubles; scaled first,
    so that no square overflows."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Blocks:
    """The rotation, the blocks' axes, and each block's share of the squared distance."""

    def __init__(self, sample: np.ndarray, cosine: float):
        dim = sample.shape[1]
        var, axes = np.linalg.eigh(sample.T @ sample)
        self.rotation = axes[:, ::-1]
        var = np.maximum(var[::-1], 0)
        n = -(-dim // BLOCK_DIMS)
        self.axes = [slice(i * dim // n, (i + 1) * dim // n) for i in range(n)]
        share = np.array([var[a].sum() for a in self.axes])
        share = np.maximum(share / max(share.sum(), 1e-300), 0.1 / n)  # none so small that its grid is a point
        self.share = (2 - 2 * cosine + SLACK) * share / share.sum() + SLACK
        self.width = np.sqrt(self.share)

    def homes(self, rotated: np.ndarray, block: int) -> np.ndarray:
        """Grid cell of each row on the block's first axes."""
        return np.floor(rotated[:, self.axes[block]][:, :GRID_DIMS] / self.width[block]).astype(np.int64)


def _screen(left: np.ndarray, right: np.ndarray, limit: float) -> np.ndarray:
    """Which pairs of a block's coordinates may lie within the squared distance ``limit``:
    one single-precision product, with more slack than its rounding needs."""
    one = np.ones((len(left), 1)), np.ones((len(right), 1))
    a = np.hstack((-2 * left, (left * left).sum(1)[:, None], one[0])).astype(np.float32)
    b = np.hstack((right, one[1], (right * right).sum(1)[:, None])).astype(np.float32)
    return a @ b.T <= np.float32(limit + 2e-5)


def verified(unit: np.ndarray, i: np.ndarray, j: np.ndarray, block: int, blocks: Blocks, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) with a cosine of ``cosine`` or more that count in this block: it is
    the first one whose share they meet (the union). A pair's figures are summed in the
    same order in every task."""
    out = []
    for at in range(0, len(i), 50_000):
        p, q = i[at:at + 50_000], j[at:at + 50_000]
        ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
        p, q = p[ok], q[ok]
        turned = np.einsum("ij,jk->ik", unit[p] - unit[q], blocks.rotation) ** 2
        met = np.stack([turned[:, a].sum(1) <= s for a, s in zip(blocks.axes, blocks.share)], axis=1)
        ok = met[:, block] & ~met[:, :block].any(axis=1)
        out.append((p[ok], q[ok]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
                 cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, n_links, component): every id once, with the number of other vectors at
    ``cosine`` or more and the smallest id reachable over such links."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0, at most 1")
    spark = vectors.sparkSession
    prepare(spark)
    of_floats = getattr(vectors.schema[vec_col].dataType, "elementType", None) == T.FloatType()
    kind = "<f4" if of_floats else "<f8"  # what goes through the shuffle holds the components exactly
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = (rows.where("id is not null").groupBy("id").agg(F.min(F.when(usable("v"), F.col("v"))).alias("v"))
            .unionByName(rows.where("id is null").select("id", F.lit(None).cast("array<double>").alias("v"))).checkpoint())
    live = rows.where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    reps = live.groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")).checkpoint()
    found = None
    for dim in sorted(r["dim"] for r in reps.select("dim").distinct().collect()):
        got = _links(reps.where(F.col("dim") == dim), kind, cosine, cell_rows)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = spark.createDataFrame([], "node long, root long, n long")
    found = found.checkpoint()
    of = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    near = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = (reps.join(near, "node", "left").join(of, "node", "left")
              .select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                      F.coalesce("component", "node").alias("component")))
    linked = live.join(groups, "v").select("id", "n_links", "component")
    alone = rows.where(F.col("v").isNull() | ~F.exists("v", lambda x: x != 0))
    return linked.unionByName(alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))


def _links(reps: DataFrame, kind: str, cosine: float, cell_rows: int) -> DataFrame:
    """(node, root, n): for each vector with links found in a task, how many vectors these
    are and the smallest one that it reaches by the task's links."""
    fit = reps.orderBy(F.xxhash64("node")).limit(FIT_ROWS).select("v").collect()
    blocks = Blocks(_unit([np.asarray(r["v"], dtype=kind).tobytes() for r in fit], kind), cosine)

    def place(batches):
        for b in batches:
            if not len(b):
                continue
            raw = [np.asarray(v, dtype=kind).tobytes() for v in b["v"]]
            rot = _unit(raw, kind) @ blocks.rotation
            for k in range(len(blocks.axes)):
                home = blocks.homes(rot, k)
                # up to the cells that rows at most a radius higher can be in
                for step in np.ndindex(*(2,) * home.shape[1]):
                    cell = home + np.array(step)
                    yield pd.DataFrame({"block": np.int32(k), "cell": [",".join(map(str, c)) for c in cell.tolist()],
                                        "up": ",".join(map(str, step)), "node": b["node"], "copies": b["copies"], "raw": raw})

    placed = reps.select("node", "copies", "v").mapInPandas(place, "block int, cell string, up string, node long, copies long, raw binary")
    cells = spread_lists(placed, ["block", "cell"], "node", cell_rows)
    keys = ["block", "cell", "ci", "cj"]

    def join(batches):
        for pdf in whole_groups(batches, keys):
            new = np.any([pdf[k].to_numpy()[1:] != pdf[k].to_numpy()[:-1] for k in keys], axis=0)
            edges = np.concatenate(([0], np.flatnonzero(new) + 1, [len(pdf)]))
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo > 1:
                    got = _join_one(pdf.iloc[lo:hi], kind, blocks, cosine)
                    if len(got):
                        yield got

    dealt = cells.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(join, "node long, root long, n long")


def _join_one(pdf: pd.DataFrame, kind: str, blocks: Blocks, cosine: float) -> pd.DataFrame:
    block = int(pdf["block"].iloc[0])
    cell = np.array([int(x) for x in pdf["cell"].iloc[0].split(",")])
    unit = _unit(list(pdf["raw"]), kind)
    rot = unit @ blocks.rotation
    # as it was placed, not computed again: a rounding must not move a row to another home
    step = {up: [int(x) for x in up.split(",")] for up in pdf["up"].unique()}
    home = cell - np.array([step[up] for up in pdf["up"]])
    node, copies, own = (pdf[c].to_numpy() for c in ("node", "copies", "own"))
    ci, cj = int(pdf["ci"].iloc[0]), int(pdf["cj"].iloc[0])
    ax = rot[:, blocks.axes[block]]
    sort = ax[:, min(GRID_DIMS, ax.shape[1] - 1)]  # tiles far apart on the next axis are skipped
    left, right = (x[np.argsort(sort[x], kind="stable")] for x in (np.flatnonzero(own == ci), np.flatnonzero(own == cj)))
    n = np.zeros(len(pdf), dtype=np.int64)
    root = np.arange(len(pdf))
    for x in range(0, len(left), TILE):
        for y in range(0, min(x + TILE, len(right)) if ci == cj else len(right), TILE):
            p, q = left[x:x + TILE], right[y:y + TILE]
            if sort[p[0]] - sort[q[-1]] > blocks.width[block] + 1e-4 or sort[q[0]] - sort[p[-1]] > blocks.width[block] + 1e-4:
                continue
            near = _screen(ax[p], ax[q], blocks.share[block])
            if ci == cj and x == y:
                near &= np.tri(len(p), len(q), -1, dtype=bool)  # one list: pairs once
            if not near.any():
                continue
            i, j = np.nonzero(near)
            i, j = p[i], q[j]
            # a pair meets in one cell: the higher of its homes on each axis
            meets = (np.maximum(home[i], home[j]) == cell).all(axis=1)
            i, j = verified(unit, i[meets], j[meets], block, blocks, cosine)
            if len(i):
                n += np.bincount(i, copies[j], len(pdf)).astype(np.int64) + np.bincount(j, copies[i], len(pdf)).astype(np.int64)
                root = forest(np.concatenate((np.arange(len(pdf)), i)), np.concatenate((root, j)), len(pdf))
    got = n > 0
    return pd.DataFrame({"node": node[got], "root": node[root[got]], "n": n[got]})


def keep_one(found: DataFrame) -> DataFrame:
    """Adds kept: whether the id names its component."""
    return found.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
