"""Vector code compression (product codes) through memoised grid cells.

Components become whole numbers, floor(scale * x). Vectors are cut into equal parts; each
part position has a codebook, and a vector's code is the index of the nearest entry of
each part.

1. The codebooks start as the parts of the first vectors by id and are improved by rounds
   of assignment and averaging (whole numbers, rounded down).
2. To find the nearest entry of a part, its coarse cell (components divided by ``cell``) is
   looked up in the task's memo. For a new cell, the smallest and largest squared distance
   from its box to every entry are summed from tables of one row a coordinate; an entry
   whose smallest distance exceeds the least largest distance can be nearest nowhere in the
   box. The entries left are kept for the cell.
3. Only these are evaluated exactly; ties go to the smaller index. Equal and similar parts
   share a cell, so copies cost a lookup and a few distances.
4. A round's sums are kept per task and met in partial sums by (part, run of entries); the
   codebooks alone (parts x entries, a stated size) pass through the driver. Vectors are
   scanned in place, never shuffled.

Defined results: rows whose vector is null or holds a null or a component that is not
finite are dropped. Vectors of different lengths are compressed apart, each length with
codebooks of its own; a length that does not divide by ``parts`` gives the first parts one
component more. Rows that repeat an id are rows of their own; equal ids are ordered by
their vectors, null ids come last. Fewer rows than entries give fewer entries. Whole numbers
of any size are held exactly; an error beyond a long is held at its end. An empty table gives
an empty result. Extra columns pass through ``encode``; ``codes`` and ``error`` replace
columns of those names.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

CELL = 32             # width of a coarse cell, in whole numbers
MEMO_CELLS = 50_000   # cells that a task keeps per part before it starts anew
PAIRS = 1 << 18       # exact distances at a time
CELLS = 256           # new cells summed at a time
RUN = 16              # entries of one partial sum
LONG = (1 << 63) - 1


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): int64, or unbounded whole numbers where these are too large."""
    with np.errstate(over="ignore"):
        y = np.floor(values * scale)
    if not y.size or np.abs(y).max() < 1 << 52:
        return y.astype(np.int64)
    flat = [math.floor(Fraction(float(x)) * Fraction(scale)) for x in values.reshape(-1)]
    return np.array(flat, dtype=object).reshape(values.shape)


def _fits(top: int, dim: int) -> bool:
    """Whether squared distances between components up to ``top`` stay in int64."""
    return 4 * top * top * max(1, dim) < 1 << 62


def _top(x: np.ndarray) -> int:
    return max(-int(x.min()), int(x.max()), 0) if x.size else 0


class Cells:
    """Nearest entries of one codebook (entries x components) by memoised cells."""

    def __init__(self, book: np.ndarray, cell: int = CELL, memo_cells: int = MEMO_CELLS):
        self.book, self.cell, self.memo_cells = book, cell, memo_cells
        self.top = _top(book)
        self.memo: dict[object, np.ndarray] = {}
        self.looked, self.made, self.pairs = 0, 0, 0

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell (rows of coarse components) the entries that may be nearest in it."""
        reach = (_top(cells) + 1) * self.cell + self.top  # no component is further from an entry's
        number = np.int32 if cells.shape[1] * reach * reach < 1 << 31 else self.book.dtype
        tables = []  # by component: place of each cell's row, and squared distances of the rows
        for j in range(cells.shape[1]):
            coarse, of = np.unique(cells[:, j], return_inverse=True)
            low = (coarse * self.cell)[:, None]
            below, above = low - self.book[None, :, j], self.book[None, :, j] - (low + self.cell - 1)
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(abs(below), abs(above))
            tables.append((of, (near * near).astype(number), (far * far).astype(number)))
        out = []
        for at in range(0, len(cells), CELLS):
            n = min(CELLS, len(cells) - at)
            least = np.zeros((n, len(self.book)), dtype=number)
            most = least.copy()
            for of, near, far in tables:
                own = of[at:at + n]
                least += near[own]
                most += far[own]
            row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
            out += np.split(entry.astype(np.uint16), np.searchsorted(row, np.arange(1, n)))
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row of ``x``."""
        if x.dtype != self.book.dtype or not _fits(max(self.top, _top(x)) + self.cell, x.shape[1]):
            x, self.book = x.astype(object), self.book.astype(object)
        coarse = x // self.cell
        keys = list(map(tuple, coarse)) if x.dtype == object else [r.tobytes() for r in coarse]
        if len(self.memo) > self.memo_cells:
            self.memo.clear()
        new = {}
        for i, k in enumerate(keys):
            if k not in self.memo and k not in new:
                new[k] = i
        if new:
            self.memo.update(zip(new, self.candidates(coarse[list(new.values())])))
        self.looked, self.made = self.looked + len(keys), self.made + len(new)
        index, dist = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=x.dtype)
        lists = [self.memo[k] for k in keys]
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        ends = np.cumsum(size)
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS)))
            row, entry = np.repeat(np.arange(at, to), size[at:to]), np.concatenate(lists[at:to]).astype(np.int64)
            d = np.zeros(len(row), dtype=x.dtype)
            for j in range(x.shape[1]):
                diff = x[row, j] - self.book[entry, j]
                d += diff * diff
            first = np.cumsum(size[at:to]) - size[at:to]
            dist[at:to] = np.minimum.reduceat(d, first)
            best = np.flatnonzero(d == dist[row])  # entries of a row ascend: the first is the smallest
            hit = best[np.searchsorted(row[best], np.arange(at, to))]
            index[at:to] = entry[hit]
            self.pairs += len(row)
            at = to
        return index, dist


@dataclass
class Codebooks:
    """Codebooks by vector length: one (entries x components) array a part."""
    parts: int
    scale: float
    cell: int
    books: dict[int, list[np.ndarray]] = field(default_factory=dict)

    def digest(self, dim: int) -> str:
        """sha256 of all components by part, entry and position, joined with commas."""
        numbers = (str(int(v)) for b in self.books[dim] for v in b.reshape(-1))
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def decode(self, dim: int, codes: bytes) -> np.ndarray:
        """The whole numbers that a code stands for."""
        return np.concatenate([b[c] for b, c in zip(self.books[dim], codes)])


def _cuts(dim: int, parts: int) -> list[int]:
    """Where the parts begin and end: equal, the first ones longer by one if need be."""
    return [0, *np.cumsum([dim // parts + (p < dim % parts) for p in range(parts)]).tolist()]


def _usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(v.isNotNull() & ~bad)


def _by_length(col: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length in a list column."""
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(size) - size
    out = {}
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        out[dim] = rows, flat[begin[rows][:, None] + np.arange(dim)]
    return out


def _assign(cells: dict[int, list[Cells]], dim: int, x: np.ndarray, parts: int):
    """(part, its whole numbers, nearest index, squared distance) for each part."""
    cut = _cuts(dim, parts)
    for p, c in enumerate(cells[dim]):
        own = x[:, cut[p]:cut[p + 1]]
        yield p, own, *c.nearest(own)


def _cells(model: Codebooks) -> dict[int, list[Cells]]:
    return {d: [Cells(b, model.cell) for b in books] for d, books in model.books.items()}


def _round(vectors: DataFrame, model: Codebooks) -> Codebooks:
    """One assignment and update. Entries that no part chose stay."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(model)
    schema = "dim int, part int, run int, sums binary"

    def partial(batches):
        m = sent.value
        cells = _cells(m)
        sums: dict[tuple[int, int, int], dict[int, tuple[int, list[int]]]] = {}
        for b in batches:
            for dim, (_, values) in _by_length(b.column(0)).items():
                for p, x, index, _ in _assign(cells, dim, whole(values, m.scale), m.parts):
                    order = np.argsort(index, kind="stable")
                    used, first, n = np.unique(index[order], return_index=True, return_counts=True)
                    total = np.add.reduceat(x[order], first, axis=0)
                    for e, k, s in zip(used.tolist(), n.tolist(), total.tolist()):
                        run = sums.setdefault((dim, p, e // RUN), {})
                        had = run.get(e, (0, [0] * len(s)))
                        run[e] = had[0] + k, [a + c for a, c in zip(had[1], s)]
        yield pa.RecordBatch.from_pydict(
            {"dim": pa.array([k[0] for k in sums], pa.int32()), "part": pa.array([k[1] for k in sums], pa.int32()),
             "run": pa.array([k[2] for k in sums], pa.int32()),
             "sums": pa.array([pickle.dumps(v) for v in sums.values()], pa.binary())})

    def meet(batches):
        sums: dict[tuple[int, int, int], dict[int, tuple[int, list[int]]]] = {}
        for b in batches:
            for dim, p, r, packed in b.itertuples(index=False):
                run = sums.setdefault((dim, p, r), {})
                for e, (k, s) in pickle.loads(packed).items():
                    had = run.get(e, (0, [0] * len(s)))
                    run[e] = had[0] + k, [a + c for a, c in zip(had[1], s)]
        yield pd.DataFrame([(*k, pickle.dumps(v)) for k, v in sums.items()], columns=["dim", "part", "run", "sums"])

    got = vectors.mapInArrow(partial, schema).repartition("dim", "part", "run").mapInPandas(meet, schema).collect()
    sent.destroy()
    books = {d: [b.astype(object) for b in old] for d, old in model.books.items()}
    for r in got:
        for e, (n, s) in pickle.loads(r["sums"]).items():
            books[r["dim"]][r["part"]][e] = [x // n for x in s]
    return Codebooks(model.parts, model.scale, model.cell, {d: [_narrow(b) for b in new] for d, new in books.items()})


def _narrow(book: np.ndarray) -> np.ndarray:
    """int64 where distances to such entries can be held in it."""
    return book.astype(np.int64) if _top(book) < 1 << 52 else book.astype(object)


def fit_codebooks(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0,
                  cell: int = CELL, id_col: str = "vec_id", vec_col: str = "embedding") -> Codebooks:
    """Codebooks of at most ``entries`` (256) entries for each of ``parts`` parts, started
    from the vectors with the smallest ids and improved in ``rounds`` rounds over all rows."""
    if not 1 <= entries <= 256 or parts < 1 or cell < 1:
        raise ValueError("entries must be 1 to 256, parts and cell at least 1")
    prepare(vectors.sparkSession)
    rows = _usable(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), "v")
    model = Codebooks(parts, scale, cell)
    for r in rows.select(F.size("v").alias("dim")).distinct().collect():  # lengths: one, but for odd rows
        first = rows.where(F.size("v") == r["dim"]).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
        x = whole(np.array([s["v"] for s in first], dtype=np.float64).reshape(len(first), r["dim"]), scale)
        cut = _cuts(r["dim"], parts)
        model.books[r["dim"]] = [_narrow(x[:, a:b]) for a, b in zip(cut, cut[1:])]
    for _ in range(rounds if model.books else 0):
        model = _round(rows.select("v"), model)
    return model


def encode(vectors: DataFrame, model: Codebooks, vec_col: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors`` with ``codes`` (a byte a part) and ``error`` (squared
    distance to what the codes stand for)."""
    spark = vectors.sparkSession
    prepare(spark)
    cols = [c for c in vectors.columns if c.lower() not in ("codes", "error")]
    rows = _usable(vectors.select(*cols), vec_col)
    out = T.StructType([*rows.schema.fields, T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())])
    at, sent = [c.lower() for c in cols].index(vec_col.lower()), spark.sparkContext.broadcast(model)

    def local(batches):
        m = sent.value
        cells = _cells(m)
        for b in batches:
            codes, errors = np.zeros((b.num_rows, m.parts), dtype=np.uint8), [0] * b.num_rows
            for dim, (of, values) in _by_length(b.column(at)).items():
                error = 0
                for p, _, index, dist in _assign(cells, dim, whole(values, m.scale), m.parts):
                    codes[of, p] = index
                    error = dist.astype(object) + error
                for i, e in zip(of.tolist(), error):
                    errors[i] = min(int(e), LONG)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(errors, pa.int64())],
                names=[*cols, "codes", "error"])
    return rows.mapInArrow(local, out)
