"""Line dedup through a sharded minimal perfect hash.

1. Every task hashes the keys of its documents' lines (128 bits) and counts them before
   anything moves; one partial aggregate then gives each distinct hash its number of
   documents and the largest doc_id that holds it.
2. Hashes found in at least ``min_docs`` documents are dealt over shards. Each shard
   becomes a minimal perfect hash (levels of bits, collisions go on to the next level) whose
   slot indexes three arrays: a 64-bit fingerprint, the count, and the largest doc_id. Other
   lines need no entry: their fingerprints will not match.
3. Documents probe the arrays. Lines are not joined and texts are not shuffled while the
   arrays fit ``broadcast_bytes`` (their measured size is compared, not guessed). Beyond
   it, the most frequent hashes (at most ``hot_keys`` of them, by construction) are still
   sent to all tasks, and the hashes of the other lines go to the tasks that hold
   their shard and are probed batch by batch, so that no line, however frequent, gathers in
   one task, and a task holds one shard's arrays whatever is asked of it.

Defined results: a null or empty text is one empty line. A row is a document; rows that
repeat a doc_id count each. A null doc_id sorts below all others. Empty tables give empty
results. Extra columns pass through; ``n_lines`` and ``n_dropped`` replace columns of
those names.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, prepare, unboxed, utf8

NO_ID = -(1 << 63)          # a null doc_id: below all others
SHARDS, SHARD_KEYS = 64, 131_072
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 100_000
ASKED_ROWS = 2_000_000      # hashes asked of one shard, on average, before copies of it share them
_ROWS = "h1 long, h2 long, n long, m long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys (two uint64 arrays), with their
    fingerprint, count and largest doc_id by slot. About 4 bits a key beside the arrays."""

    GAMMA = 2

    def __init__(self, h1: np.ndarray, h2: np.ndarray, n: np.ndarray, m: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []  # size, bits, rank by byte, first slot
        slot = np.zeros(len(h1), dtype=np.int64)
        left, first = np.arange(len(h1)), 0
        while len(left):
            size = max(64, self.GAMMA * len(left))
            at = self._place(h1[left], h2[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, dtype=np.uint8)
            bits[at[alone]] = 1
            packed = np.packbits(bits)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed))))[:-1].astype(np.uint32)
            self.levels.append((size, packed, before, first))
            slot[left[alone]] = first + np.cumsum(bits, dtype=np.int64)[at[alone]] - 1
            first += int(alone.sum())
            left = left[~alone]
        self.fingerprint, self.count, self.largest = (np.empty(len(h1), dtype=t) for t in (np.uint64, np.uint32, np.int64))
        self.fingerprint[slot] = h2
        self.count[slot] = np.minimum(n, 0xFFFFFFFF)
        self.largest[slot] = m

    @staticmethod
    def _place(h1, h2, level: int, size: int) -> np.ndarray:
        return (_mix(h1 ^ _mix(h2 + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) % np.uint64(size)).astype(np.int64)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0: not in here) and largest doc_id of each key."""
        count, largest = np.zeros(len(h1), dtype=np.int64), np.zeros(len(h1), dtype=np.int64)
        left = np.arange(len(h1))
        for level, (size, packed, before, first) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(h1[left], h2[left], level, size)
            byte = packed[at >> 3]
            hit = (byte >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            got, at, byte = left[hit], at[hit], byte[hit]
            inside = np.bitwise_count(byte >> (8 - (at & 7)).astype(np.uint16)).astype(np.int64)
            slot = first + before[at >> 3].astype(np.int64) + inside
            same = self.fingerprint[slot] == h2[got]
            count[got[same]], largest[got[same]] = self.count[slot[same]], self.largest[slot[same]]
            left = left[~hit]
        return count, largest


class ShardedIndex:
    def __init__(self, shards: dict[int, PerfectHash], n_shards: int):
        self.shards, self.n_shards = shards, n_shards

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, largest = np.zeros(len(h1), dtype=np.int64), np.zeros(len(h1), dtype=np.int64)
        of = h1 % np.uint64(self.n_shards)
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[order])) + 1
        for rows in np.split(order, cuts) if len(order) else ():
            if (index := self.shards.get(int(of[rows[0]]))) is not None:
                count[rows], largest[rows] = index.probe(h1[rows], h2[rows])
        return count, largest


def _key(line: bytes, least: int) -> bytes | None:
    """The key of a line if it has ``least`` code points. bytes.strip() and bytes.lower()
    know exactly the six blanks and A-Z."""
    k = line.strip()
    if len(k) < least or not k.isascii() and len(k.decode()) < least:
        return None
    return k.lower()


def _hashes(lines: list[bytes], least: int) -> list[bytes | None]:
    h = xxhash.xxh3_128_digest
    return [None if (k := _key(x, least)) is None else h(k) for x in lines]


def _pair(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return a[:, 0].copy(), a[:, 1].copy()


def _doc_key(col: pa.Array) -> list[int]:
    return [NO_ID if x is None else x for x in col.to_pylist()]


def line_counts(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(h1, h2, n, m): every distinct hash of a line key of ``min_chars`` code points, the
    documents that hold it, and the largest doc_id of these."""
    def local(batches):
        seen: dict[bytes, list[int]] = {}

        def rows():
            if seen:
                h1, h2 = _pair(list(seen))
                v = np.array(list(seen.values()), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                                                  pa.array(v[:, 0]), pa.array(v[:, 1])], names=["h1", "h2", "n", "m"])
                seen.clear()
        for b in batches:
            for doc, text in zip(_doc_key(b.column(0)), utf8(b.column(1))):
                for d in {x for x in _hashes((text or b"").split(b"\n"), min_chars) if x}:
                    if (e := seen.get(d)) is None:
                        seen[d] = [1, doc]
                    else:
                        e[0] += 1
                        e[1] = max(e[1], doc)
            if len(seen) > 200_000:
                yield from rows()
        yield from rows()

    prepare(docs.sparkSession, text_batches=True)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(local, _ROWS)
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("m").alias("m"))


def _shards(keys: DataFrame, n_shards: int) -> DataFrame:
    """(shard, index): the pickled PerfectHash of every shard of (h1, h2, n, m)."""
    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h = PerfectHash(pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64),
                        pdf["n"].to_numpy(), pdf["m"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "index": [pickle.dumps(h)]})
    return keys.withColumn("shard", _shard_of(n_shards)).groupBy("shard").applyInPandas(build, "shard long, index binary")


def _shard_of(n_shards: int):
    """h1 as unsigned modulo ``n_shards``, a power of two."""
    return F.col("h1").bitwiseAND(F.lit(n_shards - 1).cast("long"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                broadcast_bytes: int = BROADCAST_BYTES, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``docs`` with their texts less the lines whose key has at least ``min_chars`` code
    points and stands in at least ``min_docs`` documents, but for those in the largest
    doc_id that holds the key; ``n_lines`` (before) and ``n_dropped`` are added."""
    spark = docs.sparkSession
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    keys = line_counts(docs, min_chars).where(F.col("n") >= min_docs).checkpoint()
    size = keys.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
    n_shards = 1 << max(SHARDS.bit_length() - 1, (size["k"] // SHARD_KEYS).bit_length())
    every = size["k"] * 21 <= broadcast_bytes  # 20 bytes of arrays and about 4 bits of levels a key
    cut = 1 if every else size["n"] // hot_keys + 1  # at most hot_keys hashes have that many documents
    near = _shards(keys if every else keys.where(F.col("n") >= cut), n_shards).collect()
    index = ShardedIndex({r["shard"]: pickle.loads(r["index"]) for r in near}, n_shards)
    sent = spark.sparkContext.broadcast(index)
    far = None if every else _probe_far(docs, keys.where(F.col("n") < cut), sent, n_shards, min_chars, min_docs)
    return _drop(docs, sent, far, min_chars, min_docs)


def _row_tag():
    """Tells rows of one doc_id, or without one, apart by their texts."""
    return F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))


def _probe_far(docs: DataFrame, keys: DataFrame, sent, n_shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, tag, gone): by document, the hashes to drop among those that were not sent to
    all tasks. Only hashes move: a task takes its shard's index, then the hashes asked of it
    batch by batch. Where many are asked of a shard, they and copies of its index are dealt
    over several tasks."""
    def probes(batches):
        for b in batches:
            ids, tags, hs = [], [], []
            for doc, text, tag in zip(_doc_key(b.column(0)), utf8(b.column(1)), b.column(2).to_pylist()):
                own = list({x for x in _hashes((text or b"").split(b"\n"), min_chars) if x})
                ids += [doc] * len(own)
                tags += [tag] * len(own)
                hs += own
            h1, h2 = _pair(hs) if hs else (np.zeros(0, np.uint64),) * 2
            cold = sent.value.probe(h1, h2)[0] == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(x, dtype=np.int64)[cold]) for x in (ids, tags)] + [pa.array(h[cold].view(np.int64)) for h in (h1, h2)],
                names=["doc_id", "tag", "h1", "h2"])

    def lookup(batches):
        at, index = None, None
        for b in batches:
            shard, salt = (b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("shard", "salt"))
            cuts = (np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1).tolist()
            for first, end in zip([0, *cuts], [*cuts, b.num_rows]):
                if first == end:
                    continue
                if at != (shard[first], salt[first]):
                    at, index = (shard[first], salt[first]), None
                own = b.slice(first, end - first)
                for packed in own.column(names.index("index")).drop_null().to_pylist():
                    index = pickle.loads(packed)
                own = own.filter(own.column(names.index("h1")).is_valid())
                if index is None or not own.num_rows:
                    continue
                doc, h1, h2 = (own.column(names.index(c)).to_numpy() for c in ("doc_id", "h1", "h2"))
                count, largest = index.probe(h1.view(np.uint64), h2.view(np.uint64))
                yield own.filter(pa.array((count >= min_docs) & (largest != doc))).select(["doc_id", "tag", "h1", "h2"])

    schema = "doc_id long, tag long, h1 long, h2 long"
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row_tag().alias("tag")).mapInArrow(probes, schema).checkpoint()
    salts = 1 + asked.count() // (n_shards * ASKED_ROWS)
    asked = asked.withColumns({"shard": _shard_of(n_shards), "salt": F.pmod(F.xxhash64("doc_id", "tag", "h2"), F.lit(salts))})
    index = _shards(keys, n_shards).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    both = asked.unionByName(index, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.isnull("index"))
    names = both.columns
    gone = both.mapInArrow(lookup, schema)
    return gone.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))


def _drop(docs: DataFrame, sent, far: DataFrame | None, min_chars: int, min_docs: int) -> DataFrame:
    cols = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    keep = ["doc_id", "text"]
    rows = boxed(docs.select(*cols), keep).withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    if far is None:
        rows = rows.withColumn("gone", F.lit(None).cast("array<struct<h1:long,h2:long>>"))
    else:
        far = far.withColumnsRenamed({"doc_id": "far_id", "tag": "far_tag"})
        rows = rows.join(far, (F.col("doc") == F.col("far_id")) & (_row_tag() == F.col("far_tag")), "left")
    rows = rows.select("doc_id", "text", "row", "doc", "gone")
    out = T.StructType([rows.schema["doc_id"], rows.schema["text"], rows.schema["row"],
                        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def local(batches):
        for b in batches:
            ids, gone = b.column(3).to_pylist(), b.column(4).to_pylist()
            lines = [(t or b"").split(b"\n") for t in utf8(b.column(1))]
            hashes = [_hashes(x, min_chars) for x in lines]
            flat = [h for hs in hashes for h in hs if h]
            h1, h2 = _pair(flat) if flat else (np.zeros(0, np.uint64),) * 2
            count, largest = sent.value.probe(h1, h2)
            at, texts, n_dropped = 0, [], []
            for doc, own, hs, far_gone in zip(ids, lines, hashes, gone):
                k = sum(h is not None for h in hs)
                drop = (count[at:at + k] >= min_docs) & (largest[at:at + k] != doc)
                if far_gone:
                    away = {(g["h1"], g["h2"]) for g in far_gone}
                    drop |= np.array([x in away for x in zip(h1[at:at + k].view(np.int64).tolist(), h2[at:at + k].view(np.int64).tolist())], dtype=bool)
                at += k
                n_dropped.append(int(drop.sum()))
                if n_dropped[-1]:
                    flags = iter(drop.tolist())
                    own = [x for x, h in zip(own, hs) if h is None or not next(flags)]
                texts.append(b"\n".join(own))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, type=pa.binary()).cast(b.schema.field(1).type), b.column(2),
                 pa.array([len(x) for x in lines], type=pa.int64()), pa.array(n_dropped, type=pa.int64())],
                names=["doc_id", "text", "row", "n_lines", "n_dropped"])
    return unboxed(rows.mapInArrow(local, out), cols, keep, "n_lines", "n_dropped")
