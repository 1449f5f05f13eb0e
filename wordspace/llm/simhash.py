"""SimHash near-dedup through an inverted index of byte positions with count filtering.

A 64-bit fingerprint is eight positional bytes. Fingerprints that differ in at most
``max_bits`` bits share at least ``8 - max_bits`` of them, the guaranteed matches. So
their first ``t`` shared positions lie among a few choices of ``t`` positions, for every
``t`` up to that number: the index posts each distinct fingerprint under each choice
(positions and their bytes). A task walks the posting lists it got, tallies the shared
positional bytes of each pair, keeps pairs with the guaranteed matches and verifies the
bit distance. ``t`` grows with the logarithm of the number of fingerprints, so that lists
stay short; it changes the work, never the links.

Equal fingerprints are one entry (a partial aggregate), so exact copies cost nothing. A
posting list longer than ``list_rows`` is cut into blocks; each pair of blocks is a list
of its own in any task. Tasks emit a spanning forest of the links they verify, so a group
of thousands of near copies gives thousands of rows, not millions.

Defined results: a null or empty text, or one of blanks only, has fingerprint zero, which
links like any other. Fewer words than a shingle: the whole sequence is the one shingle.
A null doc_id gets a fingerprint and a component but names none while its group has
another id. Repeated rows give repeated results. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, forest, prepare, unboxed, utf8, whole_groups
from .components import components

SEED = 42
LIST_ROWS = 1024
#: Hash values whose bits are counted at once: bounds memory for the longest texts.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the whole text; bytes.split() and bytes.lower() know exactly the six
    blanks and A-Z."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), SEED)
    over, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    for at in range(0, n, CHUNK):
        part = words[at:at + CHUNK + shingle - 1]
        own = [h(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(shingle)))]
        bits = np.unpackbits(np.array(own, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        over += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * over > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, its bits as a signed long."""
    def local(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in utf8(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    prepare(docs.sparkSession, text_batches=True)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(local, "doc_id long, fp long"))


def _postings(reps: DataFrame, max_bits: int, n: int) -> DataFrame:
    """(key, fp, node): each fingerprint under each choice of its first ``t`` shared
    positional bytes."""
    sure = 8 - max_bits
    t = min(sure, max(1, (max(n, 2).bit_length() + 7 - 3) // 8))  # lists of about 2^3 entries or fewer, if bytes are even
    choices = [c for c in combinations(range(8), t) if all(p <= max_bits + i for i, p in enumerate(c))]
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")) for p in range(8)]

    def key(no, choice):
        k = F.lit(no).cast("long")
        for p in choice:
            k = F.shiftleft(k, 8).bitwiseOR(byte[p])
        return k
    return reps.select(F.explode(F.array(*[key(i, c) for i, c in enumerate(choices)])).alias("key"), "fp", "node")


def spread_lists(rows: DataFrame, key: list[str], salt: str, list_rows: int, hot_limit: int = 100_000) -> DataFrame:
    """Adds (ci, cj, own): the cell of a list's row. A list of at most ``list_rows`` rows is
    the cell (0, 0); a longer one is cut by ``salt`` into blocks, ``own`` is the row's block,
    and the row stands in the cell of its block with every block, itself included."""
    n_rows = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > list_rows).checkpoint()
    few = n_rows.count()
    if not few:
        return rows.withColumns({"ci": F.lit(0), "cj": F.lit(0), "own": F.lit(0)})
    n_rows = F.broadcast(n_rows) if few <= hot_limit else n_rows
    s = F.coalesce(F.ceil(F.col("__n") / list_rows), F.lit(1)).cast("int")
    rows = rows.join(n_rows, key, "left").withColumn("__s", s)
    rows = rows.withColumn("own", F.pmod(F.xxhash64(salt), F.col("__s")).cast("int"))
    rows = rows.withColumn("__x", F.explode(F.sequence(F.lit(0), F.col("__s") - 1)))
    return (rows.withColumn("ci", F.least("own", "__x")).withColumn("cj", F.greatest("own", "__x"))
            .drop("__n", "__s", "__x"))


def links(reps: DataFrame, max_bits: int = 3, list_rows: int = LIST_ROWS) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints of ``reps`` (fp, node) at
    ``max_bits`` or fewer differing bits, as a spanning forest of each task's findings."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be 0 to 7: eight bytes guarantee no match beyond")
    sure = 8 - max_bits
    keys = ["key", "ci", "cj"]
    cells = spread_lists(_postings(reps, max_bits, reps.count()), ["key"], "fp", list_rows)

    def local(batches):
        for pdf in whole_groups(batches, keys):
            fp = pdf["fp"].to_numpy().view(np.uint64)
            n = len(pdf)
            new = np.ones(n, dtype=bool)
            new[1:] = np.any([pdf[k].to_numpy()[1:] != pdf[k].to_numpy()[:-1] for k in keys], axis=0)
            group = np.cumsum(new)
            own, cross = pdf["own"].to_numpy(), (pdf["ci"] != pdf["cj"]).to_numpy()
            root = np.arange(n)
            i, step = np.arange(n), 0
            while len(i):
                step += 1
                i = i[i + step < n]
                i = i[group[i] == group[i + step]]  # lists shorter than the step drop out
                j = i + step
                x = fp[i] ^ fp[j]
                shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # the tally
                ok = (shared >= sure) & ~(cross[i] & (own[i] == own[j]))
                ok[ok] = np.bitwise_count(x[ok]) <= max_bits
                if ok.any():
                    merged = forest(np.concatenate((np.arange(n), i[ok])), np.concatenate((root, j[ok])), n)
                    root = merged
            got = root != np.arange(n)
            node = pdf["node"].to_numpy()
            yield pd.DataFrame({"a": node[got], "b": node[root[got]]})

    dealt = cells.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(local, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, list_rows: int = LIST_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``: ``component_id`` is the smallest
    doc_id reachable over fingerprints at ``max_bits`` or fewer differing bits."""
    fps = fingerprints(docs, shingle).checkpoint()
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    named = reps.where("node is not null").checkpoint()
    of = components(links(named, max_bits, list_rows))
    groups = (reps.join(of.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
              .select("fp", F.coalesce("component", "node").alias("component_id")))
    return fps.join(groups, "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each group stays: the one whose doc_id names it. Rows that repeat a
    doc_id are one document, of which the row with the least text stays. Rows with a null
    doc_id stay."""
    rows = boxed(docs, ["doc_id", "text"]).withColumn("id", F.col("doc_id").cast("long"))
    found = near_duplicates(docs.select("doc_id", "text"), shingle, max_bits).where("doc_id is not null")
    ids = (found.groupBy(F.col("doc_id").alias("id"))
           .agg(F.count(F.lit(1)).alias("n"), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("names"))
           .where("names = 1").select("id", "n").checkpoint())
    often = ids.where("n > 1").select("id")
    # the narrow side is hashed, so that texts are not sorted
    stay = rows.join(ids.where("n = 1").select("id").hint("shuffle_hash"), "id", "left_semi")
    if often.take(1):
        least = F.row_number().over(Window.partitionBy("id").orderBy("text"))
        again = rows.join(often, "id", "left_semi").withColumn("least", least).where("least = 1")
        stay = stay.unionByName(again.drop("least"))
    return unboxed(stay.unionByName(rows.where("id is null")), docs.columns, ["doc_id", "text"])
