"""Token ids packed into fixed rows, best fit decreasing, in binary form.

1. Documents become token ids (public byte-level vocabulary, a parameter). A document
   longer than a row is split into pieces of a whole row and a rest; no id is lost, and
   each piece carries its document and number.
2. Pieces are dealt over groups by the hash of their document and number. The number of
   groups follows the bytes of text, so a group has about ``group_bytes`` of text whatever
   the table's size, and the pieces of one very long document spread over groups.
3. A group packs its pieces from the longest down. A segment tree over the capacities
   0 to ``row_tokens`` counts the rows that have each capacity left and finds the least
   capacity that holds a piece in logarithmic time.
4. A group's rows leave as matrices of at most ``matrix_rows`` rows: the ids of all rows
   (little-endian, padded), the cumulative segment lengths of each row, the position of
   each token within its segment (it resets to 0 where a segment begins), and the piece
   behind each segment.

Defined results: a null or empty text has no tokens and no piece. A null doc_id stays
null. Rows that repeat are packed each. Empty tables give no matrices. Extra columns are
not read.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts a text into words before it merges bytes (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROW_TOKENS, MATRIX_ROWS, GROUP_BYTES, PAD = 2048, 64, 4 << 20, 50256


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and their rank, from the vocabulary's file on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class CapacityTree:
    """A segment tree over capacities 0..top with the number of open rows of each."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int = 1) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, need: int) -> int:
        """The least capacity of at least ``need`` that an open row has; -1 for none."""
        count, i = self.count, need + self.size
        if count[i]:
            return need
        while i > 1:  # up until a right sibling has open rows, then down its left edge
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows, each a list of indices into ``sizes`` (1 to ``capacity``): longest first, each
    into the row with the least room that holds it, ties to the row opened last."""
    tree, room, rows = CapacityTree(capacity), {}, []
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        need = int(sizes[i])
        have = tree.least(need)
        if have < 0:
            rows.append([i])
            row, left = len(rows) - 1, capacity - need
        else:
            tree.add(have, -1)
            row, left = room[have].pop(), have - need
            rows[row].append(i)
        if left:
            tree.add(left)
            room.setdefault(left, []).append(row)
    return rows


def token_pieces(docs: DataFrame, ranks: dict[bytes, int], row_tokens: int, groups: int) -> DataFrame:
    """(grp, doc_id, has_id, piece, n, ids): each document's ids, little-endian, in pieces
    of at most ``row_tokens``; two bytes an id where the vocabulary allows it."""
    width = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def local(batches):
        enc = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        for b in batches:
            doc, piece, n, ids = [], [], [], []
            for d, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                own = np.array(enc.encode_ordinary(text.decode()) if text else [], dtype=width)
                for at in range(0, len(own), row_tokens):
                    part = own[at:at + row_tokens]
                    doc.append(d)
                    piece.append(at // row_tokens)
                    n.append(len(part))
                    ids.append(part.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([d or 0 for d in doc], pa.int64()), pa.array([d is not None for d in doc], pa.bool_()), pa.array(piece, pa.int64()), pa.array(n, pa.int32()), pa.array(ids, pa.binary())],
                names=["doc_id", "has_id", "piece", "n", "ids"])
    pieces = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .mapInArrow(local, "doc_id long, has_id boolean, piece long, n int, ids binary"))
    return pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.crc32("ids")), F.lit(groups)))


PACKED = ("grp long, matrix int, n_rows int, row_tokens int, ids binary, positions binary, cu_seqlens array<array<int>>, "
          "segments array<array<struct<doc_id:long,piece:long>>>")


def pack_documents(docs: DataFrame, ranks: dict[bytes, int] | None = None, row_tokens: int = ROW_TOKENS,
                   matrix_rows: int = MATRIX_ROWS, group_bytes: int = GROUP_BYTES, pad: int = PAD) -> DataFrame:
    """Packed matrices of the documents' token ids, see the module. ``ids`` and
    ``positions`` are ``n_rows`` x ``row_tokens`` little-endian numbers, two bytes each
    where ids fit, else four; padding has position 0 and lies behind the row's last
    cumulative length."""
    prepare(docs.sparkSession, text_batches=True)
    ranks = load_ranks() if ranks is None else ranks
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(64, -(-size // group_bytes))
    width = "<u2" if max(*ranks.values(), pad) < 1 << 16 and row_tokens <= 1 << 16 else "<u4"
    stored = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "has_id", "piece", "n", "ids"], ignore_index=True)  # one order on every run
        doc = [d if known else None for d, known in zip(pdf["doc_id"].tolist(), pdf["has_id"])]
        piece, n, raw = pdf["piece"].tolist(), pdf["n"].to_numpy(), pdf["ids"].tolist()
        rows = best_fit_decreasing(n, row_tokens)
        out = []
        for at in range(0, len(rows), matrix_rows):
            some = rows[at:at + matrix_rows]
            ids = np.full((len(some), row_tokens), pad, dtype=width)
            positions = np.zeros((len(some), row_tokens), dtype=width)
            lengths, segments = [], []
            for r, members in enumerate(some):
                ends = [0]
                for i in members:
                    a, b = ends[-1], ends[-1] + int(n[i])
                    ids[r, a:b] = np.frombuffer(raw[i], dtype=stored)
                    positions[r, a:b] = np.arange(b - a)
                    ends.append(b)
                lengths.append(ends)
                segments.append([{"doc_id": doc[i], "piece": piece[i]} for i in members])
            out.append((key[0], at // matrix_rows, len(some), row_tokens, ids.tobytes(), positions.tobytes(), lengths, segments))
        return pd.DataFrame(out, columns=["grp", "matrix", "n_rows", "row_tokens", "ids", "positions", "cu_seqlens", "segments"])

    return token_pieces(docs, ranks, row_tokens, groups).groupBy("grp").applyInPandas(pack, PACKED)


def unpack(row, width: str = "<u2"):
    """(doc_id, piece, ids) of every segment of a packed matrix."""
    ids = np.frombuffer(row["ids"], dtype=width).reshape(row["n_rows"], row["row_tokens"])
    for r, (ends, members) in enumerate(zip(row["cu_seqlens"], row["segments"])):
        for a, b, m in zip(ends, ends[1:], members):
            yield m["doc_id"], m["piece"], ids[r, a:b]


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrices as Parquet files of binary columns, in order within their group."""
    packed.sortWithinPartitions("grp", "matrix").write.mode("errorifexists").parquet(path)
