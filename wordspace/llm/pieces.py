"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over a normalised text character by character. Every boundary keeps its
best last piece; a piece is at most ``longest`` characters, so only the boundaries of that
window can still be extended. From time to time the backpointer paths of all boundaries in
the window are followed back: where they meet, everything before is committed as ids and
forgotten. Beside the text and its ids, memory is the window and the uncommitted part.

What makes a last piece best depends on the model's kind, which its file names:

* unigram: the largest sum of scores, a character that is no piece at the least score
  less 10;
* bpe: merges are applied best score first, leftmost first. A sequence of pieces is what
  the merges give if and only if every two neighbours are what the merges give for the
  two together. So the score of a step is 0 if the pair is such, else minus infinity, and
  each boundary has exactly one surviving last piece.

Where no piece can cross a boundary (before a space mark, around a character that stands in
no piece), all paths converge there by themselves, so each such span is a search of its
own. Spans repeat: a worker remembers the ids of twice ``MEMO`` of them and those of a batch.
The new spans of a batch, whatever their lengths, are searched side by side for a bpe model,
one boundary at a time for all of them in a common window (``SideBySide``).

Characters that are no piece become byte pieces where the model has them, else the unknown
id. Ids are those of the sentencepiece library for a bpe model (held against it in tests).

Defined results: a null text counts as an empty one, which has no ids and decodes to "".
Null ids decode to "". Repeated rows repeat; an empty table gives an empty result; extra
columns pass through, columns called ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import prepare, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
MEMO = 150_000
#: Spans that are searched side by side, and their characters, at most; characters of a
#: span that a worker remembers.
SIDE_ROWS, SIDE_CHARS, MEMO_CHARS = 16_384, 1 << 20, 48
#: Fewer spans of like length are not worth a step side by side.
FEW = 8


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol buffer message."""
    def varint(i):
        n = shift = 0
        while True:
            n |= (buf[i] & 127) << shift
            shift += 7
            i += 1
            if buf[i - 1] < 128:
                return n, i
    i = 0
    while i < len(buf):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if key & 7 == 2 else (8 if key & 7 == 1 else 4, i)
            value, i = buf[i:i + size], i + size
        yield key >> 3, value


def model_kind(model: bytes) -> int:
    """UNIGRAM or BPE: field 3 of the model's trainer settings (its field 2); unigram where
    it is left out."""
    for no, value in _fields(model):
        if no == 2:
            return next((v for n, v in _fields(value) if n == 3), UNIGRAM)
    return UNIGRAM


class Search:
    """The pieces of a vocabulary and the streaming search over them. ``pieces``: text to
    (id, score). Ids of characters that are no piece are below zero: minus their code
    point less 1."""

    def __init__(self, pieces: dict[str, tuple[int, float]], kind: int):
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and bpe models")
        self.kind = kind
        self.score = {p: s for p, (_, s) in pieces.items()}
        self.text = {i: p for p, (i, _) in pieces.items()}
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        #: every ending of a piece: its id, or None where it is no piece itself
        self.ends: dict[str, int | None] = {}
        for p, (i, _) in pieces.items():
            for k in range(1, len(p)):
                self.ends.setdefault(p[k:], None)
            self.ends[p] = i
        self.pairs: dict[tuple[int, int], bool] = {}

    def _spell(self, i: int) -> str:
        return chr(-i - 1) if i < 0 else self.text[i]

    def merged(self, s: str) -> list[str]:
        """What the merges give for a short string."""
        parts = list(s)
        while True:
            best = None
            for k in range(len(parts) - 1):
                v = self.score.get(parts[k] + parts[k + 1])
                if v is not None and (best is None or v > best[0]):
                    best = v, k
            if best is None:
                return parts
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def pair(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a."""
        own = [self._spell(b)] if a == START else [self._spell(a), self._spell(b)]
        return self.merged("".join(own)) == own

    def fits(self, a: int, b: int) -> bool:
        """``pair``, remembered."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.pair(a, b)
        return ok

    def stream(self, chars: str, window: int | None = None) -> Iterator[list[int]]:
        """Ids in committed runs. ``window``: how many characters go by between two looks
        for a boundary that all paths share."""
        longest, ends, bpe = self.longest, self.ends, self.kind == BPE
        pairs, fits, score = self.pairs.get, self.fits, self.score
        window = window or 4 * longest
        n = len(chars)
        first, look = 0, window                     # first: the last committed boundary
        room = min(n, window) + 1
        last = [START] + [0] * (room - 1)           # by boundary from first on: its last piece,
        size = [0] * room                           # that piece's length,
        total = [0.0] * room                        # and the sum of scores (unigram)
        for end in range(1, n + 1):
            at, best = end - first, None
            for k in range(1, min(longest, at) + 1):
                s = chars[end - k:end]
                t = ends.get(s, 0.5)
                if t.__class__ is not int:
                    if k == 1:
                        ending, t = t is None, -ord(s) - 1  # a character that is no piece
                    elif t is None:
                        continue
                    else:
                        break
                else:
                    ending = True
                if bpe:
                    prev = last[at - k]
                    ok = pairs((prev, t))
                    if fits(prev, t) if ok is None else ok:
                        last[at], size[at] = t, k
                        break
                else:
                    z = total[at - k] + (score[s] if t >= 0 else self.unknown)
                    if best is None or z > best:
                        last[at], size[at], total[at], best = t, k, z, z
                if not ending:
                    break
            if not size[at]:
                raise ValueError("no piece of the vocabulary may end here")
            if end >= look and end < n:
                # the boundaries that later pieces may follow; their paths lead back to one
                live = set(range(max(0, at + 1 - longest), at + 1))
                while len(live) > 1:
                    b = max(live)
                    live.remove(b)
                    live.add(b - size[b])
                meet = live.pop()
                if meet:
                    yield self._path(last, size, meet)
                    first += meet
                    del last[:meet], size[:meet], total[:meet]
                look = end + window
                more = min(n, look) + 1 - first - len(last)
                last += [0] * more
                size += [0] * more
                total += [0.0] * more
        if n > first:
            yield self._path(last, size, n - first)

    @staticmethod
    def _path(last, size, b: int) -> list[int]:
        out = []
        while b > 0:
            out.append(last[b])
            b -= size[b]
        return out[::-1]


#: The piece before the first one.
START = -0x200000


class Table:
    """Whole numbers (uint64, not 0) to small ones, open addressing in numpy arrays."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of ``keys``, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (there != 0)]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
        return out

    def put(self, keys: np.ndarray, values) -> None:
        """New distinct keys; all old ones are forgotten when the table is two thirds full."""
        if 3 * (self.used + len(keys)) > 2 * len(self.keys):
            self.keys[:] = 0
            self.used = 0
        mask = int(self.mask)
        for k, at, v in zip(keys.tolist(), self._slot(keys).tolist(), values):
            while self.keys[at]:
                at = (at + 1) & mask
            self.keys[at], self.values[at] = k, v
        self.used += len(keys)


class SideBySide:
    """The streaming search of a bpe model over many spans at once. Substrings are looked
    up by two polynomial hashes of 64 bits each. ``characters`` counts what went through."""

    BASES = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xC2B2AE3D27D4EB4F)

    def __init__(self, search: Search):
        self.search, self.longest, self.characters = search, search.longest, 0
        texts = [search.text.get(i, "") for i in range(max(search.text, default=0) + 1)]
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        one, self.check = (self._hash_all(texts, b) for b in self.BASES)
        self.powers = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.longest, b))), dtype=np.uint64) for b in self.BASES]
        known = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
        self.pieces = Table(max(8, (4 * len(known)).bit_length()))
        self.pieces.put(self._sized(one[known], self.sizes[known]), known.tolist())
        self.pairs = Table(20)

    @staticmethod
    def _sized(h: np.ndarray, size) -> np.ndarray:
        """A hash with the length mixed in, never 0."""
        h = (h ^ np.asarray(size, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(31))) | np.uint64(1 << 63)

    @staticmethod
    def _codes(texts: list[str]) -> np.ndarray:
        """A row of code points plus 1 for each text, 0 behind its end."""
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        out = np.zeros((len(texts), int(lens.max(initial=1))), dtype=np.uint64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out[np.arange(out.shape[1]) < lens[:, None]] = flat + np.uint64(1)
        return out

    def _prefixes(self, codes: np.ndarray, base) -> np.ndarray:
        h = np.zeros((codes.shape[1] + 1, len(codes)), dtype=np.uint64)
        for i in range(codes.shape[1]):
            h[i + 1] = h[i] * base + codes[:, i]
        return h

    def _hash_all(self, texts: list[str], base) -> np.ndarray:
        h = self._prefixes(self._codes(texts), base)
        return h[[len(t) for t in texts], np.arange(len(texts))]

    def _fit(self, prev: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each id may follow the piece before it (-1: the beginning)."""
        keys = ((prev.astype(np.int64) + 2).astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
        ok = self.pairs.get(keys)
        new = np.unique(keys[ok < 0])
        if len(new):
            before, after = (new >> np.uint64(32)).astype(np.int64) - 2, (new & np.uint64(0xFFFFFFFF)).astype(np.int64)
            self.pairs.put(new, [int(self.search.pair(START if a < 0 else a, b)) for a, b in zip(before.tolist(), after.tolist())])
            ok = self.pairs.get(keys)
        return ok == 1

    def run(self, spans: list[str], window: int | None = None) -> list[bytes | None]:
        """The ids of each span as bytes of little-endian numbers; None where a boundary
        has no piece of the vocabulary (left to ``Search.stream``).

        All spans advance together, a boundary at a time. Boundaries lie in a ring that is
        a window longer than the longest piece; every ``window`` boundaries the paths of
        each span are followed back to where they meet, what lies before is committed, and
        the ring grows only where paths have not met yet."""
        longest = self.longest
        window = window or 4 * longest
        codes = self._codes(spans)
        n, width = codes.shape
        lens = np.array([len(t) for t in spans], dtype=np.int64)
        self.characters += int(lens.sum())
        ring = 1
        while ring < longest + 2 * window + 2:
            ring *= 2
        h, check = (np.zeros((ring, n), dtype=np.uint64) for _ in range(2))
        last, size = np.full((ring, n), -1, np.int32), np.zeros((ring, n), np.int8)
        alive, first = np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64)
        runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, their numbers of ids, the ids
        open_ = np.flatnonzero(lens > 0)  # spans whose ids are not all committed
        for end in range(1, width + 1):
            now, before = end % ring, (end - 1) % ring
            h[now] = h[before] * self.BASES[0] + codes[:, end - 1]
            check[now] = check[before] * self.BASES[1] + codes[:, end - 1]
            todo = np.flatnonzero(alive & (lens >= end))
            for k in range(1, min(end, longest) + 1):
                if not len(todo):
                    break
                at_k = (end - k) % ring
                key = h[now, todo] - h[at_k, todo] * self.powers[0][k]
                ids = self.pieces.get(self._sized(key, k))
                some = np.flatnonzero(ids >= 0)
                at, got = todo[some], ids[some]
                same = check[now, at] - check[at_k, at] * self.powers[1][k] == self.check[got]
                some, at, got = some[same], at[same], got[same]
                prev = np.where(end == k, -1, last[at_k, at])
                ok = self._fit(prev, got)
                last[now, at[ok]], size[now, at[ok]] = got[ok], k
                left = np.ones(len(todo), dtype=bool)
                left[some[ok]] = False
                todo = todo[left]
            alive[todo] = False
            if end % window == 0 or end == width:
                open_ = open_[alive[open_]]
                done = lens[open_] <= end
                meet = np.where(done, lens[open_], 0)
                going = open_[~done]
                meet[~done] = self._meet(size, going, end, first[going])
                runs.append(self._paths(last, size, open_, first[open_], meet))
                first[open_] = meet
                open_ = going
                if len(going) and end - int(first[going].min()) + longest + window + 1 >= ring:
                    kept = np.arange(max(0, end - ring + 1), end + 1)
                    grown = [np.zeros((2 * ring, n), dtype=x.dtype) for x in (h, check, last, size)]
                    for new, old in zip(grown, (h, check, last, size)):
                        new[kept % (2 * ring)] = old[kept % ring]
                    (h, check, last, size), ring = grown, 2 * ring
        return self._joined(runs, alive, n)

    def _meet(self, size: np.ndarray, rows: np.ndarray, end: int, first: np.ndarray) -> np.ndarray:
        """Where the paths of the boundaries that can still be extended meet, by row."""
        ring = len(size)
        at = np.maximum(np.arange(end + 1 - self.longest, end + 1)[:, None], first[None, :])
        while True:
            top = at.max(axis=0, initial=0)
            on = (at == top) & (at != at.min(axis=0, initial=end))
            if not on.any():
                return top
            at = np.where(on, at - size[at % ring, rows[None, :]], at)

    @staticmethod
    def _paths(last, size, rows: np.ndarray, first: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, numbers of ids, ids row by row) of the paths from ``first`` to ``to``."""
        ring, steps, at = len(last), [], to.copy()
        left = np.flatnonzero(at > first)
        while len(left):
            place = at[left] % ring
            steps.append((left, last[place, rows[left]]))
            at[left] -= size[place, rows[left]]
            left = left[at[left] > first[left]]
        count = np.zeros(len(rows), dtype=np.int64)
        for own, _ in steps:
            count[own] += 1
        ends = np.cumsum(count)
        flat, place = np.zeros(int(ends[-1]) if len(ends) else 0, dtype="<i4"), ends - 1
        for own, ids in steps:
            flat[place[own]] = ids
            place[own] -= 1
        return rows, count, flat

    @staticmethod
    def _joined(runs, alive: np.ndarray, n: int) -> list[bytes | None]:
        """The committed runs of each span, one after another."""
        out: list[bytes | None] = [b"" if ok else None for ok in alive.tolist()]
        for rows, count, flat in runs:
            raw, ends = flat.tobytes(), (4 * np.cumsum(count)).tolist()
            for r, a, b in zip(rows.tolist(), [0, *ends], ends):
                if out[r] is not None and a < b:
                    out[r] += raw[a:b]
        return out


def _alike(spans: list[str]) -> Iterator[list[str]]:
    """Runs of spans in rising length, of bounded rows and characters."""
    at = 0
    while at < len(spans):
        to = min(at + SIDE_ROWS, len(spans))
        while to > at + 1 and (to - at) * len(spans[to - 1]) > SIDE_CHARS:
            to = at + max(1, min((to - at) // 2, SIDE_CHARS // len(spans[to - 1])))
        yield spans[at:to]
        at = to


class Speller:
    """What each id of a model stands for; ids to texts."""

    def __init__(self, model: bytes):
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        self.plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.byte_ids = {int(lib.id_to_piece(i)[3:-1], 16): i for i in range(n) if lib.is_byte(i)}
        self.spelled = [b""] * n
        for i in self.plain:
            self.spelled[i] = lib.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.spelled[i] = bytes([b])
        self.spelled[lib.unk_id()] = " ⁇ ".encode()

    def decode(self, ids: list[int]) -> str:
        spelled = self.spelled
        out = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


class Codec(Speller):
    """A model's pieces, with the library's normaliser; encodes whole texts too."""

    def __init__(self, model: bytes):
        super().__init__(model)
        lib, plain, kind = self.lib, self.plain, model_kind(model)
        self.search = Search({lib.id_to_piece(i): (i, lib.get_score(i)) for i in plain}, kind)
        chars = {c for i in plain for c in lib.id_to_piece(i)} - {SPACE}
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", lib.id_to_piece(i)) for i in plain)
        inside = "[" + "".join(map(re.escape, sorted(chars))) + "]+" if chars else "(?!)"
        # spans that no piece crosses the ends of
        self.spans = re.compile(f"{SPACE}*{inside}|{SPACE}+|." if self.by_word else f"(?:{inside}|{SPACE})+|.", re.S)
        self.odd = re.compile("[^" + "".join(map(re.escape, sorted(chars | {SPACE}))) + "]", re.S)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.side = SideBySide(self.search) if kind == BPE and plain else None

    def _streamed(self, span: str) -> bytes:
        out: list[int] = []
        for run in self.search.stream(span):
            for i in run:
                if i >= 0:
                    out.append(i)
                elif len(self.byte_ids) == 256:
                    out += [self.byte_ids[b] for b in chr(-i - 1).encode()]
                else:
                    out.append(self.lib.unk_id())
        return array("i", out).tobytes()

    def _learn(self, spans: set[str]) -> dict[str, bytes]:
        """Finds the ids of new spans, all of a bpe model in one streaming search side by
        side; short ones are remembered, long ones returned. A span with characters that stand in no piece is cut around these first."""
        odd, memo, long_ = self.odd.search, self.memo, {}
        parts = {s: self.spans.findall(s) for s in spans if odd(s)}
        need = spans - parts.keys()
        need.update(p for ps in parts.values() for p in ps if p not in memo)
        for some in _alike(sorted(need, key=len)) if self.side else ():  # of like length: rows without padding
            if len(some) < FEW:
                continue  # one after another, through ``Search.stream``
            for p, ids in zip(some, self.side.run(some)):
                if ids is not None:
                    (memo if len(p) <= MEMO_CHARS else long_)[p] = ids
        for p in need:
            if p not in memo and p not in long_:
                (memo if len(p) <= MEMO_CHARS else long_)[p] = self._streamed(p)
        for s, ps in parts.items():
            (memo if len(s) <= MEMO_CHARS else long_)[s] = b"".join([long_.get(p) or memo[p] for p in ps])
        return long_

    def _spans(self, text: str) -> list[str]:
        if not text:
            return []
        s = self.lib.normalize(text)
        if not self.by_word:
            return [s]
        if SPACE * 2 in s:
            return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", s)
        head, *words = s.split(SPACE)
        words = [SPACE + w for w in words]
        return [head, *words] if head else words

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; spans that are new are searched together."""
        if len(self.memo) > MEMO:  # the older half is kept aside: frequent spans come back from it
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        spans = [self._spans(t) for t in texts]
        new = set().union(*spans) - memo.keys()
        back = new & old.keys()
        memo.update(zip(back, map(old.__getitem__, back)))
        long_ = self._learn(new - back) if new else {}
        return [np.frombuffer(b"".join([memo.get(w) or long_[w] for w in x]), dtype="<i4") for x in spans]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    """One codec a worker, so that tasks share its memory of spans."""
    return Codec(model)


@lru_cache(maxsize=2)
def speller(model: bytes) -> Speller:
    return Speller(model)


def load_model(path: str = MODEL) -> bytes:
    """The model's file, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of the whole text; with ``decoded`` also what
    these ids spell (as ``decode`` gives it), in the same pass over the texts."""
    prepare(docs.sparkSession, text_batches=True)
    sent = docs.sparkSession.sparkContext.broadcast(load_model() if model is None else model)
    docs = docs.drop("ids", "decoded") if decoded else docs.drop("ids")
    cols = docs.columns
    at = cols.index("text")

    def local(batches):
        own_codec = codec(sent.value)
        for b in batches:
            own = own_codec.encode_all([(t or b"").decode() for t in utf8(b.column(at))])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
            flat = np.concatenate(own) if own else np.zeros(0, dtype="<i4")
            arrays = [*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))]
            if decoded:
                arrays.append(pa.array([own_codec.decode(x.tolist()) for x in own], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    out = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        out = out.add("decoded", T.StringType())
    return docs.mapInArrow(local, out)


def decode(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``."""
    prepare(encoded.sparkSession, text_batches=True)
    sent = encoded.sparkSession.sparkContext.broadcast(load_model() if model is None else model)
    encoded = encoded.drop("decoded")
    cols = encoded.columns
    at = cols.index("ids")

    def local(batches):
        own = speller(sent.value)
        for b in batches:
            texts = [own.decode(x or []) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*cols, "decoded"])
    return encoded.mapInArrow(local, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
