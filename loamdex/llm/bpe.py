"""Encoding a corpus with a public byte-level BPE vocabulary.

Texts are split by the vocabulary's pattern; each distinct piece is encoded once per process.
Method: pieces not seen before go into length-bucketed padded numpy matrices; every row merges its
leftmost minimum-rank pair each round, found through a hashed pair lookup, and finished rows are
compacted away. Pieces too long for a matrix use the same rule with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
import sys
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Folder of the public vocabulary files; a parameter of every operator here.
VOCABULARIES = os.environ.get("LOAMDEX_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"

#: Pieces of more bytes are merged with a heap, with the same result: a matrix takes time quadratic
#: in the width. From about here on the heap is as fast.
MATRIX_WIDTH = 256
#: Bytes of distinct pieces a process remembers before it starts afresh, and the longest piece it
#: remembers between batches. No effect on results.
CACHE_BYTES, CACHE_PIECE_CHARS = 48_000_000, 64
#: Vocabularies a worker process holds at once.
HELD_ENCODERS = 2
#: Text handled at once inside an Arrow batch.
SLICE_CHARS = 4_000_000
NONE = np.int32(2**31 - 1)

# The split pattern of the vocabulary, spelled for the standard library's faster matcher.
# White space as Unicode defines it (the matcher's own class adds four controls).
_SPACE = "\t-\r \x85\xa0  -     　"


def _class(chars: list[int]) -> str:
    """Code points as ranges of a character class."""
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"\\U{chars[i]:08x}-\\U{chars[j]:08x}")
        i = j + 1
    return "".join(out)


def split_pattern() -> re.Pattern:
    """Contractions, letters, numbers, other marks (each with one leading space), white space."""
    other_number = _class([c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")])
    letters, numbers = rf"[^\W\d_{other_number}]", rf"[\d{other_number}]"
    marks = rf"(?:[^\w{_SPACE}]+|_+)+"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{numbers}+| ?{marks}|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> merged id, as an open-addressing hash table over numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        bits = max(4, (4 * max(1, len(pairs)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        todo = np.fromiter(pairs.keys(), np.int64, len(pairs))
        vals = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.probes = 0
        while len(todo):
            slot = (self._hash(todo) + self.probes) & self.mask
            free = self.keys[slot] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = todo[put], vals[put]
            todo, vals = todo[~put], vals[~put]
            self.probes += 1

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair does not merge (or an id is negative padding)."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        base, out = self._hash(keys), np.full(keys.shape, NONE, np.int32)
        todo = np.nonzero((left >= 0) & (right >= 0))
        for probe in range(self.probes):
            if not len(todo[0]):
                break
            slot = (base[todo] + probe) & self.mask
            found, key = self.keys[slot], keys[todo]
            hit = found == key
            where = tuple(t[hit] for t in todo)
            out[where] = self.values[slot[hit]]
            todo = tuple(t[~hit & (found != -1)] for t in todo)
        return out


class ByteBPE:
    """A byte-level BPE encoder. Special tokens are not known: their strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.split = split_pattern().findall
        self.cache: dict[str, bytes] = {}
        self.cached_bytes = 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian int32 bytes; empty for an empty or null text."""
        pieces = [self.split(t) if t else () for t in texts]
        long = self._learn(set().union(*pieces))
        get = self.cache.__getitem__
        out = [b"".join(map(get, p)) for p in pieces]
        for w in long:
            del self.cache[w]
        return out

    def _learn(self, words: set[str]) -> list[str]:
        """Put ``words`` into the cache; those too long to be kept there after this batch."""
        if self.cached_bytes > CACHE_BYTES:
            self.cache, self.cached_bytes = {}, 0
        new = words - self.cache.keys()
        long = [w for w in new if len(w) > CACHE_PIECE_CHARS]
        # A piece, its ids and the entry take about this much.
        self.cached_bytes += sum(200 + 3 * len(w) for w in new) - sum(200 + 3 * len(w) for w in long)
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            raw = w.encode()
            if len(raw) > MATRIX_WIDTH:
                self.cache[w] = self._merge_long(raw)
            else:
                width = len(raw) if len(raw) <= 8 else 1 << (len(raw) - 1).bit_length()
                buckets.setdefault(width, []).append((w, raw))
        for width, members in buckets.items():
            step = max(1, 4_000_000 // width)
            for i in range(0, len(members), step):
                part = members[i : i + step]
                for (w, _), ids in zip(part, self.merge_rows([r for _, r in part], width), strict=True):
                    self.cache[w] = ids
        return long

    def merge_rows(self, rows: list[bytes], width: int) -> list[bytes]:
        """Encode byte strings of at most ``width`` bytes together."""
        n = len(rows)
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
        length = np.fromiter(map(len, rows), np.int64, n)
        ids = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], np.int32(-1))
        out: list[bytes] = [b""] * n
        row = np.arange(n)
        rank = self.table.lookup(ids[:, :-1], ids[:, 1:])
        while len(row):
            if rank.shape[1]:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(row)), at]
            else:
                at, best = np.zeros(len(row), np.int64), np.full(len(row), NONE)
            over = best == NONE
            if over.any():
                for k in np.nonzero(over)[0]:
                    x = ids[k]
                    out[row[k]] = x[x >= 0].astype("<i4").tobytes()
                ids, rank, row, at, best = ids[~over], rank[~over], row[~over], at[~over], best[~over]
                if not len(row):
                    break
            k, width = np.arange(len(row)), ids.shape[1] - 1
            cols = np.arange(width)
            ids[k, at] = best
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), axis=1)
            for side in (at - 1, at):  # the two pairs the new token is part of
                ok = (side >= 0) & (side < width - 1)
                rank[k[ok], side[ok]] = self.table.lookup(ids[k[ok], side[ok]], ids[k[ok], side[ok] + 1])
        return out

    def _merge_long(self, raw: bytes) -> bytes:
        """The same merges by a heap of (rank, position) over a linked list: n log n for any length."""
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        n, pairs = len(ids), self.table.pairs
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.table.lookup(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (x := pairs.get(r << 32 | ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (x, i))
            if prev[i] >= 0 and (x := pairs.get(ids[prev[i]] << 32 | r)) is not None:
                heapq.heappush(heap, (x, prev[i]))
        return np.array([x for x in ids if x >= 0], "<i4").tobytes()


_ENCODERS: OrderedDict[str, ByteBPE] = OrderedDict()
_SHARED: dict[tuple, tuple] = {}


def _encoder(digest: str, ranks: dict[bytes, int]) -> ByteBPE:
    """One encoder per worker process and vocabulary; the vocabulary's digest tells them apart."""
    if digest not in _ENCODERS:
        while len(_ENCODERS) >= HELD_ENCODERS:
            _ENCODERS.popitem(last=False)
        _ENCODERS[digest] = ByteBPE(ranks)
    _ENCODERS.move_to_end(digest)
    return _ENCODERS[digest]


def _shared_ranks(spark: SparkSession, path: str) -> tuple:
    """(broadcast, digest) of a vocabulary, sent once per application. A fixed public file of about a megabyte."""
    key = (spark.sparkContext.applicationId, os.path.abspath(path), os.path.getmtime(path))
    if key not in _SHARED:
        ranks = read_ranks(path)
        digest = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
        _SHARED[key] = spark.sparkContext.broadcast(ranks), digest
    return _SHARED[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_CHARS, so that long texts do not pile up in memory."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > SLICE_CHARS:
            yield start, i
            start, total = i, 0
        total += int(s)
    yield start, len(sizes)


def _apply(df: DataFrame, text: str, out: str, field_type: T.DataType, vocabulary: str | None, make) -> DataFrame:
    path = vocabulary or os.path.join(VOCABULARIES, DEFAULT_VOCABULARY)
    shared, digest = _shared_ranks(df.sparkSession, path)
    kept = [c for c in df.columns if c != out]
    at = kept.index(text)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, field_type)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(digest, shared.value)
        for batch in batches:
            for i, j in _slices(batch.column(at)) if batch.num_rows else ():
                part = batch.slice(i, j - i)
                ids = bpe.encode(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, make(ids)], names=[*part.schema.names, out])

    return df.select(*kept).mapInArrow(encode, schema)


def encode_column(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` plus ``ids``: the token ids of ``text``, whole texts, without special tokens.

    A null or empty text has an empty list. Repeated rows stay. A column already called ``ids`` is
    replaced; all others pass through. One map stage, no shuffle.
    """

    def make(rows: list[bytes]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))

    return _apply(df, text, ids, T.ArrayType(T.IntegerType()), vocabulary, make)


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """``df`` plus the number of tokens of ``text`` (0 for null or empty)."""
    return _apply(df, text, out, T.LongType(), vocabulary, lambda rows: pa.array(np.array([len(r) // 4 for r in rows], np.int64)))
