"""Byte-level BPE encoding and decoding of whole texts, with two tiers of lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens themselves.  Tier 2: all other
pre-tokens are merged from single bytes, with a heap of pair ranks over a doubly linked list.  The driver reads the
rank file once and broadcasts the vocabulary (its size is that of the file, checked); tasks open no file.

Defined results: null or empty text has no tokens and decodes to no bytes; equal texts have equal ids; repeated rows
are kept; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

#: A vocabulary of more bytes isn't broadcast.
MOST_BYTES = 64 << 20
#: Pre-tokens whose ids a task remembers; beyond it forgets them all.
REMEMBERED = 800_000

_U = np.uint64


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (d * _U(0x9E3779B97F4A7C15))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return ((x >> _U(32)) * _U(n)) >> _U(32)


class PerfectHash:
    """Hash and displace: keys fall into buckets, and each bucket, the fullest first, gets the first displacement that
    sends its keys to free slots; as many slots as keys, so buckets of one key name their slot outright."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.n_buckets = max(1, n // 4)
        h = self.hash(keys)
        assert len(np.unique(h)) == len(keys), "two keys share a 64-bit hash"
        bucket = (h % _U(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.n_buckets)
        ends = np.cumsum(sizes)
        self.shift = np.zeros(self.n_buckets, np.int64)
        self.slot_key = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        tries = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            mine = order[ends[b] - sizes[b] : ends[b]]
            if not len(mine):
                break
            if len(mine) == 1:
                self.singles = np.flatnonzero(free)
                rest = [x for x in np.argsort(-sizes, kind="stable") if sizes[x] == 1]
                for s, x in zip(self.singles, rest, strict=True):
                    self.shift[x] = -1 - s
                    self.slot_key[s] = order[ends[x] - 1]
                break
            start = _U(0)
            while True:
                at = _slots(h[mine][None, :], (tries + start)[:, None], n).astype(np.int64)
                fits = free[at].all(axis=1)
                fits &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
                if fits.any():
                    k = int(np.flatnonzero(fits)[0])
                    self.shift[b] = int(tries[k] + start)
                    self.slot_key[at[k]] = mine
                    free[at[k]] = False
                    break
                start += _U(256)

    @staticmethod
    def hash(keys: list[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)

    def place(self, keys: list[bytes]) -> np.ndarray:
        """For each key the one position that it can have among the keys of the table, to be compared."""
        h = self.hash(keys)
        d = self.shift[(h % _U(self.n_buckets)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, _slots(h, np.maximum(d, 0).astype(np.uint64), self.n).astype(np.int64))
        return self.slot_key[slot]


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    def __init__(self, path: str, pattern: str):
        self.rank = ranks(path)
        assert sum(map(len, self.rank)) < MOST_BYTES, "the vocabulary is too large to broadcast"
        self.tokens = list(self.rank)
        self.ids = list(self.rank.values())
        self.table = PerfectHash(self.tokens)
        self.single = [self.rank[bytes([b])] for b in range(256)]
        self.size = max(self.ids) + 1
        #: Of each two tokens that make a third one, its rank.
        self.pairs = {a * self.size + b: r for t, r in self.rank.items() for k in range(1, len(t)) if (a := self.rank.get(t[:k])) is not None and (b := self.rank.get(t[k:])) is not None}
        self.pattern = pattern

    def prepare(self) -> None:
        """Once a worker process: what cannot be sent, and the pre-tokens that it has met."""
        if hasattr(self, "known"):
            return
        self.split = regex.compile(self.pattern).findall
        self.bytes_of = {str(i): t for t, i in self.rank.items()}
        self.known: dict[str, str] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token: the pair of lowest rank merges first, the leftmost of equals.  A heap
        entry is the rank and the place of a pair; it is stale if that place now starts another pair."""
        rank_of, size, n = self.pairs.get, self.size, len(piece)
        ids = list(map(self.single.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] * size + ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            j = after[i]
            if j >= n or ids[i] < 0 or rank_of(ids[i] * size + ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank_of(r * size + ids[k])) is not None:
                    heappush(heap, q << 32 | i)
            k = before[i]
            if k >= 0 and (q := rank_of(ids[k] * size + r)) is not None:
                heappush(heap, q << 32 | k)
        return [x for x in ids if x >= 0]

    def learn(self, new: list[str]) -> None:
        raw = [t.encode() for t in new]
        for text, piece, k in zip(new, raw, self.table.place(raw).tolist() if raw else [], strict=True):
            self.known[text] = str(self.ids[k]) if self.tokens[k] == piece else " ".join(map(str, self.merge(piece)))

    def encode(self, text: str) -> str:
        """Decimal ids, joined by spaces."""
        pieces = self.split(text)
        try:
            return " ".join(map(self.known.__getitem__, pieces))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.learn([p for p in set(pieces) if p not in self.known])
            return " ".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


def _shared(docs: DataFrame, path: str, pattern: str):
    return docs.sparkSession.sparkContext.broadcast(Bpe(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row."""
    sent = _shared(docs, path, pattern)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent.value
        bpe.prepare()
        for batch in batches:
            ids = [[int(i) for i in bpe.encode(t or "").split()] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, content binary) from (doc_id, ids)."""
    sent = _shared(encoded, path, pattern)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent.value
        bpe.prepare()
        for batch in batches:
            content = [bpe.decode(" ".join(map(str, x or []))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(of, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, encoded and decoded again within the task."""
    sent = _shared(docs, path, pattern)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent.value
        bpe.prepare()
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
