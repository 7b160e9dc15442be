"""Token counts of whole texts under a piece model with byte fallback, without emitting a token.

A text is a list of symbols: its characters, or the UTF-8 bytes of a character that is no piece.  A heap holds the adjacent
pairs that make a piece, by rank (the order of scores) and place, over a doubly linked list of symbols; popping the lowest
again and again merges the text.  The count is the number of initial symbols less the number of merges.

No piece has the word mark after another character (checked), so no merge crosses the start of a word: a text is counted
word by word, and a task remembers the counts of short words.  Line ends and tabs that no longer piece holds stand alone.
The driver reads the model once and broadcasts its pairs (their size follows from the file, checked).

Defined results: null or empty text has no bytes and no tokens; strings of control pieces in a text are ordinary text;
repeated rows are kept; an empty table gives no rows; columns other than id and text are ignored, whatever their names.
A very long text is one list of words, and a very long word one heap of its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A model of more bytes isn't broadcast.
MOST_BYTES = 64 << 20
#: Words whose counts a task remembers; beyond it forgets them all.  Longer words are counted each time.
REMEMBERED, LONGEST = 800_000, 64
#: The token limit that over_limit is about.
LIMIT = 4096
MARK = "▁"


class Pieces:
    """Pieces of a model file and the pairs that make them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            content = f.read()
        assert len(content) < MOST_BYTES, "the model is too large to broadcast"
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(content)
        rules, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("not a byte-pair model with byte fallback")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model's normalizer isn't the identity")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces aren't known here")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        pieces = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        number = {p: i for i, p in enumerate(pieces)}
        self.size = len(pieces)
        self.single = {p: i for p, i in number.items() if len(p) == 1}
        if any(MARK in p.lstrip(MARK) for p in pieces) or any(c not in self.single for p in pieces for c in p):
            raise ValueError("pieces reach across words, or have characters that are no pieces")
        #: Of each two pieces that make a third one: its rank, and its number.
        self.pairs = {a * self.size + b: (order[s], number[p]) for p, s in pieces.items() for k in range(1, len(p)) if (a := number.get(p[:k])) is not None and (b := number.get(p[k:])) is not None}
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in pieces if len(p) > 1))
        #: Words with their marks, runs of marks, and characters that stand alone.
        self.pattern = (f"[{alone}]|" if alone else "") + f"{MARK}*[^{MARK}{alone}]+|{MARK}+"

    def symbols(self, word: str) -> list[int]:
        """Piece numbers of the characters; -1 for each byte of a character that is none."""
        try:
            return list(map(self.single.__getitem__, word))
        except KeyError:
            return [i for c in word for i in ([self.single[c]] if c in self.single else [-1] * len(c.encode("utf-8", "surrogatepass")))]

    def merges(self, ids: list[int]) -> int:
        """How many merges the symbols allow: the pair of lowest rank first, the leftmost of equals.  A heap entry is the
        rank and the place of a pair; it is stale if that place no longer starts a pair of that rank.  A symbol that is no
        piece, or was merged into another, is -1 and makes no pair."""
        n, size, known, done = len(ids), self.size, self.pairs.get, 0
        heap = [p[0] << 40 | i for i, (a, b) in enumerate(pairwise(ids)) if a >= 0 and b >= 0 and (p := known(a * size + b))]
        if not heap:
            return 0
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = heappop(heap)
            i = x & 0xFFFFFFFFFF
            j, a = after[i], ids[i]
            if j >= n or a < 0 or (b := ids[j]) < 0 or not (p := known(a * size + b)) or p[0] != x >> 40:
                continue
            a = ids[i] = p[1]
            ids[j] = -1
            done += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (b := ids[k]) >= 0 and (p := known(a * size + b)):
                    heappush(heap, p[0] << 40 | i)
            k = before[i]
            if k >= 0 and (b := ids[k]) >= 0 and (p := known(b * size + a)):
                heappush(heap, p[0] << 40 | k)
        return done

    def word(self, word: str) -> int:
        ids = self.symbols(word)
        return len(ids) - self.merges(ids)

    def prepare(self) -> None:
        """Once a worker process: what cannot be sent, and the counts of the words that it has met."""
        if not hasattr(self, "known"):
            self.split = re.compile(self.pattern).findall
            self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = self.split(self.prefix + text.replace(" ", MARK))
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            pass
        if len(self.known) > REMEMBERED:
            self.known.clear()
        total = 0
        for w in words:
            n = self.known.get(w)
            if n is None:
                n = self.word(w)
                if len(w) <= LONGEST:
                    self.known[w] = n
            total += n
        return total


def token_counts(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row under the model file at `path` on the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(Pieces(path))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        pieces.prepare()
        for batch in batches:
            n = [pieces.count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return rows.mapInArrow(of, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
