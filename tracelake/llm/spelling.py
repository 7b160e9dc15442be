"""Spelling variants of the words of a corpus, found with bit-sliced position indexes.

Words that differ by one inserted, deleted or replaced code point share the first or the last half of the shorter one
(rounded down), so the vocabulary is cut into blocks by (length, side, half).  Each block, or slice of a large one, is
indexed by position and letter: one bitset over its words for each.  A query letter by letter keeps three sets of words at
once: those without an error so far, those with one replaced letter, and those with one letter too many, whose positions
are shifted by one.  Words with a letter too few are found from their longer partner's side.

Defined results: a null text has no words; a null id counts as the text "null" in the hash of an occurrence; only A-Z are
lower-cased; repeated rows count again; of near words with the same count the first in code-point order is the form; an
empty table gives no rows; columns other than id and text are ignored, whatever their names.  A very long run is one word:
its index has one bitset for each of its positions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracelake.sources.shared import cut, drop

#: Words are this long, and occur so often.
LETTERS, OCCURS = 5, 3
#: A form occurs so many times as often as the word.
TIMES = 2
#: One occurrence in so many loses a letter.
ONE_IN = 97
#: Words of a block that one index holds; a larger block is cut into slices, and its queries go to each.
SLICE = 1 << 14

# What a word is made of, and the letters that are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text", letters: int = LETTERS, occurs: int = OCCURS) -> DataFrame:
    """(word, n): the words of all texts.  An occurrence whose hash ONE_IN divides loses one letter; runs shorter than a
    word can't become one, so they are never cut out."""
    key = F.coalesce(F.col(id).cast("long").cast("string"), F.lit("null"))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({RUN}{{{letters},}})"))).alias("run"))
    hashed = runs.select(F.translate("run", UPPER, LOWER).alias("run"), "key").withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.pmod("h", F.lit(ONE_IN)) == 0, lost).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurs)


class Index:
    """Bit-sliced positions of a list of words: bit k of a set stands for word k."""

    def __init__(self, words: list[str]):
        self.at: dict[tuple[int, str], int] = defaultdict(int)
        self.long: dict[int, int] = defaultdict(int)
        self.all = (1 << len(words)) - 1
        for k, w in enumerate(words):
            bit = 1 << k
            self.long[len(w)] |= bit
            for place in enumerate(w):
                self.at[place] |= bit

    def near(self, query: str) -> int:
        """The set of words that are the query with one letter replaced or one more."""
        at, n = self.at.get, len(query)
        same, replaced, more = self.all, 0, 0
        here = at((0, query[0]), 0)
        for i, letter in enumerate(query):
            ahead = at((i + 1, letter), 0)
            more = (more | same) & ahead
            replaced = replaced & here | same & ~here
            same &= here
            if i + 1 < n:
                here = at((i + 1, query[i + 1]), 0)
        return replaced & self.long.get(n, 0) | (more | same) & self.long.get(n + 1, 0)


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _pairs(words: list[str], counts: list[int], asked: Iterator[tuple[str, int, bool]]) -> Iterator[tuple[str, str, int]]:
    """(word, other, other's n) both ways for the queries (word, n, whether the block is one of first halves)."""
    index = Index(words)
    for q, n, first in asked:
        half = len(q) // 2
        for k in _bits(index.near(q)):
            w = words[k]
            if not first and w[:half] == q[:half]:
                continue  # found in the block of first halves
            yield q, w, counts[k]
            if len(w) > len(q):
                yield w, q, n


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, other, other_n): every two words of (word, n) that differ by exactly one letter, both ways and once each."""
    long = F.char_length("word")
    ways = [(shorter, first) for shorter in (0, 1) for first in (True, False)]
    keyed = vocab.select("word", "n", F.explode(F.array(*[F.struct((long - shorter).alias("length"), F.lit(first).alias("first")) for shorter, first in ways])).alias("way")).select("word", "n", "way.*")
    part = F.when(F.col("first"), F.expr("left(word, cast(length div 2 as int))")).otherwise(F.expr("right(word, cast(length div 2 as int))"))
    keyed = keyed.select(F.xxhash64("length", "first", part).alias("block"), "first", "word", "n", (F.char_length("word") == F.col("length")).alias("asks"))
    sizes = keyed.groupBy("block").agg(F.count("*").alias("size"), F.max("asks").alias("asked")).where("size > 1 and asked").select("block", F.ceil(F.col("size") / SLICE).cast("int").alias("slices"))
    dealt = keyed.join(sizes, "block")
    slices = F.col("slices")
    held = dealt.select("block", F.pmod(F.xxhash64("word"), slices).cast("int").alias("slice"), F.lit(False).alias("asks"), "word", "n", "first")
    asked = dealt.where("asks").select("block", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(True).alias("asks"), "word", "n", "first")
    n = max(int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = held.unionByName(asked).repartition(n, "block", "slice").sortWithinPartitions("block", "slice", "asks", "word")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple[str, str, int]] = []
        for _, block in groupby(stream, lambda r: r[:2]):
            words, counts = [], []
            for asks, part in groupby(block, lambda r: r[2]):
                if not asks:
                    for r in part:
                        words.append(r[3])
                        counts.append(r[4])
                elif words:
                    for p in _pairs(words, counts, ((r[3], r[4], r[5]) for r in part)):
                        out.append(p)
                        if len(out) >= 10_000:
                            yield _batch(out)
                            out = []
        yield _batch(out)

    return rows.mapInArrow(of, "word string, other string, other_n long")


def _batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "other", "other_n"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form of each word of (word, form), by pointer jumping; counts double along forms, so their
    chains are short and never closed."""
    up = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        jumped = cut(up.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        drop(up)
        moved = not jumped.where("moved").isEmpty()
        up = jumped
        if not moved:
            return up.select("word", "root")


def variants(vocab: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n): its near word of largest count, if that is at
    least `times` its own, and the last of these forms."""
    vocab = cut(vocab)
    near = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    told = vocab.join(near, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    told = cut(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    found = roots(told.where("form is not null").select("word", "form"))
    return told.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
