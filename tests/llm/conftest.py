"""Small tables with the awkward cases that every operator must handle."""

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def prose(seed: int, n: int, vocabulary: int = 300) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        out.append(r.choice(words))
        out.append("\n" if i % 12 == 11 else " ")
    return "".join(out).strip()


def rows():
    """Prose, exact and near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    passage = "\n".join(prose(900 + i, 30) for i in range(4))
    out = [(i, prose(i, 40 + 17 * i), ["en", "de", None, "xx"][i % 4], f"src{i % 15}") for i in range(40)]
    out += [(100 + i, prose(3, 91), "en", "src0") for i in range(12)]
    for i in range(30):
        words = prose(7, 159).split(" ")
        for k in range(i % 9):
            words[(11 * k + i) % len(words)] = f"x{i}y{k}"
        out.append((200 + i, " ".join(words), "en", "src0"))
    out += [(300 + i, prose(50 + i, 60) + "\n" + passage + "\n" + prose(80 + i, 40), "fr", "src3") for i in range(8)]
    out += [(400, None, None, None), (401, "", "en", "src1"), (402, " \n\t ", "en", "src1"), (403, "one", "de", "odd"), (404, "one two three", "de", "odd")]
    out += [(405, "ONE two  three", "de", "odd"), (406, "ẞ İ ſ 😀     ﬁ", "es", "src2"), (407, prose(5, 9000), "es", "src2"), (408, "\n".join(["same line of five words"] * 70), "es", "src2")]
    out += [(409, prose(5, 9000) + " tail", "es", "src2"), (None, "a text without an id at all", "en", "src4"), (500, prose(1, 57), "en", "src5"), (500, prose(1, 57), "en", "src5")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), DOCS).repartition(5)
    # names that operators use inside
    clash = ("n_words", "h", "node", "bucket", "stratum", "row", "gone", "blob", "spans", "component_id", "epoch", "gone lines_", "w", "x", "ord",
             "gone lines", "near copy id", "taken id", "meta.url", "key", "lost", "of", "whole", "taken", "quality rules ", "c", "a b,c", "label", "place")
    return df.select("*", *[F.lit(7).alias(c) for c in clash]).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
