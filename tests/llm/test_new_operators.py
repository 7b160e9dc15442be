"""Spelling variants, token counts and the prefix trie, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from tracelake.llm import spelling, token_counts, turn_trie
from tracelake.llm.registry import QUERIES, _pieces

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["docs", "table"])
def some(request, spark, docs, small_dir):
    return docs if request.param == "docs" else spark.read.parquet(f"{small_dir}/documents.parquet")


def test_variants(some):
    got = [tuple(r) for r in spelling.variants(spelling.vocabulary(some)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.variants(pairs(some))


def test_letters_that_lose_one_and_long_runs(spark):
    r = random.Random(4)
    base = ["straße", "Ñandú", "colour", "color", "colours", "aaaaaa", "aaaaaaa", "×÷×÷×", "grün", "abcdefgh" * 40, "abcdefgh" * 39 + "abcdefg"]
    rows = [(i if i % 7 else None, " ".join(r.choice(base) + r.choice(["", "!", "1", "Ā"]) for _ in range(60))) for i in range(80)]
    df = spark.createDataFrame(rows + rows[:3] + [(900, None), (901, "")], "doc_id long, text string")
    assert {tuple(x) for x in spelling.variants(spelling.vocabulary(df)).collect()} == brute.variants(pairs(df))


def test_very_long_runs(spark):
    a = "abcdefgh" * 3000
    df = spark.createDataFrame([(k, f"{x} {x}") for k, x in enumerate((a, a, a[:-1], a[:-1], a[:9000] + "x" + a[9001:]))], "doc_id long, text string")
    vocab = spelling.vocabulary(df, occurs=2)
    got = {(r.word, r.other) for r in spelling.near_words(vocab).collect()}
    words = [r.word for r in vocab.collect()]
    near = lambda x, y: len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1 or len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in (0, 9000, len(x)))
    assert got == {(x, y) for x in words for y in words if near(x, y) or near(y, x)} and got


@pytest.mark.parametrize("slice_", [1 << 14, 3])
def test_near_words(spark, monkeypatch, slice_):
    monkeypatch.setattr(spelling, "SLICE", slice_)
    r = random.Random(9)
    words = {"".join(r.choice("abé") for _ in range(r.randint(5, 8))) for _ in range(400)}
    vocab = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")
    got = [(x.word, x.other) for x in spelling.near_words(vocab).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(w, x) for w in words for x in brute.one_edit(w, "abé") if x in words}


def test_forms_follow_to_the_last(spark):
    vocab = spark.createDataFrame([("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 48), ("bbbbb", 96), ("zzzzz", 5)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(vocab).collect()}
    assert got["aaaaa"] == ("aaaab", "bbbbb", 1) and got["bbbbb"] == (None, "bbbbb", 1) and got["zzzzz"] == (None, "zzzzz", 0)


def test_ties_of_near_words(spark):
    vocab = spark.createDataFrame([("house", 3), ("mouse", 9), ("horse", 9), ("éouse", 9)], "word string, n long")
    assert {r.word: r.form for r in spelling.variants(vocab).collect()}["house"] == "horse"


def test_token_counts(some):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=_pieces())
    got = sorted((tuple(r) for r in token_counts.token_counts(some, _pieces(), limit=200).collect()), key=repr)
    want = []
    for i, t in pairs(some):
        n = len(sp.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 200))
    assert got == sorted(want, key=repr)


def test_token_counts_of_odd_texts():
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=_pieces()), token_counts.Pieces(_pieces())
    own.prepare()
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab ▁\n\t\r  eéà梦😀<s>/0x\x00\xadthe ing") for _ in range(r.randint(0, 40)))
        assert own.count(t) == len(sp.encode(t)), t
    for t in ("a" * 100_001, " " * 30_001 + "x", "<s></s><unk><0x0A>", "é" * 5000, "\n" * 999):
        assert own.count(t) == len(sp.encode(t))


def conversations():
    """Copies, shared first turns, long ones over several layers, gaps, ties, nulls, repeated rows, negative ids."""
    r = random.Random(3)
    say = ["one two", "three", "", "four five  six\n", None]
    rows = []
    for c in range(-30, 90):
        for t in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((c, r.choice([t, t, None, 3]), r.choice(["user", "assistant", None]), r.choice(say)))
    long = [("user" if t % 2 else "assistant", f"turn {t} x y") for t in range(200)]
    for c, n in ((100, 200), (101, 200), (102, 128), (103, 64), (104, 130), (105, 65), (106, 199), (107, 128), (140, 64), (160, 63), (180, 128), (181, 190), (182, 128)):
        rows += [(c, t, *x) for t, x in enumerate(long[:n])]
    rows += [(101, 200, "user", "tail"), (181, 190, "user", "another"), (None, 1, "user", "no id"), (5, 1, "user", "twice"), (5, 1, "user", "twice")]
    rows += [(c, t, *long[t]) for c in range(300, 420) for t in range(5)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("run,layer", [(1 << 14, 64), (7, 64), (3, 2), (1, 5), (40, 1)])
def test_trie(spark, monkeypatch, run, layer):
    monkeypatch.setattr(turn_trie, "STRIDE", 4)
    df = spark.createDataFrame(conversations(), SCHEMA).repartition(5)
    for c in ("conv", "pos", "part", "n", "layer", "h", "base", "words", "digest", "edge"):
        df = df.withColumn(c, F.lit("x"))
    got = [tuple(r) for r in turn_trie.rebuilt_trie(df, layer, run).select(*TRIE).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.trie(conversations())


def test_trie_of_a_table(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in QUERIES["op13_prefix_trie"](spark, small_dir).select(*TRIE).collect()} == brute.trie(rows)


def test_turnless_conversations_only(spark):
    # the first conversation of the family is absent, so most lose their only turn
    rows = [(c, 0, "user", "x") for c in range(1, 20)]
    assert {tuple(r) for r in turn_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA)).select(*TRIE).collect()} == brute.trie(rows)
    bare = [x for x in rows if len(brute.trie([x])) == 1]
    assert bare and {tuple(r) for r in turn_trie.rebuilt_trie(spark.createDataFrame(bare, SCHEMA)).select(*TRIE).collect()} == brute.trie(bare)


def test_empty_tables(spark, empty):
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0
    assert token_counts.token_counts(empty, _pieces()).count() == 0
    assert turn_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
