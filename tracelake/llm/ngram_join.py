"""N-gram Jaccard join: documents whose sets of five-word shingles are at least 75 % alike, and their components.

Method: partition the universe of shingle hashes into segments, by bands of set size.  Sets of sizes s <= l with
Jaccard >= 3/4 differ in at most (s + l) / 7 elements, so of any (s + l) / 7 + 1 segments one holds no difference.
Each segment of a set gets an allocation by what its list costs:

  0  the empty segment, and a list that turns out long: matching it costs much and tells little;
  1  the segment's content is a key: one difference hides it;
  2  its content and its content less any one element are keys: two differences hide it.

A set emits its segments in order until the keys exceed the differences that a partner may have, by a margin that
makes up for keys lost to long lists.  A set that cannot reach the number with allocation 1 also emits all segments
with allocation 2 into a second index, and if that is too little (tiny sets) each shingle into a third: a pair is
missed in an index only if both sets fall short there, so both are in the next.  Keys meet in Spark, packed and dealt
by hash.  Candidates pass an exact bound (bitmaps of hash parity, whose distance never exceeds the true difference)
before the sets themselves are compared.

The allocation is by measured cost: a list that turns out longer than LONG gets 0.  Sets that lost more keys by it than
their margin are compared with a leader of the list, and where the list still spans components, joined by their
differences from it (links.link_lists), so no link is lost and no list is multiplied with itself.

Defined results: null or word-less texts have the empty set and stand alone; a null id gets a null component; equal
texts are one class; repeated rows are kept in the result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracelake.llm.links import link, link_lists, small
from tracelake.llm.shingles import mix, sets, utf8
from tracelake.sources.shared import cut, small_batches

PERCENT = 75
#: Lists up to SHORT give all pairs at once; those beyond LONG (not below SHORT) count as lost keys.
SHORT = LONG = 8
#: Keys that one task gathers, and the share of spare keys.
TASK_KEYS, SPARE = 3_000_000, 0.12
#: Texts whose keys a task holds and packs at once.
TEXTS = 2_500

_U = np.uint64


def _tops() -> list[int]:
    tops = [4]
    while tops[-1] < 1 << 40:
        tops.append(-(-tops[-1] * 3 // 2))
    return tops


#: The largest set size of each band.
TOPS = np.array(_tops())


def segments(band: int) -> int:
    need = 2 * int(TOPS[band]) // 7 + 1
    return int(need * (1 + 2 * SPARE)) + 3


def _keys(x: np.ndarray, band: int, need: int) -> tuple[list[np.ndarray], int]:
    """Keys of the sorted hashes x in the partition of a band, when a partner may differ in need - 1 elements; and
    how many of them may be lost."""
    m = segments(band)
    seg = ((x >> _U(32)) * _U(m)) >> _U(32)
    heads = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    value = mix(x)
    total = np.add.reduceat(value, heads)
    place = mix((seg[heads] + _U(band << 40)) * _U(0x9E3779B97F4A7C15))
    wanted = need + int(np.ceil(SPARE * need)) + 2
    out = [mix(total[:wanted] ^ place[:wanted])]
    spare = len(out[0]) - need
    if spare >= 0:
        return out, spare
    sizes = np.diff(np.append(heads, len(x)))
    second = mix(place + _U(2))
    of = np.repeat(np.arange(len(heads)), sizes)
    more = sizes[of] > 1
    out += [mix(total ^ second), mix((total[of] - value)[more] ^ second[of][more])]
    if int(np.minimum(sizes, 2).sum()) < need:
        out.append(mix(x ^ mix(np.full(1, (band << 40) + 3, np.uint64))))
    return out, 0


def keys(x: np.ndarray) -> tuple[np.ndarray, int]:
    """All keys of a set, and the least of the spare keys over its bands."""
    n = len(x)
    band = int(np.searchsorted(TOPS, n))
    most = 4 * n // 3
    out, spare = _keys(x, band, (n + min(most, int(TOPS[band]))) // 7 + 1)
    if most > TOPS[band]:
        more, other = _keys(x, band + 1, (n + most) // 7 + 1)
        out, spare = out + more, min(spare, other)
    return np.concatenate(out), spare


def digest(x: np.ndarray) -> bytes:
    """128 bits of hash of a set: equal digests make a class."""
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def class_key(x: np.ndarray) -> int:
    """The short handle of a set in key lists; sets that share one by chance are both candidates."""
    return int.from_bytes(digest(x)[:8], "big", signed=True)


def least_spare(n: int) -> int:
    """The fewest spare keys of sets that may be similar to a set of n elements."""
    low = max(1, -(-PERCENT * n // 100))
    need = (low + min(4 * low // 3, int(TOPS[np.searchsorted(TOPS, low)]))) // 7 + 1
    return int(np.ceil(SPARE * need)) + 2


def parity(x: np.ndarray) -> bytes:
    """A bit for each of about len(x) hash classes: whether an odd number of elements falls into it."""
    bits = max(64, 1 << int(len(x) - 1).bit_length())
    return np.packbits((np.bincount((mix(x) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(x: bytes, y: bytes, n: int, m: int) -> bool:
    """False only if sets of sizes n and m with these parities cannot be similar."""
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= (n + m) // 7


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, node, spare, n_keys, bits) of each row; digest and node, hashes of the set, are null
    for the empty set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(1))
            n, whole, node, spare, n_keys, bits = [], [], [], [], [], []
            for x in sets(data, ends):
                n.append(len(x))
                k, s = keys(x) if len(x) else ((), 0)
                n_keys.append(len(k))
                spare.append(min(s, least_spare(len(x))) if s else 0)
                whole.append(digest(x) if len(x) else None)
                node.append(class_key(x) if len(x) else None)
                bits.append(parity(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(node, pa.int64()), pa.array(spare, pa.int32()), pa.array(n_keys, pa.int64()), pa.array(bits, pa.binary())],
                ["doc_id", "n_shingles", "digest", "node", "spare", "n_keys", "bits"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(of, "doc_id long, n_shingles long, digest binary, node long, spare int, n_keys long, bits binary")


def met(docs: DataFrame, n_keys: int, text: str = "text") -> DataFrame:
    """Lists of at least two sets.  kind 0: a pair (a, b) of a short list.  kind 1: set a of the long list `key` of
    `size` sets, whose first is b.  Keys travel packed: a row for each batch and hash range;
    what a batch holds beyond LONG + 1 sets of a key is dealt out over all tasks, with the first of them as b."""
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // TASK_KEYS))
    parts = 1 << int(4 * tasks - 1).bit_length()
    shift = 64 - (parts.bit_length() - 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, len(b), TEXTS)):
            data, ends = utf8(batch.column(0))
            nodes, got = [], []
            for x in sets(data, ends):
                if len(x) and (node := class_key(x)) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    got.append(keys(x)[0])
            if not got:
                continue
            key = np.concatenate(got)
            owner = np.repeat(np.arange(len(got)), [len(k) for k in got])
            table = np.array(nodes, np.int64)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            rows: dict[str, list] = {"part": [], "high": [], "low": [], "owner": [], "nodes": []}
            over, lead = overflow(key, LONG)
            if over.any():
                name = ((key >> _U(shift)) << _U(48) | key & _U((1 << 48) - 1))[over].astype(np.int64)
                spread = (mix(key[over] + _U(nodes[0] & (1 << 63) - 1)) >> _U(shift)).astype(np.int64)
                first, member = table[owner[lead[over]]], table[owner[over]]
                for p in np.unique(spread):
                    mine = spread == p
                    for c, x in (("part", int(p)), ("high", name[mine].tobytes()), ("low", member[mine].tobytes()), ("owner", first[mine].tobytes()), ("nodes", None)):
                        rows[c].append(x)
                key, owner = key[~over], owner[~over]
            cuts = np.searchsorted(key >> _U(shift), np.arange(parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(cuts)):
                k, o = key[cuts[p] : cuts[p + 1]], owner[cuts[p] : cuts[p + 1]]
                used = np.zeros(len(table), bool)
                used[o] = True
                rows["part"].append(int(p))
                rows["high"].append((k >> _U(16)).astype(np.uint32).tobytes())
                rows["low"].append(k.astype(np.uint16).tobytes())
                rows["owner"].append((np.cumsum(used) - 1)[o].astype(np.uint16 if used.sum() < 65_536 else np.uint32).tobytes())
                rows["nodes"].append(table[used].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in ("high", "low", "owner", "nodes"))], list(rows))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, high, low, owner, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if nodes is None:
                    name, member, first = (np.frombuffer(x, np.int64) for x in (high, low, owner))
                    yield _rows(1, name, np.full(len(name), LONG + 1), member, first)
                    continue
                k = (np.frombuffer(high, np.uint32).astype(np.uint64) << _U(16)) | np.frombuffer(low, np.uint16)
                o = np.frombuffer(owner, np.uint16 if len(owner) == 2 * len(k) else np.uint32)
                held.setdefault(part, []).append((k, np.frombuffer(nodes, np.int64)[o]))
        for part in sorted(held):
            yield from lists(part, *map(np.concatenate, zip(*held.pop(part), strict=True)), SHORT)

    packed = docs.select(F.col(text).alias("text")).mapInArrow(pack, "part int, high binary, low binary, owner binary, nodes binary")
    return packed.repartition(tasks, "part").mapInArrow(meet, "kind int, key long, size int, a long, b long")


def overflow(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For the sorted keys of one batch: which entries are beyond the first most + 1 of their key, and where each entry's
    key begins.  Such a list is long whatever other tasks hold, so those entries need not meet the rest: they go
    elsewhere with the first of the batch, and only most + 1 of a batch reach the task that owns the key."""
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    lead = np.repeat(heads, np.diff(np.append(heads, len(key))))
    return np.arange(len(key)) - lead > most, lead


def lists(part: int, key: np.ndarray, node: np.ndarray, short: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    same = key[1:] == key[:-1]
    often = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    key, node = key[often], node[often]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))[: len(key)]
    key, node = key[fresh], node[fresh]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    sizes = np.diff(np.append(heads, len(key)))
    first, second = [], []
    for s in range(2, short + 1):
        at = heads[sizes == s]
        for i in range(s):
            for j in range(i + 1, s):
                first.append(node[at + i])
                second.append(node[at + j])
    if first and sum(map(len, first)):
        a, b = np.concatenate(first), np.concatenate(second)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        a, b = a[new], b[new]
        yield _rows(0, np.zeros(len(a), np.int64), np.full(len(a), 2), a, b)
    big = np.flatnonzero(sizes > short)
    if len(big):
        at = np.repeat(heads[big] - (np.cumsum(sizes[big]) - sizes[big]), sizes[big]) + np.arange(sizes[big].sum())
        name = (key[at] | (_U(part) << _U(48))).astype(np.int64)
        yield _rows(1, name, np.repeat(sizes[big], sizes[big]), node[at], np.repeat(node[heads[big]], sizes[big]))


def _rows(kind: int, key: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(key), pa.array(size.astype(np.int32)), pa.array(a), pa.array(b)], ["kind", "key", "size", "a", "b"])


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of nodes that may be similar, as pairs of their least documents."""

    @F.arrow_udf("boolean")
    def may(x: pa.Array, y: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array([may_link(*r) for r in zip(*(c.to_pylist() for c in (x, y, n, m)), strict=True)], pa.bool_())

    for end in ("a", "b"):
        of = classes.select(F.col("node").alias(end), F.col("rep").alias(f"rep_{end}"), F.col("n_shingles").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
        pairs = pairs.join(of, end)
    near = pairs.where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)").where(may("bits_a", "bits_b", "n_a", "n_b"))
    return near.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """digests() of rows, and (digest, class_id, component_id) of their different sets, both written."""
    d = cut(digests(rows))
    classes = cut(d.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("node").alias("node"), F.first("n_shingles").alias("n_shingles"),
        F.min("spare").alias("spare"), F.first("bits").alias("bits")))
    out = cut(met(rows.where("doc_id is not null"), d.agg(F.sum("n_keys").alias("s")).first().s or 0))
    texts = rows.select(F.col("doc_id").alias("node"), "text")
    links, found = link(_possible(out.where("kind = 0").select("a", "b"), classes), texts, PERCENT)
    found = link_lists(_hidden(out, classes), texts, PERCENT, links, found)[1]
    return d, cut(classes.join(found, classes.rep == found.v, "left").select("digest", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id")))


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of each row: the least document reachable by links, and the least
    one with an equal set."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):  # all work in Python is done and written within
        d, whole = _classes(rows)
    told = d.select("doc_id", "n_shingles", "digest").join(whole, "digest", "left")
    known = F.col("doc_id").isNotNull()
    return told.select("doc_id", "n_shingles", F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"))


def _hidden(out: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, node): the long lists, with those of their sets, by least document, that lost more keys than any partner has
    to spare.  A similar pair that no short list holds shares a long one, and both its sets are among these."""
    members = out.where("kind = 1").select("key", F.col("a").alias("node")).distinct()
    lost = members.groupBy("node").agg(F.count("*").alias("lost"))
    short = cut(classes.join(lost, "node").where("lost > spare").select("node", "rep"))
    return members.join(small(short), "node").select("key", F.col("rep").alias("node"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the least id.  Rows with a null id stay; rows that
    repeat an id stay or go together."""
    gone = jaccard_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"))  # no column of docs clashes with those added
    return own.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")
