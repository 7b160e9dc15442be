"""The trie of conversation prefixes, by union-find over the common prefixes of sorted neighbours.

A conversation is the list of the digests of its turns, cut into layers of LAYER turns.  A row is one layer of one
conversation, keyed by the hash of all turns above it, so a layer's rows with one key are the conversations that share
everything so far.  Rows are range-partitioned and sorted, and read in runs of at most RUN rows.  In a run the edges
between neighbours are taken in descending length of their common prefix; each merge of components makes or widens a
branching node.  A node inside a run is finished there.  The nodes on the path of the first and of the last row of a run,
and those where a layer ends, may go on elsewhere: such a forest is contracted to partial rows, which Spark merges by the
hash of the prefix.

Two passes read the sorted rows.  In the first, a conversation that meets a smaller one at a node says how many words they
share up to there, and each node without children names its smallest conversation; both are one number a conversation.  In
the second they are summed over each node's conversations: leaves, and tokens saved.

No conversation and no group of equal ones is held whole: places within a conversation are counted in sorted pieces, a row
holds at most LAYER turns, and the ids that end at a node are hashed as a stream.

Defined results: rows without conversation id are left out; a null role or text is empty; turns of the same number are in
the order of their digests, repeated rows are turns of their own; an empty table has no conversations and no rows; columns
other than those named are ignored, whatever their names.  Very long texts are only hashed and counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracelake.llm.links import small
from tracelake.sources.shared import cut, drop

#: Turns of a conversation in one row; bytes of a digest; rows of a run, which a task holds.
LAYER, DIGEST, RUN = 64, 16, 1 << 14
#: Layers whose hashes are added up in one window.
STRIDE = 1024
#: Conversations to a family, the first of which gives the others their first turns; and how many turns at most.
FAMILY, HEADS = 20, 4

WORD = r"[^\x20\x09-\x0D]+"


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def placed(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, words) of each turn, from position 0.  Positions are counted in ranges of the sorted turns,
    so a conversation may be of any length."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    digest = F.unhex(F.md5(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said))).alias("digest")
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), digest, F.regexp_count(said[1], F.lit(WORD)).cast("long").alias("words"))
    dealt = cut(rows.repartitionByRange(_parts(rows), "conv", F.col("turn").asc_nulls_first(), "digest").withColumn("part", F.spark_partition_id()))
    pieces = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    within = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "digest")) - 1
    numbered = dealt.withColumn("at", within).join(pieces.select("conv", "part", before), ["conv", "part"])
    return numbered.select("conv", (F.col("before") + F.col("at")).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, digest, words) of each turn, and (conv, n): the turns of each conversation, after the first of its
    family gives it its first h turns, with h the hash of its id."""
    counts = turns.groupBy("conv").agg(F.max("pos").alias("last")).select("conv", (F.col("last") + 1).alias("n"))
    convs = counts.select("conv", "n", F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(HEADS)).alias("h"), (F.col("conv") - F.pmod("conv", F.lit(FAMILY))).alias("base"))
    of_base = counts.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = cut(convs.join(of_base, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0)))))
    own = turns.join(convs.select("conv", "h", "given"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "digest", "words")
    heads = turns.where((F.col("pos") < HEADS) & (F.pmod("conv", F.lit(FAMILY)) == 0)).withColumnRenamed("conv", "base")
    given = heads.join(convs.select("base", "conv", "given"), "base").where("pos < given").select("conv", "pos", "digest", "words")
    return own.unionByName(given), convs.select("conv", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def layered(turns: DataFrame, counts: DataFrame, size: int = LAYER) -> DataFrame:
    """(layer, pa, pb, block, words, conv, ends, above, na, nb): the turns of one layer of a conversation, the hash and
    the words of those above, whether it ends here, and the hash of all turns to the layer's end."""
    listed = F.sort_array(F.collect_list(F.struct((F.col("pos") % size).cast("int").alias("at"), F.hex("digest").alias("digest"), "words")))  # at most size
    rows = turns.groupBy("conv", F.floor(F.col("pos") / size).cast("long").alias("layer")).agg(listed.alias("x")).select(
        "conv", "layer", F.array_join("x.digest", "").alias("block"), F.col("x.words").alias("words"))
    bare = counts.where("n = 0").select("conv", F.lit(0).cast("long").alias("layer"), F.lit("").alias("block"), F.array().cast("array<bigint>").alias("words"))
    own = [F.xxhash64(F.lit(s), "layer", "block").alias(c) for s, c in enumerate(("ha", "hb"))]
    rows = rows.unionByName(bare).select("*", *own, F.floor(F.col("layer") / STRIDE).alias("stride"), F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + w).alias("sum"))
    # the hash of a prefix is the exclusive or of the hashes of its layers: of whole strides first, then within one
    told = lambda c, window: F.coalesce(c.over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strides = rows.groupBy("conv", "stride").agg(F.bit_xor("ha").alias("sa"), F.bit_xor("hb").alias("sb"), F.sum("sum").alias("ss"))
    earlier, inner = Window.partitionBy("conv").orderBy("stride"), Window.partitionBy("conv", "stride").orderBy("layer")
    strides = strides.select("conv", "stride", told(F.bit_xor("sa"), earlier).alias("ea"), told(F.bit_xor("sb"), earlier).alias("eb"), told(F.sum("ss"), earlier).alias("es")).join(counts, "conv")
    rows = rows.join(strides, ["conv", "stride"]).withColumns({
        "pa": told(F.bit_xor("ha"), inner).bitwiseXOR(F.col("ea")), "pb": told(F.bit_xor("hb"), inner).bitwiseXOR(F.col("eb")), "above": told(F.sum("sum"), inner) + F.col("es")})
    ends = F.col("layer") == F.greatest(F.floor((F.col("n") - 1) / size), F.lit(0))
    return rows.select(
        "layer", "pa", "pb", F.unhex("block").alias("block"), "words", "conv", ends.alias("ends"), "above",
        F.col("pa").bitwiseXOR(F.col("ha")).alias("na"), F.col("pb").bitwiseXOR(F.col("hb")).alias("nb"))


class Row(NamedTuple):
    """One layer of a conversation, as layered() makes it, with two numbers of the first pass: words that it shares with a
    smaller conversation, and 1 if it is the smallest of a node without children."""

    layer: int
    pa: int
    pb: int
    block: bytes
    words: list[int]
    conv: int
    ends: bool
    above: int
    na: int
    nb: int
    shared: int
    leaf: int

    def key(self, length: int, size: int) -> tuple[int, int, int]:
        """Depth and hash of the prefix that ends `length` turns into this layer of `size` turns."""
        depth = self.layer * size + length
        if length in (0, size):
            return (depth, self.na, self.nb) if length else (depth, self.pa, self.pb)
        h = hashlib.blake2b(self.block[: length * DIGEST], digest_size=16, key=b"%d %d" % (self.pa, self.pb)).digest()
        return depth, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


class Component:
    """Rows i to j of a group, equal in the first `top` turns of their layer; its parent node has the first `foot`."""

    __slots__ = ("ends", "first", "foot", "i", "j", "leaves", "least", "parent", "shared", "top", "under")

    def __init__(self, i: int, j: int, top: int, least: int, first: int):
        self.i, self.j, self.top, self.foot, self.parent = i, j, top, 0, None
        #: The smallest conversation, and what it shares; sums over all; nodes right below; rows that end at the top.
        self.least, self.first = least, first
        self.shared = self.leaves = 0
        self.under: list[Component] = []
        self.ends: list[int] = []


def _common(a: bytes, b: bytes) -> int:
    """Digests that two blocks share from the start."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    same = 0
    while a[same * DIGEST : (same + 1) * DIGEST] == b[same * DIGEST : (same + 1) * DIGEST]:
        same += 1
    return same


def forest(rows: list[Row], lost: list[tuple[int, int]]) -> list[Component]:
    """The nodes of sorted rows of one layer and key.  lost gets (conversation, words) for each that is not the smallest of
    its part of a merge: the words that it shares with a smaller one.

    Edges between neighbours are taken in descending length of their common prefix; all that merges at one length and
    place becomes one component, a branching node over the parts that reach further."""
    up = list(range(len(rows)))
    at: list[Component] = []
    by_length: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        c = Component(i, i, len(r.block) // DIGEST, r.conv, r.shared)
        c.shared, c.leaves = r.shared, r.leaf
        if r.ends:
            c.ends.append(i)
        at.append(c)
        if i and (n := _common(rows[i - 1].block, r.block)):
            by_length.setdefault(n, []).append(i)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    nodes: list[Component] = []
    for length in sorted(by_length, reverse=True):
        made: dict[int, list[Component]] = {}
        for i in by_length[length]:
            a, b = root(i - 1), root(i)
            made.setdefault(a, [at[a]]).append(at[b])
            up[b] = a
        for a, parts in made.items():
            best = min(parts, key=lambda c: c.least)
            node = at[a] = Component(parts[0].i, parts[-1].j, length, best.least, best.first)
            words = rows[node.i].above + sum(rows[node.i].words[:length])
            for c in parts:
                node.shared += c.shared
                node.leaves += c.leaves
                if c is not best:
                    lost.append((c.least, words))
                if c.top > length:
                    c.foot, c.parent = length, node
                    node.under.append(c)
                else:
                    node.ends += c.ends
            nodes += node.under
    return nodes + [at[a] for a in dict.fromkeys(root(i) for i in range(len(rows)))]


# "node": finished but perhaps for its parent; "part": of a node, by key; "end": ids (in ends) that end at a partial node;
# "lost": words that conv shares with a smaller conversation; "leaf": conv is the smallest of a node without children
SCHEMA = ("kind string, depth long, ka long, kb long, conv long, up_depth long, up_a long, up_b long, up_conv long, n long, children long, leaves long, "
          "shared long, first long, above long, words long, edge boolean, ends string")
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in SCHEMA.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()
NO_KEY = (None, None, None)


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _group(rows: list[Row], size: int, at_left: bool, at_right: bool, sums: bool) -> Iterator[tuple]:
    """Tuples of SCHEMA from a run's rows of one layer and key.  at_left, at_right: whether its first row is the run's
    first, its last the run's last.  Without sums only "part", "lost" and "leaf"."""
    lost: list[tuple[int, int]] = []
    nodes = forest(rows, lost)
    if not sums:
        for conv, words in lost:
            yield "lost", *NO_KEY, conv, *NO_KEY, *[None] * 7, words, None, None

    def open_(c: Component) -> bool:
        return at_left and c.i == 0 or at_right and c.j == len(rows) - 1

    tops = [c for c in nodes if c.parent is None]
    ends = [rows[i].conv for c in tops if c.top == 0 for i in c.ends]
    inner = sum(not open_(c) for c in tops if c.top)
    if rows[0].layer == 0:  # the root
        best = min(tops, key=lambda c: c.least)
        yield "part", *rows[0].key(0, size), best.least, *NO_KEY, None, len(rows), inner, sum(c.leaves for c in tops), sum(c.shared for c in tops), best.first, 0, 0, True, None
        if sums and ends:
            yield "end", *rows[0].key(0, size), ends[0], *[None] * 12, _joined(ends)
    else:  # nodes under the last node of the layer above
        yield "part", *rows[0].key(0, size), None, *NO_KEY, None, 0, inner, 0, 0, *[None] * 3, False, None
    for c in nodes:
        if not c.top:
            continue
        r, n, edge = rows[c.i], c.j - c.i + 1, open_(c)
        above = r.above + sum(r.words[: c.foot])
        goes_on = c.top == size and len(c.ends) < n
        for length in range(c.foot + 1, c.top + 1):
            tip, words = length == c.top, r.words[length - 1]
            ids = [rows[i].conv for i in c.ends] if tip else []
            children = sum(not (edge and open_(u)) for u in c.under) if tip else int(not edge)
            if length > c.foot + 1 and not edge:
                up, up_conv = NO_KEY, c.least
            elif length == c.foot + 1 and c.parent is not None and not open_(c.parent):
                up, up_conv = NO_KEY, c.parent.least
            else:
                up, up_conv = r.key(length - 1, size), None
            if edge or tip and goes_on:
                key = r.key(length, size)
                yield "part", *key, c.least, *up, up_conv, n, children, c.leaves, c.shared, c.first, above, words, edge, _joined(ids) if ids and not edge else None
                if sums and ids and edge:
                    yield "end", *key, ids[0], *[None] * 12, _joined(ids)
            elif sums:
                told = hashlib.sha256(_joined(ids).encode()).hexdigest() if ids else NO_ENDS
                yield "node", length + r.layer * size, None, None, c.least, *up, up_conv, n, children, c.leaves, c.shared, c.first, above, words, False, told
            elif not children:
                yield "leaf", *NO_KEY, c.least, *[None] * 13
            above += words


def _forests(rows: DataFrame, sums: bool, size: int, most: int) -> DataFrame:
    """SCHEMA from all rows, sorted, and read in runs of `most`."""
    order = ["layer", "pa", "pb", "block", "conv"]
    ordered = rows.select(*Row._fields).repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def run(held: list[Row]) -> Iterator[pa.RecordBatch]:
            done = 0
            for _, group in groupby(held, lambda r: r[:3]):
                mine = list(group)
                for x in _group(mine, size, done == 0, done + len(mine) == len(held), sums):
                    out.append(x)
                    if len(out) >= 10_000:
                        yield made()
                done += len(mine)

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(_NAMES)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)

        held: list[Row] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(Row(*r))
                if len(held) == most:
                    yield from run(held)
                    held = []
        yield from run(held)
        yield made()

    return ordered.mapInArrow(of, SCHEMA)


KEY = ["depth", "ka", "kb"]


def _merged(parts: DataFrame) -> DataFrame:
    """One row a partial node: its parts added up, and open nodes below it counted once each."""
    best = F.min(F.when(F.col("conv").isNotNull(), F.struct("conv", "first")))
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "shared")]
    most = [F.max(c).alias(c) for c in ("up_depth", "up_a", "up_b", "up_conv", "above", "words", "edge", "ends")]
    merged = cut(parts.groupBy(*KEY).agg(best.alias("best"), *sums, *most))
    below = merged.where("edge and up_depth is not null").groupBy(F.col("up_depth").alias("depth"), F.col("up_a").alias("ka"), F.col("up_b").alias("kb")).agg(F.count("*").alias("more"))
    whole = merged.join(below, KEY, "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).withColumn("conv", F.col("best.conv")).drop("more")
    out = cut(whole)
    drop(merged)
    return out


def _shared(rows: DataFrame, size: int, most: int) -> DataFrame:
    """(conv, shared, leaf): the first pass."""
    found = cut(_forests(rows.withColumns({"shared": F.lit(0).cast("long"), "leaf": F.lit(0).cast("long")}), False, size, most))
    parts = found.where("kind = 'part'")
    merged = _merged(parts)
    later = parts.join(merged.select(*KEY, F.col("conv").alias("least")), KEY).where("conv <> least").select("conv", (F.col("above") + F.col("words")).alias("shared"), F.lit(0).alias("leaf"))
    told = found.where("kind in ('lost', 'leaf')").select("conv", F.coalesce("words", F.lit(0)).alias("shared"), (F.col("kind") == "leaf").cast("int").alias("leaf"))
    tips = merged.where("children = 0").select("conv", F.lit(0).alias("shared"), F.lit(1).alias("leaf"))
    return told.unionByName(later).unionByName(tips).groupBy("conv").agg(F.max("shared").cast("long").alias("shared"), F.max("leaf").cast("long").alias("leaf"))


def _hashes(ends: DataFrame) -> DataFrame:
    """(depth, ka, kb, told): SHA-256 of the ids that end at a node, from their lists in order, read as a stream."""
    ordered = ends.select(*KEY, "conv", "ends").repartition(_parts(ends), *KEY).sortWithinPartitions(*KEY, "conv")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []
        for key, lists in groupby(stream, lambda r: r[:3]):
            h, comma = hashlib.sha256(), b""
            for r in lists:
                h.update(comma + r[4].encode())
                comma = b","
            out.append((*key, h.hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], [*KEY, "told"])

    return ordered.mapInArrow(of, "depth long, ka long, kb long, told string")


def trie(turns: DataFrame, counts: DataFrame, size: int = LAYER, most: int = RUN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node, from
    (conv, pos, digest, words), positions from 0 without gaps, and (conv, n), the turns of every conversation."""
    rows = cut(layered(turns, counts, size))
    found = cut(_forests(rows.join(_shared(rows, size, most), "conv", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("shared", "leaf")}), True, size, most))
    merged = _merged(found.where("kind = 'part'"))
    told = F.coalesce("told", F.when(F.col("ends").isNotNull(), F.sha2("ends", 256)), F.lit(NO_ENDS))
    partial = merged.join(_hashes(found.where("kind = 'end'")), KEY, "left").withColumn("ends", told).withColumn("first", F.col("best.first"))
    same = ["depth", "conv", "up_depth", "up_a", "up_b", "up_conv", "n", "children", "leaves", "shared", "first", "above", "ends"]
    nodes = found.where("kind = 'node'").select(*same).unionByName(partial.select(*same))
    parents = small(merged.select(F.col("depth").alias("up_depth"), F.col("ka").alias("up_a"), F.col("kb").alias("up_b"), F.col("conv").alias("above_conv")))
    saved = F.col("shared") - F.col("first") - (F.col("n") - 1) * F.col("above")
    return nodes.join(parents, ["up_depth", "up_a", "up_b"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.coalesce("up_conv", "above_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, size: int = LAYER, most: int = RUN) -> DataFrame:
    """The trie of the conversations as rebuilt()."""
    return trie(*rebuilt(placed(conversations)), size, most)
