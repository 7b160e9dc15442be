"""Connected components of an undirected graph, by hooking and contraction.

Each round every vertex hooks to its smallest neighbour, the pointers are jumped twice, and the edges are
rewritten to the ends of the pointers.  Edges inside one component vanish, so the edge table shrinks
geometrically; a chain of n vertices needs O(log n) rounds.  A vertex with very many neighbours costs no more
than its edges: neighbours are only ever reduced with min(), which combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from tracelake.sources.shared import cut, drop


#: Flipped, so that signed numbers have the order of unsigned ones.
LOWEST = -(1 << 63)


def _finished(e: DataFrame) -> DataFrame:
    """(v, p): the least vertex that each end of the edges reaches, by union-find in one task."""
    kind = e.schema["a"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
        columns = [pa.array(c, f.type) for c, f in zip((list(up), [root(v) for v in list(up)]), batch.schema, strict=True)] if up else []
        yield from [pa.RecordBatch.from_arrays(columns, ["v", "p"])] if up else []

    return e.select("a", "b").coalesce(1).mapInArrow(of, f"v {kind}, p {kind}")


def packed(id: Column, prefix: str) -> Column:
    """A text of `prefix` and 16 lower-case hexadecimal digits as a number, in the order of the texts; null for other texts."""
    number = F.conv(F.substring(id, -16, 16), 16, -10).cast("long").bitwiseXOR(F.lit(LOWEST))
    return F.when((F.length(id) == len(prefix) + 16) & id.startswith(prefix) & F.substring(id, -16, 16).rlike("^[0-9a-f]{16}$"), number)


def unpacked(number: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.lower(F.hex(number.bitwiseXOR(F.lit(LOWEST)))), 16, "0"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", finish: int = 0) -> DataFrame:
    """(v, component) for every vertex of edges; component is the smallest vertex reachable.

    Null ends and self-loops are dropped; repeated edges count once; no edges give no rows.  Once no more than `finish` edges
    are left, counted on what is written, one task does the rest in the same way as further rounds would.  Where all ends are
    stable ids of one kind, numbers in their order travel in their places."""
    e, prefix = coded(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    found = contracted(e, finish)
    if prefix is None:
        return found
    return found.select(unpacked(F.col("v"), prefix).alias("v"), unpacked(F.col("component"), prefix).alias("component"))


def coded(edges: DataFrame) -> tuple[DataFrame, str | None]:
    """Different edges (a, b) of edges, written, the lesser end first, without null ends and self-loops; and, where all ends
    are stable ids of one kind, the prefix that these have in common: then the ends are numbers in the order of the ids."""
    e = edges.where("a <> b")
    once = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = e.first() if e.schema["a"].dataType.simpleString() == "string" else None
    if first is None or len(first.a) < 17:
        return cut(once(e)), None
    prefix, other = first.a[:-16], Observation()
    pair = e.select(packed(F.col("a"), prefix).alias("a"), packed(F.col("b"), prefix).alias("b"))
    numbers = cut(once(pair.observe(other, F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n"))))
    if other.get["n"]:
        drop(numbers)
        return cut(once(e)), None
    return numbers, prefix


def contracted(e: DataFrame, finish: int = 0) -> DataFrame:
    """connected_components() of edges as coded() writes them, which go on the way: a round holds no table longer than it
    reads it."""
    label = None
    while not e.isEmpty():
        if finish and e.count() <= finish:
            parent, left = cut(_finished(e)), None
            drop(e)
        else:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).withColumn("p", F.least("v", "p")))
            up = near.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            jump = lambda of: cut(of.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")))  # noqa: E731, B023
            once = jump(near)
            parent = jump(once)
            drop(near, once)
            # one join at a time, so that no more than one table of edges is shuffled beside those that are read
            to = lambda end: parent.select(F.col("v").alias(end), F.col("p").alias(f"p{end}"))  # noqa: E731, B023
            half = cut(e.join(to("a"), "a").select("pa", "b"))
            drop(e)
            left = half.join(to("b"), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            left = cut(left.distinct())
            drop(half)
        if label is None:
            label = parent
        else:
            moved = cut(label.withColumnRenamed("p", "q").join(parent.select(F.col("v").alias("q"), "p"), "q", "left").select("v", F.coalesce("p", "q").alias("p")))
            drop(label, parent)
            label = moved
        if left is None:
            return label.select("v", F.col("p").alias("component"))
        e = left
    if label is None:
        return e.select(F.col("a").alias("v"), F.col("a").alias("component"))
    drop(e)
    return label.select("v", F.col("p").alias("component"))


def extended(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b", finish: int = 0) -> DataFrame:
    """(v, component) of the vertices whose label changes when edges are added to a graph with labels (v, component), new
    vertices included.  The new edges are lifted to the labels of their ends and only these are contracted, so the work is that of the new
    edges and of the components that they join.  relabelled() puts the result into the labels."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    ends = cut(e.select(F.col("a").alias("v")).unionByName(e.select(F.col("b").alias("v"))).distinct().join(labels, "v", "left"))
    top = lambda end: ends.select(F.col("v").alias(end), F.coalesce("component", "v").alias(f"top_{end}"))
    moved = cut(connected_components(e.join(top("a"), "a").join(top("b"), "b"), "top_a", "top_b", finish).where("v <> component"))
    old = labels.join(moved.select(F.col("v").alias("component"), F.col("component").alias("now")), "component").select("v", F.col("now").alias("component"))
    new = ends.where("component is null").select("v").join(moved, "v", "left").select("v", F.coalesce("component", "v").alias("component"))
    return old.unionByName(new)


def relabelled(labels: DataFrame, changed: DataFrame) -> DataFrame:
    """labels with those of changed in their places."""
    return labels.join(changed.select("v"), "v", "left_anti").unionByName(changed.select("v", "component"))
