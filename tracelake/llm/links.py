"""From candidate pairs to components: exact Jaccard checks of pairs in Spark, and only of those that can still matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracelake.llm.shingles import sets, utf8
from tracelake.operators.components import connected_components
from tracelake.sources.shared import cut, drop

#: Partners of one document that are compared in one block; more are dealt out with a copy of the document each.
BLOCK = 256
#: A side of at most so many rows of three longs (about 16 MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x and y| >= percent * |x or y|, for sorted arrays without repeats."""
    if not len(x) or not len(y):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def beside(pairs: DataFrame, texts: DataFrame, made, schema: str) -> DataFrame:
    """A row made(a, set of a, b, set of b), or none where that is None, for every pair (a, b).  texts: (node, text).

    Each b goes to a block of its a; a goes to every block of its own.  A block is read as a stream, a first."""
    pairs = cut(pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct())
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block")
    dealt = pairs.join(blocks, "a").select("a", block, F.col("b").alias("node"), F.lit(1).alias("part"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    heads = blocks.select("a", each, F.col("a").alias("node"), F.lit(0).alias("part"))
    sent = cut(dealt.unionByName(heads))
    full = texts.join(small(sent), "node").select("a", "block", "part", "node", "text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(4))
            held = pa.array([s.tobytes() for s in sets(data, ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], held], ["a", "block", "part", "node", "tokens"])

    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows, size = [], 0
            for key, block, part, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(raw, np.uint64)
                if part == 0:
                    at, head = (key, block), x
                elif at == (key, block) and (row := made(key, head, node, x)) is not None:
                    rows.append(row)
                    size += len(x)
                    if size > 1 << 18:
                        yield _columns(rows, names, kinds)
                        rows, size = [], 0
            yield _columns(rows, names, kinds)

    full = full.mapInArrow(tokens, "a long, block int, part int, node long, tokens binary")
    return full.repartition("a", "block").sortWithinPartitions("a", "block", "part").mapInArrow(compared, schema)


def _columns(rows: list[tuple], names: tuple[str, ...], kinds: tuple[str, ...]) -> pa.RecordBatch:
    arrow = {"long": pa.int64(), "boolean": pa.bool_()}

    def column(values: list, kind: str) -> pa.Array:
        if kind in arrow:
            return pa.array(values, arrow[kind])
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))

    return pa.RecordBatch.from_arrays([column([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar.  texts: (node, text)."""

    def made(a: int, x: np.ndarray, b: int, y: np.ndarray) -> tuple | None:
        return (a, b) if similar(x, y, percent) else None

    return beside(pairs, texts, made, "a long, b long")


def link(pairs: DataFrame, texts: DataFrame, percent: int, known: DataFrame | None = None, found: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Verified links that join the same nodes as all similar candidate pairs would, and the components (v, component).
    known: links that are settled already; found: their components, if at hand.

    Two rounds check one partner of each node, the smallest left; pairs within a component by then are settled; the
    last round checks all pairs still open."""
    rest = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    links = known
    if found is None:
        found = cut(connected_components(known if known is not None else rest.limit(0)))
    for step in range(3):
        rest = cut(_across(rest, found))
        if rest.isEmpty():
            break
        now = rest if step == 2 else cut(rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        good = cut(verified(now, texts, percent))
        links = good if links is None else cut(links.unionByName(good))
        found = cut(connected_components(links))
        rest = rest.join(now, ["a", "b"], "left_anti")
    return links, found


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(found.select(F.col("v").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def leaders(members: DataFrame) -> DataFrame:
    """(node, leader): for each list of members (key, node), its members with the list's leader; a node with few leaders.

    The leader is the member of most lists, then twice the leader of that one, so that lists of one group of near copies
    come to the same leader.  Leaders are only found with max(), which combines before the shuffle."""
    held = members.groupBy("node").agg(F.count("*").alias("held"))
    known = cut(members.join(held, "node").select("key", "node", "held"))
    lead = cut(known.groupBy("key").agg(F.max(F.struct("held", "node")).alias("lead")))
    up = known.join(small(lead), "key").groupBy("node").agg(F.max("lead").alias("lead"))
    up = cut(up.select("node", F.col("lead.node").alias("up")))
    lead = lead.select("key", F.col("lead.node").alias("node"))
    for _ in range(2):
        lead = lead.join(small(up), "node").select("key", F.col("up").alias("node"))
    lead = lead.select("key", F.col("node").alias("leader"))
    return known.join(small(cut(lead)), "key").where("node <> leader").select("node", "leader").distinct()


#: Of a node: its leader, size of its set, number of differences, whether it is similar to the leader, what it has more
#: and, only if that is no more than may matter, what it has less than the leader.
DIFFERENCES = "leader long, node long, n long, d long, near boolean, more array<long>, less array<long>"


def _differences(percent: int):
    def made(a: int, x: np.ndarray, b: int, y: np.ndarray) -> tuple:
        more, less = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
        d = len(more) + len(less)
        near = (100 + percent) * d <= (100 - percent) * (len(x) + len(y))
        needed = len(more) <= len(y) * (100 - percent) // percent
        return a, b, len(y), d, near, more.view(np.int64), less.view(np.int64) if needed else np.zeros(0, np.int64)

    return made


def link_lists(members: DataFrame, texts: DataFrame, percent: int, links: DataFrame | None, found: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Links and components (v, component) when also all similar pairs within the lists of members (key, node) are linked,
    without all pairs of a list being made.

    Each member is compared once with a leader of its list: the links so found contract a group of near copies.  Members
    are then known by their differences from the leader, in which all that the group shares has gone, and which keep
    distances: members x and y with d(x) <= d(y) differences of which c are common differ in d(x) + d(y) - 2c elements.
    They may differ in h = (|x| + |y|) (100 - percent) / (100 + percent), so c >= (d(x) + d(y) - h) / 2.  If that is not
    positive, both are similar to the leader and linked.  Else, with all differences in one order, x has a common one
    among its first h / 2 + 1, y among its first h + 1; the places bound c again.  The order: what a node has more than the
    leader, then what it has less, the rarest first in both."""
    members = cut(members.distinct())
    known = members.join(found, F.col("node") == F.col("v"), "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    mixed = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_ = cut(known.join(mixed, "key", "left_semi").select("key", "node"))
    if open_.isEmpty():
        return links, found
    told = leaders(open_).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    differing = cut(beside(told, texts, _differences(percent), DIFFERENCES))
    star = differing.where("near").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    links = cut(star if links is None else links.unionByName(star))
    found = cut(connected_components(links))
    nodes = differing.drop("near").join(found, F.col("node") == F.col("v"), "left").withColumn("label", F.coalesce("component", "node")).drop("v", "component")
    spans = nodes.groupBy("leader").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("leader")
    return link(apart(cut(nodes.join(small(cut(spans)), "leader", "left_semi")), percent), texts, percent, links, found)


def apart(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that may be similar, of those with a leader in common and different labels; nodes: columns of
    DIFFERENCES and label."""
    most = f"n * {100 - percent} div {percent}"
    more = nodes.select("leader", "node", "label", F.explode("more").alias("token"))
    held = more.groupBy("leader", "token").agg(F.count("*").alias("held"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("node"))
    held = cut(held)
    alone = held.where("held = 1").groupBy("leader", "node").agg(F.count("*").alias("alone"))
    left = cut(nodes.join(alone, ["leader", "node"], "left").where(f"coalesce(alone, 0) <= {most}"))  # of the rest, no shared one comes first
    shared = left.select("leader", "node", "label", "n", "d", F.size("more").alias("all"), F.explode("more").alias("token"))
    shared = shared.join(held.where("lo < hi").select("leader", "token", "held"), ["leader", "token"])
    own = Window.partitionBy("leader", "node")
    place = F.row_number().over(own.orderBy("held", "token")) - 1 + F.col("all") - F.count("*").over(own)
    columns = ["leader", "token", "node", "label", "n", "d", F.col("place").cast("long").alias("place")]
    shared = shared.withColumn("place", place).select(*columns)
    lacking = left.select("leader", F.explode("less").alias("token")).groupBy("leader", "token").agg(F.count("*").alias("held"))
    order = lacking.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("order"))  # no more than the leader has
    less = left.join(order.select("leader", F.col("order.token").alias("order")), "leader")
    less = less.select("leader", "node", "label", "n", "d", F.size("more").alias("all"), F.posexplode(F.array_intersect("order", "less")).alias("at", "token"))
    less = less.withColumn("place", F.col("all") + F.col("at")).select(*columns)
    first = cut(shared.unionByName(less).where(f"place <= {most}"))
    x = first.where(f"place <= {most} div 2").alias("x")
    may_differ = f"((x.n + y.n) * {100 - percent} div {100 + percent})"
    met = x.join(first.alias("y"), ["leader", "token"]).where(
        "x.label <> y.label and (x.d < y.d or x.d = y.d and x.node < y.node)"
        f" and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
        f" and 2 * least(x.d - x.place, y.d - y.place) >= x.d + y.d - {may_differ}")
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def components_of_buckets(members: DataFrame, texts: DataFrame, alike: float, known: DataFrame | None = None) -> DataFrame:
    """Components (v, component) over all similar pairs that share a key of members (key, node), and known links.
    members is read twice and may repeat rows; it should be cheap to derive from something written.

    First each member is compared with the least of its bucket; the buckets that still span components go to link_lists."""
    percent = round(100 * alike)
    members = members.select("key", "node")
    least = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key", "a")
    met = cut(members.join(least, "key"))
    links, found = link(met.select("a", F.col("node").alias("b")), texts, percent, known)
    found = link_lists(met.select("key", "node"), texts, percent, links, found)[1]
    drop(met)  # found is written
    return found
