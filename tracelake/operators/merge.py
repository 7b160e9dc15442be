"""Merging records by id: the last value wins, the first position stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracelake.functions.ids import code, decoded
from tracelake.schema import Graph
from tracelake.sources.shared import cut

#: Later than any stored batch.
LAST_BATCH = 1 << 30
#: Hashes of so many keys are broadcast.
FEW = 2_000_000


def last_wins(records: DataFrame) -> DataFrame:
    """One row an id: the values of the record with the greatest `ord`, at the position of the least.

    Both are plain aggregates, so they combine before the shuffle and a much repeated id costs no more than others."""
    columns = [c for c in records.columns if c not in ("id", "ord")]
    merged = records.groupBy("id").agg(F.min("ord").alias("first"), F.max_by(F.struct(*columns), "ord").alias("row"))
    return merged.select(*[F.col("id") if c == "id" else F.col("first").alias("ord") if c == "ord" else F.col(f"row.{c}").alias(c) for c in records.columns])


def merged(records: DataFrame) -> DataFrame:
    """last_wins() for records of which few repeat.  Hashes of the ids tell which may; only those records are shuffled whole,
    all others pass as they are.  Where many repeat, last_wins() itself."""
    h = F.xxhash64("id").alias("h")
    twice = cut(records.select(h).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    n = twice.count()
    if n == 0:
        return records
    if n > FEW:
        return last_wins(records)
    keyed = records.withColumn("h", F.xxhash64("id"))
    once = keyed.join(F.broadcast(twice), "h", "left_anti").drop("h")
    return once.unionByName(last_wins(keyed.join(F.broadcast(twice), "h", "left_semi").drop("h")))


def among(rows: DataFrame, key: str, few: DataFrame) -> DataFrame:
    """rows whose column `key` is in the one column of few, a written table of different values.  While these are few, hashes
    of them are broadcast first, so that only rows that pass are shuffled; the join by value follows all the same."""
    values = few.toDF(key)
    if few.count() <= FEW:
        rows = rows.withColumn("h", F.xxhash64(key)).join(F.broadcast(values.select(F.xxhash64(key).alias("h")).distinct()), "h", "left_semi").drop("h")
    return rows.join(values, key, "left_semi")


def without_target(refs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of refs whose `key` is no id of ids.  Keys are looked up once each, by their codes; what is missing then finds
    its rows."""
    keyed = refs.where(F.col(key).isNotNull())
    lost = keyed.select(code(F.col(key)).alias("code")).distinct().join(ids.select(code(F.col("id")).alias("code")), "code", "left_anti")
    gone = cut(lost.select(decoded(F.col("code")).alias(key)))
    return among(keyed, key, gone).unionByName(refs.where(F.col(key).isNull()))


def late(df: DataFrame, batch: int = LAST_BATCH) -> DataFrame:
    """Records as ones of batch number `batch`."""
    return df.withColumn("ord", F.col("ord").withField("batch", F.lit(batch)))


def merge(left: Graph, right: Graph, batch: int = LAST_BATCH) -> Graph:
    """left and right as one graph; records of right replace those of left with the same id in their places, new ones
    follow, as batch number `batch`."""
    return Graph(*(last_wins(a.unionByName(late(b, batch))) for a, b in zip(left, right, strict=True)))


def concatenated(*graphs: Graph) -> Graph:
    out = graphs[0]
    for g in graphs[1:]:
        out = Graph(*(a.unionByName(b) for a, b in zip(out, g, strict=True)))
    return out


def counts(g: Graph) -> DataFrame:
    """(node_count, edge_count, evidence_count)."""
    parts = [df.select(F.lit(n).alias("part")) for n, df in zip(("node_count", "edge_count", "evidence_count"), g, strict=True)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).agg(*[F.count_if(F.col("part") == n).alias(n) for n in ("node_count", "edge_count", "evidence_count")])
