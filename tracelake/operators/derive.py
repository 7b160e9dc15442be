"""Deriving change-to-specification links."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, functions as F

from tracelake.functions.ids import stable_id
from tracelake.functions.props import props
from tracelake.operators.merge import last_wins, late, merge
from tracelake.schema import CHANGE_TOUCHES_SPEC, CHANGE_TRACES_TO_SPEC, DERIVE_RULE, DURABLE, SPEC, Graph
from tracelake.sources.shared import cut

MISSING_END = "Cannot derive OpenSpec traceability because the change-to-spec edge has a missing endpoint."
NO_DURABLE = "No durable OpenSpec spec exists for capability: "
#: Durable specifications of at most so many capabilities are broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 100_000


def durable_specs(nodes: DataFrame) -> DataFrame:
    """(capability, durable_id, durable_scope): the durable specification with the least id of each capability."""
    specs = nodes.where((F.col("kind") == SPEC) & (F.col("scope") == DURABLE) & (F.coalesce("capability", F.lit("")) != ""))
    return specs.groupBy("capability").agg(F.min("id").alias("durable_id"), F.min_by("scope", "id").alias("durable_scope"))


def touches(g: Graph) -> DataFrame:
    """Touch edges with both ends looked up; a missing end is null."""
    known = g.nodes.select("id", F.coalesce("capability", F.lit("")).alias("capability"), F.coalesce("scope", F.lit("")).alias("scope"))
    edges = g.edges.where(F.col("kind") == CHANGE_TOUCHES_SPEC).select(F.col("id").alias("edge_id"), "source_id", "target_id", "evidence_ids", "ord")
    source = known.select(F.col("id").alias("source_id"), F.lit(True).alias("has_source"))
    target = known.select(F.col("id").alias("target_id"), "capability", "scope", F.lit(True).alias("has_target"))
    return edges.join(source, "source_id", "left").join(target, "target_id", "left")


def _settled(touched: DataFrame) -> DataFrame:
    """Touch edges by change, specification and capability, with the first of them by edge id and their number; those with a
    missing end (`gone`) stay apart, by edge id.  touches() is partitioned by the specification already."""
    keyed = touched.withColumn("gone", F.col("has_source").isNull() | F.col("has_target").isNull())
    keyed = keyed.withColumn("gone_id", F.when(F.col("gone"), F.col("edge_id")))
    kept = F.struct(*[c for c in ("edge_id", "evidence_ids", "scope") if c in touched.columns])
    return keyed.groupBy("source_id", "target_id", "capability", "gone", "gone_id").agg(F.min_by(kept, "edge_id").alias("e"), F.count("*").alias("n"))


def _inputs(settled: DataFrame, nodes: DataFrame) -> DataFrame:
    return _with_durable(settled.where("not gone").select("source_id", "target_id", "capability", "e.*"), nodes)


def _with_durable(rows: DataFrame, nodes: DataFrame, how: str = "left") -> DataFrame:
    durable = durable_specs(nodes)
    side = F.broadcast(durable) if durable.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else durable
    return rows.join(side, "capability", how)


def pairs(g: Graph) -> DataFrame:
    """(kind, source_id, target_id) of the derived edges, for steps that need no more of them than their ends."""
    met = touches(g).where("has_source and has_target").select("source_id", "capability").distinct()
    return _with_durable(met, g.nodes, "inner").select(F.lit(CHANGE_TRACES_TO_SPEC).alias("kind"), "source_id", F.col("durable_id").alias("target_id"))


def inputs(g: Graph) -> DataFrame:
    """Touch edges with both ends, the first by edge id for each change, specification and capability, with the durable
    specification of the capability, if any."""
    return _inputs(_settled(touches(g)), g.nodes)


def _edges(found: DataFrame) -> DataFrame:
    return found.where("durable_id is not null").select(
        stable_id("edge", CHANGE_TRACES_TO_SPEC, DERIVE_RULE, F.col("source_id"), F.col("durable_id"), F.col("capability")).alias("id"),
        F.lit(CHANGE_TRACES_TO_SPEC).alias("kind"), "source_id", F.col("durable_id").alias("target_id"),
        props(capability=F.col("capability"), derived=F.lit(True), rule_id=F.lit(DERIVE_RULE), source_scope=F.col("scope"),
              target_scope=F.col("durable_scope"), via_spec_id=F.col("target_id")).alias("props"),
        "evidence_ids", F.lit(None).cast("string").alias("confidence"),
        F.struct(F.lit(0).alias("batch"), F.lit(9).alias("phase"), F.array("edge_id").alias("path"), F.lit(0).alias("seq")).alias("ord"),
    )


def _missed(settled: DataFrame, found: DataFrame) -> DataFrame:
    broken = settled.where("gone").select(F.col("gone_id"), F.explode(F.sequence(F.lit(1), "n"))).select(
        F.lit("warning").alias("severity"), F.lit(DERIVE_RULE).alias("rule_id"), F.col("gone_id").alias("affected_object_id"), F.lit(MISSING_END).alias("message"))
    without = found.where("durable_id is null").select(
        F.lit("info").alias("severity"), F.lit(DERIVE_RULE).alias("rule_id"), F.col("target_id").alias("affected_object_id"), F.concat(F.lit(NO_DURABLE), "capability").alias("message"))
    return broken.unionByName(without)


class Derived(NamedTuple):
    """Derived edges before they are merged by id, in the order of their inputs; diagnostics; and their counts."""

    edges: DataFrame
    diagnostics: DataFrame
    derived_edge_count: int
    skipped_input_count: int


def run(g: Graph) -> Derived:
    """The whole derivation in one evaluation: touch edges with their ends and the inputs are written, and counted as they are."""
    broken, made = Observation(), Observation()
    settled = cut(_settled(touches(g)).observe(broken, F.coalesce(F.sum(F.when(F.col("gone"), F.col("n"))), F.lit(0)).alias("n")))
    found = cut(_inputs(settled, g.nodes).observe(made, F.count("durable_id").alias("made"), F.count_if(F.col("durable_id").isNull()).alias("missed")))
    return Derived(_edges(found), _missed(settled, found), made.get["made"], made.get["missed"] + broken.get["n"])


def derived_edges(g: Graph) -> DataFrame:
    """Derived edges before they are merged by id, in the order of their inputs."""
    return _edges(inputs(g))


def diagnostics(g: Graph, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Touch edges that gave nothing: a missing end (one row an edge), or no durable specification (one an input).  sources,
    targets: the nodes that such ends may be, where ids tell; else all.

    Targets know beforehand whether their capability has a durable specification, so edges that give one are dropped as they are
    met, nothing is written, and ids are sorted by their hashes."""
    h = lambda end: F.when(F.col(end).isNotNull(), F.xxhash64(end)).alias(f"h_{end}")
    durable = durable_specs(g.nodes).select("capability", F.lit(True).alias("durable"))
    side = F.broadcast(durable) if durable.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else durable
    source = (g.nodes if sources is None else sources).select(F.col("id").alias("source_id"), F.lit(True).alias("has_source"))
    target = (g.nodes if targets is None else targets).select(F.col("id").alias("target_id"), F.coalesce("capability", F.lit("")).alias("capability"))
    target = target.join(side, "capability", "left").select("target_id", F.when(F.col("durable").isNull(), F.col("capability")).alias("lacks"), F.lit(True).alias("has_target"))
    edges = g.edges.where(F.col("kind") == CHANGE_TOUCHES_SPEC).select("source_id", "target_id", F.col("id").alias("edge_id"))
    met = edges.withColumn("h_source_id", h("source_id")).join(source.withColumn("h_source_id", h("source_id")), ["h_source_id", "source_id"], "left").drop("h_source_id")
    met = met.withColumn("h_target_id", h("target_id")).join(target.withColumn("h_target_id", h("target_id")), ["h_target_id", "target_id"], "left")
    met = met.withColumn("gone", F.col("has_source").isNull() | F.col("has_target").isNull()).where("gone or lacks is not null")
    gone = F.col("gone")
    once = met.groupBy("h_target_id", "target_id", "source_id", "gone", F.when(gone, F.col("edge_id")).alias("gone_id"), F.when(~gone, F.col("lacks")).alias("lacks")).agg(F.count("*").alias("n"))
    return once.select(
        F.when(gone, "warning").otherwise("info").alias("severity"), F.lit(DERIVE_RULE).alias("rule_id"), F.when(gone, F.col("gone_id")).otherwise(F.col("target_id")).alias("affected_object_id"),
        F.when(gone, MISSING_END).otherwise(F.concat(F.lit(NO_DURABLE), "lacks")).alias("message"), F.explode(F.sequence(F.lit(1).cast("long"), F.when(gone, F.col("n")).otherwise(1))).alias("k")).drop("k")


def ordered(found: DataFrame) -> DataFrame:
    """Diagnostics by severity as text, rule, object and message."""
    return found.orderBy("severity", "rule_id", "affected_object_id", "message")


def derive(g: Graph, merged: bool = False) -> Graph:
    """g with its derived edges.  merged: whether ids are known to be single; then only edges are merged."""
    new = late(last_wins(derived_edges(g)))
    return Graph(g.nodes, last_wins(g.edges.unionByName(new)), g.evidence) if merged else merge(g, Graph(g.nodes.limit(0), new, g.evidence.limit(0)))


def metadata(g: Graph) -> DataFrame:
    """One row: edges derived (before they merge by id), and inputs skipped and unresolved.  Counted in one pass, in which no
    more than the ends of touch edges travel."""
    settled = _settled(touches(g).drop("evidence_ids", "ord"))
    durable = durable_specs(g.nodes)
    side = F.broadcast(durable) if durable.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else durable
    met = settled.join(side.select("capability", F.lit(True).alias("durable")), "capability", "left")
    skipped = F.coalesce(F.sum(F.when(F.col("gone"), F.col("n")).when(F.col("durable").isNull(), 1)), F.lit(0)).cast("long")
    return met.agg(F.count_if(~F.col("gone") & F.col("durable")).alias("derived_edge_count"), skipped.alias("skipped_input_count"), skipped.alias("unresolved_input_count"))
