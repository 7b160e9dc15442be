"""Questions to a graph: requirements, services, changes and the links of one object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelake.functions.props import NOT_SHOWN, without
from tracelake.operators.components import LOWEST, packed, unpacked
from tracelake.operators.merge import FEW, last_wins, without_target
from tracelake.operators.reach import labelled, within_reach_of_all
from tracelake.schema import CHANGE_HAS_ARTIFACT, CHANGE_TOUCHES_SPEC, CHANGE_TRACES_TO_SPEC, CHANGES, CONTAINS, OWNS, REPOSITORY, REQUIREMENT, SERVICE, SPEC_REQUIREMENT, Graph
from tracelake.sources.shared import cut


class UnknownObject(LookupError):
    """No node has the id."""


def locators(owners: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, locators): locators of the evidence of (id, evidence_ids), by evidence id; unknown evidence is passed over."""
    refs = owners.select("id", F.explode("evidence_ids").alias("evidence_id"))
    known = evidence.select(F.col("id").alias("evidence_id"), "source", "locator")
    return refs.join(known, "evidence_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "source", F.to_json("locator").alias("locator")))).alias("locators"))


def known_evidence(owners: DataFrame, evidence: DataFrame) -> DataFrame:
    """owners (id, evidence_ids, ...) with `known`: their evidence ids that some evidence has, sorted, as locators() would list
    them for single ids.  Evidence is looked up once an id; only owners that miss some are joined with what they miss."""
    refs = owners.select("id", F.explode("evidence_ids").alias("evidence_id"))
    gone = cut(without_target(refs, "evidence_id", evidence).groupBy("id").agg(F.collect_set("evidence_id").alias("lost")))
    n = gone.count()
    rows = owners.withColumn("h", F.xxhash64("id"))
    if n > FEW:
        met = rows.join(gone, "id", "left")
    else:
        hashes = F.broadcast(gone.select(F.xxhash64("id").alias("h")).distinct())
        met = rows.join(hashes, "h", "left_anti").withColumn("lost", F.lit(None).cast("array<string>")).unionByName(rows.join(hashes, "h", "left_semi").join(gone, "id", "left"))
    known = F.filter("evidence_ids", lambda e: e.isNotNull() & ~F.array_contains(F.coalesce("lost", F.array().cast("array<string>")), e))
    return met.withColumn("known", F.array_sort(known)).drop("h", "lost")


def node_rows(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """What is shown of nodes: sorted evidence ids, locators, and properties without hidden names."""
    shown = nodes.select("id", "kind", "name", F.array_sort("evidence_ids").alias("evidence_ids"), without(F.col("props"), NOT_SHOWN).alias("props"), *[c for c in nodes.columns if c not in ("id", "kind", "name", "evidence_ids", "props")])
    return shown.join(locators(nodes, evidence), "id", "left")


NODE_ORDER = ["id", "kind", "name"]


def in_node_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*NODE_ORDER)


def requirements(g: Graph, capability: str | None = None, service: str | None = None, change: str | None = None, evidence_ref: str | None = None, found: DataFrame | None = None, merged: bool = False, shown: bool = True) -> DataFrame:
    """Requirements that meet all given filters.  A capability, a service or a change counts when a node of the same
    component has it: each is a search from the nodes that have it.  found: component labels of this graph, if they are
    at hand, instead of searches.  merged: whether ids are known to be single."""
    nodes = g.nodes if merged else cut(last_wins(g.nodes)) if capability or service or change else last_wins(g.nodes)
    kind = F.col("kind")
    out = nodes.where(kind.isin(REQUIREMENT, SPEC_REQUIREMENT))
    wanted = []
    if capability:
        wanted.append(F.col("capability") == capability)
    if service:
        wanted.append((kind == SERVICE) & ((F.col("id") == service) | (F.col("name") == service)))
    if change:
        wanted.append(kind.isin(*CHANGES) & ((F.col("id") == change) | (F.col("name") == change)))
    if wanted and found is not None:
        known = labelled(nodes, found)
        out = known.where(kind.isin(REQUIREMENT, SPEC_REQUIREMENT))
        for w in wanted:
            out = out.join(known.where(w).select("component").distinct(), "component", "left_semi")
        out = out.drop("component")
    else:
        if wanted:
            out = within_reach_of_all(out, Graph(nodes, g.edges, g.evidence), [nodes.where(w).select("id") for w in wanted])
    if evidence_ref:
        e = g.edges.where(F.array_contains("evidence_ids", evidence_ref))
        touched = e.select(F.col("source_id").alias("id")).unionByName(e.select(F.col("target_id").alias("id"))).distinct().withColumn("touched", F.lit(True))
        out = out.join(touched, "id", "left").where(F.array_contains("evidence_ids", evidence_ref) | F.col("touched")).drop("touched")
    return node_rows(out, g.evidence) if shown else out


def services(g: Graph, merged: bool = False) -> DataFrame:
    """Services with repository_ids, sorted, repeats kept; null where there are none."""
    nodes = g.nodes if merged else last_wins(g.nodes)
    repos = nodes.where(F.col("kind") == REPOSITORY).select(F.col("id").alias("target_id"))
    of = g.edges.where(F.col("kind").isin(OWNS, CONTAINS)).join(repos, "target_id").groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list("target_id")).alias("repository_ids"))
    return node_rows(nodes.where(F.col("kind") == SERVICE).join(of, "id", "left"), g.evidence)


def changes(g: Graph, merged: bool = False, shown: bool = True) -> DataFrame:
    """Changes with the ids of their artifacts, touched and traced specifications, those touched but not among the
    traced (by id, as stored), and those touched that no trace goes through.  shown: with what node_rows() adds, or without."""
    nodes = g.nodes if merged else last_wins(g.nodes)
    kind = F.col("kind")
    pick = lambda k: F.array_sort(F.collect_list(F.when(kind == k, F.col("target_id"))))
    via = F.from_json(F.concat(F.lit('{"v":'), F.col("props")["/via_spec_id"], F.lit("}")), "v string")["v"]
    of = g.edges.where(kind.isin(CHANGE_HAS_ARTIFACT, CHANGE_TOUCHES_SPEC, CHANGE_TRACES_TO_SPEC)).groupBy(F.col("source_id").alias("id")).agg(
        pick(CHANGE_HAS_ARTIFACT).alias("artifact_ids"), pick(CHANGE_TOUCHES_SPEC).alias("touched_spec_ids"), pick(CHANGE_TRACES_TO_SPEC).alias("traceability_spec_ids"),
        F.collect_list(F.when(kind == CHANGE_TRACES_TO_SPEC, via)).alias("via"))
    out = nodes.where(kind.isin(*CHANGES)).join(of, "id", "left")
    for c in ("artifact_ids", "touched_spec_ids", "traceability_spec_ids", "via"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    minus = lambda a, b: F.filter(a, lambda x: ~F.array_contains(F.col(b), x))
    out = out.withColumn("missing_durable_spec_links", minus("touched_spec_ids", "traceability_spec_ids")).withColumn("untraced_spec_ids", minus("touched_spec_ids", "via")).drop("via")
    return node_rows(out, g.evidence) if shown else out


def edge_rows(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    shown = edges.select(F.col("id"), "kind", "source_id", "target_id", F.array_sort("evidence_ids").alias("evidence_ids"), without(F.col("props"), NOT_SHOWN).alias("props"), "confidence")
    return shown.join(locators(edges, evidence), "id", "left").withColumnRenamed("id", "edge_id")


def _looked_up(g: Graph, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(object_id) of the objects that have a node, and of those that have none."""
    asked = objects.select("object_id").distinct()
    known = g.nodes.select(F.col("id").alias("object_id"))
    return asked.join(known, "object_id", "left_semi"), asked.join(known, "object_id", "left_anti")


def unknown(g: Graph, objects: DataFrame) -> DataFrame:
    """(object_id): the objects that have no node."""
    return _looked_up(g, objects)[1]


def links(g: Graph, objects: DataFrame) -> DataFrame:
    """(object_id, edge_id, kind, source_id, target_id, evidence_ids, known): the edges in and out of each object that has a
    node, as traceability() gives them for single ids, with their known evidence ids instead of locators and properties."""
    there = _looked_up(g, objects)[0]
    end = lambda own, far, out: F.struct(F.col(own).alias("object_id"), F.col(far).alias("other_id"), F.lit(out).alias("out"))
    both = F.when(F.col("source_id") == F.col("target_id"), F.array(end("source_id", "target_id", True))).otherwise(F.array(end("source_id", "target_id", True), end("target_id", "source_id", False)))
    ends = g.edges.select("id", "kind", "evidence_ids", F.inline(both))
    rows = known_evidence(cut(ends.join(there, "object_id", "left_semi")), g.evidence)
    pick = lambda out: F.when(F.col("out") == out, F.col("object_id")).otherwise(F.col("other_id"))
    return rows.select("object_id", F.col("id").alias("edge_id"), "kind", pick(True).alias("source_id"), pick(False).alias("target_id"), "evidence_ids", "known")


def traceability(g: Graph, objects: DataFrame, missing_ok: bool = True) -> DataFrame:
    """Edges in and out of each object of (object_id); one row with missing = true for an object without node."""
    there, gone = _looked_up(g, objects)
    if not missing_ok and (x := gone.first()) is not None:
        raise UnknownObject(x.object_id)
    ends = g.edges.select(F.col("id").alias("edge_id"), F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("object_id"))
    mine = ends.join(there, "object_id")
    near = g.edges.join(mine.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi")  # before locators are looked up
    rows = mine.join(edge_rows(near, g.evidence), "edge_id").withColumn("missing", F.lit(False))
    return rows.unionByName(gone.withColumn("missing", F.lit(True)), allowMissingColumns=True)


EDGE_ORDER = ["edge_id", "kind", "source_id", "target_id"]


def in_edge_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*EDGE_ORDER)


def numbered(df: DataFrame) -> DataFrame:
    """A sorted df with each row's place, from 0, as `position`.  Ranges are sorted apart and each row is numbered within its
    range as it is written; only the sizes of ranges, one row a range, meet in one task, and rows do not move again."""
    laid = cut(df.withColumn("place", F.monotonically_increasing_id()))  # the range in the upper bits, the place in it in the lower 33
    part = F.shiftright("place", 33)
    sizes = laid.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.col("place").bitwiseAND((1 << 33) - 1)
    return laid.withColumn("part", part).join(F.broadcast(before), "part").withColumn("position", (F.col("before") + within).cast("long")).drop("part", "place", "before")


#: Bits of an id by which its rows are counted, and the most rows of one range.
RANGE_BITS, RANGE_ROWS = 12, 1_000_000


def numbered_by_id(df: DataFrame, order: list[str], ids: dict[str, str], same: dict[str, str]) -> DataFrame:
    """numbered(df.orderBy(*order)) where the first column of order holds stable ids, whose upper bits are even ranges: rows are
    counted by these, then moved once, and nothing is written.  On the way, stable ids of the columns `ids` (column: prefix) are
    numbers, and a column of `same` (column: another) is left out where it equals the other.  Other texts travel as they
    are; if the first column holds one, the way is numbered() itself."""
    key = order[0]
    of = packed(F.col(key), ids[key])
    spot = F.shiftrightunsigned(of.bitwiseXOR(F.lit(LOWEST)), 64 - RANGE_BITS).cast("int")
    counts = {r.spot: r.n for r in df.select(spot.alias("spot")).groupBy("spot").agg(F.count("*").alias("n")).collect()}  # at most 2 ** RANGE_BITS rows
    if None in counts:
        return numbered(df.orderBy(*order))
    bits = min(RANGE_BITS, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1, sum(counts.values()) // RANGE_ROWS).bit_length())
    before, n = [0] * (1 << bits), 0
    for at in range(1 << RANGE_BITS):
        if at % (1 << RANGE_BITS - bits) == 0:
            before[at >> RANGE_BITS - bits] = n
        n += counts.get(at, 0)
    number, text = (lambda c: f"{c} number"), (lambda c: f"{c} text")
    columns = [packed(F.col(c), prefix).alias(number(c)) for c, prefix in ids.items()]
    columns += [F.when(packed(F.col(c), prefix).isNull(), F.col(c)).alias(text(c)) for c, prefix in ids.items() if c != key]
    columns += [x for c, other in same.items() for x in (F.col(c).eqNullSafe(F.col(other)).alias(f"{c} same"), F.when(~F.col(c).eqNullSafe(F.col(other)), F.col(c)).alias(text(c)))]
    columns += [F.col(c) for c in df.columns if c not in ids and c not in same]
    part = F.shiftrightunsigned(F.col(number(key)).bitwiseXOR(F.lit(LOWEST)), 64 - bits).cast("int") if bits else F.lit(0)
    whole = {c: unpacked(F.col(number(c)), prefix) if c == key else F.coalesce(unpacked(F.col(number(c)), prefix), text(c)) for c, prefix in ids.items()}
    whole |= {c: F.when(F.col(f"{c} same"), whole.get(other, F.col(other))).otherwise(F.col(text(c))) for c, other in same.items()}
    laid = df.select(*columns).repartitionById(1 << bits, part).sortWithinPartitions(number(key), *[whole.get(c, F.col(c)) for c in order[1:]])
    laid = laid.withColumn("place", F.monotonically_increasing_id())  # a range is a partition; the place in it is in the lower 33 bits
    position = F.element_at(F.lit(before), part + 1) + F.col("place").bitwiseAND((1 << 33) - 1)
    return laid.select(*[whole.get(c, F.col(c)).alias(c) for c in df.columns], position.cast("long").alias("position"))


def as_json(df: DataFrame, name: str = "record") -> DataFrame:
    """(id, record): each row as JSON with sorted keys; null fields left out."""
    return df.select(df.columns[0], F.to_json(F.struct(*sorted(df.columns))).alias(name))
