"""Specification trees and change folders to graph facts.

Files come as tables: files (path, value) with the text of each specification file, and manifest (path, is_dir) with
every file and folder, hidden ones and folders without files included.  Paths are relative to the store.  Layout:
openspec/specs/<capability...>/spec.md, openspec/changes/<change>/..., openspec/changes/archive/<change>/...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracelake.functions import text as tx
from tracelake.functions.ids import stable_id
from tracelake.functions.props import listed, props
from tracelake.operators.merge import last_wins
from tracelake.schema import (
    ACTIVE_CHANGE, ACTIVE_SCOPE, ARCHIVED_CHANGE, ARCHIVED_SCOPE, ARTIFACT, CHANGE_HAS_ARTIFACT, CHANGE_TOUCHES_SPEC, DURABLE, EVIDENCE_SCHEMA, RELATED_SPEC,
    REQUIREMENT_HAS_SCENARIO, SCENARIO, SPEC, SPEC_HAS_REQUIREMENT, SPEC_REQUIREMENT, Graph,
)
from tracelake.sources import store_tree
from tracelake.sources.shared import cut
from tracelake.sources.trees import tree

SPECS, CHANGES_DIR = "openspec/specs", "openspec/changes"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, is_dir, bytes, content) of all below a store, hidden names and empty folders included; content of spec.md files."""
    return store_tree.by_level(spark, root, "spec.md")


def read_files(listed: DataFrame) -> DataFrame:
    """(path, value) of the spec.md files of manifest(), decoded as UTF-8; bad_bytes() names those that aren't."""
    return listed.where("content is not null").select("path", F.decode("content", "UTF-8").alias("value"))


def bad_bytes(listed: DataFrame) -> DataFrame:
    """(path): specification files that aren't valid UTF-8."""
    return listed.where("content is not null").where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path")


def bad_frontmatter(files: DataFrame) -> DataFrame:
    """(path): specification files whose frontmatter is broken YAML; parsed() takes them as files without any."""
    block = files.select("path", tx.frontmatter(tx.lines(F.col("value")))["block"].alias("block")).where("block is not null")
    return block.where(~tree(F.col("block"))["ok"]).select("path")


def json_string(text: Column) -> Column:
    """The text of a JSON string; null for other JSON."""
    return F.when(text.startswith('"'), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0])


def top_name(path: Column) -> Column:
    """The first name of a path of leaves, which begins with no slash."""
    return F.substring_index(path, "/", 1)


def placed(files: DataFrame) -> DataFrame:
    """files with scope, change and capability; rows that are no specification file of the layout are dropped."""
    path = F.col("path")
    archived, active = path.startswith(f"{CHANGES_DIR}/archive/"), path.startswith(f"{CHANGES_DIR}/")
    scope = F.when(path.startswith(f"{SPECS}/"), DURABLE).when(archived, ARCHIVED_SCOPE).when(active, ACTIVE_SCOPE)
    parts = F.split(path, "/")
    root = F.when(F.col("scope") == DURABLE, 2).when(F.col("scope") == ARCHIVED_SCOPE, 5).otherwise(4)
    out = files.withColumn("scope", scope).where("scope is not null").withColumn("change", F.when(F.col("scope") == ARCHIVED_SCOPE, parts[3]).when(F.col("scope") == ACTIVE_SCOPE, parts[2]))
    out = out.withColumn("root", root).withColumn("below", F.array_join(F.slice(parts, F.col("root") + 1, F.greatest(F.lit(0), F.size(parts) - F.col("root"))), "/"))
    good = (F.element_at(parts, -1) == "spec.md") & F.col("below").contains("/") & ((F.col("scope") == DURABLE) | (parts[F.col("root") - 1] == "specs"))
    return out.where(good).withColumn("capability", tx.capability_of(F.col("below"))).drop("root", "below")


def parsed(files: DataFrame) -> DataFrame:
    """placed() with title, related titles, frontmatter leaves (path without its first slash -> JSON text) and the body lines."""
    split = files.withColumn("fm", tx.frontmatter(tx.lines(F.col("value")))).withColumn("leaves", tree(F.col("fm.block"))["leaves"])
    texts = F.filter("leaves", lambda x: x["text"])
    said = lambda name: F.transform(F.filter(texts, lambda x: x["path"].rlike(rf"^/{name}$")), lambda x: json_string(x["value"]))
    front = split.withColumn("related", tx.related_titles(said(r"related(/\[[0-9]+\])?")))
    front = front.withColumn("title", tx.title_or(F.get(said("title"), 0), F.col("capability")))
    named = F.transform("leaves", lambda x: F.struct(F.substring(x["path"], F.lit(2), F.length(x["path"])).alias("key"), x["value"].alias("value")))
    kept = F.filter(named, lambda x: top_name(x["key"]).isin(*tx.FRONTMATTER_KEYS) & ~(x["key"].isin(*tx.FRONTMATTER_KEYS) & (x["value"] == "null")))
    return front.withColumn("top", F.map_from_entries(kept)).withColumn("body", F.col("fm.body")).drop("fm", "leaves", "value")


def headings(bodies: DataFrame) -> DataFrame:
    """Requirement and scenario headings of (path, body): path, line (from 1), requirement, scenario (null at a
    requirement).  A scenario belongs to the last requirement above it; one without any is dropped."""
    lines = bodies.select("path", F.posexplode("body").alias("pos", "text"))
    found = lines.select("path", (F.col("pos") + 1).alias("line"), tx.heading(F.col("text"), tx.REQUIREMENT_HEADING).alias("r"), tx.heading(F.col("text"), tx.SCENARIO_HEADING).alias("scenario"))
    found = found.where("r is not null or scenario is not null")
    above = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = found.withColumn("requirement", F.last("r", ignorenulls=True).over(above)).where("requirement is not null")
    return carried.select("path", "line", "requirement", F.when(F.col("r").isNull(), F.col("scenario")).alias("scenario"))


def _ord(phase: int, path: Column, seq: Column | int) -> Column:
    return F.struct(F.lit(0).alias("batch"), F.lit(phase).alias("phase"), F.split(path, "/").alias("path"), (F.lit(seq) if isinstance(seq, int) else seq).cast("int").alias("seq")).alias("ord")


def _change(c: str = "change") -> Column:
    return F.coalesce(F.col(c), F.lit("current"))


def identity() -> Column:
    return F.concat_ws(":", "scope", _change(), "capability")


def spec_id() -> Column:
    return stable_id("node", SPEC, F.col("scope"), _change(), F.col("capability"))


def change_kind() -> Column:
    return F.when(F.col("scope") == ARCHIVED_SCOPE, ARCHIVED_CHANGE).otherwise(ACTIVE_CHANGE)


def change_id(kind: Column | None = None) -> Column:
    return stable_id("node", kind if kind is not None else change_kind(), F.col("change"))


def edge(kind: str, source: Column, target: Column, *parts: Column | str, evidence: Column | None = None, of: Column | None = None, confidence: str | None = None, id: Column | None = None) -> list[Column]:
    return [
        (stable_id("edge", kind, source, target, *parts) if id is None else id).alias("id"), F.lit(kind).alias("kind"), source.alias("source_id"), target.alias("target_id"),
        (of if of is not None else props()).alias("props"), (F.array(evidence) if evidence is not None else F.array().cast("array<string>")).alias("evidence_ids"),
        F.lit(confidence).cast("string").alias("confidence"),
    ]


def node(id: Column, kind: str | Column, name: Column, of: Column, evidence: Column | None, **hot: Column) -> list[Column]:
    text = lambda n: (hot[n] if n in hot else F.lit(None)).cast("string").alias(n)
    return [id.alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), name.alias("name"), *[text(n) for n in ("capability", "scope", "change_identity", "openspec_identity")],
            of.alias("props"), (F.array(evidence) if evidence is not None else F.array().cast("array<string>")).alias("evidence_ids")]


def evidence(id: Column, path: Column, artifact: str | Column, identity_: Column, heading: Column | None = None, line: Column | None = None) -> list[Column]:
    kinds = dict(f.split(":") for f in EVIDENCE_SCHEMA.split("locator struct<")[1].split(">")[0].split(","))
    known = {"loc_type": F.lit("openspec"), "relative_file_path": path, "artifact_type": F.lit(artifact) if isinstance(artifact, str) else artifact, "openspec_identity": identity_,
             "heading_name": F.nullif(heading, F.lit("")) if heading is not None else None, "line_start": line}
    return [id.alias("id"), F.lit("openspec").alias("source"), F.struct(*[(known[n] if known.get(n) is not None else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]).alias("locator"), props().alias("props")]


def evidence_id(path: Column, identity_: Column) -> Column:
    return stable_id("evidence", "openspec", path, identity_)


#: Ids of the records that one row gives: its node, the end that its edge comes from, its edge, its evidence.
NODE_ID, FROM_ID, LINK_ID, PROOF_ID = MADE = ("node_id", "from_id", "link_id", "proof_id")


def spec_ids() -> dict[str, Column]:
    """MADE of specifications; those of changes touch them."""
    node, source = spec_id(), change_id()
    link = stable_id("edge", CHANGE_TOUCHES_SPEC, source, node, F.concat("scope", F.lit("-spec")), F.col("change"), F.col("capability"))
    return dict(zip(MADE, (node, source, link, evidence_id(F.col("path"), identity())), strict=True))


def requirement_ids() -> dict[str, Column]:
    ident = F.concat(identity(), F.lit(":requirement:"), "requirement")
    node, source = stable_id("node", SPEC_REQUIREMENT, ident), spec_id()
    link = stable_id("edge", SPEC_HAS_REQUIREMENT, source, node, "spec-requirement", identity(), F.col("requirement"))
    return dict(zip(MADE, (node, source, link, evidence_id(F.col("path"), ident)), strict=True))


def scenario_ids() -> dict[str, Column]:
    source = requirement_ids()[NODE_ID]
    ident = F.concat(identity(), F.lit(":requirement:"), "requirement", F.lit(":scenario:"), "scenario")
    node = stable_id("node", SCENARIO, ident)
    link = stable_id("edge", REQUIREMENT_HAS_SCENARIO, source, node, "requirement-scenario", source, F.col("scenario"))
    return dict(zip(MADE, (node, source, link, evidence_id(F.col("path"), ident)), strict=True))


def heading_ids() -> dict[str, Column]:
    """MADE of requirements and scenarios."""
    of_requirement, of_scenario = requirement_ids(), scenario_ids()
    return {n: F.when(F.col("scenario").isNull(), of_requirement[n]).otherwise(of_scenario[n]) for n in MADE}


def change_ids() -> dict[str, Column]:
    return {NODE_ID: change_id(), PROOF_ID: evidence_id(F.col("path"), F.col("change"))}


def artifact_ids() -> dict[str, Column]:
    ident = F.concat_ws(":", "scope", "change", F.lit("artifact"), "artifact")
    node, source = stable_id("node", ARTIFACT, ident), change_id()
    link = stable_id("edge", CHANGE_HAS_ARTIFACT, source, node, "change-artifact", F.col("change"), F.col("artifact"))
    return dict(zip(MADE, (node, source, link, evidence_id(F.col("path"), ident)), strict=True))


def _made(rows: DataFrame, ids: dict[str, Column]) -> list[Column]:
    """ids, those that rows has as columns as these."""
    return [F.col(n) if n in rows.columns else c for n, c in ids.items()]


def spec_facts(specs: DataFrame, repository_id: str = "requirements") -> Graph:
    """Specifications (path, scope, change, capability, title, related, top) as nodes with evidence; the touch edges of
    those inside a change.  top holds leaves of frontmatter: path -> JSON text.  Columns of MADE, if there, are ids made before."""
    own, changed, link, e = _made(specs, spec_ids())
    change = F.coalesce(F.col("change"), F.lit(""))
    base = props(capability=F.col("capability"), change_identity=change, openspec_identity=identity(), repository_id=F.lit(repository_id), scope=F.col("scope"))
    full = F.map_concat(base, F.transform_keys("top", lambda k, v: F.concat(F.lit("/frontmatter/"), k)))
    nodes = specs.select(*node(own, SPEC, F.col("title"), full, e, capability=F.col("capability"), scope=F.col("scope"), change_identity=change, openspec_identity=identity()), _ord(1, F.col("path"), 0))
    proof = specs.select(*evidence(e, F.col("path"), "openspec-spec", identity()), _ord(1, F.col("path"), 0))
    touch = specs.where("change is not null").select(*edge(CHANGE_TOUCHES_SPEC, changed, own, evidence=e, id=link), _ord(3, F.col("path"), 0))
    return Graph(nodes, touch, proof)


def heading_facts(rows: DataFrame) -> Graph:
    """Requirements and scenarios (path, scope, change, capability, line, requirement, scenario) with edges and evidence.  Columns
    of MADE, if there, are ids made before."""
    change = F.coalesce(F.col("change"), F.lit(""))
    r_identity = F.concat(identity(), F.lit(":requirement:"), "requirement")
    s_identity = F.concat(r_identity, F.lit(":scenario:"), "scenario")

    def facts(df: DataFrame, kind: str, ids: dict[str, Column], ident: Column, name: str, link: str) -> Graph:
        own, source, edge_id, e = _made(df, ids)
        of = props(capability=F.col("capability"), change_identity=change, openspec_identity=ident, scope=F.col("scope"))
        at = _ord(1, F.col("path"), F.col("line"))
        return Graph(
            df.select(*node(own, kind, F.col(name), of, e, capability=F.col("capability"), scope=F.col("scope"), change_identity=change, openspec_identity=ident), at),
            df.select(*edge(link, source, own, evidence=e, id=edge_id), at), df.select(*evidence(e, F.col("path"), kind, ident, F.col(name), F.col("line")), at))

    req, sce = rows.where("scenario is null"), rows.where("scenario is not null")
    a = facts(req, SPEC_REQUIREMENT, requirement_ids(), r_identity, "requirement", SPEC_HAS_REQUIREMENT)
    b = facts(sce, SCENARIO, scenario_ids(), s_identity, "scenario", REQUIREMENT_HAS_SCENARIO)
    return Graph(*(x.unionByName(y) for x, y in zip(a, b, strict=True)))


def change_facts(changes: DataFrame, artifacts: DataFrame) -> Graph:
    """Changes (path, scope, change) and their artifacts (path, scope, change, artifact).  Columns of MADE, if there, are ids made before."""
    own, e = _made(changes, change_ids())
    state = F.when(F.col("scope") == ARCHIVED_SCOPE, "archived").otherwise("active")
    of = F.map_concat(props(archive_state=state, change_identity=F.col("change")), listed("jira_reference_hints", tx.issue_keys(F.col("change"))))
    nodes = changes.select(*node(own, change_kind(), F.col("change"), of, e, change_identity=F.col("change")), _ord(2, F.col("path"), 0))
    proof = changes.select(*evidence(e, F.col("path"), change_kind(), F.col("change")), _ord(2, F.col("path"), 0))
    ident = F.concat_ws(":", "scope", "change", F.lit("artifact"), "artifact")
    a_id, a_from, a_link, a_e = _made(artifacts, artifact_ids())
    of = props(artifact_type=F.col("artifact"), change_identity=F.col("change"), scope=F.col("scope"))
    at = _ord(2, F.col("path"), 1)
    more = artifacts.select(*node(a_id, ARTIFACT, F.col("artifact"), of, a_e, scope=F.col("scope"), change_identity=F.col("change")), at)
    links = artifacts.select(*edge(CHANGE_HAS_ARTIFACT, a_from, a_id, evidence=a_e, id=a_link), at)
    return Graph(nodes.unionByName(more), links, proof.unionByName(artifacts.select(*evidence(a_e, F.col("path"), "openspec-artifact", ident), at)))


def related_matches(specs: DataFrame) -> DataFrame:
    """Each related title of a durable specification: matches (other durable specifications of that title) and, if there
    is exactly one, its target_id; reason is missing or ambiguous otherwise."""
    durable = specs.where(F.col("scope") == DURABLE).select("path", "capability", "title", "related", spec_id().alias("id"))
    wanted = durable.select("path", "capability", "id", F.posexplode("related").alias("at", "related_title"))
    titles = durable.groupBy("title").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    own = wanted.join(durable.select(F.col("id").alias("id"), F.col("title").alias("own_title")).distinct(), "id")
    met = own.join(titles, own.related_title == titles.title, "left")
    # all of a title but the specification itself: count and least other id, without listing them
    others = F.coalesce("n", F.lit(0)) - F.when(F.col("own_title") == F.col("related_title"), 1).otherwise(0)
    target = F.when(F.col("own_title") == F.col("related_title"), F.when(F.col("lo") == F.col("id"), F.col("hi")).otherwise(F.col("lo"))).otherwise(F.col("lo"))
    return met.select("path", "capability", "id", "at", "related_title", others.alias("matches"), F.when(others == 1, target).alias("target_id"),
                      F.when(others == 0, "missing").when(others > 1, "ambiguous").alias("reason"))


def related_facts(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges to uniquely titled specifications, and (capability, reason, related_title) of the titles left."""
    m = related_matches(specs)
    edges = m.where("matches = 1").select(*edge(RELATED_SPEC, F.col("id"), F.col("target_id"), "related-spec", F.col("capability"), F.col("related_title"), of=props(related_title=F.col("related_title")), confidence="non-confident"), _ord(4, F.col("path"), F.col("at")))
    return edges, m.where("matches <> 1").select("capability", "reason", "related_title")


def change_dirs(manifest: DataFrame) -> DataFrame:
    """(path, scope, change): the folders of active and archived changes."""
    parts = F.split("path", "/")
    m = manifest.where(F.col("path").startswith(f"{CHANGES_DIR}/")).select("path", "is_dir", parts.alias("p"))
    in_archive = (F.col("p")[2] == "archive")
    depth = F.when(in_archive, 4).otherwise(3)
    rows = m.where((F.size("p") > depth) | (F.col("is_dir") & (F.size("p") == depth)))
    return rows.select(F.array_join(F.slice("p", F.lit(1), depth), "/").alias("path"), F.when(in_archive, ARCHIVED_SCOPE).otherwise(ACTIVE_SCOPE).alias("scope"), F.get("p", depth - 1).alias("change")).distinct()


def artifact_files(manifest: DataFrame) -> DataFrame:
    """(path, scope, change, artifact): planning files directly inside a change folder."""
    name = F.substring_index("path", "/", -1)
    files = manifest.where(~F.col("is_dir") & name.isin(*tx.ARTIFACTS)).select("path", name.alias("artifact"))
    dirs = change_dirs(manifest).withColumnRenamed("path", "dir")
    return files.withColumn("dir", F.expr("substring(path, 1, length(path) - length(artifact) - 1)")).join(dirs, "dir").drop("dir")


def missing_layout(manifest: DataFrame, by: str | None = None) -> DataFrame:
    """(path): folders that a store must have and the manifest lacks; with `by`, for each store of that column with any rows."""
    needed = F.explode(F.array(*map(F.lit, ("openspec", SPECS, CHANGES_DIR)))).alias("path")
    stores = manifest.sparkSession.range(1).select(needed) if by is None else manifest.select(by).distinct().select(by, needed)
    keys = ["path"] if by is None else [by, "path"]
    return stores.join(manifest.where("is_dir").select(*keys).distinct(), keys, "left_anti")


class StoreLayoutError(ValueError):
    """A store without the folders that it must have, or with files that can't be read."""


def extract_store(spark: SparkSession, root: str, repository_id: str = "requirements") -> tuple[Graph, DataFrame, DataFrame]:
    """extract() from the path of a store alone.  Missing folders and files that are no UTF-8 are errors."""
    listed = cut(manifest(spark, root))
    if (x := missing_layout(listed).orderBy("path").first()) is not None:
        raise StoreLayoutError(f"{root} has no folder {x.path}")
    if (x := bad_bytes(listed).first()) is not None:
        raise StoreLayoutError(f"{x.path} is not UTF-8")
    return extract(read_files(listed), listed, repository_id)


def extract(files: DataFrame, manifest: DataFrame, repository_id: str = "requirements") -> tuple[Graph, DataFrame, DataFrame]:
    """The graph of a store (one record an id, the last wins), unresolved related titles, and the extraction counts."""
    specs = cut(parsed(placed(files)))  # each text is parsed once
    heads = headings(specs.select("path", "body")).join(specs.select("path", "scope", "change", "capability"), "path")
    dirs, artifacts = change_dirs(manifest), artifact_files(manifest)
    links, unresolved = related_facts(specs)
    parts = [spec_facts(specs, repository_id), heading_facts(heads), change_facts(dirs, artifacts)]
    g = Graph(*(a.unionByName(b).unionByName(c) for a, b, c in zip(*parts, strict=True)))
    g = Graph(g.nodes, g.edges.unionByName(links), g.evidence).map(last_wins)
    durable = F.col("scope") == DURABLE
    told = [
        specs.select(F.when(durable, "durable_specs").alias("what")), heads.where(durable).select(F.when(F.col("scenario").isNull(), "requirements").otherwise("scenarios").alias("what")),
        dirs.select(F.when(F.col("scope") == ACTIVE_SCOPE, "active_changes").otherwise("archived_changes").alias("what")), artifacts.select(F.lit("artifacts").alias("what")),
    ]
    union = told[0].unionAll(told[1]).unionAll(told[2]).unionAll(told[3])
    counts = union.agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("durable_specs", "active_changes", "archived_changes", "requirements", "scenarios", "artifacts")])
    return g, unresolved, counts
