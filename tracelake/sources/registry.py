"""Workspace registries: records, the graph they describe, and the rules they must meet (all violations, not the first)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.functions.ids import stable_id
from tracelake.functions.props import NOT_REGISTERED, holds, props
from tracelake.functions.text import joined, prefixes, stripped
from tracelake.schema import CONTAINS, OWNS, REPOSITORY, SERVICE, WORKSPACE, Graph
from tracelake.sources.shared import cut
from tracelake.sources.specs import edge, node
from tracelake.sources.trees import tree

# Allowed roles and policies, the required version, and the prefixes of SSH addresses.
ROLES = ("requirements", "code", "configuration", "infrastructure", "library", "test", "other")
DIRTY, REMOTE, VERSION = ("skip", "read-with-warning"), ("allowed", "forbidden"), 1
SSH = ("git@", "ssh://")
# What an unset key of a registry stands for.
STORE_REPOSITORY, TOOL_PATH, OUTPUT_PATH, FRESHNESS = "requirements", ".openlore", ".engineering-kg/ladybugdb", "validate-only"

#: Columns of a repository that must be there, besides id, path, role and address.
REQUIRED = ("description", "default_branch", "include_by_default", "search_exclusions", "dirty_worktree", "fetch", "pull", "pull_requires_default_branch")

REGISTRY = (
    "version int, workspace struct<id:string,name:string,description:string>, layout struct<root_path:string,openlore_path:string>, "
    "engineering_kg struct<enabled:boolean,store_repository:string,output_path:string,pipeline_stages:array<string>>, "
    "openlore struct<federation_enabled:boolean,freshness_policy:string>, repositories array<struct<id:string,path:string,description:string,"
    "ssh_url:string,default_branch:string,role:string,service:struct<id:string,name:string>,openlore:struct<include_in_federation:boolean,index_location:string>,"
    "exploration:struct<include_by_default:boolean,search_exclusions:array<string>,notes:string>,"
    "git:struct<dirty_worktree:string,fetch:string,pull:string,pull_requires_default_branch:boolean,branch_rule:string>>>"
)


def from_yaml(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, value) of registry files as workspaces, repositories, and (workspace_id, path) of all their leaves, whole
    paths.  Files that are no registry give no rows; unreadable() names them.  A registry without workspace is known by its file."""
    text = cut(files.select("path", tree(F.col("value")).alias("tree")))  # parsed once
    r = text.where("tree.ok and tree.is_mapping").select("path", "tree.leaves", F.from_json("tree.json", REGISTRY).alias("r"))
    ws_id = F.coalesce("r.workspace.id", "r.workspace.name", "path")
    workspaces = r.select(
        ws_id.alias("workspace_id"), F.col("r.version").alias("version"), F.col("r.workspace.name").alias("name"), F.coalesce("r.workspace.description", F.lit("")).alias("description"),
        F.col("r.layout").isNotNull().alias("has_layout"), F.coalesce("r.layout.root_path", F.lit(".")).alias("root_path"), F.coalesce("r.layout.openlore_path", F.lit(TOOL_PATH)).alias("openlore_path"),
        F.regexp_replace("path", "/[^/]*$", "").alias("base"), F.coalesce("r.engineering_kg.enabled", F.lit(True)).alias("enabled"),
        F.coalesce("r.engineering_kg.store_repository", F.lit(STORE_REPOSITORY)).alias("store_repository"),
        F.coalesce("r.engineering_kg.output_path", F.lit(OUTPUT_PATH)).alias("output_path"), F.coalesce("r.openlore.federation_enabled", F.lit(True)).alias("federation_enabled"),
        F.coalesce("r.openlore.freshness_policy", F.lit(FRESHNESS)).alias("freshness_policy"))
    flat = r.select(ws_id.alias("workspace_id"), F.regexp_replace("path", "/[^/]*$", "").alias("base"), F.explode("r.repositories").alias("p"))
    repositories = flat.select(
        "workspace_id", F.col("p.id").alias("id"), F.col("p.path").alias("path"), joined(F.col("base"), F.col("p.path")).alias("resolved_path"),
        F.col("p.description").alias("description"), F.col("p.ssh_url").alias("ssh_url"), F.col("p.default_branch").alias("default_branch"), F.col("p.role").alias("role"),
        F.col("p.service.id").alias("service_id"), F.col("p.service.name").alias("service_name"), F.coalesce("p.openlore.include_in_federation", F.lit(False)).alias("include_in_federation"),
        F.col("p.openlore.index_location").alias("index_location"), F.col("p.git.dirty_worktree").alias("dirty_worktree"), F.col("p.git.fetch").alias("fetch"), F.col("p.git.pull").alias("pull"),
        F.col("p.git.pull_requires_default_branch").alias("pull_requires_default_branch"), F.col("p.exploration.include_by_default").alias("include_by_default"),
        F.col("p.exploration.search_exclusions").alias("search_exclusions"))
    keys = r.select(ws_id.alias("workspace_id"), F.explode("leaves.path").alias("path"))
    return workspaces, repositories, keys


def unreadable(files: DataFrame) -> DataFrame:
    """Diagnostics of (path, value): one error for each file that is no YAML, or holds something else than a mapping."""
    told = files.select("path", tree(F.col("value")).alias("tree")).where("not (tree.ok and tree.is_mapping)")
    message = F.when(F.col("tree.ok"), "Workspace registry must be a mapping").otherwise("Workspace registry is not valid YAML")
    return told.select(F.lit("error").alias("severity"), F.lit("registry-readable").alias("rule_id"), F.col("path").alias("affected_object_id"), message.alias("message"))


def _ord(phase: int, *path: Column) -> Column:
    return F.struct(F.lit(0).alias("batch"), F.lit(phase).alias("phase"), F.array(*path).alias("path"), F.lit(0).alias("seq")).alias("ord")


def facts(workspaces: DataFrame, repositories: DataFrame, evidence: DataFrame, served: DataFrame | None = None) -> Graph:
    """Workspace, repository and service nodes; contains and owns edges.  evidence: any evidence table, for its schema.
    served (id, service_id, service_name): services of repositories, by default those named in repositories."""
    w_id, r_id = stable_id("node", WORKSPACE, F.col("workspace_id")), stable_id("node", REPOSITORY, F.col("id"))
    s_id = stable_id("node", SERVICE, F.col("service_id"))
    have = lambda df, *names: {n: F.col(n) for n in names if n in df.columns}
    w_props = props(**have(workspaces, "description"), **{f"layout__{k}": v for k, v in have(workspaces, "root_path", "openlore_path").items()},
                    **{f"engineering_kg__{k}": v for k, v in have(workspaces, "enabled", "output_path", "store_repository").items()},
                    **{f"openlore__{k}": v for k, v in have(workspaces, "federation_enabled", "freshness_policy").items()})
    r_props = props(**have(repositories, "default_branch", "description", "path", "resolved_path", "role", "ssh_url"),
                    **{f"openlore__{k}": v for k, v in have(repositories, "include_in_federation", "index_location").items()})
    served = (repositories if served is None else served).where(F.coalesce("service_id", F.lit("")) != "")
    ws = workspaces.select(*node(w_id, WORKSPACE, F.col("name"), w_props, None), _ord(0, F.lit("")))
    rs = repositories.select(*node(r_id, REPOSITORY, F.col("id"), r_props, None), _ord(0, F.col("id"), F.lit("0")))
    ss = served.select(*node(s_id, SERVICE, F.coalesce(F.nullif(F.col("service_name"), F.lit("")), "service_id"), props(repository_id=F.col("id")), None), _ord(0, F.col("id"), F.lit("1")))
    contains = repositories.select(*edge(CONTAINS, w_id, r_id), _ord(0, F.col("id"), F.lit("0")))
    owns = served.select(*edge(OWNS, s_id, r_id), _ord(0, F.col("id"), F.lit("1")))
    return Graph(ws.unionByName(rs).unionByName(ss), contains.unionByName(owns), evidence.limit(0))


def _v(df: DataFrame, rule: str, about: str, detail: str | Column) -> DataFrame:
    return df.select("workspace_id", F.lit(rule).alias("rule"), F.col(about).cast("string").alias("object"), (F.col(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def contained(inner: DataFrame, outer: DataFrame, path: str = "path") -> DataFrame:
    """inner (workspace_id, item, path) joined with outer (workspace_id, owner, path) where the path is that of the
    owner or below it.  The prefixes of each path meet the owners' paths in an equi-join, so no pair is tried in vain."""
    spread = inner.select("workspace_id", "item", F.col(path), F.explode(prefixes(F.col(path))).alias("at"))
    return spread.join(outer.select("workspace_id", "owner", F.col(path).alias("at")), ["workspace_id", "at"])


def violations(workspaces: DataFrame, repositories: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(workspace_id, rule, object, detail): every rule that a registry breaks."""
    w, r = workspaces, repositories
    out = []
    if "version" in w.columns:
        out.append(_v(w.where(~F.col("version").eqNullSafe(VERSION)), "version", "workspace_id", "version"))
    out.append(_v(w.where(stripped(F.coalesce("name", F.lit(""))) == ""), "required", "workspace_id", F.lit("name")))
    out.append(_v(r.where((stripped(F.coalesce("id", F.lit(""))) == "") | (stripped(F.coalesce("path", F.lit(""))) == "")), "required", "id", F.lit("id, path")))
    for c in REQUIRED:  # null also stands for a value of another type
        if c in r.columns:
            out.append(_v(r.where(F.col(c).isNull()), "required", "id", F.lit(c)))
    out.append(_v(r.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))), "role", "id", "role"))
    for c, allowed in (("dirty_worktree", DIRTY), ("fetch", REMOTE), ("pull", REMOTE)):
        if c in r.columns:
            out.append(_v(r.where(F.col(c).isNotNull() & ~F.col(c).isin(*allowed)), c, "id", c))
    out.append(_v(r.where(~(F.coalesce("ssh_url", F.lit("")).startswith(SSH[0]) | F.coalesce("ssh_url", F.lit("")).startswith(SSH[1]))), "ssh_url", "id", "ssh_url"))
    out.append(_v(r.groupBy("workspace_id", "id").agg(F.count("*").alias("n")).where("n > 1"), "unique_id", "id", "n"))
    store = w.where(F.coalesce("store_repository", F.lit("")) != "").select("workspace_id", "store_repository")
    found = store.join(r.select("workspace_id", F.col("id").alias("store_repository"), "role").distinct(), ["workspace_id", "store_repository"], "left")
    out.append(_v(found.where(F.col("role").isNull() | (F.col("role") != "requirements")), "store_repository", "store_repository", F.coalesce("role", F.lit("unknown"))))
    served = r.where(F.coalesce("service_id", F.lit("")) != "")
    out.append(_v(served.groupBy("workspace_id", "service_id").agg(F.countDistinct("id").alias("n")).where("n > 1"), "service_topology", "service_id", "n"))
    if "resolved_path" in r.columns and "has_layout" in w.columns:
        laid = w.where("has_layout")
        owner = r.join(laid.select("workspace_id", "store_repository"), "workspace_id").where("id = store_repository").select("workspace_id", F.col("id").alias("owner"), F.col("resolved_path").alias("path"))
        inner = r.where(F.col("role").isin("code", "library")).select("workspace_id", F.col("id").alias("item"), F.col("resolved_path").alias("path"))
        out.append(_v(contained(inner, owner).where("item <> owner"), "inside_store", "item", "owner"))
        made = laid.select("workspace_id", F.lit("openlore_path").alias("item"), joined(joined(F.col("base"), F.col("root_path")), F.col("openlore_path")).alias("path")).where(F.col("openlore_path") != "")
        root = laid.select("workspace_id", F.lit("root").alias("owner"), joined(F.col("base"), F.col("root_path")).alias("path"))
        outside = made.join(contained(made, root).select("workspace_id"), "workspace_id", "left_anti")
        out.append(_v(outside, "outside_root", "item", "path"))
        every = r.select("workspace_id", F.col("id").alias("owner"), F.col("resolved_path").alias("path"))
        stored = laid.select("workspace_id", F.lit("output_path").alias("item"), joined(joined(F.col("base"), F.col("root_path")), F.col("output_path")).alias("path"))
        out.append(_v(contained(made.unionByName(stored), every), "generated_path", "item", "owner"))
    out.append(_v(r.where(F.col("include_in_federation") & (stripped(F.coalesce("index_location", F.lit(""))) == "")), "index_location", "id", "index_location"))
    if keys is not None:
        out.append(_v(keys.where(holds(F.col("path"), NOT_REGISTERED)), "forbidden", "path", "path"))
    return reduce(DataFrame.unionByName, out)


def federation(workspaces: DataFrame, repositories: DataFrame) -> DataFrame:
    """(workspace_id, id, index_path): repositories included in the federation of workspaces that have one."""
    on = workspaces.where("federation_enabled").select("workspace_id")
    r = repositories.where("include_in_federation").join(on, "workspace_id", "left_semi")
    return r.select("workspace_id", "id", joined(F.col("resolved_path"), F.col("index_location")).alias("index_path"))


def federation_counts(workspaces: DataFrame, repositories: DataFrame) -> DataFrame:
    """(workspace_id, repository_count) of each workspace; 0 where the federation is off or empty."""
    n = federation(workspaces, repositories).groupBy("workspace_id").agg(F.count("*").alias("n"))
    return workspaces.select("workspace_id").join(n, "workspace_id", "left").select("workspace_id", F.coalesce("n", F.lit(0)).alias("repository_count"))


def known_stores(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store records under any of their alias columns as (store_id, path), and those without one of the two."""
    pick = lambda names: F.coalesce(*[F.nullif(stripped(F.col(n)), F.lit("")) for n in names if n in entries.columns], F.lit(None).cast("string"))
    rows = entries.select(pick(("id", "name")).alias("store_id"), pick(("path", "root", "storePath", "store_path", "location")).alias("path"))
    whole = F.col("store_id").isNotNull() & F.col("path").isNotNull()
    return rows.where(whole), rows.where(~whole)


def matched_stores(repositories: DataFrame, stores: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(workspace_id, id, matches, store_id, state) of each requirements repository: the registered stores at its path.
    One is used; none or several are errors.  asked (workspace_id, store_id) names a store, whose path is then checked."""
    r = repositories.where(F.col("role") == "requirements").select("workspace_id", "id", "resolved_path")
    if asked is not None:
        named = r.join(asked, "workspace_id").join(stores.withColumnRenamed("path", "store_path"), "store_id", "left")
        state = F.when(F.col("store_path").isNull(), "unknown").when(F.col("store_path") == F.col("resolved_path"), "used").otherwise("path_mismatch")
        return named.select("workspace_id", "id", F.col("store_path").isNotNull().cast("long").alias("matches"), "store_id", state.alias("state"))
    at = stores.groupBy("path").agg(F.count("*").alias("n"), F.min("store_id").alias("store_id"))
    m = r.join(at, r.resolved_path == at.path, "left").withColumn("matches", F.coalesce("n", F.lit(0)))
    return m.select("workspace_id", "id", F.col("matches").cast("long").alias("matches"), F.when(F.col("matches") == 1, F.col("store_id")).alias("store_id"),
                    F.when(F.col("matches") == 1, "used").when(F.col("matches") == 0, "missing").otherwise("ambiguous").alias("state"))
