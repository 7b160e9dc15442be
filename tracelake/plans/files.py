"""Queries on specification files: a store put together from the part and customer tables, as texts and as real files.

Every brand has one file for each range of RANGE part keys, so files are many and bounded.  Some lie in folders that begin
with `.` or `_`.  Customers are changes: each a folder, with planning files by the divisors of its key, or none at all; some hold
a specification of their own.  The frontmatter nests values, some under names that may not be stored or shown.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelake.functions.props import NOT_SHOWN, without
from tracelake.functions.text import ARTIFACTS
from tracelake.operators import ask
from tracelake.plans.sql import IDENT, REQ_ID, REQ_IDENT, SCE_ID, SCE_IDENT, SPEC_ID, edge, evidence, sid
from tracelake.sources import registry, specs, store
from tracelake.sources.shared import cut, dealt, shared_dir
from tracelake.sources.tables import table

RANGE = 1000
#: Files that one task writes, and texts that one task parses.
FILES_A_TASK, TEXTS_A_TASK = 5_000, 20_000


def _folder(n: Column) -> Column:
    return F.when(n % 5 == 1, "_x/").when(n % 5 == 2, ".x/").otherwise("")


def headings(spark: SparkSession, d: str) -> DataFrame:
    """(path, brand, n, line, text): the headings of each part (a requirement, and its type as scenario for sizes over 25)
    with a line or two of noise, in the order of `line`."""
    p = table(spark, d, "part").withColumn("n", F.floor(F.col("p_partkey") / RANGE).cast("long"))
    p = p.withColumn("path", F.concat(F.lit("openspec/specs/"), _folder(F.col("n")), "p_brand", F.lit("/"), F.col("n").cast("string"), F.lit("/spec.md")))
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    key = F.col("p_partkey")
    heads = F.array(F.struct((2 * key).alias("line"), F.concat(F.lit("### Requirement:  "), name, F.lit(" ")).alias("text")),
                    F.struct((2 * key + 1).alias("line"), F.when(F.col("p_size") > 25, F.concat(F.lit("#### Scenario: "), "p_type")).alias("text")))
    rows = p.select("path", F.col("p_brand").alias("brand"), "n", F.explode(heads).alias("h")).where("h.text is not null")
    noise = F.when(F.col("h.line") % 8 == 4, F.lit("\r\n## Requirement: ignored\n### Scenario: ignored")).otherwise(F.lit("\nplain text"))
    return rows.select("path", "brand", "n", "h.line", F.concat("h.text", noise).alias("text"))


def spec_texts(spark: SparkSession, d: str) -> DataFrame:
    """(path, value): the text of each durable specification; at most RANGE parts are gathered for one."""
    made = headings(spark, d).groupBy("path", "brand", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("body"))
    n = F.col("n")
    title = lambda k: F.concat(F.lit("Title "), "brand", F.lit(" "), k.cast("string"))
    front = F.concat(F.lit("---\ntitle: '"), title(n), F.lit("'\ncreated: 2026-08-01\nowner: dropped\nrelated:\n  - '"), title(n + 1), F.lit("'\n  - ''\n---\n#### Scenario: before any requirement\n"))
    return made.select("path", F.concat(front, "body").alias("value"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    """(folder, key, name): a change for each customer; every third is archived."""
    key = F.col("c_custkey")
    folder = F.concat(F.lit("openspec/changes/"), F.when(key % 3 == 0, "archive/").otherwise(""), _folder(key).substr(1, 1), F.lit("CUST-"), key.cast("string"))
    return table(spark, d, "customer").select(folder.alias("folder"), key.alias("key"), F.col("c_name").alias("name"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """(path, value): every file of the store with its text, and folders, without one, that may hold no files."""
    c = changes(spark, d)
    names = [F.when(F.col("key") % (i + 2) == 0, F.concat_ws("/", "folder", F.lit(a))) for i, a in enumerate(ARTIFACTS)]
    plans = c.select(F.explode(F.array_compact(F.array(*names))).alias("path"), F.lit("plan").alias("value"))
    own = c.where("key % 7 = 0").select(F.concat("folder", F.lit("/specs/Brand#11/0/spec.md")).alias("path"), F.concat(F.lit("### Requirement: "), "name", F.lit("\n")).alias("value"))
    return spec_texts(spark, d).unionByName(plans).unionByName(own).unionByName(c.select(F.col("folder").alias("path"), F.lit(None).cast("string").alias("value")))


def written(spark: SparkSession, d: str) -> str:
    """The store as files in the shared folder, written by tasks; its path."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, top = fs.FileSystem.from_uri(root)
        n, made = 0, None
        for batch in batches:
            for path, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = path if value is None else path.rsplit("/", 1)[0]
                if folder != made:
                    target.create_dir(f"{top}/{folder}", recursive=True)
                    made = folder
                if value is not None:
                    with target.open_output_stream(f"{top}/{path}") as f:
                        f.write(value.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    dealt(cut(entries(spark, d).select("path", "value")), FILES_A_TASK).mapInArrow(of, "n long").agg(F.sum("n")).collect()
    return root


def _headings(spark, d) -> DataFrame:
    p = specs.parsed(specs.placed(spec_texts(spark, d)))
    return specs.headings(p.select("path", "body"))


def heading_requirements(spark, d):
    return _headings(spark, d).where("scenario is null").select("path", "line", "requirement")


def heading_scenarios(spark, d):
    return _headings(spark, d).where("scenario is not null").select("path", "requirement", "scenario")


def frontmatter_related(spark, d):
    p = specs.parsed(specs.placed(spec_texts(spark, d)))
    keys = F.array_join(F.array_sort(F.array_distinct(F.transform(F.map_keys("top"), specs.top_name))), "|")
    return p.select("capability", "title", F.array_join("related", "|").alias("related"), keys.alias("keys"), specs.json_string(F.col("top")["created"]).alias("created"))


def extraction_counts(spark, d):
    """Counts of the facts read from a store's path."""
    return specs.extract_store(spark, written(spark, d))[2]


def tree_manifest(spark, d):
    """Every file and folder of the store, listed from its path."""
    return specs.manifest(spark, written(spark, d)).select("path", "is_dir", F.col("content").isNotNull().alias("is_spec"))


def _graph(spark, d):
    return specs.extract_store(spark, written(spark, d))[0]


def tree_nodes(spark, d):
    return _graph(spark, d).nodes.select("id", "kind", "name", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("capability", "scope", "change_identity")], F.element_at("evidence_ids", 1).alias("evidence_id"))


def tree_edges(spark, d):
    return _graph(spark, d).edges.select("id", "kind", "source_id", "target_id", F.coalesce(F.get("evidence_ids", F.lit(0)), F.lit("-")).alias("evidence_id"))


def tree_evidence(spark, d):
    """Locators with their empty parts left out."""
    return _graph(spark, d).evidence.select("id", F.to_json("locator").alias("locator"))


def tree_in_order(spark, d):
    """The store's files and folders in the order of their path parts, with their places."""
    return ask.numbered(specs.manifest(spark, written(spark, d)).select("path", "is_dir").orderBy(F.split("path", "/")))


def tree_locators(spark, d):
    """The locators that are shown of each node, by evidence id."""
    g = _graph(spark, d)
    return ask.locators(g.nodes, g.evidence).select("id", F.explode("locators").alias("l")).select("id", "l.evidence_id", "l.source", "l.locator")


def layout_missing(spark, d):
    """Folders that stores lack, by store; suppliers are stores."""
    key = F.col("s_suppkey")
    has = F.array(F.when(key % 2 == 0, F.lit("openspec")), F.when(key % 3 != 0, F.lit("openspec/specs")), F.when(key % 5 != 0, F.lit("openspec/changes")), F.lit("readme"))
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("store"), F.explode(F.array_compact(has)).alias("path"))
    return specs.missing_layout(rows.withColumn("is_dir", F.lit(True)), by="store")


def nested_texts(spark: SparkSession, d: str) -> DataFrame:
    """(path, value): a specification for each part, with nested frontmatter; the names in it depend on the part's size."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    name = F.element_at(F.array(*map(F.lit, ("token", "symbol_body", "note", "a/token"))), (size % 4 + 1).cast("int"))
    front = F.concat(
        F.lit("---\nrepo:\n  z: {at: 2026-08-01, n: "), size.cast("string"), F.lit("}\n  a:\n  - '"), F.col("p_brand"), F.lit("'\n  - "), name, F.lit(": {k: ["), key, F.lit("]}\nrelated: [{"),
        F.when(size % 3 == 0, "url").otherwise("page"), F.lit(": x}, 'B']\nowner: {token: dropped}\n---\n"))
    return table(spark, d, "part").select(F.concat(F.lit("openspec/specs/p"), key, F.lit("/spec.md")).alias("path"), front.alias("value"))


def _nested(spark, d):
    """Each text is parsed once, by many tasks: the table that they are made from is small."""
    return specs.spec_facts(cut(specs.parsed(specs.placed(dealt(nested_texts(spark, d), TEXTS_A_TASK))).drop("body")))


def forbidden_nested(spark, d):
    """Properties at any depth under a name that may not be stored."""
    g = _nested(spark, d)
    return store.forbidden(g).join(g.nodes.select("id", "capability"), "id").select("capability", "path")


def sanitized_nested(spark, d):
    """What is shown of nested frontmatter."""
    shown = _nested(spark, d).nodes.select("capability", F.explode(without(F.col("props"), NOT_SHOWN)).alias("path", "value"))
    return shown.where("path like '/frontmatter/%'")


def registry_readable(spark, d):
    """Diagnostics of registry files of suppliers, of which one in three is broken or no mapping."""
    key = F.col("s_suppkey")
    text = F.when(key % 6 == 0, "version: [1").when(key % 6 == 3, "- version\n- 1").otherwise(F.concat(F.lit("version: 1\nworkspace: {id: w"), key.cast("string"), F.lit("}\n")))
    files = table(spark, d, "supplier").select(F.concat(F.lit("/w"), key.cast("string"), F.lit("/repo-index.yaml")).alias("path"), text.alias("value"))
    read = registry.from_yaml(cut(files))[0].select(F.lit("info").alias("severity"), F.lit("registry-read").alias("rule_id"), F.col("workspace_id").alias("affected_object_id"), F.lit("").alias("message"))
    return registry.unreadable(files).unionByName(read)


_ART = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ARTIFACTS))
_FOLDER = "CASE {0} % 5 WHEN 1 THEN '_x/' WHEN 2 THEN '.x/' ELSE '' END"
_SQL = {
    "parts": f"""SELECT p_partkey, p_brand, n, p_size, p_type, 'openspec/specs/' || {_FOLDER.format('n')} || p_brand || '/' || n || '/spec.md' AS path, {_FOLDER.format('n')} || p_brand || '/' || n AS capability,
      p_name || ' ' || p_partkey AS requirement, 'durable' AS scope, CAST(NULL AS VARCHAR) AS change FROM (SELECT *, p_partkey // {RANGE} AS n FROM part)""",
    "lines": """SELECT path, requirement, 0 AS s, 2 * p_partkey AS pos FROM parts UNION ALL SELECT path, requirement, 1, 2 * p_partkey + 1 FROM parts WHERE p_size > 25""",
    "placed": """SELECT path, requirement, s, CAST(2 + sum(CASE WHEN pos % 8 = 4 THEN 3 ELSE 2 END) OVER (PARTITION BY path ORDER BY pos) - CASE WHEN pos % 8 = 4 THEN 3 ELSE 2 END AS INT) AS line FROM lines""",
    "dur": f"""SELECT *, 'Title ' || p_brand || ' ' || n AS title, 'Title ' || p_brand || ' ' || (n + 1) AS related, {SPEC_ID} AS id, {evidence(IDENT)} AS eid FROM (SELECT DISTINCT path, p_brand, n, capability, scope, change FROM parts)""",
    "ch": f"""SELECT *, {sid('node', "'openspec-' || scope", 'change')} AS id, {sid('evidence', "'openspec'", 'path', 'change')} AS eid FROM (
      SELECT c_custkey AS key, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'archived-change' ELSE 'active-change' END AS scope, substr({_FOLDER.format('c_custkey')}, 1, 1) || 'CUST-' || c_custkey AS change,
        'openspec/changes/' || CASE WHEN c_custkey % 3 = 0 THEN 'archive/' ELSE '' END || substr({_FOLDER.format('c_custkey')}, 1, 1) || 'CUST-' || c_custkey AS path FROM customer)""",
    "art": f"""SELECT *, {sid('node', "'openspec-artifact'", "scope || ':' || change || ':artifact:' || artifact")} AS id, {sid('evidence', "'openspec'", 'path', "scope || ':' || change || ':artifact:' || artifact")} AS eid FROM (
      SELECT scope, change, id AS change_id, path || '/' || artifact AS path, artifact FROM (SELECT *, CASE i {_ART} END AS artifact FROM ch, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE key % (i + 2) = 0))""",
    "own": f"""SELECT *, {SPEC_ID} AS id, {evidence(IDENT)} AS eid FROM (SELECT path || '/specs/Brand#11/0/spec.md' AS path, scope, change, id AS change_id, 'Brand#11/0' AS capability, c_name AS requirement FROM ch WHERE key % 7 = 0)""",
    "req": f"""SELECT *, {REQ_ID} AS id, {evidence(REQ_IDENT)} AS eid, {SPEC_ID} AS spec_id, {IDENT} AS ident FROM (
      SELECT path, scope, change, capability, requirement, line FROM parts JOIN placed USING (path, requirement) WHERE s = 0 UNION ALL SELECT path, scope, change, capability, requirement, 1 FROM own)""",
    "sce": f"""SELECT *, {SCE_ID} AS id, {evidence(SCE_IDENT)} AS eid, {REQ_ID} AS req_id, {SCE_IDENT} AS ident FROM (SELECT path, scope, change, capability, requirement, p_type AS scenario, line FROM parts JOIN placed USING (path, requirement) WHERE s = 1)""",
}


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({_SQL[n]})" for n in _SQL if n in names)


def _locator(path: str, kind: str, ident: str, heading: str = "NULL", line: str = "NULL") -> str:
    text = lambda k, v: f"""CASE WHEN {v} IS NULL THEN '' ELSE ',"{k}":"' || {v} || '"' END"""
    return f"""'{{"loc_type":"openspec"' || {text('relative_file_path', path)} || ',"artifact_type":"' || {kind} || '","openspec_identity":"' || {ident} || '"' || {text('heading_name', heading)} || CASE WHEN {line} IS NULL THEN '' ELSE ',"line_start":' || {line} END || '}}'"""


_ALL = ("parts", "lines", "placed", "dur", "ch", "art", "own", "req", "sce")
_SPECS = "(SELECT path, scope, change, capability, title, id, eid FROM dur UNION ALL SELECT path, scope, change, capability, capability, id, eid FROM own)"
ORACLES = {
    "heading_requirements": f"{_with('parts', 'lines', 'placed')} SELECT path, line, requirement FROM placed WHERE s = 0",
    "heading_scenarios": f"{_with('parts')} SELECT path, requirement, p_type AS scenario FROM parts WHERE p_size > 25",
    "frontmatter_related": f"{_with('parts', 'dur')} SELECT capability, title, related, 'created|related|title' AS keys, '2026-08-01' AS created FROM dur",
    "extraction_counts": f"""{_with(*_ALL)} SELECT (SELECT count(*) FROM dur) AS durable_specs, (SELECT count(*) FROM ch WHERE scope = 'active-change') AS active_changes, (SELECT count(*) FROM ch WHERE scope = 'archived-change') AS archived_changes,
      (SELECT count(*) FROM parts) AS requirements, (SELECT count(*) FROM sce) AS scenarios, (SELECT count(*) FROM art) AS artifacts""",
    "tree_manifest": f"""{_with(*_ALL)}, files AS (SELECT path, true AS is_spec FROM dur UNION ALL SELECT path, true FROM own UNION ALL SELECT path, false FROM art),
      up AS (SELECT string_split(path, '/') AS x FROM files UNION ALL SELECT list_append(string_split(path, '/'), '') FROM ch), dirs AS (SELECT DISTINCT array_to_string(x[:i], '/') AS path FROM (SELECT x, unnest(generate_series(1, len(x) - 1)) AS i FROM up))
      SELECT path, false AS is_dir, is_spec FROM files UNION ALL SELECT path, true, false FROM dirs""",
    "tree_nodes": f"""{_with(*_ALL)} SELECT id, 'openspec-spec' AS kind, title AS name, capability, scope, coalesce(change, '') AS change_identity, eid AS evidence_id FROM {_SPECS}
      UNION ALL SELECT id, 'openspec-requirement', requirement, capability, scope, coalesce(change, ''), eid FROM req UNION ALL SELECT id, 'openspec-scenario', scenario, capability, scope, '', eid FROM sce
      UNION ALL SELECT id, 'openspec-' || scope, change, '-', '-', change, eid FROM ch UNION ALL SELECT id, 'openspec-artifact', artifact, '-', scope, change, eid FROM art""",
    "tree_edges": f"""{_with(*_ALL)} SELECT {edge('openspec-spec-contains-requirement', 'spec_id', 'id', "'spec-requirement'", 'ident', 'requirement')} AS id, 'openspec-spec-contains-requirement' AS kind, spec_id AS source_id, id AS target_id, eid AS evidence_id FROM req
      UNION ALL SELECT {edge('openspec-requirement-contains-scenario', 'req_id', 'id', "'requirement-scenario'", 'req_id', 'scenario')}, 'openspec-requirement-contains-scenario', req_id, id, eid FROM sce
      UNION ALL SELECT {edge('openspec-change-has-artifact', 'change_id', 'id', "'change-artifact'", 'change', 'artifact')}, 'openspec-change-has-artifact', change_id, id, eid FROM art
      UNION ALL SELECT {edge('openspec-change-touches-spec', 'change_id', 'id', "scope || '-spec'", 'change', 'capability')}, 'openspec-change-touches-spec', change_id, id, eid FROM own
      UNION ALL SELECT {edge('openspec-related-spec', 'd.id', 'o.id', "'related-spec'", 'd.capability', 'd.related')}, 'openspec-related-spec', d.id, o.id, '-' FROM dur d JOIN dur o ON o.title = d.related""",
    "tree_evidence": f"""{_with(*_ALL)} SELECT eid AS id, {_locator('path', "'openspec-spec'", IDENT)} AS locator FROM {_SPECS}
      UNION ALL SELECT eid, {_locator('path', "'openspec-requirement'", "ident || ':requirement:' || requirement", 'requirement', 'line')} FROM req
      UNION ALL SELECT eid, {_locator('path', "'openspec-scenario'", 'ident', 'scenario', 'line')} FROM sce
      UNION ALL SELECT eid, {_locator('path', "'openspec-' || scope", 'change')} FROM ch
      UNION ALL SELECT eid, {_locator('path', "'openspec-artifact'", "scope || ':' || change || ':artifact:' || artifact")} FROM art""",
    "layout_missing": """SELECT s_name AS store, p AS path FROM supplier, (SELECT unnest(['openspec', 'openspec/specs', 'openspec/changes']) AS p)
      WHERE (p = 'openspec' AND s_suppkey % 2 <> 0) OR (p = 'openspec/specs' AND s_suppkey % 3 = 0) OR (p = 'openspec/changes' AND s_suppkey % 5 = 0)""",
    "forbidden_nested": """SELECT 'p' || p_partkey AS capability, '/frontmatter/repo/a/[1]/token/k/[0]' AS path FROM part WHERE p_size % 4 = 0 UNION ALL SELECT 'p' || p_partkey, '/frontmatter/related/[0]/url' FROM part WHERE p_size % 3 = 0""",
    "sanitized_nested": """WITH p AS (SELECT 'p' || p_partkey AS capability, p_size AS s, p_partkey AS k, p_brand FROM part)
      SELECT capability, '/frontmatter/repo/z/at' AS path, '"2026-08-01"' AS value FROM p UNION ALL SELECT capability, '/frontmatter/repo/z/n', CAST(s AS VARCHAR) FROM p UNION ALL SELECT capability, '/frontmatter/repo/a/[0]', '"' || p_brand || '"' FROM p
      UNION ALL SELECT capability, '/frontmatter/related/[1]', '"B"' FROM p UNION ALL SELECT capability, '/frontmatter/related/[0]/page', '"x"' FROM p WHERE s % 3 <> 0
      UNION ALL SELECT capability, '/frontmatter/repo/a/[1]/' || CASE s % 4 WHEN 2 THEN 'note' ELSE 'a~1token' END || '/k/[0]', CAST(k AS VARCHAR) FROM p WHERE s % 4 > 1""",
    "registry_readable": """SELECT 'error' AS severity, 'registry-readable' AS rule_id, '/w' || s_suppkey || '/repo-index.yaml' AS affected_object_id, CASE s_suppkey % 6 WHEN 0 THEN 'Workspace registry is not valid YAML' ELSE 'Workspace registry must be a mapping' END AS message FROM supplier WHERE s_suppkey % 3 = 0
      UNION ALL SELECT 'info', 'registry-read', 'w' || s_suppkey, '' FROM supplier WHERE s_suppkey % 3 <> 0""",
}
ORACLES["tree_in_order"] = f"SELECT path, is_dir, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS position FROM ({ORACLES['tree_manifest']})"
ORACLES["tree_locators"] = f"SELECT n.id, evidence_id, 'openspec' AS source, locator FROM ({ORACLES['tree_nodes']}) n JOIN ({ORACLES['tree_evidence']}) e ON e.id = n.evidence_id"
QUERIES = {f.__name__: f for f in (heading_requirements, heading_scenarios, frontmatter_related, extraction_counts, tree_manifest, tree_nodes, tree_edges, tree_evidence, tree_in_order, tree_locators, layout_missing, forbidden_nested, sanitized_nested, registry_readable)}
