"""Graph operators on small graphs: ids, text functions, extraction, merging, derivation, integrity, questions, store."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import text as tx
from tracelake.functions.ids import stable_id
from tracelake.functions.props import NOT_SHOWN, canonical, props, without
from tracelake.handle import GraphHandle
from tracelake.operators import ask, derive, merge, reach, validate
from tracelake.operators.components import connected_components
from tracelake.plans.job import build
from tracelake.schema import Graph, empty_graph
from tracelake.sources import registry, specs, store

SPEC_A = """---
title: Payments
created: 2026-08-01
related:
  - Billing
  - Missing Capability
---
## Requirement: Ignored
#### Scenario: Nothing above

### Requirement: Payment is submitted
#### Scenario: Valid payment
## Requirement: Still ignored
#### Scenario: Belongs to the one above
### Requirement: pay  A
### Requirement:  Pay a
"""
FILES = [
    ("openspec/specs/payments/spec.md", SPEC_A),
    ("openspec/specs/service/payments/spec.md", "### Requirement: Nested\n#### Scenario: One\n"),
    ("openspec/specs/billing/spec.md", "---\ntitle: Billing\nrelated: Payments\n---\n### Requirement: Bill\n"),
    ("openspec/specs/open/spec.md", "---\ntitle: never closed\n### Requirement: In the body\n"),
    ("openspec/specs/spec.md", "### Requirement: In the root itself\n"),
    ("openspec/changes/JIRA-123-add-refund/specs/payments/spec.md", "### Requirement: Refund\n"),
    ("openspec/changes/JIRA-123-add-refund/specs/service/payments/spec.md", "### Requirement: Refund service\n"),
    ("openspec/changes/archive/2026-08-01-JIRA-122-add-payments/specs/payments/spec.md", "### Requirement: Payment is submitted\n"),
    ("openspec/changes/archive/2026-08-01-JIRA-122-add-payments/specs/nowhere/spec.md", "plain"),
]
MANIFEST = [(p, False) for p, _ in FILES] + [
    ("openspec/changes/JIRA-123-add-refund/proposal.md", False), ("openspec/changes/JIRA-123-add-refund/.openspec.yaml", False), ("openspec/changes/JIRA-123-add-refund/deep/tasks.md", False),
    ("openspec/changes/archive/2026-08-01-JIRA-122-add-payments/tasks.md", False), ("openspec/changes/empty-change", True), ("openspec", True), ("openspec/specs", True),
]


@pytest.fixture(scope="module")
def extracted(spark):
    files = spark.createDataFrame(FILES, "path string, value string")
    manifest = spark.createDataFrame(MANIFEST, "path string, is_dir boolean")
    g, unresolved, counts = specs.extract(files, manifest)
    return g.map(lambda df: df.cache()), unresolved, counts, manifest


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("got, want", [
    (("node", "workspace", "payments-workspace"), "node:2a64c98bd28ddcdd"),
    (("node", "repository", " Payment-Service\t"), "node:d01bfdb006df5e06"),
    (("node", "openspec-spec", "durable", "current", "PAYMENTS"), "node:41240bcabcd3484b"),
    (("node", "openspec-active-change", "JIRA-123-add-refund"), "node:14ebf066bd64f007"),
    (("node", "openspec-requirement", "durable:current:payments:requirement:Payment  is\x1csubmitted"), "node:e7c9bf97a87fed4f"),
])
def test_stable_ids(spark, got, want):
    assert value(spark, stable_id(got[0], *got[1:])) == want


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\rc\n\nd", "\n", "x\x0by\x0cz\x1c1\x1d2\x1e3\x854 5 6", "end\r\n"])
def test_lines(spark, text):
    assert value(spark, tx.lines(F.lit(text))) == text.splitlines()


@pytest.mark.parametrize("text, block, body", [
    ("---\na: 1\n---\nrest\nmore", "a: 1", ["rest", "more"]), ("---\na: 1", "", ["---", "a: 1"]), (" --- \n---\nx", "", ["x"]), ("no\n---\n---", "", ["no", "---", "---"]), ("", "", [])])
def test_frontmatter(spark, text, block, body):
    assert tuple(value(spark, tx.frontmatter(tx.lines(F.lit(text))))) == (block, body)


def test_small_functions(spark):
    assert value(spark, tx.heading(F.lit("### Requirement:  A b "), tx.REQUIREMENT_HEADING)) == "A b"
    assert value(spark, tx.heading(F.lit("### Requirement:   "), tx.REQUIREMENT_HEADING)) == ""
    assert value(spark, tx.heading(F.lit("## Requirement: x"), tx.REQUIREMENT_HEADING)) is None
    assert value(spark, tx.issue_keys(F.lit("2026-08-01-JIRA-122-x AB-1 a-1"))) == ["JIRA-122", "AB-1"]
    assert value(spark, tx.resolved(F.lit("/a/./b//../c/.."))) == "/a" and value(spark, tx.resolved(F.lit("/.."))) == "/"
    assert value(spark, tx.prefixes(F.lit("/a/b"))) == ["/", "/a", "/a/b"] and value(spark, tx.prefixes(F.lit("/"))) == ["/"]
    m = props(a=F.lit("x\"y"), nested__token=F.lit(1), n=F.lit(None).cast("string"), deep__note=F.lit(True))
    assert value(spark, m) == {"/a": '"x\\"y"', "/nested/token": "1", "/deep/note": "true"}
    assert value(spark, without(m, NOT_SHOWN)) == {"/a": '"x\\"y"', "/deep/note": "true"}
    assert value(spark, canonical(props(b=F.lit(1), a=F.lit(2)))) == value(spark, canonical(props(a=F.lit(2), b=F.lit(1))))


def test_extraction(extracted):
    g, unresolved, counts, _ = extracted
    assert counts.first().asDict() == {"durable_specs": 4, "active_changes": 2, "archived_changes": 1, "requirements": 6, "scenarios": 3, "artifacts": 3}
    names = {(r.kind, r.name, r.scope) for r in g.nodes.collect()}
    assert ("openspec-spec", "Payments", "durable") in names and ("openspec-spec", "service/payments", "durable") in names and ("openspec-spec", "open", "durable") in names
    assert ("openspec-requirement", "Ignored", "durable") not in names and ("openspec-requirement", "In the root itself", "durable") not in names
    # equal but for case and blanks: one node, the later name
    assert ("openspec-requirement", "Pay a", "durable") in names and ("openspec-requirement", "pay  A", "durable") not in names
    ids = {r.id for r in g.nodes.collect()}
    assert {"node:41240bcabcd3484b", "node:a07e933cffe944b8", "node:14ebf066bd64f007", "node:7c64c527aec6130d", "node:e7c9bf97a87fed4f", "node:049ef7e6e1e57165"} <= ids
    assert "edge:ea0febe7404e37ad" in {r.id for r in g.edges.collect()}
    lines = {r.locator.heading_name: r.locator.line_start for r in g.evidence.collect() if r.locator.relative_file_path == FILES[0][0] and r.locator.heading_name}
    assert lines["Payment is submitted"] == 4
    e = {(r.source_id, r.target_id) for r in g.edges.where("kind = 'openspec-requirement-contains-scenario'").collect()}
    assert ("node:e7c9bf97a87fed4f", "node:049ef7e6e1e57165") in e
    assert sorted(map(tuple, unresolved.collect())) == [("payments", "missing", "Missing Capability")]
    assert g.edges.where("kind = 'openspec-related-spec' and confidence = 'non-confident'").count() == 2


def test_layout_and_changes(extracted):
    _, _, _, manifest = extracted
    assert [r.path for r in specs.missing_layout(manifest).collect()] == ["openspec/changes"]
    assert {r.change for r in specs.change_dirs(manifest).collect()} == {"JIRA-123-add-refund", "2026-08-01-JIRA-122-add-payments", "empty-change"}


def test_derivation(extracted):
    g = extracted[0]
    made = derive.derived_edges(g).collect()
    assert len(made) == 3 and "edge:f6462e7be42d2f51" in {r.id for r in made}
    once = derive.derive(g)
    twice = derive.derive(once)
    assert sorted(r.id for r in once.edges.collect()) == sorted(r.id for r in twice.edges.collect())
    assert [(r.severity, r.message) for r in derive.diagnostics(g).collect()] == [("info", derive.NO_DURABLE + "nowhere")]
    assert tuple(derive.metadata(g).first()) == (3, 1, 1)


def test_derivation_with_missing_ends(extracted):
    g = extracted[0]
    broken = Graph(g.nodes.where("id <> 'node:14ebf066bd64f007'"), g.edges, g.evidence)
    assert {r.severity for r in derive.diagnostics(broken).where("severity = 'warning'").collect()} == {"warning"}
    assert derive.diagnostics(broken).where("severity = 'warning'").count() == 2


def test_integrity(spark, extracted):
    g = derive.derive(extracted[0])
    found = validate.diagnostics(g)
    assert validate.status(found).first().asDict() == {"error_count": 0, "warning_count": 1, "info_count": 0, "status": "valid"}
    assert validate.require_valid(g) is g
    twin = Graph(g.nodes.unionAll(g.nodes.limit(1)), g.edges, g.evidence)
    assert validate.conflicts(twin.nodes, "node").count() == 0
    assert {r.collection: r.surplus for r in validate.surplus(twin).collect()} == {"node": 1, "edge": 0, "evidence": 0}
    other = Graph(g.nodes.unionAll(g.nodes.limit(1).withColumn("name", F.lit("other"))), g.edges, g.evidence)
    assert [r.rule_id for r in validate.conflicts(other.nodes, "node").collect()] == ["duplicate-identity-conflict"]
    bad = Graph(g.nodes, g.edges.unionAll(g.edges.where("kind = 'openspec-change-traces-to-spec'").limit(1).withColumn("id", F.lit("edge:x")).withColumn("target_id", F.col("source_id")).withColumn("evidence_ids", F.array(F.lit("evidence:none")))), g.evidence)
    rules = sorted(r.rule_id for r in validate.ordered(validate.diagnostics(bad)).collect() if r.affected_object_id == "edge:x")
    assert rules == ["evidence-reference-exists", "openspec-traceability-target-kind"]
    with pytest.raises(validate.GraphInvalid):
        validate.require_valid(bad)


def test_questions(spark, extracted):
    g = derive.derive(extracted[0]).map(lambda df: df.cache())
    assert ask.requirements(g).count() == 8
    paid = {r.name for r in ask.requirements(g, capability="payments").collect()}
    assert {"Payment is submitted", "Refund", "Refund service", "Nested"} <= paid and "In the body" not in paid
    assert {r.name for r in ask.requirements(g, change="JIRA-123-add-refund").collect()} == paid
    assert ask.requirements(g, service="none").count() == 0
    ref = g.nodes.where("name = 'Bill'").first().evidence_ids[0]
    assert [r.name for r in ask.requirements(g, evidence_ref=ref).collect()] == ["Bill"]
    c = {r.name: r for r in ask.changes(g).collect()}["JIRA-123-add-refund"]
    assert len(c.touched_spec_ids) == 2 == len(c.traceability_spec_ids) and c.missing_durable_spec_links == c.touched_spec_ids and c.untraced_spec_ids == []
    asked = spark.createDataFrame([("node:14ebf066bd64f007",), ("node:gone",)], "object_id string")
    rows = ask.traceability(g, asked).collect()
    assert sorted(r.kind for r in rows if not r.missing) == ["openspec-change-has-artifact"] * 2 + ["openspec-change-touches-spec"] * 2 + ["openspec-change-traces-to-spec"] * 2
    assert [r.object_id for r in rows if r.missing] == ["node:gone"]
    with pytest.raises(ask.UnknownObject):
        ask.traceability(g, asked, missing_ok=False)


def test_handle(spark, extracted, tmp_path):
    g = derive.derive(extracted[0])
    store.write(g, str(tmp_path / "h"))
    h = GraphHandle.from_store(spark, str(tmp_path / "h"), require_validation=True)
    assert [r.id for r in h.list_requirements(capability="billing").collect()] == sorted(r.id for r in ask.requirements(g, capability="billing").collect())
    assert h.list_services().count() == 0 and h.list_changes().count() == 3
    assert h.traceability("node:gone", require_validation=True).first().missing
    with pytest.raises(validate.GraphInvalid):
        GraphHandle.from_graph(Graph(g.nodes.limit(1), g.edges, g.evidence), require_validation=True)


def test_merge_is_biased_to_the_right_and_idempotent(extracted):
    g = extracted[0]
    new = Graph(g.nodes.withColumn("name", F.concat(F.lit("new "), "name")), g.edges.limit(0), g.evidence.limit(0))
    m = merge.merge(g, new)
    assert m.nodes.where("name not like 'new %'").count() == 0 and m.nodes.count() == g.nodes.count()
    first = {r.id: r.ord for r in g.nodes.collect()}
    assert {r.id: r.ord for r in m.nodes.collect()} == first
    assert merge.counts(merge.merge(m, new)).first() == merge.counts(m).first() == merge.counts(g).first()


def test_store(spark, extracted, tmp_path):
    folder = str(tmp_path / "store")
    assert store.read(spark, folder).nodes.count() == 0 and not (tmp_path / "store").exists()
    g = extracted[0]
    assert merge.counts(store.write(g, folder)).first() == merge.counts(g).first() == merge.counts(store.write(g, folder)).first()
    token = Graph(g.nodes.limit(1).withColumn("props", props(nested__token=F.lit("x"))), g.edges, g.evidence)
    with pytest.raises(store.StoreError):
        store.write(token, folder)
    blank = Graph(g.nodes.limit(1).withColumn("name", F.lit(" ")), g.edges, g.evidence)
    with pytest.raises(store.StoreError):
        store.write(blank, folder)
    record = store.export(g).where("table = 'edges'").first().record
    assert record.index('"evidence_ids"') < record.index('"id"') < record.index('"kind"')


def test_build(extracted, tmp_path):
    done = build(extracted[0], str(tmp_path / "s"))
    a, b = merge.counts(done.stored).first(), merge.counts(done.graph).first()
    assert b.edge_count == a.edge_count + 3 and b.node_count == a.node_count


def test_components(spark):
    r = random.Random(1)
    edges = [(f"v{i}", f"v{i + 1}") for i in range(200) if i % 23] + [("hub", f"h{i}") for i in range(300)] + [(f"x{r.randrange(80)}", f"x{r.randrange(80)}") for _ in range(60)] + [("s", "s"), (None, "n")]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a string, b string").repartition(7)
    for finish in (0, 40, 10**6):
        assert {x.v: x.component for x in connected_components(df, finish=finish).collect()} == {v: root(v) for v in up}
        assert connected_components(df.limit(0), finish=finish).count() == 0
    numbers = spark.createDataFrame([(5, 3), (3, 9), (7, 8)], "a long, b long")
    assert sorted(map(tuple, connected_components(numbers, finish=9).collect())) == [(3, 3), (5, 3), (7, 7), (8, 7), (9, 3)]


YAML = """version: 1
workspace: {id: pay, name: Pay}
layout: {root_path: ., openlore_path: kg}
engineering_kg: {enabled: true, store_repository: reqs}
openlore: {federation_enabled: true, freshness_policy: any}
repositories:
  - {id: reqs, path: reqs, description: d, ssh_url: "git@h:x", default_branch: main, role: requirements, exploration: {include_by_default: true, search_exclusions: []}, git: {dirty_worktree: skip, fetch: allowed, pull: forbidden, pull_requires_default_branch: true}, openlore: {include_in_federation: true, index_location: idx}}
  - {id: pay-service, path: svc/../svc/pay, description: d, ssh_url: "ssh://h/x", default_branch: main, role: code, exploration: {include_by_default: true, search_exclusions: []}, git: {dirty_worktree: skip, fetch: allowed, pull: forbidden, pull_requires_default_branch: true}, service: {id: pay-service, name: Pay}, openlore: {include_in_federation: false}}
"""


def test_registry(spark):
    bad = YAML.replace("path: svc/../svc/pay", "path: reqs/inner").replace("role: requirements", "role: test").replace("git@h:x", "http://h").replace("version: 1", "version: 2").replace("freshness_policy: any", "jira_data: {a: 1}").replace("id: pay,", "id: bad,").replace("openlore_path: kg", "openlore_path: ../bad/reqs/kg")
    out = YAML.replace("openlore_path: kg", "openlore_path: ../elsewhere").replace("id: pay,", "id: out,")
    files = spark.createDataFrame([("/out/repo-index.yaml", out), ("/ws/repo-index.yaml", YAML), ("/bad/repo-index.yaml", bad), ("/none/repo-index.yaml", "- a list")], "path string, value string")
    w, r, keys = registry.from_yaml(files)
    w = w.where("workspace_id is not null")
    g = registry.facts(w.where("workspace_id = 'pay'"), r.where("workspace_id = 'pay'"), empty_graph(spark).evidence)
    assert merge.counts(g).first().asDict() == {"node_count": 4, "edge_count": 3, "evidence_count": 0}
    assert {x.resolved_path for x in r.where("workspace_id = 'pay'").collect()} == {"/ws/reqs", "/ws/svc/pay"}
    broken = {(x.workspace_id, x.rule) for x in registry.violations(w, r, keys).collect()}
    assert not [x for x in broken if x[0] == "pay"]
    assert {x[1] for x in broken if x[0] == "out"} == {"outside_root"}
    assert {x[1] for x in broken if x[0] == "bad"} == {"version", "ssh_url", "store_repository", "inside_store", "generated_path", "forbidden"}
    assert [tuple(x) for x in registry.federation(w, r).where("workspace_id = 'pay'").collect()] == [("pay", "reqs", "/ws/reqs/idx")]
    stores, faulty = registry.known_stores(spark.createDataFrame([("s1", None, "/ws/reqs", None), (None, "s2", None, "/ws/reqs"), ("s3", None, None, " ")], "id string, name string, root string, location string"))
    assert stores.count() == 2 and faulty.count() == 1
    assert {(x.workspace_id, x.state) for x in registry.matched_stores(r, stores).collect()} == {("pay", "ambiguous"), ("out", "missing")}
    asked = spark.createDataFrame([("pay", "s1")], "workspace_id string, store_id string")
    assert registry.matched_stores(r, stores, asked).first().state == "used"


def test_stream_of_nodes(spark, extracted, tmp_path):
    from tracelake.streaming.facts import merge_nodes

    nodes = extracted[0].nodes
    nodes.where("kind = 'openspec-spec'").write.json(str(tmp_path / "in"))
    for _ in range(2):
        merge_nodes(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "progress")).awaitTermination()
    assert store.read(spark, str(tmp_path / "store")).nodes.count() == nodes.where("kind = 'openspec-spec'").count()


def test_workspace_edges_do_not_conduct(spark, extracted):
    g = extracted[0]
    w = spark.createDataFrame([("pay",)], "workspace_id string").select("workspace_id", F.col("workspace_id").alias("name"))
    r = spark.createDataFrame([("pay", "a", None, None), ("pay", "b", "svc", None)], "workspace_id string, id string, service_id string, service_name string")
    joined = merge.concatenated(registry.facts(w, r, g.evidence), g)
    found = {x.id: x.component for x in reach.labels(joined).collect()}
    owns = joined.edges.where("kind = 'owns'").first()
    assert found[owns.source_id] == found[owns.target_id] and joined.edges.where("kind = 'contains'").first().source_id not in found


def test_registry_defaults(spark):
    """Unset keys have their defaults, repositories lie below the registry's folder, missing and mistyped keys are told."""
    least = """version: 1
workspace: {name: Least}
layout: {root_path: ws}
repositories:
  - {id: requirements, path: repos/a, description: d, ssh_url: "git@h:x", default_branch: main, role: requirements, exploration: {include_by_default: true, search_exclusions: []}, git: {dirty_worktree: skip, fetch: allowed, pull: forbidden, pull_requires_default_branch: true}, openlore: {include_in_federation: true, index_location: idx}}
"""
    bare = least.replace("Least", "Bare").replace("description: d, ", "").replace("fetch: allowed, ", "").replace("include_by_default: true", "include_by_default: often").replace("id: requirements", "id: other")
    inside = least.replace("Least", "Inside").replace("path: repos/a", "path: ws/.engineering-kg")
    files = spark.createDataFrame([("/base/repo-index.yaml", least), ("/bare/repo-index.yaml", bare), ("/in/repo-index.yaml", inside)], "path string, value string")
    w, r, keys = registry.from_yaml(files)
    row = w.where("name = 'Least'").first()
    assert (row.enabled, row.federation_enabled, row.store_repository, row.openlore_path) == (True, True, "requirements", ".openlore")
    assert r.where("workspace_id = 'Least'").first().resolved_path == "/base/repos/a"
    found = {(x.workspace_id, x.rule, x.object, x.detail) for x in registry.violations(w, r, keys).collect()}
    assert found == {
        ("Bare", "required", "other", "description"), ("Bare", "required", "other", "fetch"), ("Bare", "required", "other", "include_by_default"),
        ("Bare", "store_repository", "requirements", "unknown"), ("Inside", "generated_path", "output_path", "requirements"),
    }
    assert registry.federation(w, r).count() == 3


@pytest.mark.parametrize("front, title, related", [
    ("title: 2024", "a", []), ("title: true", "a", []), ("title: 2026-08-01", "a", []), ("title: '2024'", "2024", []), ("title: ' Foo '\nrelated: 5", "Foo", []),
    ("related: [1, Foo, ' ', null]", "a", ["Foo"]), ("related: '[Draft] Foo'", "a", ["[Draft] Foo"]), ("related: Foo", "a", ["Foo"]), ("title: [broken", "a", []),
])
def test_frontmatter_types(spark, front, title, related):
    files = spark.createDataFrame([("openspec/specs/a/spec.md", f"---\n{front}\n---\n### Requirement: R")], "path string, value string")
    row = specs.parsed(specs.placed(files)).first()
    assert (row.title, row.related) == (title, related)
    assert specs.bad_frontmatter(files).count() == (front == "title: [broken")


def test_frontmatter_keeps_types(spark):
    """A number and a text with the same digits are different properties."""
    made = [(f"openspec/specs/{n}/spec.md", f"---\nrepo: {v}\n---\n") for n, v in (("a", "1"), ("b", "'1'"), ("c", "true"), ("d", "{k: 1}"))]
    g = specs.spec_facts(specs.parsed(specs.placed(spark.createDataFrame(made, "path string, value string"))))
    repo = {x.capability: {k: v for k, v in x.props.items() if k.startswith("/frontmatter/repo")} for x in g.nodes.collect()}
    assert repo == {"a": {"/frontmatter/repo": "1"}, "b": {"/frontmatter/repo": '"1"'}, "c": {"/frontmatter/repo": "true"}, "d": {"/frontmatter/repo/k": "1"}}


@pytest.mark.parametrize("keys, kind", [
    (["repository", "revision", "file", "symbol"], "code"), (["repository", "file", "symbol"], None), (["repository", "revision", "file", "symbol", "line_start"], None),
    ([*store.OPENSPEC], "openspec"), ([*store.OPENSPEC, "extra"], "openspec"), (["page_id"], "page"), (["page_id", "text"], None), (["text"], "text"),
])
def test_locator_kinds(spark, keys, kind):
    assert value(spark, store.locator_kind(F.array(*map(F.lit, keys)))) == kind
