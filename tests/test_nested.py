"""Nested YAML values as leaves: the guard of the store, what is shown, and canonical content."""

import pytest
from pyspark.sql import functions as F

from tracelake.functions.props import NOT_SHOWN, NOT_STORED, has_any, without
from tracelake.operators import validate
from tracelake.schema import Graph, empty_graph
from tracelake.sources import registry, specs, store
from tracelake.sources.trees import leaves, tree


def spec_nodes(spark, *fronts):
    rows = [(f"openspec/specs/s{i}/spec.md", f"---\n{f}\n---\n### Requirement: R") for i, f in enumerate(fronts)]
    return specs.spec_facts(specs.parsed(specs.placed(spark.createDataFrame(rows, "path string, value string"))))


@pytest.mark.parametrize("front, path", [
    ("repo: {token: abc}", "/frontmatter/repo/token"), ("repo:\n  a:\n  - b: [{c: {credentials: []}}]", "/frontmatter/repo/a/[0]/b/[0]/c/credentials"),
    ("related: [A, {url: x}]", "/frontmatter/related/[1]/url"), ("created: {1: {content: null}}", "/frontmatter/created/1/content"),
])
def test_forbidden_at_any_depth(spark, tmp_path, front, path):
    g = spec_nodes(spark, front, "repo: fine")
    assert [r.path for r in store.forbidden(g).collect()] == [path]
    with pytest.raises(store.StoreError, match=path.replace("[", "\\[").replace("]", "\\]")):
        store.write(g, str(tmp_path / "s"))
    shown = g.nodes.select(F.explode(F.map_keys(without(F.col("props"), NOT_SHOWN))).alias("k"))
    assert path not in {r.k for r in shown.collect()}


def test_names_with_slashes_are_whole_names(spark):
    g = spec_nodes(spark, "repo: {a/token: 1, ~token: 2, tokens_used: 3}")
    assert g.nodes.where(has_any(F.col("props"), NOT_STORED)).count() == 0
    assert {k: v for k, v in g.nodes.first().props.items() if "repo/" in k} == {"/frontmatter/repo/a~1token": "1", "/frontmatter/repo/~0token": "2", "/frontmatter/repo/tokens_used": "3"}


def test_order_of_keys_is_no_conflict(spark):
    a, b = spec_nodes(spark, "repo: {a: 1, b: {c: x, d: [1, 2]}}"), spec_nodes(spark, "repo:\n  b: {d: [1, 2], c: x}\n  a: 1")
    assert validate.conflicts(a.nodes.unionByName(b.nodes), "node").count() == 0
    c = spec_nodes(spark, "repo: {a: 1, b: {c: x, d: [2, 1]}}")
    assert validate.conflicts(a.nodes.unionByName(c.nodes), "node").count() == 1


def test_odd_yaml(spark):
    deep = "a: " + "[" * 5000 + "]" * 5000
    texts = {
        "dates": "repo: {2026-08-01: 2026-08-02, k: 2026-08-01 10:00:00}", "keys": "{1: a, '1': b, null: c, false: d}", "empty": "repo: {}\nrelated: []", "null": "repo: ~",
        "list": "- a", "text": "only text", "none": "", "broken": "a: [b", "tab": "\tx: 1", "deep": deep, "endless": "a: &x [*x]", "bad date": "a: 2026-13-45", "set": "a: !!set {x, y}", "object": "a: !!python/object:os.system {}",
    }
    rows = spark.createDataFrame(list(texts.items()), "name string, text string").select("name", tree(F.col("text")).alias("t")).collect()
    got = {r.name: r.t for r in rows}
    said = {n: {x.path: x.value for x in t.leaves} for n, t in got.items()}
    assert said["dates"] == {"/repo/2026-08-01": '"2026-08-02"', "/repo/k": '"2026-08-01 10:00:00"'} and not any(x.text for x in got["dates"].leaves)
    assert said["keys"] == {"/1": '"b"', "/None": '"c"', "/False": '"d"'}
    assert said["empty"] == {"/repo": "{}", "/related": "[]"} and said["null"] == {"/repo": "null"}
    assert [n for n, t in got.items() if not t.ok] == ["broken", "tab", "deep", "endless", "bad date", "object"]
    assert not got["list"].is_mapping and not got["text"].is_mapping and not got["none"].is_mapping and got["list"].ok
    assert [p for p, _, _ in leaves({"b": [1, {"z": 2}], "a": {}})] == ["/a", "/b/[0]", "/b/[1]/z"]


def test_a_broken_registry_is_a_row(spark):
    good = "version: 1\nworkspace: {id: w}\nrepositories:\n- {id: r, path: p, jira_data: {issues: [1]}, x: {url: {architecture: []}}}\n"
    files = spark.createDataFrame([("/a/r.yaml", good), ("/b/r.yaml", "a: [b"), ("/c/r.yaml", "- x"), ("/d/r.yaml", "version: 1"), ("/e/r.yaml", None)], "path string, value string")
    w, r, keys = registry.from_yaml(files)
    assert {x.workspace_id for x in w.collect()} == {"w", "/d/r.yaml"} and [x.id for x in r.collect()] == ["r"]
    told = registry.violations(w, r, keys).where("rule = 'forbidden'").collect()
    assert sorted(x.object for x in told) == ["/repositories/[0]/jira_data/issues/[0]", "/repositories/[0]/x/url/architecture"]
    bad = {x.affected_object_id: x.message for x in registry.unreadable(files).collect()}
    assert bad == {"/b/r.yaml": "Workspace registry is not valid YAML", "/c/r.yaml": "Workspace registry must be a mapping", "/e/r.yaml": "Workspace registry must be a mapping"}


def test_guard_covers_all_tables(spark):
    g = empty_graph(spark)
    edge = spark.createDataFrame([("e", "k", "a", "b", {"/x/[0]/tokens": "1"}, [], None, None)], g.edges.schema)
    proof = spark.createDataFrame([("v", "s", None, {"/attachments": "[]"}, None)], g.evidence.schema)
    assert {r.path for r in store.forbidden(Graph(g.nodes, edge, proof)).collect()} == {"/x/[0]/tokens", "/attachments"}
