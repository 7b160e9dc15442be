"""Ways that must agree: one pass and rule by rule, search and labels, labels kept up and from scratch, checks in the write."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracelake.handle import GraphHandle
from tracelake.operators import ask, derive, reach, validate
from tracelake.operators.components import connected_components, extended, relabelled
from tracelake.schema import EVIDENCE_SCHEMA, Graph, empty_graph
from tracelake.sources import store

NODE = "id string, kind string, name string, capability string, scope string, change_identity string, openspec_identity string, props map<string,string>, evidence_ids array<string>, ord struct<batch:int,phase:int,path:array<string>,seq:int>"
EDGE = "id string, kind string, source_id string, target_id string, props map<string,string>, evidence_ids array<string>, confidence string, ord struct<batch:int,phase:int,path:array<string>,seq:int>"


def rough(spark, seed, n=60):
    """A graph with every fault: dangling ends and evidence, repeats, conflicts, trace edges of all shapes, related titles."""
    r = random.Random(seed)
    kinds = ["openspec-spec", "openspec-active-change", "openspec-archived-change", "workspace", "service", "openspec-requirement"]
    at = lambda: (0, 0, [str(r.randrange(99))], r.randrange(9))
    node = lambda i: (f"n{i}", r.choice(kinds), f"name {i % 7}", r.choice(["a", "b", None]), r.choice(["durable", "active-change", None]), None, None,
                      r.choice([{}, {"/frontmatter/related/[0]": '" T1 "', "/frontmatter/related/[1]": "5"}, {"/frontmatter/related": '"T2"'}, {"/x": "1"}]), r.choice([[], ["v1"], ["v2", "gone"], None]), at())
    nodes = [node(r.randrange(n)) for _ in range(n)]
    nodes += nodes[:5]
    edge = lambda i: (f"e{i}", r.choice(["openspec-change-traces-to-spec", "openspec-related-spec", "openspec-change-touches-spec", "owns"]), r.choice([f"n{r.randrange(n + 9)}", None]), f"n{r.randrange(n + 9)}",
                      r.choice([{}, {"/related_title": '"T1"'}, {"/related_title": '"T2"'}]), r.choice([[], ["v1", "gone", "gone"]]), None, at())
    edges = [edge(r.randrange(n)) for _ in range(2 * n)]
    edges += edges[:9]
    proof = spark.createDataFrame([("v1", "s", None, {}, at()), ("v2", "s", None, {}, at()), ("v2", "other", None, {}, at())], EVIDENCE_SCHEMA)
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), proof)


@pytest.mark.parametrize("seed", range(3))
def test_one_pass_equals_rule_by_rule(spark, seed):
    g = rough(spark, seed).map(lambda df: df.cache())
    got, want = (sorted(map(tuple, x.collect()), key=repr) for x in (validate.diagnostics(g), validate.one_by_one(g)))
    assert got == want and len({x[1] for x in got}) == 7


def test_one_pass_of_an_empty_graph(spark):
    assert validate.diagnostics(empty_graph(spark)).count() == 0


@pytest.mark.parametrize("rounds", [1, 2, 12])
def test_search_equals_labels(spark, rounds):
    r = random.Random(rounds)
    ids = [f"c{i}" for i in range(40)] + [f"x{i}" for i in range(30)] + ["alone", "w"]
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(39)] + [(f"x{r.randrange(30)}", f"x{r.randrange(30)}") for _ in range(25)] + [("w", "c0"), ("x1", "w"), ("ghost", "x2"), ("ghost", "c3")]
    nodes = spark.createDataFrame([(i, "workspace" if i == "w" else "service") for i in ids], "id string, kind string")
    g = Graph(nodes, spark.createDataFrame(pairs, "source_id string, target_id string"), None)
    found = {x.id: x.component for x in reach.labels(g).collect()}
    label = lambda i: found.get(i, i)
    for seeds in (["c20"], ["x5", "alone"], ["w"], ["ghost"], [], [None, "c39"]):
        got = [x.id for x in reach.reached(g, spark.createDataFrame([(s,) for s in seeds], "id string"), rounds).collect()]
        want = {i for i in {*ids, "ghost"} for s in seeds if s is not None and label(i) == label(s)}
        assert len(got) == len(set(got)) and set(got) == want


def test_labels_kept_up(spark):
    r = random.Random(5)
    edges = [(f"v{r.randrange(60):02}", f"v{r.randrange(60):02}") for _ in range(70)] + [("a0", "v59"), ("v03", "zz"), ("new1", "new2"), ("new2", "new3"), ("s", "s")]
    r.shuffle(edges)
    labels = connected_components(spark.createDataFrame(edges[:25], "a string, b string"))
    for k in range(25, len(edges), 17):
        changed = extended(labels, spark.createDataFrame(edges[k : k + 17], "a string, b string"))
        before = {x.v: x.component for x in labels.collect()}
        assert all(before.get(x.v) != x.component for x in changed.collect())
        labels = relabelled(labels, changed)
    want = connected_components(spark.createDataFrame(edges, "a string, b string"))
    assert sorted(map(tuple, labels.select("v", "component").collect())) == sorted(map(tuple, want.collect()))


def test_a_bad_write_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "s")
    g = empty_graph(spark)
    row = lambda i, props=None, name="x": (i, "service", name, None, None, None, None, props or {}, [], (0, 0, ["a"], 0))
    store.write(Graph(spark.createDataFrame([row("a")], NODE), g.edges, g.evidence), folder)
    kept = set(os.listdir(f"{folder}/data"))
    bad = spark.createDataFrame([row("b"), row("c", {"/p/[0]/token": "1"}), row("d", {"/url": "1"})], NODE)
    with pytest.raises(store.StoreError, match=r"c holds /p/\[0\]/token \(2 records\)"):
        store.write(Graph(bad, g.edges, g.evidence), folder)
    with pytest.raises(store.StoreError, match="nodes e: name is blank"):
        store.write(Graph(spark.createDataFrame([row("e", name=" ")], NODE), g.edges, g.evidence), folder)
    assert [r.id for r in store.read(spark, folder).nodes.collect()] == ["a"] and set(os.listdir(f"{folder}/data")) == kept
    proof = lambda **of: spark.createDataFrame([("v", "s", {"loc_type": "x", **of}, {}, (0, 0, ["a"], 0))], EVIDENCE_SCHEMA)
    for of in ({}, {"text": "t", "page_id": "p"}, {"file": "f", "symbol": "s"}):
        with pytest.raises(store.StoreError, match="Unsupported evidence locator shape"):
            store.write(Graph(g.nodes, g.edges, proof(**of)), folder)
    store.write(Graph(g.nodes, g.edges, proof(page_id="p")), folder)
    assert store.read(spark, folder).evidence.first().locator.page_id == "p"


def test_an_unknown_shape_is_an_error_when_read(spark, tmp_path):
    folder = str(tmp_path / "s")
    g = empty_graph(spark)
    store.write(Graph(g.nodes, g.edges, spark.createDataFrame([("v", "s", {"text": "t"}, {}, (0, 0, ["a"], 0))], EVIDENCE_SCHEMA)), folder)
    (_, part), name = next(iter(store.current(spark, folder)[1].items()))
    odd = spark.createDataFrame([("w", "s", {"text": "t", "page_id": "p"}, {}, None)], EVIDENCE_SCHEMA)
    odd.write.mode("append").parquet(f"{folder}/data/{name}/evidence/part={part}")
    assert store.read(spark, folder).evidence.select("id").count() == 2
    with pytest.raises(Exception, match="Unsupported evidence locator shape: text, page_id"):
        store.read(spark, folder).evidence.select("locator").collect()


def test_counts_beside_the_derivation(spark):
    g = rough(spark, 11, 90)
    g = Graph(g.nodes.where("capability is not null"), g.edges.withColumn("kind", F.lit("openspec-change-touches-spec")), g.evidence).map(lambda df: df.cache())
    done = derive.run(g)
    assert done.derived_edge_count == done.edges.count() == derive.derived_edges(g).count()
    assert done.skipped_input_count == done.diagnostics.count() and sorted(map(tuple, done.diagnostics.collect())) == sorted(map(tuple, derive.diagnostics(g).collect()))


def test_diagnostics_handed_in_are_not_checked(spark, tmp_path):
    folder = str(tmp_path / "s")
    g = empty_graph(spark)
    edge = spark.createDataFrame([("e", "owns", "a", "b", {}, [], None, (0, 0, ["a"], 0))], EDGE)
    store.write(Graph(g.nodes, edge, g.evidence), folder)
    with pytest.raises(validate.GraphInvalid):
        GraphHandle.from_store(spark, folder, require_validation=True)
    told = validate.diagnostics(g)
    assert GraphHandle.from_store(spark, folder, require_validation=True, diagnostics=told).diagnostics() is told


def test_places_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(9)
    got = sorted(map(tuple, ask.numbered(df.orderBy("k")).select("k", "position").collect()))
    assert [p for _, p in got] == list(range(5000))


def _bytes(folder):
    return {os.path.join(at, n): os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(f"{folder}/data") for n in names if n.endswith(".parquet")}


def test_a_small_batch_rewrites_the_parts_it_touches(spark, tmp_path):
    folder, none = str(tmp_path / "s"), empty_graph(spark)
    rows = [(f"n{i}", "service", f"name {i}", None, None, None, None, {"/x": str(i)}, [], (0, 0, [str(i)], 0)) for i in range(4000)]
    store.write(Graph(spark.createDataFrame(rows, NODE), none.edges, none.evidence), folder)
    first = _bytes(folder)
    late = [("n7", "service", "new", None, None, None, None, {}, [], (0, 0, ["z"], 0)), ("other", "service", "o", None, None, None, None, {}, [], (0, 0, ["y"], 0))]
    store.write(Graph(spark.createDataFrame(late, NODE), none.edges, none.evidence), folder)
    added = {p: n for p, n in _bytes(folder).items() if p not in first}
    assert set(first) <= set(_bytes(folder)) and sum(added.values()) < sum(first.values()) / 16
    got = {r.id: (r.name, r.ord.batch, r.ord.path) for r in store.read(spark, folder).nodes.collect()}
    assert len(got) == 4001 and got["n7"] == ("new", 0, ["7"]) and got["other"] == ("o", 1, ["y"]) and got["n8"][0] == "name 8"
    store.write(none, folder)
    assert store.current(spark, folder)[0] == 2 and store.read(spark, folder).nodes.count() == 4001 and not set(_bytes(folder)) - set(first) - set(added)
