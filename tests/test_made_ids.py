"""Ids made once and read again, and ids of clean texts."""

from pyspark.sql import functions as F

from tracelake.functions.ids import clean, clean_parts, code, decoded, stable_id
from tracelake.operators import ask, derive, reach, validate
from tracelake.plans import fixture_graph as fg, queries
from tracelake.plans.job import build
from tracelake.schema import CHANGE_TRACES_TO_SPEC, CHANGES, Graph
from tracelake.sources import specs

SF = "/root/testdata/sf0.001"
TEXTS = ["a", "A b", "Brand#1/rare", "É x", " a", "a ", "a  b", "a\tb", "a\u00a0b", "x\u2003y", "a\x1fb", "", None]


def test_clean_texts_have_the_same_ids(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    told = {r.t: r.c for r in rows.select("t", clean(F.col("t")).alias("c")).collect()}
    assert [t for t in TEXTS if told[t]] == ["a", "A b", "Brand#1/rare", "É x", None]
    parts = ("openspec", F.col("t"), F.concat(F.lit("ORD-"), "t", F.lit("/x")))
    with clean_parts():
        short = stable_id("node", *parts)
    assert rows.where(clean(F.col("t"))).where(short != stable_id("node", *parts)).isEmpty()


def test_codes_differ_where_texts_do(spark):
    digits = "0123456789abcdef"
    texts = ["", digits, "node:" + digits, "edge:" + digits, "node:" + digits.upper(), "node:" + digits[:-1] + "g", "node:" + digits + "\n", "node:", "\x01", "é" + digits]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.select(code(F.col("t"))).distinct().count() == len(texts)


def test_made_ids_are_those_of_the_records(spark):
    bare, made = fg.graph(spark, SF), fg.graph(spark, SF, with_implements=False, made=specs.MADE)
    for a, b in zip(bare, made, strict=True):
        hashed = lambda df: sorted(tuple(r) for r in df.select(F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns if c != "props"], F.to_json("props"))).collect())
        assert hashed(a) == hashed(b)


def test_every_reference_and_end_is_looked_up(spark):
    rows = spark.range(10)
    text = F.col("id").cast("string")
    proofs = F.when(text == "3", F.array()).when(text == "4", F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), text, text)).cast("array<string>")
    owner = rows.select(F.concat(F.lit("n"), text).alias("id"), proofs.alias("evidence_ids"))
    ends = rows.select(F.concat(F.lit("e"), text).alias("id"), text.alias("source_id"), F.when(text != "5", text).alias("target_id"), F.array().cast("array<string>").alias("evidence_ids"))
    there = rows.where("id not in (3, 7)").select(text.alias("id")).unionByName(spark.createDataFrame([("x",)], "id string"))
    found = validate.missing_evidence(Graph(owner, ends.limit(0), there))
    assert [r.affected_object_id for r in found.collect()] == ["n7", "n7"]
    found = validate.missing_ends(Graph(there, ends, there))
    assert sorted((r.rule_id, r.affected_object_id) for r in found.collect()) == [
        ("edge-source-exists", "e3"), ("edge-source-exists", "e7"), ("edge-target-exists", "e3"), ("edge-target-exists", "e5"), ("edge-target-exists", "e7")]


def test_codes_lead_back_to_their_texts(spark):
    digits = "0123456789abcdef"
    texts = ["", digits, "node:" + digits, "node:" + digits.upper(), "node:" + digits + "\n", "\x01", "é" + digits, "ж", "a\x00", digits + "\x01"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~decoded(code(F.col("t"))).eqNullSafe(F.col("t"))).isEmpty()


def test_derived_edges_carry_properties_only_where_they_are_shown(spark):
    bare, shown = queries.full(spark, SF, evidence=False), queries.full(spark, SF, evidence=False, shown=True)
    of = F.col("kind") == CHANGE_TRACES_TO_SPEC
    assert bare.edges.where(of & (F.size("props") > 0)).isEmpty() and shown.edges.where(of & (F.size("props") != 6)).isEmpty()
    assert sorted(r.id for r in bare.edges.where(of).select("id").collect()) == sorted(r.id for r in shown.edges.where(of).select("id").collect())


def test_a_built_graph_reads_the_records_of_the_store(spark, tmp_path):
    folder = str(tmp_path / "s")
    facts = fg.graph(spark, "/root/testdata/sf0.001", made=specs.MADE)
    done = build(facts, folder, check=False, written=True)
    for df in (done.graph.nodes, done.graph.evidence, done.stored.edges):
        assert all(folder in f for f in df.inputFiles())
    assert done.graph.edges.count() == done.stored.edges.count() + derive.derived_edges(done.stored).select("id").distinct().count()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(done.diagnostics) == rows(validate.diagnostics(done.graph))


def test_two_filters_share_their_labels(spark, monkeypatch):
    node = lambda id, kind, name, capability=None: (id, kind, name, capability)
    nodes = spark.createDataFrame([node("c", CHANGES[0], "C"), node("s", "openspec-spec", "s", "cap"), node("r", "openspec-requirement", "r"), node("q", "openspec-requirement", "q", "cap")], "id string, kind string, name string, capability string")
    edges = spark.createDataFrame([("k", "c", "s"), ("k", "s", "r")], "kind string, source_id string, target_id string")
    calls, label = [], reach.contracted
    monkeypatch.setattr(reach, "FEW_SEEDS", 0)
    monkeypatch.setattr(reach, "contracted", lambda *a: calls.append(a) or label(*a))
    got = ask.requirements(Graph(nodes, edges, nodes.limit(0)), capability="cap", change="C", merged=True, shown=False)
    assert [r.id for r in got.collect()] == ["r"] and len(calls) == 1
