"""What steps move and how they share out their work, beside their results."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tracelake.llm import ngram_join
from tracelake.operators import ask, derive, merge, reach, validate
from tracelake.functions.ids import code
from tracelake.operators.components import connected_components
from tracelake.plans import files, fixture_graph as fg, queries
from tracelake.schema import CHANGES, SPEC, Graph
from tracelake.sources import adjacency, store_tree
from tracelake.sources.shared import cut, shared_dir

SF = "/root/testdata/sf0.001"


def shuffled(spark, run):
    """What run() returns, and the bytes that its stages shuffled."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    old = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in old)


def test_merged_shuffles_no_whole_records(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("node:"), F.when(F.col("id") < 3, 7).otherwise(F.col("id")).cast("string")).alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("text"),
                                      F.struct(F.lit(0).alias("batch"), F.lit(0).alias("phase"), F.array(F.col("id").cast("string")).alias("path"), F.lit(0).alias("seq")).alias("ord"))
    got, n = shuffled(spark, lambda: sorted(map(tuple, merge.merged(rows).collect())))
    want, m = shuffled(spark, lambda: sorted(map(tuple, merge.last_wins(rows).collect())))
    assert got == want and n < m / 4


def test_without_target_keeps_null_and_repeated_keys(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "c")], "id int, key string")
    ids = spark.createDataFrame([("a",), ("c",)], "id string")
    assert sorted(r.id for r in merge.without_target(refs, "key", ids).collect()) == [2, 3, 4]


def test_numbered_moves_rows_once(spark):
    df = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 512).alias("k"))
    _, sort = shuffled(spark, lambda: cut(df.orderBy("k")))
    got, n = shuffled(spark, lambda: ask.numbered(df.orderBy("k")).orderBy("position").collect())
    assert [r.position for r in got] == list(range(20_000)) and [r.k for r in got] == sorted(r.k for r in got)
    _, n = shuffled(spark, lambda: cut(ask.numbered(df.orderBy("k"))))
    assert n < 1.2 * sort + 10_000


@pytest.mark.parametrize("ids", [["node:00000000000000ff", "node:8000000000000000", "node:7fffffffffffffff", "node:fffffffffffffffe"], ["node:00000000000000ff", "x", "node:8000000000000000", "node:0"]])
def test_components_of_stable_ids_and_others(spark, ids):
    edges = spark.createDataFrame([(ids[0], ids[1]), (ids[1], ids[2]), (ids[3], ids[3])], "a string, b string")
    assert {(r.v, r.component) for r in connected_components(edges).collect()} == {(v, min(ids[:3])) for v in ids[:3]}


def test_cut_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files_of = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    old = files_of()
    written = cut(spark.range(5_000).groupBy(F.col("id") % 1_000).count())
    assert not files_of() - old and written.count() == 1_000


def test_components_leave_one_table(spark):
    edges = spark.range(3_000).select(F.format_string("node:%016x", "id").alias("a"), F.format_string("node:%016x", F.floor(F.col("id") / 2)).alias("b"))
    tables = lambda: {f for f in os.listdir(shared_dir(spark)) if f.startswith("cut-")}
    old = tables()
    assert {r.component for r in connected_components(edges).collect()} == {"node:" + 16 * "0"} and len(tables() - old) == 1


def test_reach_of_seeds_without_an_edge(spark):
    nodes = spark.createDataFrame([(i, "k") for i in ("node:00000000000000ff", "node:8000000000000000", "node:0000000000000001", "x", "y")], "id string, kind string")
    edges = spark.createDataFrame([("node:00000000000000ff", "node:8000000000000000")], "source_id string, target_id string")
    seeds = spark.createDataFrame([("node:8000000000000000",), ("node:0000000000000001",), ("x",), (None,)], "id string")
    g = Graph(nodes, edges, nodes.limit(0))
    want = ["node:0000000000000001", "node:00000000000000ff", "node:8000000000000000", "x"]
    for rounds in (0, 5):
        assert sorted(r.id for r in reach.within_reach(nodes, g, seeds, rounds).collect()) == want


def test_ends_are_those_of_all_edges(spark):
    pair = lambda g: {tuple(r) for r in g.edges.select("kind", "source_id", "target_id").collect()}
    assert pair(queries.ends(spark, SF)) == pair(queries.full(spark, SF, evidence=False))


def test_tasks_of_order_joins_grow_with_the_lines(spark, monkeypatch):
    want = sorted(map(tuple, fg.order_capabilities(spark, SF, fg.ordered_parts(spark, SF)).collect()))
    monkeypatch.setattr(fg, "LINES_A_TASK", 100)
    monkeypatch.setattr(fg, "FEW_PARTS", 10)
    got = fg.order_capabilities(spark, SF, fg.ordered_parts(spark, SF))
    assert sorted(map(tuple, got.collect())) == want
    assert got.groupBy(F.spark_partition_id()).count().count() > 8


def test_an_index_of_changes_moves_no_other_edge(spark):
    few = queries.full(spark, SF, evidence=False, of_changes=True).edges
    every = queries.full(spark, SF, evidence=False).edges.where(F.col("kind").isin(*queries._OF_CHANGES))
    row = lambda df: sorted(map(tuple, df.select("id", "kind", "source_id", "target_id").collect()))
    assert row(few) == row(every)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files_of = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    old = files_of()
    adjacency.detach(adjacency.write(few, f"{shared_dir(spark)}/adjacency-{uuid.uuid4().hex}"))
    assert not files_of() - old


def test_without_target_moves_codes(spark):
    ids = spark.range(20_000).select(F.concat(F.lit("node:"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16)).alias("id"))
    refs = ids.withColumnRenamed("id", "key")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got, n = shuffled(spark, lambda: merge.without_target(refs, "key", ids).count())
        _, m = shuffled(spark, lambda: cut(refs.distinct().join(ids.withColumnRenamed("id", "key"), "key", "left_anti")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == 0 and n < 0.8 * m
    texts = ["", "a", "0123456789abcdef", "node:0123456789abcdef", "node:0123456789ABCDEF", "node:0123456789abcdef\n", "\u00e9:0123456789abcdef", "nod:e0123456789abcdef", "\x010123456789abcdef"]
    df = spark.createDataFrame([(t,) for t in texts], "id string")
    assert df.select(code(F.col("id"))).distinct().count() == len(texts)


def test_trace_shape_of_single_ids_finds_the_same(spark):
    g = queries.full(spark, SF, evidence=False)
    wrong = g.edges.withColumn("kind", F.when(F.col("kind").isin("openspec-change-touches-spec", "owns"), "openspec-change-traces-to-spec").otherwise(F.col("kind")))
    bad = Graph(g.nodes, wrong, g.evidence).map(cut)
    row = lambda df: sorted(map(tuple, df.collect()))
    want = row(validate.trace_shape(bad))
    assert want and row(validate._trace_shape_single(bad)) == want


def test_touching_holds_all_that_touch_edges_meet(spark):
    g, small = fg.graph(spark, SF), fg.touching(spark, SF)
    want = {r.id for r in g.nodes.where(F.col("kind").isin(SPEC, *CHANGES)).select("id").collect()}
    assert {r.id for r in small.nodes.select("id").collect()} == want


def test_a_wide_folder_is_shared_out(spark, tmp_path):
    for k in range(30):
        os.makedirs(tmp_path / "s/openspec/changes/archive" / f".c{k}/specs")
        (tmp_path / "s/openspec/changes/archive" / f".c{k}/specs/spec.md").write_text(f"text {k}")
    os.makedirs(tmp_path / "s/empty")
    root = str(tmp_path / "s")
    want = sorted(map(tuple, store_tree.tree(spark, root, "spec.md").collect()))
    by = store_tree.by_level(spark, root, "spec.md", each=5)
    assert sorted(map(tuple, by.collect())) == want == sorted(map(tuple, store_tree.by_level(spark, root, "spec.md", levels=2).collect()))
    deep = by.where("path like '%/specs'").select(F.input_file_name().alias("f")).distinct().count()
    assert deep > 1
    assert store_tree.by_level(spark, root + "/none").count() == 0


def test_texts_of_a_small_table_are_parsed_by_many_tasks_once(spark, monkeypatch):
    monkeypatch.setattr(files, "TEXTS_A_TASK", 20)
    nodes = files._nested(spark, SF).nodes
    assert nodes.select(F.input_file_name().alias("f")).distinct().count() > 1
    assert "ArrowEvalPython" not in nodes._jdf.queryExecution().toString()


def test_op3_packs_few_texts_at_once(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, ngram_join.jaccard_components(docs).collect()))
    monkeypatch.setattr(ngram_join, "TEXTS", 7)
    assert sorted(map(tuple, ngram_join.jaccard_components(docs).collect())) == want


def test_edges_are_numbered_by_their_ids_unwritten(spark):
    n = F.col("id")
    text = lambda kind, x=n: F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(x.cast("string"), 256), 1, 16))
    d = spark.range(20_000).select(
        text("edge", n % 19_990).alias("edge_id"), F.when(n % 5 == 0, "b").otherwise("a").alias("kind"), F.when(n % 7 == 0, "no id").when(n % 7 > 1, text("node")).alias("source_id"), text("node", n % 100).alias("target_id"),
        F.when(n % 3 > 0, text("evidence")).otherwise("").alias("evidence"), F.when(n % 4 > 0, text("evidence")).otherwise("").alias("known_evidence"))
    number = lambda of: ask.numbered_by_id(of, ask.EDGE_ORDER, {"edge_id": "edge:", "source_id": "node:", "target_id": "node:", "evidence": "evidence:"}, {"known_evidence": "evidence"})
    old = set(os.listdir(shared_dir(spark)))
    got, moved = shuffled(spark, lambda: number(d).collect())
    assert set(os.listdir(shared_dir(spark))) == old  # what numbered() writes is as long as the rows
    want, whole = shuffled(spark, lambda: ask.numbered(ask.in_edge_order(d)).orderBy("position").collect())
    assert got == want and moved < 0.6 * whole
    assert number(d.limit(0)).collect() == []
    other = d.withColumn("edge_id", F.when(F.col("kind") == "b", F.concat(F.lit("x"), "target_id", F.col("evidence"))).otherwise(F.col("edge_id"))).distinct()
    assert sorted(number(other).collect(), key=lambda r: r.position) == ask.numbered(ask.in_edge_order(other)).orderBy("position").collect()


def test_op3_hands_python_small_batches(spark, monkeypatch):
    def checked(batches):
        for b in batches:
            assert len(b) <= 1000
            yield b

    made, name = ngram_join.digests, "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(ngram_join, "digests", lambda d: made(d.mapInArrow(checked, d.schema)))
    docs = spark.range(3_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("one word more than "), (F.col("id") % 1_000).cast("string")).alias("text"))
    old = spark.conf.get(name)
    got = ngram_join.jaccard_components(docs).groupBy("component_id").count().collect()
    assert len(got) == 1_000 and {r["count"] for r in got} == {3} and spark.conf.get(name) == old


def test_touched_capabilities_are_those_of_orders(spark, tmp_path):
    want = fg.order_capabilities(spark, SF, fg.ordered_parts(spark, SF))
    assert sorted(map(str, fg.touched_capabilities(spark, SF).collect())) == sorted(map(str, want.collect()))
    d = str(tmp_path)
    spark.createDataFrame([(1, "P", "x"), (1, "O", "x"), (2, "F", None), (3, "F", None), (4, "F", "y")], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(o, p) for o in (1, 2, 3, 4, 5, None) for p in (1, 2, 2, 9)], "l_orderkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1, "a", "B#1", 1), (2, "b", "B#1", 50)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    want = fg.order_capabilities(spark, d, fg.ordered_parts(spark, d))
    assert sorted(map(str, fg.touched_capabilities(spark, d).collect())) == sorted(map(str, want.collect())) and want.count() == 6


def test_derive_diagnostics_are_not_written(spark):
    g = fg.touching(spark, SF)
    g = Graph(g.nodes.unionByName(g.nodes.where("id like '%7'")), g.edges.unionByName(g.edges.where("id like '%3'")), g.evidence)  # repeated records count as they did
    old = set(os.listdir(shared_dir(spark)))
    got = sorted(map(tuple, derive.diagnostics(g).collect()))
    assert set(os.listdir(shared_dir(spark))) == old
    assert got == sorted(map(tuple, derive.run(g).diagnostics.collect())) and {r[0] for r in got} == {"info", "warning"}
    ends = g.nodes.where(F.col("kind").isin(*CHANGES)), g.nodes.where(F.col("kind") == SPEC)
    assert sorted(map(tuple, derive.diagnostics(g, *ends).collect())) == got
