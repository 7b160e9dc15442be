"""Registered graph queries against their SQL in DuckDB, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__
from tracelake.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
SOME = ["stable_ids", "registry_edges", "registry_violations", "path_containment", "store_match", "federation_refs", "heading_requirements", "heading_scenarios", "frontmatter_related", "document_lines", "capability_paths",
        "change_touches", "related_edges", "related_unresolved", "merge_last_wins", "dup_counts", "dup_conflicts", "services", "sanitized_props", "locator_kinds", "components", "changes", "traceability", "traceability_missing",
        "registry_rules", "federation_counts", "node_records", "edge_records", "service_records", "derive_diagnostics_ordered", "validation_ordered",
        "extraction_counts", "tree_manifest", "tree_nodes", "tree_edges", "tree_evidence", "tree_in_order", "tree_locators", "layout_missing", "forbidden_nested", "sanitized_nested", "registry_readable",
        "federation_ordered", "store_export", "store_match_named", "components_extended", "requirements_by_capability_and_change", "change_links"]


def oracle(sql: str):
    c = duckdb.connect(config={"temp_directory": ""})
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return sorted(names), sorted(repr(tuple(x for _, x in sorted(zip(names, row)))) for row in r.fetchall())


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    assert (names, got) == oracle(ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
