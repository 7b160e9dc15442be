"""Tables of the graph and the kinds of its records."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# Record kinds.
WORKSPACE, REPOSITORY, SERVICE, REQUIREMENT = "workspace", "repository", "service", "requirement"
SPEC, SPEC_REQUIREMENT, SCENARIO, ARTIFACT = "openspec-spec", "openspec-requirement", "openspec-scenario", "openspec-artifact"
ACTIVE_CHANGE, ARCHIVED_CHANGE = "openspec-active-change", "openspec-archived-change"
CONTAINS, OWNS, IMPLEMENTS = "contains", "owns", "implements"
SPEC_HAS_REQUIREMENT, REQUIREMENT_HAS_SCENARIO = "openspec-spec-contains-requirement", "openspec-requirement-contains-scenario"
CHANGE_HAS_ARTIFACT, CHANGE_TOUCHES_SPEC = "openspec-change-has-artifact", "openspec-change-touches-spec"
CHANGE_TRACES_TO_SPEC, RELATED_SPEC = "openspec-change-traces-to-spec", "openspec-related-spec"
CHANGES = (ACTIVE_CHANGE, ARCHIVED_CHANGE)
DURABLE, ACTIVE_SCOPE, ARCHIVED_SCOPE = "durable", "active-change", "archived-change"
DERIVE_RULE = "openspec-change-to-durable-spec"

ORD = "ord struct<batch:int,phase:int,path:array<string>,seq:int>"
LOCATOR = ("locator struct<loc_type:string,text:string,repository:string,revision:string,file:string,symbol:string,page_id:string,"
           "relative_file_path:string,artifact_type:string,openspec_identity:string,heading_name:string,line_start:int,line_end:int>")
NODE_SCHEMA = (
    "id string, kind string, name string, capability string, scope string, change_identity string, openspec_identity string, "
    f"props map<string,string>, evidence_ids array<string>, {ORD}")
EDGE_SCHEMA = f"id string, kind string, source_id string, target_id string, props map<string,string>, evidence_ids array<string>, confidence string, {ORD}"
EVIDENCE_SCHEMA = f"id string, source string, {LOCATOR}, props map<string,string>, {ORD}"
DIAGNOSTIC_SCHEMA = "severity string, rule_id string, affected_object_id string, message string"


class Graph(NamedTuple):
    """One property graph: three tables."""

    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame

    def map(self, of) -> "Graph":
        return Graph(*(of(df) for df in self))


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(*(spark.createDataFrame([], s) for s in (NODE_SCHEMA, EDGE_SCHEMA, EVIDENCE_SCHEMA)))
