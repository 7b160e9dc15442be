"""Nested properties as one map: key = path of a leaf ('/layout/root_path', '/related/[0]'), value = its JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names that may not be stored, names that are not shown, names that a registry may not hold.
NOT_STORED = (
    "api_response", "attachments", "call_graph", "class_body", "comments", "content", "credentials", "dependency_graph",
    "external_api_response", "function_body", "openlore_analysis", "page_content", "page_url", "source_code", "token", "tokens", "url",
)
NOT_SHOWN = (*NOT_STORED, "generated_graph_records", "jira_payload", "bitbucket_payload", "confluence_content", "symbol_body")
NOT_REGISTERED = (
    "architecture", "architecture_relationships", "bitbucket_data", "code_structure", "generated_documentation",
    "implementation_details", "jira_data", "openspec_requirements",
)


def json_text(value: Column) -> Column:
    """JSON of a scalar; null stays null."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def props(**leaves: Column) -> Column:
    """A map from keyword arguments; `a__b` stands for the path /a/b.  Null leaves are left out."""
    if not leaves:
        return F.create_map().cast("map<string,string>")
    pairs = [x for k, v in leaves.items() for x in (F.lit("/" + k.replace("__", "/")), json_text(v))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def listed(prefix: str, values: Column) -> Column:
    """Map entries of a list of strings; an empty list is the leaf []."""
    path = F.lit("/" + prefix.replace("__", "/"))
    items = F.transform(values, lambda x, i: F.struct(F.concat(path, F.lit("/["), i.cast("string"), F.lit("]")).alias("key"), json_text(x).alias("value")))
    return F.map_from_entries(F.when(F.size(values) > 0, items).otherwise(F.array(F.struct(path.alias("key"), F.lit("[]").alias("value")))))


def holds(key: Column, names: tuple[str, ...]) -> Column:
    """Whether a part of the path is one of the names; `/` inside a name is written ~1, so parts are whole names."""
    return F.exists(F.split(key, "/"), lambda part: part.isin(*names))


def has_any(of: Column, names: tuple[str, ...]) -> Column:
    """Whether a name stands anywhere in a path."""
    return F.exists(F.map_keys(of), lambda k: holds(k, names))


def without(of: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(of, lambda k, v: ~holds(k, names))


def canonical(of: Column) -> Column:
    """The map as text with sorted keys, for comparison."""
    return F.to_json(F.array_sort(F.map_entries(of)))
