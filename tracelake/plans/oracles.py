"""DuckDB SQL for the queries on graphs."""

from __future__ import annotations

from tracelake.plans.sql import needs, sid

_LINE = r"regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1)"
_PATHS = f"""p AS (SELECT page_id, '/' || array_to_string(list_filter(string_split({_LINE}, '/'), lambda x: x NOT IN ('', '.')), '/') AS path FROM pages WHERE {_LINE} <> '')"""


def _reach(start: str, tables: tuple[str, ...] = (), more: str = "") -> str:
    """Requirements that share a component with the start nodes: a walk over the open edges from them."""
    return f"""{needs('nodes', 'open_edges', *tables)}, oe AS MATERIALIZED (SELECT a, b FROM open_edges {more}), both_ways AS MATERIALIZED (SELECT a, b FROM oe UNION SELECT b, a FROM oe),
      seen AS (SELECT id AS v FROM nodes WHERE {start} UNION SELECT b FROM seen JOIN both_ways ON a = v)
      SELECT id, kind, name FROM nodes WHERE kind = 'openspec-requirement' AND id IN (SELECT v FROM seen)"""


def _components(rounds: int) -> str:
    """Least ids spread to neighbours, round after round; the fixture graph is flat, and more rounds change nothing."""
    steps = ["l0 AS MATERIALIZED (SELECT DISTINCT a AS id, a AS l FROM both_ways)"]
    for k in range(rounds):
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT o.id, least(o.l, min(n.l)) AS l FROM l{k} o JOIN both_ways e ON e.a = o.id JOIN l{k} n ON n.id = e.b GROUP BY o.id, o.l)")
    both = "both_ways AS MATERIALIZED (SELECT a, b FROM open_edges UNION SELECT b, a FROM open_edges)"
    return f"{needs('open_edges')}, {both}, {', '.join(steps)} SELECT id, l AS component FROM l{rounds}"


_IMPLEMENTS = f"""SELECT {sid('node', "'repository'", "'NATION ' || (p_partkey % 25)")} AS a, id AS b FROM req WHERE scope = 'durable' AND p_partkey % 10 = 0"""
_NO_END = "'Cannot derive OpenSpec traceability because the change-to-spec edge has a missing endpoint.'"
_RULE = "'openspec-change-to-durable-spec'"

_DIAG = f"""diag AS (
  SELECT 'error' AS severity, 'edge-source-exists' AS rule_id, id AS affected_object_id, 'Edge source node does not exist: ' || source_id AS message
  FROM edges WHERE source_id NOT IN (SELECT id FROM nodes)
  UNION ALL SELECT 'error', 'evidence-reference-exists', id, 'Evidence reference does not exist: ' || eid FROM nodes WHERE eid IS NOT NULL AND eid NOT IN (SELECT id FROM evs)
  UNION ALL SELECT 'error', 'evidence-reference-exists', id, 'Evidence reference does not exist: ' || eid FROM edges WHERE eid IS NOT NULL AND eid NOT IN (SELECT id FROM evs)
  UNION ALL SELECT 'warning', 'unresolved-non-confident-related-spec', id, 'Non-confident related spec reference is unresolved: ' || related_title FROM rel WHERE matches <> 1)"""

_FIRST_REQ = "(SELECT min(eid) FROM req WHERE scope = 'durable')"

_SUPPLIER_REGISTRIES = """k AS (SELECT s_suppkey AS k, s_suppkey // 10 AS w FROM supplier),
      w AS (SELECT DISTINCT w, 'W' || w AS workspace_id, CASE WHEN w % 7 = 3 THEN 'requirements' ELSE 'SUP ' || (w * 10 + 1) END AS store_repository, w % 6 <> 5 AS has_layout FROM k),
      r AS (SELECT k, 'W' || w AS workspace_id, 'SUP ' || CASE WHEN k % 10 = 9 THEN k - 1 ELSE k END AS id, 'svc-' || (k % 7) AS service_id,
        CASE k % 4 WHEN 0 THEN 'requirements' WHEN 1 THEN 'code' WHEN 2 THEN 'library' ELSE 'unknown-role' END AS role,
        'root/repos/r' || CASE WHEN k % 10 = 3 THEN (w * 10 + 1) || '/sub' ELSE CAST(k AS VARCHAR) END AS at FROM k),
      made AS (SELECT workspace_id, 'openlore_path' AS item, 'root/repos/r' || (w * 10 + 2) || '/made' AS at FROM w WHERE has_layout AND w % 3 = 2
        UNION ALL SELECT workspace_id, 'output_path', 'root/repos/r' || (w * 10 + 5) FROM w WHERE has_layout AND w % 4 = 2)"""

ORACLES = {
    "stable_ids": f"""SELECT p_partkey, {sid('node', 'p_brand', 'p_name')} AS id FROM part UNION ALL SELECT -s_suppkey, {sid('service', "'  ' || upper(s_name) || chr(9) || ' x'")} FROM supplier""",
    "registry_nodes": f"{needs('ws', 'repo', 'svc')} SELECT id, 'workspace' AS kind, workspace_id AS name FROM ws UNION ALL SELECT id, 'repository', name FROM repo UNION ALL SELECT id, 'service', name FROM svc",
    "registry_edges": f"{needs('edges')} SELECT id, kind, source_id, target_id FROM edges WHERE kind IN ('contains', 'owns')",
    "registry_violations": f"""{needs('ws', 'repo')}
      SELECT workspace_id, 'role' AS rule, name AS object, role AS detail FROM repo WHERE role = 'unknown-role'
      UNION ALL SELECT workspace_id, 'ssh_url', name, 'https://host/x' FROM repo WHERE n % 5 = 0
      UNION ALL SELECT ws.workspace_id, 'store_repository', store_repository, coalesce(role, 'unknown') FROM ws LEFT JOIN repo ON name = store_repository AND repo.workspace_id = ws.workspace_id WHERE role IS DISTINCT FROM 'requirements'
      UNION ALL SELECT workspace_id, 'service_topology', sid, CAST(count(DISTINCT name) AS VARCHAR) FROM (
        SELECT workspace_id, name, 'svc-' || (CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS INT) % 5) AS sid FROM supplier JOIN repo ON n = s_nationkey) GROUP BY ALL HAVING count(DISTINCT name) > 1
      UNION ALL SELECT workspace_id, 'index_location', name, '  ' FROM repo WHERE include_in_federation AND n % 6 = 0""",
    "path_containment": f"""WITH {_PATHS}, owners AS (SELECT DISTINCT path AS owner FROM p UNION SELECT DISTINCT regexp_extract(path, '^/[^/]+', 0) FROM p)
      SELECT page_id, owner FROM p JOIN owners ON path = owner OR starts_with(path, owner || '/')""",
    "store_match": f"""{needs('repo')}, s AS (SELECT '/ws/repos/n' || (s_suppkey % 60) AS path, 'store-' || s_suppkey AS store_id FROM supplier)
      SELECT workspace_id, name AS id, count(store_id) AS matches, CASE WHEN count(store_id) = 1 THEN min(store_id) ELSE '-' END AS store_id,
        CASE count(store_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'used' ELSE 'ambiguous' END AS state
      FROM repo LEFT JOIN s ON path = resolved_path WHERE role = 'requirements' GROUP BY workspace_id, name""",
    "federation_refs": f"""{needs('ws', 'repo')} SELECT workspace_id, name AS id, resolved_path || CASE WHEN n % 6 = 0 THEN '' ELSE '/index/kg' END AS index_path
      FROM repo JOIN (SELECT workspace_id FROM ws WHERE federation_enabled) USING (workspace_id) WHERE include_in_federation""",
    "document_lines": """WITH l AS (SELECT doc_id, unnest(list_slice(x, 1, CASE WHEN x[len(x)] = '' THEN len(x) - 1 ELSE len(x) END)) AS line, generate_subscripts(list_slice(x, 1, CASE WHEN x[len(x)] = '' THEN len(x) - 1 ELSE len(x) END), 1) AS pos
        FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS x FROM documents))
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '^[A-E]')) AS n_keyed, coalesce(max(pos) - min(pos) FILTER (regexp_matches(line, '^[A-E]')), 0) AS n_below FROM l GROUP BY doc_id""",
    "capability_paths": f"{needs('durable', 'scoped')} SELECT path, scope, '-' AS change, capability FROM durable UNION ALL SELECT path, scope, change, capability FROM scoped",
    "issue_tokens": f"{needs('ch')} SELECT change, array_to_string(regexp_extract_all(change, '\\b[A-Z][A-Z0-9]+-\\d+\\b'), '|') AS tokens FROM ch WHERE known",
    "change_artifacts": f"{needs('edges')} SELECT id, source_id, target_id, eid AS evidence_id FROM edges WHERE kind = 'openspec-change-has-artifact'",
    "change_touches": f"{needs('touch')} SELECT id, source_id, target_id, eid AS evidence_id FROM touch",
    "registry_rules": f"""WITH {_SUPPLIER_REGISTRIES}
      SELECT workspace_id, 'version' AS rule, workspace_id AS object, '2' AS detail FROM w WHERE w % 4 = 3
      UNION ALL SELECT workspace_id, 'required', workspace_id, 'name' FROM w WHERE w % 5 = 4
      UNION ALL SELECT workspace_id, 'required', id, 'id, path' FROM r WHERE k % 13 = 5
      UNION ALL SELECT workspace_id, 'required', id, 'default_branch' FROM r WHERE k % 11 = 4
      UNION ALL SELECT workspace_id, 'required', id, 'dirty_worktree' FROM r WHERE k % 7 = 1
      UNION ALL SELECT workspace_id, 'required', id, 'fetch' FROM r WHERE k % 8 = 1
      UNION ALL SELECT workspace_id, 'required', id, 'pull' FROM r WHERE k % 9 = 1
      UNION ALL SELECT workspace_id, 'dirty_worktree', id, 'perhaps' FROM r WHERE k % 7 = 0
      UNION ALL SELECT workspace_id, 'fetch', id, 'perhaps' FROM r WHERE k % 8 = 0
      UNION ALL SELECT workspace_id, 'pull', id, 'perhaps' FROM r WHERE k % 9 = 0
      UNION ALL SELECT workspace_id, 'role', id, role FROM r WHERE role = 'unknown-role'
      UNION ALL SELECT workspace_id, 'ssh_url', id, 'https://host/x' FROM r WHERE k % 5 = 0
      UNION ALL SELECT workspace_id, 'unique_id', id, CAST(count(*) AS VARCHAR) FROM r GROUP BY workspace_id, id HAVING count(*) > 1
      UNION ALL SELECT w.workspace_id, 'store_repository', store_repository, coalesce(role, 'unknown') FROM w
        LEFT JOIN (SELECT DISTINCT workspace_id, id, role FROM r) r ON r.workspace_id = w.workspace_id AND id = store_repository WHERE role IS DISTINCT FROM 'requirements'
      UNION ALL SELECT workspace_id, 'service_topology', service_id, CAST(count(DISTINCT id) AS VARCHAR) FROM r GROUP BY workspace_id, service_id HAVING count(DISTINCT id) > 1
      UNION ALL SELECT r.workspace_id, 'inside_store', r.id, o.id FROM r JOIN w USING (workspace_id) JOIN r o ON o.workspace_id = r.workspace_id AND o.id = w.store_repository
        WHERE has_layout AND r.role IN ('code', 'library') AND r.id <> o.id AND starts_with(r.at || '/', o.at || '/')
      UNION ALL SELECT workspace_id, 'outside_root', 'openlore_path', '/ws' || w || '/out' FROM w WHERE has_layout AND w % 3 = 1
      UNION ALL SELECT workspace_id, 'generated_path', item, id FROM made JOIN r USING (workspace_id) WHERE starts_with(made.at || '/', r.at || '/')
      UNION ALL SELECT workspace_id, 'index_location', id, '  ' FROM r WHERE k % 6 = 0
      UNION ALL SELECT workspace_id, 'forbidden', p, p FROM (SELECT workspace_id, '/repositories/[' || k || ']/jira_data/issues' AS p FROM r WHERE k % 6 = 2)""",
    "federation_counts": f"""WITH {_SUPPLIER_REGISTRIES} SELECT workspace_id, CAST(count(id) FILTER (w % 2 = 0 AND k % 3 = 0) AS BIGINT) AS repository_count FROM w JOIN r USING (workspace_id) GROUP BY workspace_id""",
    "node_records": f"""{needs('nodes', 'evs')}, n AS (SELECT DISTINCT id, kind, name, coalesce(eid, '') AS evidence FROM nodes)
      SELECT *, CASE WHEN evidence IN (SELECT id FROM evs) THEN evidence ELSE '' END AS known_evidence, row_number() OVER (ORDER BY id, kind, name) - 1 AS position FROM n""",
    "edge_records": f"""{needs('derived', 'rel', 'edges', 'evs')}, e AS (
        SELECT id AS edge_id, 'openspec-change-traces-to-spec' AS kind, source_id, target_id, eid AS evidence, '-' AS confidence, '/capability="' || capability || '"|/derived=true|/rule_id="openspec-change-to-durable-spec"|/source_scope="'
          || scope || '"|/target_scope="durable"|/via_spec_id="' || via_spec_id || '"' AS props FROM derived
        UNION ALL SELECT e.id, kind, source_id, e.target_id, '', 'non-confident', '/related_title="' || related_title || '"' FROM edges e JOIN rel ON rel.id = e.source_id WHERE kind = 'openspec-related-spec'
        UNION ALL SELECT DISTINCT id, kind, source_id, target_id, coalesce(eid, ''), '-', '' FROM edges WHERE kind <> 'openspec-related-spec')
      SELECT *, CASE WHEN evidence IN (SELECT id FROM evs) THEN evidence ELSE '' END AS known_evidence, row_number() OVER (ORDER BY edge_id, kind, source_id, target_id) - 1 AS position FROM e""",
    "service_records": f"""{needs('svc')} SELECT id, '{{"id":"' || id || '","kind":"service","name":"' || name || '","props":"/repository_id=\\"' || 'NATION ' || s_nationkey || '\\"","repositories":"' || repo_id || '"}}' AS record
      FROM svc JOIN supplier ON s_name = name""",
    "derive_diagnostics_ordered": f"""{needs('touch', 'tin')}, x AS (SELECT 'warning' AS severity, {_RULE} AS rule_id, id AS affected_object_id, {_NO_END} AS message FROM touch WHERE NOT known
      UNION ALL SELECT 'info', {_RULE}, target_id, 'No durable OpenSpec spec exists for capability: ' || capability FROM tin WHERE durable_id IS NULL)
      SELECT *, row_number() OVER (ORDER BY severity, rule_id, affected_object_id, message) - 1 AS position FROM x""",
    "validation_ordered": f"""{needs('nodes', 'edges', 'evs', 'rel', 'derived')}, {_DIAG} SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, rule_id, affected_object_id, message) - 1 AS position FROM diag""",
    "related_edges": f"{needs('edges')} SELECT id, source_id, target_id, 'non-confident' AS confidence FROM edges WHERE kind = 'openspec-related-spec'",
    "related_unresolved": f"{needs('rel')} SELECT capability, CASE WHEN matches = 0 THEN 'missing' ELSE 'ambiguous' END AS reason, related_title FROM rel WHERE matches <> 1",
    "graph_counts": f"{needs('nodes', 'edges', 'evs')} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM evs) AS evidence_count",
    "merge_last_wins": "SELECT CAST(o_custkey AS VARCHAR) AS id, max(o_orderkey) AS value, arg_max(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey",
    "derive_edges": f"""{needs('derived')} SELECT id, source_id, target_id, '"' || capability || '"' AS capability_json, '"' || via_spec_id || '"' AS via_json, eid AS evidence_id FROM derived""",
    "derive_diagnostics": f"""{needs('touch', 'tin')} SELECT 'warning' AS severity, {_RULE} AS rule_id, id AS affected_object_id, {_NO_END} AS message FROM touch WHERE NOT known
      UNION ALL SELECT 'info', {_RULE}, target_id, 'No durable OpenSpec spec exists for capability: ' || capability FROM tin WHERE durable_id IS NULL""",
    "derive_metadata": f"""{needs('touch', 'tin')} SELECT (SELECT count(*) FROM tin WHERE durable_id IS NOT NULL) AS derived_edge_count, n AS skipped_input_count, n AS unresolved_input_count
      FROM (SELECT (SELECT count(*) FROM touch WHERE NOT known) + (SELECT count(*) FROM tin WHERE durable_id IS NULL) AS n)""",
    "dup_counts": "SELECT 'node' AS collection, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM documents GROUP BY coalesce(text, ''))",
    "dup_conflicts": """SELECT 'error' AS severity, 'duplicate-identity-conflict' AS rule_id, 'turn:' || turn AS affected_object_id, 'node ID has conflicting serialized values: turn:' || turn AS message
      FROM conversations GROUP BY turn HAVING count(DISTINCT role) > 1""",
    "broken_edges": f"""{needs('nodes', 'edges')} SELECT 'error' AS severity, 'edge-source-exists' AS rule_id, id AS affected_object_id, 'Edge source node does not exist: ' || source_id AS message FROM edges WHERE source_id NOT IN (SELECT id FROM nodes)
      UNION ALL SELECT 'error', 'edge-target-exists', id, 'Edge target node does not exist: ' || target_id FROM edges WHERE target_id NOT IN (SELECT id FROM nodes)""",
    "missing_evidence": f"""{needs('nodes', 'edges', 'evs')} SELECT 'error' AS severity, 'evidence-reference-exists' AS rule_id, id AS affected_object_id, 'Evidence reference does not exist: ' || eid AS message
      FROM (SELECT id, eid FROM nodes UNION ALL SELECT id, eid FROM edges) WHERE eid IS NOT NULL AND eid NOT IN (SELECT id FROM evs)""",
    "documents_without_label": """SELECT 'error' AS severity, 'evidence-reference-exists' AS rule_id, CAST(doc_id AS VARCHAR) AS affected_object_id, 'Evidence reference does not exist: ' || doc_id AS message
      FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""",
    "trace_shape": f"""{needs('nodes', 'edges')}, e AS (SELECT e.id, s.kind AS sk, t.kind AS tk, e.kind FROM edges e JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id WHERE e.kind IN ('openspec-change-touches-spec', 'openspec-change-has-artifact', 'owns'))
      SELECT 'openspec-traceability-source-kind' AS rule_id, id AS affected_object_id FROM e WHERE kind = 'owns'
      UNION ALL SELECT 'openspec-traceability-target-kind', id FROM e""",
    "related_warnings": f"""{needs('rel')} SELECT 'warning' AS severity, 'unresolved-non-confident-related-spec' AS rule_id, id AS affected_object_id, 'Non-confident related spec reference is unresolved: ' || related_title AS message FROM rel WHERE matches <> 1""",
    "validation_summary": f"""{needs('nodes', 'edges', 'evs', 'rel', 'derived')}, {_DIAG} SELECT rule_id, severity, count(*) AS n FROM diag GROUP BY ALL""",
    "gated_read": f"""{needs('nodes', 'edges', 'evs', 'rel', 'derived')}, {_DIAG} SELECT count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count, count(*) FILTER (severity = 'info') AS info_count,
      CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'invalid' ELSE 'valid' END AS status FROM diag""",
    "requirements_by_capability": _reach("capability = 'Brand#13'"),
    "requirements_by_service": _reach("kind = 'service' AND name = 'Supplier#000000001'", ("req",), f"UNION ALL {_IMPLEMENTS}"),
    "requirements_by_change": _reach("kind = 'openspec-active-change' AND name = (SELECT min(name) FROM nodes WHERE kind = 'openspec-active-change')"),
    "requirements_by_evidence": f"""{needs('nodes', 'edges', 'req')} SELECT id, kind, name FROM nodes WHERE kind = 'openspec-requirement' AND (eid = {_FIRST_REQ} OR id IN (SELECT source_id FROM edges WHERE eid = {_FIRST_REQ} UNION SELECT target_id FROM edges WHERE eid = {_FIRST_REQ}))""",
    "services": f"{needs('svc')} SELECT id, name, repo_id AS repository_ids FROM svc",
    "changes": f"""{needs('nodes', 'edges', 'derived')}, c AS (SELECT * FROM nodes WHERE kind IN ('openspec-active-change', 'openspec-archived-change')),
      a AS (SELECT source_id, string_agg(target_id, '|' ORDER BY target_id) AS x FROM edges WHERE kind = 'openspec-change-has-artifact' GROUP BY 1),
      t AS (SELECT source_id, string_agg(target_id, '|' ORDER BY target_id) AS x FROM edges WHERE kind = 'openspec-change-touches-spec' GROUP BY 1),
      r AS (SELECT source_id, string_agg(target_id, '|' ORDER BY target_id) AS x FROM derived GROUP BY 1),
      u AS (SELECT source_id, string_agg(target_id, '|' ORDER BY target_id) AS x FROM edges e WHERE kind = 'openspec-change-touches-spec' AND target_id NOT IN (SELECT via_spec_id FROM derived) GROUP BY 1)
      SELECT c.id, c.kind, c.name, coalesce(a.x, '') AS artifact_ids, coalesce(t.x, '') AS touched_spec_ids, coalesce(r.x, '') AS traceability_spec_ids, coalesce(t.x, '') AS missing_durable_spec_links, coalesce(u.x, '') AS untraced_spec_ids
      FROM c LEFT JOIN a ON a.source_id = c.id LEFT JOIN t ON t.source_id = c.id LEFT JOIN r ON r.source_id = c.id LEFT JOIN u ON u.source_id = c.id""",
    "traceability": f"""{needs('nodes', 'edges', 'derived', 'evs', 'ch')}, o AS (SELECT id AS object_id FROM ch WHERE known),
      every AS (SELECT id, kind, source_id, target_id, eid FROM edges UNION ALL SELECT id, 'openspec-change-traces-to-spec', source_id, target_id, eid FROM derived)
      SELECT object_id, every.id AS edge_id, kind, source_id, target_id, CASE WHEN eid IN (SELECT id FROM evs) THEN eid ELSE '' END AS evidence FROM o JOIN every ON object_id = source_id OR object_id = target_id""",
    "change_links": f"""{needs('nodes', 'edges', 'derived', 'ch')}, o AS (SELECT id AS object_id FROM ch),
      every AS (SELECT id, kind, source_id, target_id FROM edges UNION ALL SELECT id, 'openspec-change-traces-to-spec', source_id, target_id FROM derived)
      SELECT object_id, CASE WHEN object_id = source_id THEN target_id ELSE source_id END AS other_id, object_id = source_id AS out, every.id AS edge_id, kind FROM o JOIN every ON object_id = source_id OR object_id = target_id""",
    "traceability_missing": f"{needs('ch')} SELECT id AS object_id, true AS missing FROM ch WHERE NOT known",
    "sanitized_props": """SELECT p_partkey AS id, '/brand' AS path, '"' || p_brand || '"' AS value FROM part UNION ALL SELECT p_partkey, '/tokens_used', CAST(p_size AS VARCHAR) FROM part
      UNION ALL SELECT p_partkey, '/nested/note/[0]', '"' || p_name || '"' FROM part WHERE p_size % 3 = 2""",
    "forbidden_props": "SELECT p_partkey AS id FROM part WHERE p_size % 3 = 0",
    "locator_kinds": "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'page' WHEN 2 THEN 'code' WHEN 3 THEN 'openspec' ELSE 'unknown' END AS loc_type FROM part",
    "store_roundtrip": f"{needs('ws', 'repo', 'svc')} SELECT id, 'workspace' AS kind, workspace_id AS name FROM ws UNION ALL SELECT id, 'repository', 'new ' || name FROM repo UNION ALL SELECT id, 'service', name FROM svc",
    "build_job": f"""{needs('nodes', 'edges', 'evs', 'derived')} SELECT n AS stored_node_count, e AS stored_edge_count, v AS stored_evidence_count, n AS node_count, e + (SELECT count(*) FROM derived) AS edge_count, v AS evidence_count
      FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS e, (SELECT count(*) FROM evs) AS v)""",
    "components": _components(24),
    "components_extended": _components(24),
    "requirements_by_capability_and_change": f"""SELECT id, kind, name FROM ({_reach("capability = 'Brand#13'")}) WHERE id IN (SELECT id FROM ({_reach("kind = 'openspec-active-change' AND name = (SELECT min(name) FROM nodes WHERE kind = 'openspec-active-change')")}))""",
    "store_export": f"""{needs('edges', 'svc')} SELECT 'edges' AS "table", id, '{{"evidence_ids":[],"id":"' || id || '","kind":"' || kind || '","props":{{}},"source_id":"' || source_id || '","target_id":"' || target_id || '"}}' AS record FROM edges WHERE kind IN ('contains', 'owns')
      UNION ALL SELECT 'nodes', svc.id, '{{"evidence_ids":[],"id":"' || svc.id || '","kind":"service","name":"' || name || '","props":{{"/repository_id":"\\"NATION ' || s_nationkey || '\\""}}}}' FROM svc JOIN supplier ON s_name = name""",
    "federation_ordered": f"""WITH {_SUPPLIER_REGISTRIES} SELECT *, row_number() OVER (ORDER BY workspace_id, id, index_path) - 1 AS position FROM (
      SELECT workspace_id, id, '/ws' || (k // 10) || '/' || r.at || CASE WHEN k % 6 = 0 THEN '/  ' ELSE '/index/kg' END AS index_path FROM r WHERE k % 3 = 0 AND (k // 10) % 2 = 0)""",
    "store_match_named": """WITH k AS (SELECT s_suppkey AS k, s_suppkey // 10 AS w FROM supplier), r AS (SELECT k, w FROM k WHERE k % 4 = 0)
      SELECT 'W' || r.w AS workspace_id, 'SUP ' || r.k AS id, CAST(s.k IS NOT NULL AS BIGINT) AS matches, 'store-' || (a.k * 2) AS store_id, CASE WHEN s.k IS NULL THEN 'unknown' WHEN s.k = r.k THEN 'used' ELSE 'path_mismatch' END AS state
      FROM r JOIN k a ON a.w = r.w LEFT JOIN k s ON s.k = a.k * 2""",
}
