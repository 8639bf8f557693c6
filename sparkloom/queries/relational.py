"""Lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import keywords as kw
from sparkloom.operators import lookup as q

NAME, SYMBOL, ACCESSED = "read_file", 42, 903
NAMED = "(SELECT s.*, f.path, f.language, f.repo_label FROM symbols s JOIN files f ON f.id = s.file_id)"
TEST_PATH = r"regexp_matches(path, 'test|spec|__tests__|(_test\.(rs|py|ts|js|go|java)|\.(test|spec)\.(ts|js))$')"
VERB = "split_part(callee_name, '_', 1)"
DIRECT = "(SELECT DISTINCT src_id, dst_id FROM edges WHERE edge_kind = 'CALLS')"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _callers(where: str) -> str:
    return f"SELECT s.name FROM calls c JOIN symbols s ON s.id = c.caller_scope_id WHERE {where}"


def _first(parts: list[tuple[str, str]]) -> str:
    union = " UNION ALL ".join(f"SELECT name, {i} AS p, '{m}' AS detection_method FROM ({sql}) x{i}" for i, (m, sql) in enumerate(parts))
    return f"SELECT name, min_by(detection_method, p) AS detection_method FROM ({union}) u GROUP BY name"


def _unresolved(section: str, table: str, key: str, null: str) -> str:
    return f"SELECT * FROM (SELECT '{section}' AS section, {key} AS key, count(*) AS total, CAST(0 AS BIGINT) AS hits FROM {table} WHERE {null} IS NULL GROUP BY {key} ORDER BY total DESC, key LIMIT 20) t_{section}"


RESOLUTION = f"""
WITH c AS (SELECT c.*, f.language FROM calls c JOIN files f ON f.id = c.file_id)
SELECT 'overall' AS section, 'calls' AS key, count(*) AS total, count(resolved_symbol_id) AS hits FROM c
UNION ALL SELECT 'language', language, count(*), count(resolved_symbol_id) FROM c GROUP BY language
UNION ALL SELECT 'confidence', CASE WHEN confidence >= .95 THEN 'exact' WHEN confidence >= .8 THEN 'high' WHEN confidence >= .5 THEN 'medium' WHEN confidence > 0 THEN 'low' ELSE 'none' END AS k, count(*), count(resolved_symbol_id) FROM c GROUP BY k
UNION ALL {_unresolved('unresolved_callee', 'calls', 'callee_name', 'resolved_symbol_id')}
UNION ALL {_unresolved('unresolved_import', 'imports', 'imported_name', 'resolved_file_id')}
UNION ALL SELECT * FROM (SELECT 'worst_caller', CAST(caller_scope_id AS VARCHAR) AS key, count(*) AS total, count(resolved_symbol_id) AS hits FROM c GROUP BY 2 HAVING count(*) > count(resolved_symbol_id) ORDER BY count(*) - count(resolved_symbol_id) DESC, key LIMIT 15) w
"""
CROSSINGS = """
WITH a AS (SELECT s.id, split_part(f.path, '/', 1) AS top, f.repo_label AS repo FROM symbols s JOIN files f ON f.id = s.file_id),
j AS (SELECT e.edge_kind, x.top AS st, y.top AS dt, x.repo AS sr, y.repo AS dr FROM edges e JOIN a x ON x.id = e.src_id JOIN a y ON y.id = e.dst_id WHERE e.edge_kind IN ('CALLS', 'IMPORTS'))
SELECT 'top_' || lower(edge_kind) AS kind, st AS from_top, dt AS to_top, count(*) AS n FROM j WHERE st <> dt GROUP BY ALL UNION ALL SELECT 'repo', sr, dr, count(*) FROM j WHERE sr <> dr GROUP BY ALL
"""
ROLLUP = """
WITH a AS (SELECT s.id, f.path AS p, CASE WHEN contains(f.path, '/') THEN regexp_replace(f.path, '/[^/]*$', '') ELSE '.' END AS m FROM symbols s JOIN files f ON f.id = s.file_id),
j AS (SELECT e.edge_kind, x.p AS sp, y.p AS dp, x.m AS sm, y.m AS dm FROM edges e JOIN a x ON x.id = e.src_id JOIN a y ON y.id = e.dst_id)
SELECT 'file' AS level, sp AS src, dp AS dst, edge_kind, count(*) AS weight FROM j WHERE sp <> dp GROUP BY ALL UNION ALL SELECT 'module', sm, dm, edge_kind, count(*) FROM j WHERE sm <> dm GROUP BY ALL
"""
CHANGED = "(SELECT DISTINCT file_path AS path FROM file_commits WHERE is_creation AND lines_added > 90)"

QUERIES = {
    "symbols_by_name": (lambda c: q.symbols(c, NAME), f"SELECT id, name, kind, path, line, CASE WHEN is_exported THEN 'public' ELSE 'private' END AS visibility FROM {NAMED} x WHERE name = '{NAME}'"),
    "search_symbols": (lambda c: q.search_symbols(c, "read"), "SELECT id, name, kind, CASE WHEN lower(name) = 'read' THEN 0 WHEN starts_with(lower(name), 'read') THEN 1 ELSE 2 END AS rank FROM symbols WHERE contains(lower(name), 'read') ORDER BY rank, name, id LIMIT 20"),
    "symbols_page": (lambda c: q.paginated(c.symbols.select("id", "name"), 30, 10), "SELECT id, name, true AS has_more FROM symbols ORDER BY id OFFSET 30 LIMIT 10"),
    "symbols_by_ids": (lambda c: q.by_ids(c.symbols.select("id", "name"), c.routes.select("handler_symbol_id")), "SELECT id, name FROM symbols WHERE id IN (SELECT handler_symbol_id FROM routes)"),
    "edges_of_nodes": (lambda c: q.edges_of(c, c.symbols.where(F.col("name") == NAME).select("id")).select("id", "src_id", "dst_id", "edge_kind"), f"WITH i AS (SELECT id FROM symbols WHERE name = '{NAME}') SELECT id, src_id, dst_id, edge_kind FROM edges WHERE src_id IN (SELECT id FROM i) OR dst_id IN (SELECT id FROM i)"),
    "routes": (q.routes, "SELECT r.id, method, path, file_path, framework, r.line, coalesce(s.name, '') AS handler FROM routes r LEFT JOIN symbols s ON s.id = r.handler_symbol_id"),
    "stats": (q.table_counts, " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS n FROM {t}" for m, t in (("files", "files"), ("symbols", "symbols"), ("imports", "imports"), ("calls", "calls"), ("resolved_calls", "calls WHERE resolved_symbol_id IS NOT NULL"), ("heritage", "heritage"), ("edges", "edges"), ("evidence", "evidence")))),
    "repos": (q.repos, "SELECT repo_label, count(DISTINCT f.id) AS files, count(s.id) AS symbols, CAST(count(*) FILTER (s.is_exported) AS BIGINT) AS public_symbols FROM files f LEFT JOIN symbols s ON s.file_id = f.id GROUP BY repo_label"),
    "symbol_kinds": (q.symbol_kinds, "SELECT kind, count(*) AS n FROM symbols GROUP BY kind"),
    "context": (lambda c: q.context(c, NAME), f"""WITH r AS (SELECT id AS root_id FROM symbols WHERE name = '{NAME}'), e AS {DIRECT}, p AS (SELECT root_id, 'definition' AS role, root_id AS id FROM r UNION SELECT root_id, 'caller', src_id FROM r JOIN e ON dst_id = root_id UNION SELECT root_id, 'callee', dst_id FROM r JOIN e ON src_id = root_id)
SELECT p.*, n.name, n.path FROM p JOIN {NAMED} n ON n.id = p.id"""),
    "shape_check": (q.shape_check, f"""WITH e AS {DIRECT} SELECT s.id, s.name, (SELECT count(*) FROM e WHERE src_id = s.id) AS callees, (SELECT count(*) FROM e WHERE dst_id = s.id) AS callers FROM symbols s WHERE s.id IN (SELECT handler_symbol_id FROM routes) ORDER BY callees DESC, callers DESC, s.id LIMIT 50"""),
    "tool_map": (q.tool_map, f"""WITH e AS {DIRECT}, h AS (SELECT DISTINCT handler_symbol_id AS id FROM routes), io AS (SELECT DISTINCT caller_scope_id AS id FROM calls WHERE {VERB} IN {_in(kw.IO_CALLEES)}), b AS (SELECT id, 'handler' AS how FROM h WHERE id IN (SELECT src_id FROM e) UNION ALL SELECT id, 'io' FROM io WHERE id NOT IN (SELECT id FROM h WHERE id IS NOT NULL))
SELECT b.id, how, name, kind FROM b JOIN symbols s ON s.id = b.id"""),
    "entrypoints": (q.entrypoints, f"SELECT id, name, kind, path, line FROM {NAMED} x WHERE is_exported AND kind IN ('Function', 'Method', 'Class') ORDER BY path, line, id LIMIT 100"),
    "public_api": (lambda c: q.public_api(c, "core/"), f"SELECT id, name, kind, path, line FROM {NAMED} x WHERE is_exported AND path ILIKE '%core/%'"),
    "dead_code": (q.dead_code, f"SELECT id, name, kind, path, line FROM {NAMED} x WHERE NOT is_exported AND kind IN ('Function', 'Method') AND id NOT IN (SELECT resolved_symbol_id FROM calls WHERE resolved_symbol_id IS NOT NULL) ORDER BY path, line, id LIMIT 50"),
    "hotspots": (q.hotspots, "SELECT s.id, s.name, s.kind, count(*) AS fan_in FROM calls c JOIN symbols s ON s.id = c.resolved_symbol_id GROUP BY ALL ORDER BY fan_in DESC, s.id LIMIT 20"),
    "dep_cycles": (q.mutual_edges, "WITH e AS (SELECT DISTINCT src_id, dst_id FROM edges) SELECT x.src_id AS a, x.dst_id AS b FROM e x JOIN e y ON x.src_id = y.dst_id AND x.dst_id = y.src_id WHERE x.src_id < x.dst_id ORDER BY a, b LIMIT 20"),
    "resolution_stats": (q.resolution_stats, RESOLUTION),
    "uncovered": (q.uncovered, f"SELECT id, name, kind, path, line FROM {NAMED} x WHERE NOT is_exported AND id NOT IN (SELECT resolved_symbol_id FROM calls WHERE resolved_symbol_id IS NOT NULL) AND name NOT IN (SELECT callee_name FROM calls WHERE file_id IN (SELECT id FROM files WHERE {TEST_PATH})) ORDER BY path, line, id LIMIT 50"),
    "boundary_check": (q.boundary_crossings, CROSSINGS),
    "scope_violations": (q.scope_violations, """SELECT DISTINCT s.id, s.name, 'private_called' AS reason FROM calls c JOIN symbols s ON s.id = c.resolved_symbol_id WHERE NOT s.is_exported AND c.file_id <> s.file_id
UNION SELECT id, name, 'exported_private_name' FROM symbols WHERE is_exported AND ((starts_with(name, '_') AND NOT starts_with(name, '__')) OR regexp_matches(name, '_internal|_private|_impl|Internal|Private')) UNION SELECT id, imported_name, 'private_import' FROM imports WHERE starts_with(imported_name, '_')"""),
    "config_map": (q.config_map, _first([("keyword", f"SELECT name FROM symbols WHERE {kw.sql_any('name', kw.CONFIG)}"), ("env_access", _callers(f"{VERB} IN {_in(kw.ENV_CALLEES)}")), ("config_reader", _callers(f"{VERB} IN {_in(kw.READER_CALLEES)}"))])),
    "concurrency": (q.concurrency, _first([("keyword", f"SELECT name FROM symbols WHERE {kw.sql_any('name', kw.CONCURRENCY)}"), ("async_call", _callers(f"({VERB} IN {_in(kw.ASYNC_CALLEES)} OR regexp_matches(callee_name, 'await|spawn|join'))")), ("shared_state", _callers(f"{VERB} IN {_in(kw.SHARED_CALLEES)}"))])),
    "docs_drift": (lambda c: q.docs_drift(c, c.file_commits.where("is_creation AND lines_added > 90").select("file_path")), f"""WITH d AS (SELECT id, count(*) AS degree FROM (SELECT src_id AS id FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY id)
SELECT n.id, name, path, degree, lower(split_part(name, '_', 1)) IN {_in(kw.GENERIC)} AS generic FROM {NAMED} n JOIN d ON d.id = n.id WHERE is_exported AND kind IN ('Function', 'Method', 'Class') AND path IN (SELECT path FROM {CHANGED} ch) AND degree > 1"""),
    "group_sync": (q.group_sync, """WITH i AS (SELECT i.id, imported_name AS name, repo_label AS from_repo FROM imports i JOIN files f ON f.id = i.file_id WHERE resolved_file_id IS NULL), x AS (SELECT DISTINCT exported_name AS name, repo_label AS to_repo FROM exports e JOIN files f ON f.id = e.file_id)
SELECT from_repo, to_repo, count(DISTINCT id) AS links, count(DISTINCT name) AS names, CAST(0.8 AS DOUBLE) AS confidence FROM i JOIN x USING (name) WHERE from_repo <> to_repo GROUP BY ALL"""),
    "deduplicate_symbols": (lambda c: q.deduplicate_symbols(c).select("id", "name"), "SELECT id, name FROM symbols QUALIFY row_number() OVER (PARTITION BY file_id, name, line ORDER BY id) = 1"),
    "deduplicate_calls": (lambda c: q.deduplicate_calls(c).select("id", "callee_name"), "SELECT id, callee_name FROM calls QUALIFY row_number() OVER (PARTITION BY file_id, caller_scope_id, callee_name, line ORDER BY id) = 1"),
    "abstraction_layers": (q.rollup, ROLLUP),
    "graph_metadata": (q.metadata, """WITH n AS (SELECT (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM files) AS n_files)
SELECT *, CASE WHEN n_symbols < 100 THEN 'small' WHEN n_symbols < 1000 THEN 'medium' WHEN n_symbols < 10000 THEN 'large' ELSE 'huge' END AS size_class, CAST(CASE WHEN n_symbols < 100 THEN 5000 WHEN n_symbols < 1000 THEN 2000 WHEN n_symbols < 10000 THEN 1000 ELSE 500 END AS BIGINT) AS max_nodes FROM n"""),
    "accesses": (lambda c: q.accesses(c, ACCESSED), f"SELECT id, src_id, edge_kind, line FROM edges WHERE starts_with(edge_kind, 'ACCESSES') AND dst_id = {ACCESSED}"),
    "file_subgraph": (lambda c: q.file_subgraph(c, "store/sync/f4.go"), f"WITH i AS (SELECT id FROM {NAMED} x WHERE path = 'store/sync/f4.go') SELECT DISTINCT id, src_id, dst_id, edge_kind FROM edges WHERE src_id IN (SELECT id FROM i) OR dst_id IN (SELECT id FROM i)"),
    "rename_sites": (lambda c: q.rename_sites(c, NAME), f"""WITH d AS (SELECT * FROM symbols WHERE name = '{NAME}'), p AS (SELECT file_id, line, col FROM d UNION SELECT file_id, line, col FROM calls WHERE callee_name = '{NAME}' OR resolved_symbol_id IN (SELECT id FROM d)) SELECT path, line, col FROM p JOIN files f ON f.id = p.file_id"""),
    "innermost_symbol": (q.innermost_symbol, "SELECT c.id AS call_id, min_by(s.id, (20 + s.col % 40, s.id)) AS symbol_id FROM calls c JOIN symbols s ON s.file_id = c.file_id AND c.line >= s.line AND c.line < s.line + 20 + s.col % 40 GROUP BY c.id"),
    "preceding_class": (q.preceding_class, "SELECT h.id AS heritage_id, max_by(s.id, (s.line, s.id)) AS class_id FROM heritage h LEFT JOIN symbols s ON s.kind = 'Class' AND s.file_id = h.file_id AND s.line <= h.line GROUP BY h.id"),
}
