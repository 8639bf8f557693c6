"""Traversal and graph-algorithm queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import keywords as kw
from sparkloom.operators import communities as g
from sparkloom.operators import knowledge as k
from sparkloom.operators import traverse as t

NAME, SYMBOL, FLOW, SINK, START, GOAL = "open_file", 42, 223, 803, 4, 291
LEAF, OTHER_LEAF = "core/auth/f0.py", "core/model/f32.ts"
CALLS = "SELECT DISTINCT src_id AS src, dst_id AS dst FROM edges WHERE edge_kind = 'CALLS'"
BACK = "SELECT DISTINCT dst_id AS src, src_id AS dst FROM edges WHERE edge_kind = 'CALLS'"
NAMED_ROOTS = f"SELECT id FROM symbols WHERE name = '{NAME}'"
NAMED = "(SELECT s.*, f.path FROM symbols s JOIN files f ON f.id = s.file_id)"
TEST_PATH = r"regexp_matches(path, 'test|spec|__tests__|(_test\.(rs|py|ts|js|go|java)|\.(test|spec)\.(ts|js))$')"
TEST_NAME = "regexp_matches(name, 'test|Test|Spec|should_|^it_|_spec$')"


#: The files of the newest commit that has any.
LAST_FILES = "SELECT file_path FROM file_commits WHERE commit_hash = (SELECT hash FROM commits WHERE hash IN (SELECT commit_hash FROM file_commits) ORDER BY timestamp DESC, hash LIMIT 1)"


def last_commit_files(c):
    newest = c.commits.join(c.file_commits.select(F.col("commit_hash").alias("hash")), "hash", "left_semi").orderBy(F.desc("timestamp"), "hash").limit(1).select(F.col("hash").alias("commit_hash"))
    return c.file_commits.join(newest, "commit_hash", "left_semi").select(F.col("file_path").alias("path"))


def reach(name: str, roots: str, link: str, depth: int) -> str:
    """Common table expressions: {name} is (root_id, node_id, depth) with the least depth."""
    return f"""{name}_l AS ({link}), {name}_c(root_id, node_id, depth) AS (SELECT id, id, CAST(0 AS BIGINT) FROM ({roots}) {name}_r UNION SELECT root_id, dst, depth + 1 FROM {name}_c JOIN {name}_l ON src = node_id WHERE depth < {depth}),
{name} AS (SELECT root_id, node_id, min(depth) AS depth FROM {name}_c WHERE node_id <> root_id GROUP BY ALL)"""


UP3, DOWN3 = reach("up", NAMED_ROOTS, BACK, 3), reach("down", NAMED_ROOTS, CALLS, 3)
WITH_NAMES = "SELECT c.root_id, c.node_id, c.depth, n.name, n.path FROM {} c JOIN " + NAMED + " n ON n.id = c.node_id"
TIER = "CASE WHEN {0} <= 5 THEN 'LOW' WHEN {0} <= 15 THEN 'MEDIUM' WHEN {0} <= 40 THEN 'HIGH' ELSE 'CRITICAL' END"
EXPLAIN = f"""x AS (SELECT id AS root_id, (SELECT count(*) FROM up WHERE root_id = s.id) AS callers, (SELECT count(*) FROM down WHERE root_id = s.id) AS callees,
(SELECT count(*) FROM heritage WHERE child_symbol_id = s.id) AS parents, (SELECT count(*) FROM heritage WHERE parent_symbol_id = s.id) AS children FROM symbols s WHERE name = '{NAME}')"""


def _trace_flow(a: str, b: str, root: int = FLOW) -> str:
    return f"WITH RECURSIVE f(node_id, flow_kind, depth) AS (SELECT {b}, flow_kind, CAST(1 AS BIGINT) FROM data_flows WHERE {a} = {root} UNION ALL SELECT {b}, d.flow_kind, depth + 1 FROM f JOIN data_flows d ON d.{a} = f.node_id WHERE depth < 3) SELECT * FROM f"


def _labels(rounds: int) -> str:
    """Label propagation unrolled to that many rounds."""
    out = """le AS (SELECT src_id, dst_id, sum(confidence) AS w FROM edges WHERE edge_kind IN ('CALLS', 'ACCESSES_read') GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v, round(sum(w), 6) AS w FROM (SELECT src_id AS u, dst_id AS v, w FROM le UNION ALL SELECT dst_id, src_id, w FROM le) GROUP BY ALL), l0 AS (SELECT DISTINCT u AS id, u AS community FROM e)"""
    for i in range(1, rounds + 1):
        out += f", l{i} AS MATERIALIZED (SELECT u AS id, community FROM (SELECT u, community, round(sum(w), 6) AS w FROM e JOIN l{i - 1} ON l{i - 1}.id = e.v GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY u ORDER BY w DESC, community) = 1)"
    n = rounds
    return out + f""", z AS (SELECT community, count(*) AS n FROM l{n} GROUP BY ALL), sized AS (SELECT l.id, l.community, z.n FROM l{n} l JOIN z USING (community)),
pull AS (SELECT a.community AS a, b.community AS b, round(sum(w), 6) AS w FROM e JOIN sized a ON a.id = u JOIN sized b ON b.id = v WHERE a.n < 3 AND b.n >= 3 GROUP BY ALL), mv AS (SELECT a, b FROM pull QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) = 1),
lab AS (SELECT id, coalesce(b, community) AS community FROM l{n} LEFT JOIN mv ON a = community)"""


ROUNDS = 20
LAB = _labels(ROUNDS)
IN_LAB = "j AS (SELECT x.community AS a, y.community AS b FROM edges k JOIN lab x ON x.id = k.src_id JOIN lab y ON y.id = k.dst_id WHERE edge_kind IN ('CALLS', 'ACCESSES_read'))"


def _processes(steps: int) -> str:
    out = f"""c AS ({CALLS}), s AS (SELECT * FROM symbols WHERE id IN (SELECT src FROM c)),
entry AS (SELECT id FROM s WHERE id NOT IN (SELECT dst FROM c) OR is_exported OR id IN (SELECT handler_symbol_id FROM routes) OR regexp_matches(name, '^(on|handle|process).+')), o1 AS (SELECT [id] AS trace, id AS e FROM entry)"""
    ends = []
    for i in range(1, steps):
        out += f", o{i + 1} AS (SELECT list_append(trace, n) AS trace, n AS e FROM (SELECT trace, min(dst) AS n FROM o{i} JOIN c ON src = e WHERE NOT list_contains(trace, dst) GROUP BY trace))"
        ends.append(f"SELECT trace FROM o{i} o WHERE NOT EXISTS (SELECT 1 FROM c WHERE src = o.e AND NOT list_contains(o.trace, dst))")
    ends.append(f"SELECT trace FROM o{steps}")
    return f"WITH {out} SELECT trace[1] AS entry, CAST(len(trace) AS BIGINT) AS steps, array_to_string(trace, '>') AS trace FROM (SELECT DISTINCT trace FROM ({' UNION ALL '.join(ends)}) WHERE len(trace) >= 3) ORDER BY steps DESC, entry LIMIT 300"


def _beam(depth: int, width: int) -> str:
    cost = "CASE edge_kind " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in g.COSTS.items()) + " ELSE 2.5 END"
    out = f"b AS (SELECT node, next, CAST(min(cost) AS DOUBLE) AS cost FROM (SELECT src_id AS node, dst_id AS next, {cost} AS cost FROM edges UNION ALL SELECT dst_id, src_id, {cost} + 0.5 FROM edges) GROUP BY ALL), s0 AS (SELECT id AS seed, id AS node, CAST(0 AS BIGINT) AS depth, [id] AS path, CAST(0 AS DOUBLE) AS cost FROM symbols WHERE name = '{NAME}')"
    seen = "SELECT * FROM s0"
    for d in range(1, depth + 1):
        out += f""", t{d} AS (SELECT s.seed, b.next AS node, min((s.cost + b.cost, list_append(s.path, b.next))) AS m FROM s{d - 1} s JOIN b ON b.node = s.node WHERE (s.seed, b.next) NOT IN (SELECT (seed, node) FROM ({seen})) GROUP BY ALL),
s{d} AS (SELECT seed, node, CAST({d} AS BIGINT) AS depth, m[2] AS path, m[1] AS cost FROM t{d} QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(m[1], 6), node) <= {width})"""
        seen += f" UNION ALL SELECT * FROM s{d}"
    return f"WITH {out} SELECT seed, node, depth, array_to_string(path, '>') AS path, round(cost, 6) AS cost, round(1 / (1 + cost), 6) AS confidence FROM ({seen}) WHERE depth > 0"


def _lab(c):
    return g.communities(c, ROUNDS)


FILE_LINKS = "w AS (SELECT x.file_id AS src, y.file_id AS dst, edge_kind, count(*) AS weight FROM edges k JOIN symbols x ON x.id = k.src_id JOIN symbols y ON y.id = k.dst_id WHERE x.file_id <> y.file_id GROUP BY ALL)"
NEIGHBOUR = f"SELECT id FROM symbols WHERE id = {SYMBOL}"

QUERIES = {
    "callers": (lambda c: t.callers(c, NAME), f"WITH RECURSIVE {UP3} {WITH_NAMES.format('up')}"),
    "callees": (lambda c: t.callees(c, NAME), f"WITH RECURSIVE {DOWN3} {WITH_NAMES.format('down')}"),
    "impact": (lambda c: t.impact(c, NAME), f"WITH RECURSIVE {UP3}, {DOWN3}, b AS (SELECT *, 'caller' AS direction FROM up UNION ALL SELECT *, 'callee' FROM down) SELECT b.*, n.name, n.path FROM b JOIN {NAMED} n ON n.id = b.node_id"),
    "impact_by_kind": (lambda c: t.impact_by_kind(c, NAME, "func"), f"WITH RECURSIVE {UP3} SELECT u.*, n.name, n.path, n.kind FROM up u JOIN {NAMED} n ON n.id = u.node_id WHERE n.kind ILIKE '%func%'"),
    "api_impact": (t.api_impact, f"""WITH RECURSIVE h AS (SELECT DISTINCT handler_symbol_id AS id FROM routes WHERE handler_symbol_id IN (SELECT id FROM symbols)), {reach('up', 'SELECT id FROM h', BACK, 3)},
n AS (SELECT id AS root_id, {', '.join(f'(SELECT count(*) FROM up WHERE root_id = h.id AND depth = {d}) AS d{d}' for d in (1, 2, 3))} FROM h), s AS (SELECT *, 3 * d1 + 2 * d2 + d3 AS score FROM n) SELECT *, {TIER.format('score')} AS tier FROM s"""),
    "explain": (lambda c: t.explain(c, NAME), f"WITH RECURSIVE {UP3}, {DOWN3}, {EXPLAIN} SELECT * FROM x"),
    "affected_tests": (lambda c: t.affected_tests(c, NAME), f"""WITH RECURSIVE {reach('u5', NAMED_ROOTS, BACK, 5)}, up AS (SELECT node_id AS id, min(u5.depth) AS depth, any_value(name) AS name, any_value(path) AS path FROM u5 JOIN {NAMED} n ON n.id = node_id GROUP BY node_id)
SELECT id, 'direct_test_name' AS how FROM up WHERE depth = 1 AND {TEST_NAME} UNION ALL SELECT id, 'test_path' FROM up WHERE {TEST_PATH} UNION ALL SELECT id, 'test_name' FROM up WHERE {TEST_NAME}
UNION ALL SELECT id, 'test_framework' FROM up WHERE id IN (SELECT caller_scope_id FROM calls WHERE split_part(callee_name, '_', 1) IN ({', '.join(f"'{w}'" for w in kw.TEST_FRAMEWORK)}))"""),
    "validation_plan": (lambda c: t.validation_plan(c, NAME), f"""WITH RECURSIVE {UP3}, {DOWN3}, {EXPLAIN}, y AS (SELECT root_id, 3 * callers + callees + 2 * (parents + children) AS risk, (SELECT count(DISTINCT file_id) FROM up JOIN symbols s ON s.id = node_id WHERE up.root_id = x.root_id) AS affected_files FROM x)
SELECT *, {TIER.format('risk')} AS tier FROM y"""),
    "semantic_diff": (lambda c: t.semantic_diff(c, last_commit_files(c)), f"WITH RECURSIVE r AS (SELECT id, name FROM {NAMED} x WHERE path IN ({LAST_FILES})), {reach('up', 'SELECT id FROM r', BACK, 3)} SELECT r.id AS root_id, r.name, (SELECT count(*) FROM up WHERE root_id = r.id) AS callers FROM r"),
    "side_effects": (lambda c: t.side_effects(c, NAME), f"WITH RECURSIVE {reach('c', NAMED_ROOTS, CALLS, 2)}, x AS (SELECT c.root_id, c.node_id, c.depth, name, {kw.sql_first('name', kw.EFFECTS)} AS label FROM c JOIN symbols s ON s.id = c.node_id) SELECT * FROM x WHERE label IS NOT NULL"),
    "error_trace": (lambda c: t.error_trace(c, NAME), f"""WITH RECURSIVE s AS (SELECT id, name, {kw.sql_class('name', kw.ERRORS)} AS label FROM symbols), {reach('c', NAMED_ROOTS, f"SELECT DISTINCT src_id AS src, dst_id AS dst FROM edges JOIN s ON s.id = src_id WHERE edge_kind = 'CALLS' AND (s.label IS NULL OR s.name = '{NAME}')", 5)}
SELECT root_id, name, min(depth) AS depth, any_value(label) AS label FROM c JOIN s ON s.id = c.node_id WHERE label IS NOT NULL GROUP BY root_id, name"""),
    "resource_lifecycle": (lambda c: t.resource_lifecycle(c, NAME), f"""WITH RECURSIVE {reach('c', NAMED_ROOTS, CALLS, 2)}, x AS (SELECT root_id, {kw.sql_class('name', kw.LIFECYCLE)} AS label FROM c JOIN symbols s ON s.id = c.node_id), n AS (SELECT root_id, count(*) FILTER (label = 'creation') AS creation, count(*) FILTER (label = 'cleanup') AS cleanup, count(*) FILTER (label = 'usage') AS usage FROM x WHERE label IS NOT NULL GROUP BY root_id)
SELECT *, CASE WHEN creation > 0 AND cleanup = 0 THEN 'leak' WHEN creation > 0 THEN 'complete' ELSE 'use_only' END AS verdict FROM n"""),
    "rename_safety": (lambda c: t.rename_safety(c, NAME, "write_file"), f"""WITH RECURSIVE {reach('c', NAMED_ROOTS, BACK, 5)}, n AS (SELECT (SELECT count(DISTINCT node_id) FROM c) AS "references", (SELECT count(*) FROM symbols WHERE name = 'write_file') AS collisions) SELECT *, CASE WHEN "references" = 0 THEN 'SAFE' WHEN "references" <= 5 THEN 'LOW' WHEN "references" <= 20 THEN 'MEDIUM' ELSE 'HIGH' END AS tier FROM n"""),
    "edit_scope": (lambda c: t.edit_scope(c, NAME), f"WITH r AS ({NAMED_ROOTS}), e AS ({CALLS}) SELECT id, 'definition' AS role FROM r UNION SELECT src, 'caller' FROM e JOIN r ON dst = r.id WHERE src <> dst UNION SELECT dst, 'callee' FROM e JOIN r ON src = r.id WHERE src <> dst"),
    "change_coupling": (lambda c: t.change_coupling(c, NAME), f"WITH r AS ({NAMED_ROOTS}), e AS ({CALLS}) SELECT dst AS id, count(DISTINCT src) AS shared_callers FROM e WHERE src IN (SELECT src FROM e WHERE dst IN (SELECT id FROM r)) AND dst NOT IN (SELECT id FROM r) GROUP BY dst"),
    "data_flow_forward": (lambda c: t.trace_flow(c, FLOW, 3), _trace_flow("src_symbol_id", "dst_symbol_id")),
    "data_flow_backward": (lambda c: t.trace_flow(c, SINK, 3, False), _trace_flow("dst_symbol_id", "src_symbol_id", SINK)),
    "call_cycles": (t.call_cycles, f"WITH RECURSIVE l AS ({CALLS}), c(a, b, depth) AS (SELECT src, dst, CAST(1 AS BIGINT) FROM l UNION SELECT a, dst, depth + 1 FROM c JOIN l ON src = b WHERE depth < 20) SELECT a AS id, min(depth) AS length FROM c WHERE a = b GROUP BY a"),
    "cycle_pairs": (lambda c: t.cycle_pairs(c, 6), f"WITH RECURSIVE {reach('c', 'SELECT DISTINCT src_id AS id FROM edges', CALLS, 6)} SELECT x.root_id AS a, x.node_id AS b FROM c x JOIN c y ON y.root_id = x.node_id AND y.node_id = x.root_id WHERE x.root_id < x.node_id"),
    "module_impact": (lambda c: t.module_impact(c, SYMBOL), f"""WITH RECURSIVE {FILE_LINKS}, r AS (SELECT file_id AS id FROM symbols WHERE id = {SYMBOL}), {reach('c', 'SELECT id FROM r', 'SELECT DISTINCT src, dst FROM w', 2)}, n AS (SELECT node_id AS f FROM c UNION SELECT id FROM r)
SELECT x.path AS src_path, y.path AS dst_path, edge_kind, weight FROM w JOIN files x ON x.id = src JOIN files y ON y.id = dst WHERE src IN (SELECT f FROM n) AND dst IN (SELECT f FROM n) ORDER BY weight DESC, 1, 2, 3 LIMIT 50"""),
    "neighborhood": (lambda c: t.neighborhood(c, SYMBOL), f"""WITH RECURSIVE {reach('fw', NEIGHBOUR, 'SELECT DISTINCT src_id AS src, dst_id AS dst FROM edges', 2)}, {reach('bw', NEIGHBOUR, 'SELECT DISTINCT dst_id AS src, src_id AS dst FROM edges', 2)}, n AS (SELECT node_id FROM fw UNION SELECT node_id FROM bw UNION SELECT {SYMBOL})
SELECT id, src_id, dst_id, edge_kind FROM edges WHERE src_id IN (SELECT * FROM n) AND dst_id IN (SELECT * FROM n)"""),
    "search_neighborhood": (lambda c: t.search_neighborhood(c, "open_file", 2), f"""WITH RECURSIVE l AS (SELECT src_id AS src, dst_id AS dst FROM edges UNION SELECT dst_id, src_id FROM edges), c(id, hops) AS (SELECT id, CAST(0 AS BIGINT) FROM symbols WHERE contains(lower(name), 'open_file') UNION SELECT dst, hops + 1 FROM c JOIN l ON src = id WHERE hops < 2)
SELECT id, min(hops) AS hops FROM c GROUP BY id ORDER BY hops, id LIMIT 500"""),
    "trace_paths": (lambda c: t.trace_paths(c, START, GOAL), f"""WITH RECURSIVE e AS (SELECT src_id, dst_id, confidence FROM edges WHERE edge_kind = 'CALLS'), p(path, confidence, e) AS (SELECT [CAST({START} AS BIGINT)], CAST(1 AS DOUBLE), CAST({START} AS BIGINT) UNION ALL SELECT list_append(path, dst_id), p.confidence * e.confidence, dst_id FROM p JOIN e ON src_id = p.e WHERE len(path) <= 6 AND p.e <> {GOAL} AND NOT list_contains(path, dst_id))
SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS BIGINT) AS hops, round(confidence, 6) AS confidence FROM p WHERE e = {GOAL} AND len(path) > 1 ORDER BY hops, path LIMIT 5"""),
    "import_depth": (t.import_depth, f"""WITH RECURSIVE i AS (SELECT DISTINCT file_id AS src, resolved_file_id AS dst FROM imports WHERE resolved_file_id IS NOT NULL AND file_id <> resolved_file_id), tops AS (SELECT id FROM files WHERE id NOT IN (SELECT dst FROM i)), {reach('c', 'SELECT id FROM tops', 'SELECT src, dst FROM i', 6)}
SELECT node_id AS file_id, min(depth) AS depth FROM c GROUP BY node_id UNION ALL SELECT id, 0 FROM tops"""),
    "cheapest_imports": (lambda c: t.cheapest_imports(c, 4), """WITH RECURSIVE i AS (SELECT file_id AS src, resolved_file_id AS dst, 1 / greatest(max(confidence), 0.1) AS c FROM imports WHERE resolved_file_id IS NOT NULL GROUP BY ALL), p(f, cost, n) AS (SELECT CAST(4 AS BIGINT), CAST(0 AS DOUBLE), 0 UNION ALL SELECT dst, cost + c, n + 1 FROM p JOIN i ON src = f WHERE n < 4)
SELECT f AS file_id, round(min(cost), 6) AS cost FROM p GROUP BY f"""),
    "communities": (_lab, f"WITH {LAB} SELECT * FROM lab"),
    "community_details": (lambda c: g.community_details(c, _lab(c)), f"""WITH {LAB}, {IN_LAB}, m AS (SELECT community, count(*) AS members, count(*) FILTER (is_exported) AS api FROM lab JOIN symbols s ON s.id = lab.id GROUP BY community),
d AS (SELECT *, (SELECT count(*) FROM j WHERE a = b AND a = m.community) AS internal, (SELECT count(*) FROM j WHERE a <> b AND (a = m.community OR b = m.community)) AS external FROM m)
SELECT *, CASE WHEN internal + external = 0 THEN 0 ELSE round(internal / (internal + external), 6) END AS cohesion, CASE WHEN internal + external = 0 THEN 0 ELSE round(external / (internal + external), 6) END AS coupling FROM d"""),
    "community_graph": (lambda c: g.community_graph(c, _lab(c)), f"WITH {LAB}, {IN_LAB} SELECT a AS src, b AS dst, count(*) AS weight FROM j WHERE a <> b GROUP BY ALL"),
    "community_keywords": (lambda c: g.community_keywords(c, _lab(c)), rf"""WITH {LAB}, k AS (SELECT community, unnest(regexp_split_to_array(qualified_name, '[.:\\/_]+')) AS word FROM lab JOIN symbols s ON s.id = lab.id), n AS (SELECT community, word, count(*) AS n FROM k WHERE length(word) > 2 AND NOT regexp_full_match(word, '[0-9]+') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, word) AS rn FROM n) SELECT community, string_agg(word, ',' ORDER BY rn) AS keywords FROM r WHERE rn <= 5 GROUP BY community"""),
    "processes": (g.processes, _processes(10)),
    "process_steps": (lambda c: g.process_steps(g.processes(c)), f"SELECT entry AS process_id, CAST(i - 1 AS BIGINT) AS step, CAST(string_split(trace, '>')[i] AS BIGINT) AS symbol_id FROM (SELECT *, unnest(range(1, steps + 1)) AS i FROM ({_processes(10)}))"),
    "evidence_path": (lambda c: g.beam(c, c.symbols.where(F.col("name") == NAME).select("id")), _beam(5, 5)),
    "knowledge_nodes": (lambda c: k.nodes(c).select("id", "label", "name", F.to_json("properties").alias("properties")), """SELECT 'file:' || id AS id, 'File' AS label, path AS name, '{"language":"' || language || '","repo":"' || repo_label || '"}' AS properties FROM files
UNION ALL SELECT 'sym:' || id, kind, name, '{"qualified_name":"' || qualified_name || '","exported":"' || is_exported || '"}' FROM symbols"""),
    "knowledge_edges": (k.relationships, """SELECT src || '--' || type || '--' || dst AS id, src, dst, type, max(confidence) AS confidence FROM (SELECT 'sym:' || src_id AS src, 'sym:' || dst_id AS dst, edge_kind AS type, confidence FROM edges UNION ALL SELECT 'file:' || file_id, 'sym:' || id, 'DEFINES', 1.0 FROM symbols) GROUP BY src, type, dst"""),
    "symbol_context": (lambda c: k.symbol_context(c, FLOW), f"""WITH e AS (SELECT *, CASE WHEN edge_kind = 'CALLS' THEN 'calls' WHEN edge_kind IN ('EXTENDS', 'IMPLEMENTS') THEN 'inheritance' WHEN edge_kind IN ('IMPORTS', 'USES') THEN 'imports' WHEN starts_with(edge_kind, 'ACCESSES') THEN 'accesses' ELSE 'other' END AS category FROM edges)
SELECT category, 'out' AS direction, dst_id AS other FROM e WHERE src_id = {FLOW} UNION SELECT category, 'in', src_id FROM e WHERE dst_id = {FLOW} UNION SELECT 'data_flow', 'out', dst_symbol_id FROM data_flows WHERE src_symbol_id = {FLOW} UNION SELECT 'data_flow', 'in', src_symbol_id FROM data_flows WHERE dst_symbol_id = {FLOW}
UNION SELECT 'structure', 'both', id FROM symbols WHERE file_id IN (SELECT file_id FROM symbols WHERE id = {FLOW}) AND id <> {FLOW}"""),
    "folder_tree": (lambda c: k.folders(c.files.select("path")), "SELECT DISTINCT array_to_string(p[1:i], '/') AS u, array_to_string(p[1:i + 1], '/') AS v FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path, '/') AS p FROM files))"),
    "shortest_tree_path": (lambda c: k.shortest_path(k.folders(c.files.select("path")), LEAF, OTHER_LEAF), f"""WITH RECURSIVE l AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS u, array_to_string(p[1:i + 1], '/') AS v FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path, '/') AS p FROM files))), b AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
w(path, e) AS (SELECT ['{LEAF}'], '{LEAF}' UNION ALL SELECT list_append(path, v), v FROM w JOIN b ON u = e WHERE len(path) <= 4 AND NOT list_contains(path, v)) SELECT array_to_string(path, ' > ') AS path, len(path) - 1 AS hops FROM w WHERE e = '{OTHER_LEAF}' ORDER BY hops, path LIMIT 1"""),
    "c3_linearisation": (lambda c: g.c3(c.heritage), None),
}
