"""The catalog tables as views over the star-schema test tables.

One text serves Spark and DuckDB; ``EPOCH(x)`` and ``MS(x)`` stand for the dialects' unix seconds
and milliseconds. ``sql`` puts the views that a statement needs before it as common table expressions.
"""

from __future__ import annotations

import re

VERBS = "get read write open close lock test error handle config create spawn query new process parse await drop _hidden on run free expect log"
NOUNS = "user file mutex state token cache stream pool key route thread buffer env index queue"

VIEWS = {
    "files": """
SELECT file_id AS id,
  concat(split_part('core api tests web store net ui tools', ' ', CAST(file_id % 8 + 1 AS INT)), '/', split_part('auth data model view sync', ' ', CAST(file_id % 5 + 1 AS INT)), '/',
    CASE WHEN file_id % 8 = 2 THEN 'test_' ELSE '' END, 'f', CAST(file_id AS STRING), split_part('.py .rs .ts .java .go', ' ', CAST(file_id % 5 + 1 AS INT))) AS path,
  file_id * 7919 % 1000003 AS hash, split_part('python rust typescript java go', ' ', CAST(file_id % 5 + 1 AS INT)) AS language,
  1700000000 + file_id AS mtime, CAST(1700000000 AS BIGINT) AS indexed_at, concat('repo', CAST(file_id % 3 AS STRING)) AS repo_label
FROM (SELECT DISTINCT CAST(floor(p_partkey / 10) AS BIGINT) AS file_id FROM part) x""",
    "symbols": f"""
SELECT id, file_id, name, concat(split_part('core api tests web store net ui tools', ' ', CAST(file_id % 8 + 1 AS INT)), '.f', CAST(file_id AS STRING), '.', name) AS qualified_name,
  split_part('Function Method Class Variable Interface', ' ', CAST(p_size % 5 + 1 AS INT)) AS kind, id % 10 * 20 + 1 AS line, CAST(p_size AS BIGINT) AS col,
  p_size % 2 = 0 AS is_exported, id AS scope_id, CASE WHEN p_size % 5 = 1 THEN id - id % 10 END AS owner_symbol_id
FROM (SELECT p_partkey AS id, CAST(floor(p_partkey / 10) AS BIGINT) AS file_id, p_size,
  concat(split_part('{VERBS}', ' ', CAST(p_partkey % 24 + 1 AS INT)), '_', split_part('{NOUNS}', ' ', CAST(CAST(floor(p_partkey / 24) AS BIGINT) % 15 + 1 AS INT))) AS name FROM part) x""",
    "edges": """
SELECT (src * 10000000 + dst) * 8 + k AS id, src AS src_id, dst AS dst_id, split_part('CALLS EXTENDS ACCESSES_read IMPORTS USES', ' ', k + 1) AS edge_kind,
  round(max(1 - l_discount), 2) AS confidence, CAST(floor(src / 10) AS BIGINT) AS file_id, dst % 200 AS line
FROM (SELECT *, CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 0 WHEN l_returnflag = 'A' AND l_quantity >= 49 THEN 1 WHEN l_returnflag = 'A' AND l_quantity >= 46 THEN 2
    WHEN l_returnflag = 'N' AND l_quantity >= 47 THEN 3 WHEN l_returnflag = 'R' AND l_quantity >= 44 THEN 4 END AS k
  FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst, l_returnflag, l_quantity, l_discount FROM lineitem) a) b
WHERE k IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY src, dst, k""",
    "calls": """
SELECT e.id, e.file_id, e.src_id AS caller_scope_id, s.name AS callee_name, CASE e.dst_id % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'client' END AS receiver,
  CASE WHEN e.dst_id % 5 <> 0 THEN e.dst_id END AS resolved_symbol_id, CASE WHEN e.dst_id % 5 <> 0 THEN e.confidence ELSE 0.0 END AS confidence, e.line, e.dst_id % 80 AS col
FROM edges e JOIN symbols s ON s.id = e.dst_id WHERE e.edge_kind = 'CALLS'""",
    "imports": """
SELECT e.id, e.file_id, f.path AS source, s.name AS imported_name, s.name AS local_name, CASE WHEN e.dst_id % 4 <> 0 THEN s.file_id END AS resolved_file_id, e.confidence
FROM edges e JOIN symbols s ON s.id = e.dst_id JOIN files f ON f.id = s.file_id WHERE e.edge_kind = 'IMPORTS'""",
    "exports": "SELECT id, file_id, name AS exported_name, id AS symbol_id, col % 10 = 0 AS is_default FROM symbols WHERE is_exported",
    "heritage": """
SELECT e.id, e.file_id, e.src_id AS child_symbol_id, CASE WHEN e.dst_id % 6 <> 0 THEN e.dst_id END AS parent_symbol_id, s.name AS parent_name,
  CASE WHEN e.dst_id % 2 = 0 THEN 'extends' ELSE 'implements' END AS heritage_kind, e.confidence, e.line
FROM edges e JOIN symbols s ON s.id = e.dst_id WHERE e.edge_kind = 'EXTENDS'""",
    "data_flows": """
SELECT id, file_id, src_id AS src_symbol_id, dst_id AS dst_symbol_id, split_part('assignment property_write param_pass binding', ' ', CAST(dst_id % 4 + 1 AS INT)) AS flow_kind,
  concat('v', CAST(dst_id % 50 AS STRING)) AS var_name, line, dst_id % 80 AS col, confidence
FROM edges WHERE edge_kind IN ('CALLS', 'ACCESSES_read')""",
    "commits": """
SELECT CAST(o_orderkey AS STRING) AS hash, concat('author ', CAST(o_custkey % 40 AS STRING)) AS author_name, concat('a', CAST(o_custkey % 40 AS STRING), '@example.org') AS author_email,
  EPOCH(o_orderdate) AS timestamp, concat('change ', o_orderpriority) AS message FROM orders""",
    "file_commits": """
SELECT f.path AS file_path, CAST(x.l_orderkey AS STRING) AS commit_hash, CAST(sum(l_quantity) AS BIGINT) AS lines_added, CAST(sum(l_linenumber) AS BIGINT) AS lines_removed, min(l_linenumber) = 1 AS is_creation
FROM lineitem x JOIN files f ON f.id = CAST(floor(x.l_partkey / 10) AS BIGINT) GROUP BY f.path, x.l_orderkey""",
    "blame_lines": """
SELECT f.id AS file_id, row_number() OVER (PARTITION BY f.id ORDER BY floor(c.timestamp / 8000000), c.hash) AS line_number, c.hash AS commit_hash, c.author_name, c.timestamp AS last_changed_at
FROM file_commits x JOIN files f ON f.path = x.file_path JOIN commits c ON c.hash = x.commit_hash""",
    "routes": """
SELECT page_id AS id, split_part('GET POST PUT DELETE', ' ', CAST(page_id % 4 + 1 AS INT)) AS method, concat('/api/', split_part('users items carts orders', ' ', CAST(page_id % 4 + 1 AS INT)), '/', CAST(page_id % 50 AS STRING)) AS path,
  concat('api/auth/f', CAST(page_id % 30 AS STRING), '.py') AS file_path, CASE WHEN page_id % 2 = 0 THEN 'express' ELSE 'flask' END AS framework, page_id % 120 AS line, page_id * 11 % 2600 AS handler_symbol_id FROM pages""",
    "evidence": """
SELECT concat('ev_', CAST(event_id AS STRING)) AS id, event_type AS kind, concat('f', CAST(user_id AS STRING)) AS file, event_id % 300 AS start_line, event_id % 80 AS start_col, event_id % 300 + event_id % 4 AS end_line, event_id % 80 + 5 AS end_col,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('t', CAST(user_id % 17 AS STRING)) END AS target_ref, CASE WHEN event_id % 3 = 0 THEN 'heuristic' ELSE 'tree' END AS extractor, props AS raw, concat(' ', props, ' ') AS normalized,
  CAST(event_id % 107 AS DOUBLE) / 100 AS confidence, CAST(event_id % 11 AS DOUBLE) / 10 AS stability, CAST(event_id % 21 AS DOUBLE) / 20 AS entropy, MS(ts) AS timestamp_ms,
  split_part('Candidate Normalized Deduplicated Enriched Calibrated Committed Updated', ' ', CAST(event_id % 7 + 1 AS INT)) AS state, event_id FROM events""",
    "evidence_edges": "SELECT concat('ev_', CAST(event_id AS STRING)) AS from_id, concat('ev_', CAST(event_id * 3 % 5000 AS STRING)) AS to_id, CASE WHEN event_id % 4 = 0 THEN 'contradicts' ELSE 'supports' END AS edge_type FROM events",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
EPOCH = {"duck": (r"CAST(floor(epoch(\1)) AS BIGINT)", r"CAST(floor(epoch(\1)) AS BIGINT) * 1000"), "spark": (r"unix_timestamp(CAST(\1 AS TIMESTAMP))", r"unix_timestamp(CAST(\1 AS TIMESTAMP)) * 1000")}


def dialect(text: str, name: str) -> str:
    seconds, ms = EPOCH[name]
    return re.sub(r"\bMS\((\w+)\)", ms, re.sub(r"\bEPOCH\((\w+)\)", seconds, text))


def needed(text: str, known: dict[str, str] = VIEWS) -> list[str]:
    """Views that the text uses, each after those that it uses itself."""
    out: list[str] = []
    for name, body in known.items():
        if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
            out += [x for x in [*needed(body, known), name] if x not in out]
    return list(dict.fromkeys(out))


def sql(body: str) -> str:
    """body for DuckDB, with the views before it; body may begin with its own WITH [RECURSIVE]."""
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed(body))
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    rest = body[own.end() :] if own else body
    if not views:
        return dialect(body, "duck")
    return dialect(f"WITH {own[1] or '' if own else ''}{views}{', ' if own else ' '}{rest}", "duck")
