"""Change-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import history as q
from sparkloom.queries.graph import LAST_FILES, last_commit_files

PATH, SYMBOL, AS_OF = "store/sync/f4.go", 42, 1_000_000_000
JOINED = "(SELECT x.*, c.author_name, c.author_email, c.timestamp, c.hash, c.message FROM file_commits x JOIN commits c ON c.hash = x.commit_hash)"
AUTHORS = """SELECT author_email AS email, max_by(author_name, (timestamp, hash)) AS name, count(*) AS commit_count, CAST(coalesce(sum(a), 0) AS BIGINT) AS lines_added, CAST(coalesce(sum(r), 0) AS BIGINT) AS lines_removed, min(timestamp) AS first_commit, max(timestamp) AS last_commit
FROM commits c LEFT JOIN (SELECT commit_hash, sum(lines_added) AS a, sum(lines_removed) AS r FROM file_commits GROUP BY commit_hash) l ON l.commit_hash = c.hash GROUP BY author_email"""
OWN = f"(SELECT path FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.id = {SYMBOL})"
SMART = f"""
WITH own AS (SELECT commit_hash FROM file_commits WHERE file_path IN {OWN}),
g AS (SELECT file_path AS other_path, count(DISTINCT commit_hash) AS shared FROM file_commits WHERE commit_hash IN (SELECT commit_hash FROM own) AND file_path NOT IN {OWN} GROUP BY 1),
l AS (SELECT x.file_id AS sf, y.file_id AS df FROM edges e JOIN symbols x ON x.id = e.src_id JOIN symbols y ON y.id = e.dst_id WHERE x.file_id <> y.file_id),
m AS (SELECT file_id FROM symbols WHERE id = {SYMBOL}),
st AS (SELECT path AS other_path, true AS s FROM files WHERE id IN (SELECT df FROM l WHERE sf IN (SELECT file_id FROM m) UNION SELECT sf FROM l WHERE df IN (SELECT file_id FROM m)))
SELECT other_path, coalesce(shared, 0) AS shared, CASE WHEN shared IS NULL THEN 'static_only' WHEN s IS NULL THEN 'git_only' ELSE 'both' END AS signal_type FROM g FULL JOIN st USING (other_path) ORDER BY shared DESC, other_path LIMIT 10
"""

QUERIES = {
    "authors": (q.authors, AUTHORS),
    "top_authors": (q.top_authors, f"SELECT * FROM ({AUTHORS}) ORDER BY commit_count DESC, email LIMIT 10"),
    "file_history": (lambda c: q.file_history(c, PATH), f"SELECT hash, author_name, timestamp, message, lines_added, lines_removed FROM {JOINED} x WHERE file_path = '{PATH}' ORDER BY timestamp DESC, hash LIMIT 20"),
    "change_hotspots": (q.change_hotspots, "SELECT file_path, count(*) AS changes, CAST(sum(lines_added + lines_removed) AS BIGINT) AS churn FROM file_commits GROUP BY file_path ORDER BY changes DESC, churn DESC, file_path LIMIT 20"),
    "co_change": (q.co_change, "SELECT x.file_path, y.file_path AS other_path, count(*) AS shared FROM file_commits x JOIN file_commits y ON x.commit_hash = y.commit_hash AND x.file_path < y.file_path GROUP BY ALL ORDER BY shared DESC, 1, 2 LIMIT 20"),
    "co_change_of_file": (lambda c: q.co_change(c, PATH), f"SELECT file_path AS other_path, count(*) AS shared FROM file_commits WHERE file_path <> '{PATH}' AND commit_hash IN (SELECT commit_hash FROM file_commits WHERE file_path = '{PATH}') GROUP BY 1 ORDER BY shared DESC, 1 LIMIT 20"),
    "smart_co_change": (lambda c: q.smart_co_change(c, SYMBOL), SMART),
    "git_stats": (q.git_stats, "SELECT (SELECT count(*) FROM commits) AS commits, (SELECT count(DISTINCT author_email) FROM commits) AS authors, (SELECT count(*) FROM file_commits) AS file_commits, (SELECT count(DISTINCT file_path) FROM file_commits) AS files"),
    "symbol_ownership": (lambda c: q.symbol_ownership(c, SYMBOL), f"SELECT author_name, count(*) AS commits, max(timestamp) AS last_change, min_by(hash, (timestamp, hash)) AS first_hash, count(*) OVER () AS authors FROM {JOINED} x WHERE file_path IN {OWN} GROUP BY author_name ORDER BY commits DESC, author_name LIMIT 5"),
    "change_risk": (lambda c: q.change_risk(c, AS_OF), f"""WITH g AS (SELECT file_path, count(*) AS commits, count(DISTINCT author_email) AS authors, min(timestamp) AS f FROM {JOINED} x GROUP BY file_path), s AS (SELECT file_path, commits, authors, round(CAST(commits AS DOUBLE) / greatest(1, floor(({AS_OF} - f) / 86400)) * authors, 6) AS score FROM g)
SELECT *, CASE WHEN score > 10 THEN 'HIGH' WHEN score > 3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s"""),
    "find_experts": (lambda c: q.find_experts(c, PATH), f"SELECT author_name, count(*) AS commits, CAST(sum(lines_added + lines_removed) AS BIGINT) AS lines, max(timestamp) AS last_active FROM {JOINED} x WHERE file_path = '{PATH}' GROUP BY author_name ORDER BY commits DESC, lines DESC, author_name LIMIT 5"),
    "blame_runs": (q.blame_runs, "SELECT file_id, author_name, commit_hash, min(line_number) AS first_line, max(line_number) AS last_line FROM (SELECT *, line_number - row_number() OVER (PARTITION BY file_id, author_name, commit_hash ORDER BY line_number) AS island FROM blame_lines) GROUP BY file_id, author_name, commit_hash, island"),
    "symbol_blame": (q.symbol_blame, """WITH n AS (SELECT s.id, author_name, count(*) AS n, max(last_changed_at) AS t FROM symbols s JOIN blame_lines b ON b.file_id = s.file_id AND b.line_number BETWEEN s.line AND s.line + 100 GROUP BY ALL)
SELECT id, min_by(author_name, (-n, author_name)) AS primary_author, max(t) AS last_changed_at FROM n GROUP BY id"""),
    "detect_changes": (lambda c: q.detect_changes(c, 995_000_000), f"""SELECT s.id, s.name, f.path, coalesce(u, 0) AS affected FROM symbols s JOIN files f ON f.id = s.file_id LEFT JOIN (SELECT dst_id, count(DISTINCT src_id) AS u FROM edges WHERE edge_kind = 'CALLS' GROUP BY dst_id) e ON e.dst_id = s.id
WHERE f.path IN (SELECT file_path FROM {JOINED} x WHERE timestamp >= 995000000)"""),
    "contract_changes": (lambda c: q.contract_changes(c, c.symbols.join(c.files.select(F.col("id").alias("file_id"), "path"), "file_id").join(last_commit_files(c), "path", "left_semi").select("path", F.concat(F.lit("def "), "name", F.lit("():")).alias("line"))), f"""WITH n AS (SELECT s.*, path FROM symbols s JOIN files f ON f.id = s.file_id)
SELECT x.id, x.name, x.path, CASE WHEN bool_or(contains('def ' || y.name || '():', x.name)) THEN 'NEW' ELSE 'MODIFIED' END AS change FROM n x JOIN n y ON y.path = x.path AND y.path IN ({LAST_FILES}) WHERE x.is_exported GROUP BY ALL"""),
}
