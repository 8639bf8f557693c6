"""Search, evidence, resolution and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import communities as g
from sparkloom.operators import evidence as e
from sparkloom.operators import extract as x
from sparkloom.operators import resolve, search
from sparkloom.queries.graph import CALLS, _beam, _processes, reach

WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"


def _bm25(source: str, key: str, text: str, terms: list[str], prefix: bool) -> str:
    match = lambda t: f"starts_with(w, '{t}')" if prefix else f"w = '{t}'"
    tf = " UNION ALL ".join(f"SELECT {key}, dl, '{t}' AS term, len(list_filter(ws, lambda w: {match(t)})) AS tf FROM bw" for t in terms)
    return f"""bw AS (SELECT {key}, ws, len(ws) AS dl FROM (SELECT {key}, {WORDS.format(text)} AS ws FROM {source}) q0), bs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM bw), bt AS (SELECT * FROM ({tf}) q1 WHERE tf > 0), bd AS (SELECT term, count(*) AS df FROM bt GROUP BY term),
bm AS (SELECT {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM bt JOIN bd USING (term) CROSS JOIN bs GROUP BY {key})"""


def _search(query: str, terms: list[str]) -> str:
    return f"""{_bm25('symbols', 'id', "concat_ws(' ', name, qualified_name, kind)", terms, True)}, tp AS (SELECT * FROM bm ORDER BY score DESC, id LIMIT 10),
hit AS (SELECT tp.id, s.name, round(score * CASE WHEN lower(name) = '{query}' THEN 2.0 WHEN contains(lower(name), '{query}') THEN 1.2 ELSE 1.0 END * CASE WHEN is_exported THEN 1.5 ELSE 1.0 END, 6) AS score FROM tp JOIN symbols s ON s.id = tp.id)"""


SYMBOLS = _search("read_file", ["read", "file"])
COSINE = "round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5)"
NEAREST = f"SELECT v.vec_id, {COSINE} AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = {{0}}) q WHERE v.vec_id <> {{0}} ORDER BY similarity DESC, v.vec_id LIMIT {{1}}"
BOUND = r"(?:(?:^|[_:.\-/ ]){0}(?:$|[_:.\-/ A-Z])|{1}(?:$|[_:.\-/ A-Z]))"
SESSION = "|".join(BOUND.format(w, w.capitalize()) for w in sorted({"auth", "login", "signin", "session"}))
RAW = "CASE WHEN extractor <> 'heuristic' THEN 0.9 ELSE 0.4 END * CASE WHEN found THEN 1.0 ELSE 0.65 END * stability * (1 - 0.15 * entropy)"
PATTERNS = """o AS (SELECT file, kind, row_number() OVER (PARTITION BY file ORDER BY timestamp_ms, event_id) AS p FROM evidence), pr AS (SELECT a.kind AS a, b.kind AS b, a.file FROM o a JOIN o b ON a.file = b.file AND a.p < b.p),
pt AS (SELECT a, b, count(*) AS frequency, count(DISTINCT file) / (SELECT count(DISTINCT file) FROM evidence) AS d FROM pr GROUP BY ALL), pat AS (SELECT a, b, frequency, round(d, 6) AS dispersion, round(least(frequency, 100) / 100 * d, 6) AS score FROM pt WHERE frequency >= 3 AND d >= 0.1)"""
LINKED = "lk AS (SELECT k.*, x.kind AS a, y.kind AS b FROM evidence_edges k JOIN evidence x ON x.id = k.from_id JOIN evidence y ON y.id = k.to_id)"
FORBIDDEN = "fb AS (SELECT a || '>' || b AS name, round(count(*) FILTER (edge_type = 'contradicts') / count(*), 6) AS confidence FROM lk GROUP BY a, b HAVING count(*) FILTER (edge_type = 'contradicts') >= 3 AND count(*) FILTER (edge_type = 'contradicts') / count(*) >= {0})"
LAYERS = [("presentation", ["web/", "ui/"]), ("domain", ["core/", "api/"]), ("data", ["store/", "net/"])]
RULES = [("pres-no-data", "presentation", "data", False), ("domain-data", "domain", "data", True), ("data-no-pres", "data", "presentation", False), ("data-no-domain", "data", "domain", False)]
LAYER = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(path, '{p}')''' for p in ps)} THEN '{n}'" for n, ps in LAYERS) + " END"
RULE = "CASE " + " ".join(f"WHEN x.layer = '{a}' AND y.layer = '{b}' THEN '{n if not ok else ''}'" for n, a, b, ok in RULES) + " ELSE '' END"


def _kept(paths: str, cost: str, budget: int) -> str:
    """Recursive part that goes through the paths of each seed in order: a path is kept if it still fits, or if it is the first."""
    return f"""o AS (SELECT *, CAST({cost} AS BIGINT) AS price, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, path) - 1 AS place FROM ({paths})),
k(seed, place, used, cost, kept) AS (SELECT seed, place, price, price, true FROM o WHERE place = 0
  UNION ALL SELECT o.seed, o.place, CASE WHEN used + price <= {budget} THEN used + price ELSE used END, price, used + price <= {budget} FROM k JOIN o ON o.seed = k.seed AND o.place = k.place + 1)"""


BUDGET = f"""p AS (SELECT * FROM ({_beam(5, 5)}) QUALIFY row_number() OVER (PARTITION BY seed, node ORDER BY confidence DESC, path) = 1)"""


PATH_COST = "length(path) + 80 * len(string_split(path, '>')) + 40"


def _bundle(c):
    return g.beam(c, c.symbols.where(F.col("name") == "open_file").select("id"))


def _pages_as_files(c):
    """Pages as text files: half of them Markdown-like, with a heading and links."""
    text = F.concat(F.lit("# Page "), F.col("page_id").cast("string"), F.lit("  #\ntext [a](docs/x.md#top) and [b](https://example.org)\n## Sub "), (F.col("page_id") % 7).cast("string"), F.lit("\n"))
    return c.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), text.alias("content"))


def _routes_source(c):
    i = F.col("page_id").cast("string")
    js = c.pages.select(F.concat(F.lit("s"), i, F.lit(".js")).alias("path"), F.concat(F.lit("const a = 1;\napp.get('/api/"), i, F.lit("', f);\nrouter.post(\"/x/"), i, F.lit("\", g);")).alias("content"))
    py = c.pages.select(F.concat(F.lit("s"), i, F.lit(".py")).alias("path"), F.concat(F.lit("@app.route('/p/"), i, F.lit("', methods=['PUT'])\ndef f(): pass\n@r.get('/q')")).alias("content"))
    nx = c.pages.select(F.concat(F.lit("app/api/u"), i, F.lit("/[id]/route.ts")).alias("path"), F.lit("").alias("content"))
    return js.union(py).union(nx)


QUERIES = {
    "bm25_documents": (lambda c: search.bm25(c.documents, "doc_id", F.col("text"), "the und para"), f"WITH {_bm25('documents', 'doc_id', 'text', ['the', 'und', 'para'], False)} SELECT * FROM bm"),
    "search": (lambda c: search.search(c, "read_file"), f"WITH {SYMBOLS} SELECT * FROM hit"),
    "hybrid_search": (lambda c: search.hybrid_search(c, "read_file"), f"""WITH RECURSIVE {SYMBOLS}, {reach('c', 'SELECT id FROM hit', CALLS, 3)}, n AS (SELECT hit.*, (SELECT count(*) FROM c WHERE root_id = hit.id AND node_id IN (SELECT id FROM hit)) AS r FROM hit)
SELECT id, name, round(score * (1 + 0.3 * r / greatest(max(r) OVER (), 1)), 6) AS score FROM n"""),
    "issue_locator": (lambda c: search.search(c, "parse token"), f"WITH {_search('parse token', ['parse', 'token'])} SELECT * FROM hit"),
    "evidence_search": (lambda c: search.evidence_search(c, "purchase t3"), f"""WITH {_bm25('evidence', 'id', "concat_ws(' ', kind, normalized, file, target_ref)", ['purchase', 't3'], False)} SELECT * FROM bm ORDER BY score DESC, id LIMIT 20"""),
    "semantic_search": (lambda c: search.nearest(c.embeddings, 7), NEAREST.format(7, 10)),
    "rank_fusion": (lambda c: search.fuse(search.ranked(search.nearest(c.embeddings, 7, 30), "vec_id", "similarity"), search.ranked(search.nearest(c.embeddings, 11, 30), "vec_id", "similarity"), "vec_id"), f"""WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY similarity DESC, vec_id) - 1 AS r FROM ({NEAREST.format(7, 30)})), b AS (SELECT vec_id, row_number() OVER (ORDER BY similarity DESC, vec_id) - 1 AS r FROM ({NEAREST.format(11, 30)}))
SELECT vec_id, round(coalesce(0.5 / (61 + a.r), 0) + coalesce(0.5 / (61 + b.r), 0), 9) AS score FROM a FULL JOIN b USING (vec_id)"""),
    "process_search": (lambda c: search.process_search(c, g.process_steps(g.processes(c)), "read token"), f"""WITH st AS (SELECT entry AS process_id, CAST(unnest(string_split(trace, '>')) AS BIGINT) AS id FROM ({_processes(10)})), n AS (SELECT process_id, count(*) FILTER (contains(name, 'read') OR contains(name, 'token')) AS hits, count(*) AS steps FROM st JOIN symbols s ON s.id = st.id GROUP BY process_id)
SELECT * FROM n WHERE hits > 0 ORDER BY hits DESC, steps DESC, process_id LIMIT 20"""),
    "text_relevance": (lambda c: search.text_relevance(c, "token"), rf"""WITH r AS (SELECT id, name, CASE WHEN lower(name) = 'token' THEN 1.0 WHEN starts_with(lower(name), 'token') THEN 0.7 WHEN regexp_matches(name, '{SESSION}') THEN 0.5 WHEN contains(lower(name), 'token') THEN 0.4 ELSE 0 END AS relevance FROM symbols) SELECT id, name, CAST(relevance AS DOUBLE) AS relevance FROM r WHERE relevance > 0 ORDER BY relevance DESC, id LIMIT 50"""),
    "budget_paths": (lambda c: search.within_budget(_bundle(c).withColumn("tokens", (F.col("node") % 97) * 10 + 50), "seed", [(-F.col("confidence")).alias("a"), F.col("path").alias("b")], "tokens", 900), f"WITH RECURSIVE b AS ({_beam(5, 5)}), {_kept('SELECT * FROM b', 'node % 97 * 10 + 50', 900)} SELECT seed, CAST(place AS BIGINT) AS place, cost FROM k WHERE kept"),
    "evidence_bundle": (lambda c: search.bundle(_bundle(c)), f"WITH RECURSIVE {BUDGET}, {_kept('SELECT * FROM p', PATH_COST, 4000)}, n AS (SELECT seed, count(*) AS paths, CAST(sum(cost) AS BIGINT) AS tokens FROM k WHERE kept GROUP BY seed) SELECT n.*, (SELECT round(avg(confidence), 6) FROM p WHERE p.seed = n.seed) AS confidence FROM n"),
    "median_leaf": (lambda c: search.median_leaf(c, 42), "WITH d AS (SELECT id FROM (SELECT src_id AS id FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY id HAVING count(*) <= 1 AND id <> 42), r AS (SELECT id, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS n FROM d) SELECT id FROM r WHERE rn = floor(n / 2) + 1"),
    "query_evidence": (lambda c: e.query(c, kind="error", least=0.5), "SELECT id, kind, file, confidence FROM evidence WHERE kind = 'error' AND confidence >= 0.5 ORDER BY confidence DESC, id LIMIT 50"),
    "file_evidence": (lambda c: e.query(c, file="f17"), "SELECT id, kind, file, start_line, confidence FROM evidence WHERE file = 'f17' ORDER BY start_line, id LIMIT 50"),
    "evidence_stats": (e.stats, "SELECT state, count(*) AS n FROM evidence GROUP BY state"),
    "evidence_merge": (lambda c: e.normalise_and_merge(c.evidence, ["kind", "file", "normalized"]), "SELECT kind, file, trim(normalized) AS normalized, max(confidence) AS confidence, count(*) AS merged, min(id) AS id FROM evidence WHERE trim(normalized) <> '' GROUP BY ALL"),
    "evidence_advance": (lambda c: e.advance(c.evidence, "Enriched").groupBy("state", "new_state", "legal").count().withColumnRenamed("count", "n"), "SELECT state, CASE WHEN state IN ('Candidate', 'Normalized', 'Deduplicated') THEN 'Enriched' ELSE state END AS new_state, state IN ('Candidate', 'Normalized', 'Deduplicated') AS legal, count(*) AS n FROM evidence GROUP BY ALL"),
    "calibrate": (lambda c: e.calibrate(c, c.evidence.where("event_id % 5 = 0").select("target_ref")), f"""WITH r AS (SELECT DISTINCT target_ref FROM evidence WHERE event_id % 5 = 0), x AS (SELECT *, target_ref IN (SELECT target_ref FROM r) AS found FROM evidence)
SELECT id, round(greatest(0, least({RAW}, CASE WHEN extractor <> 'heuristic' THEN 1.0 ELSE 0.6 END)), 6) AS confidence FROM x"""),
    "text_entropy": (lambda c: e.text_entropy(c.evidence, "id", "raw"), """WITH ch AS (SELECT id, raw, unnest(string_split(raw, '')) AS c FROM evidence), n AS (SELECT id, length(any_value(raw)) AS len, c, count(*) AS k FROM ch GROUP BY id, c)
SELECT id, CASE WHEN count(*) = 1 THEN 0 ELSE round(-sum((k / len) * log2(k / len)) / log2(count(*)), 6) END AS entropy FROM n GROUP BY id"""),
    "evidence_violations": (e.violations, "WITH v AS (SELECT id, CASE WHEN start_line = end_line AND start_col >= end_col AND extractor <> 'heuristic' THEN 'I1' WHEN target_ref = '' AND kind IN ('signup', 'purchase') THEN 'I2' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'I3' END AS violation FROM evidence) SELECT * FROM v WHERE violation IS NOT NULL"),
    "evidence_rescan": (lambda c: e.rescan(c.evidence.where("event_id % 3 <> 0"), c.evidence.where("event_id % 3 <> 1").withColumn("confidence", F.round(1 - F.col("confidence"), 6))), """WITH a AS (SELECT id, confidence, stability FROM evidence WHERE event_id % 3 <> 0), b AS (SELECT id, round(1 - confidence, 6) AS c2 FROM evidence WHERE event_id % 3 <> 1)
SELECT id, greatest(confidence, c2) AS confidence, round(CASE WHEN confidence IS NOT NULL AND c2 IS NOT NULL THEN least(stability + 0.1, 1) ELSE coalesce(stability, 1) END, 6) AS stability, CASE WHEN confidence IS NOT NULL AND c2 IS NOT NULL THEN 'seen' WHEN c2 IS NULL THEN 'missing' ELSE 'new' END AS status FROM a FULL JOIN b USING (id)"""),
    "pattern_mine": (e.mine_patterns, f"WITH {PATTERNS} SELECT * FROM pat"),
    "pattern_impact": (lambda c: e.pattern_evidence(c, "view", "purchase").agg(F.count("*").alias("n")), "WITH f AS (SELECT file FROM evidence GROUP BY file HAVING min(CASE WHEN kind = 'view' THEN (timestamp_ms, event_id) END) < max(CASE WHEN kind = 'purchase' THEN (timestamp_ms, event_id) END)) SELECT count(*) AS n FROM evidence WHERE kind IN ('view', 'purchase') AND file IN (SELECT file FROM f)"),
    "constraints": (lambda c: e.synthesise_constraints(c, e.mine_patterns(c)), f"""WITH {PATTERNS}, {LINKED}, {FORBIDDEN.format(0.7)}, rq AS (SELECT name, max(score) AS confidence FROM (SELECT unnest([a, b]) AS name, score FROM pat WHERE score >= 0.7) GROUP BY name)
SELECT name, 'ForbiddenTransition' AS kind, confidence FROM fb UNION ALL SELECT name, 'RequiredProperty', confidence FROM rq"""),
    "constraint_check": (lambda c: e.constraint_violations(c, e.synthesise_constraints(c, e.mine_patterns(c))), f"""WITH {LINKED}, {FORBIDDEN.format(0.7)} SELECT DISTINCT a || '>' || b AS "constraint", from_id AS evidence_id FROM lk WHERE edge_type = 'supports' AND a || '>' || b IN (SELECT name FROM fb)"""),
    "boundary_violations": (lambda c: e.boundary_violations(c, LAYERS, RULES), f"""WITH a AS (SELECT s.id, path, {LAYER} AS layer FROM symbols s JOIN files f ON f.id = s.file_id), v AS (SELECT {RULE} AS rule, x.path AS from_file, y.path AS to_file, edge_kind FROM edges k JOIN a x ON x.id = k.src_id JOIN a y ON y.id = k.dst_id)
SELECT rule, from_file, to_file, edge_kind, count(*) AS n FROM v WHERE rule <> '' GROUP BY ALL"""),
    "scan_risk": (e.scan_risk, "SELECT round(0.6 * (SELECT count(*) FILTER (resolved_symbol_id IS NULL) / count(*) FROM calls) + 0.4 * least((SELECT count(*) FROM edges) / (SELECT count(*) FROM symbols), 10) / 10, 6) AS risk"),
    "evidence_stability": (e.stability_after, "SELECT id, round(stability + 0.1 * (1 - stability), 6) AS seen, round(stability * 0.9, 6) AS missed FROM evidence"),
    "resolve_imports": (lambda c: resolve.resolve_imports(c.imports.join(c.files.select(F.col("id").alias("file_id"), "language"), "file_id").withColumn("source", F.regexp_replace(F.regexp_replace("source", r"\.\w+$", ""), "/", F.when(F.col("language") == "python", ".").otherwise("/"))), c.files), r"""WITH i AS (SELECT i.id, regexp_replace(source, '\.\w+$', '') AS p, language FROM imports i JOIN files f ON f.id = i.file_id), c AS (
SELECT id, unnest(CASE language WHEN 'python' THEN [{'o': 0, 'p': p || '.py', 'c': 0.95}, {'o': 1, 'p': p || '/__init__.py', 'c': 0.9}] WHEN 'typescript' THEN [{'o': 0, 'p': p || '.ts', 'c': 0.95}, {'o': 1, 'p': p || '.tsx', 'c': 0.95}] WHEN 'rust' THEN [{'o': 0, 'p': 'src/' || p || '.rs', 'c': 0.95}, {'o': 2, 'p': p || '.rs', 'c': 0.85}] WHEN 'go' THEN [{'o': 0, 'p': p || '.go', 'c': 0.9}] WHEN 'java' THEN [{'o': 0, 'p': 'src/main/java/' || p || '.java', 'c': 0.95}, {'o': 1, 'p': p || '.java', 'c': 0.9}] END) AS k FROM i),
m AS (SELECT c.id, min_by(f.id, k.o) AS file, min_by(k.c, k.o) AS conf FROM c JOIN files f ON f.path = k.p GROUP BY c.id)
SELECT i.id, m.file AS resolved_file_id, CAST(coalesce(conf, 0) AS DOUBLE) AS confidence FROM i LEFT JOIN m ON m.id = i.id"""),
    "resolve_calls": (resolve.resolve_calls, """WITH c AS (SELECT id AS call_id, file_id, callee_name AS name, receiver FROM calls), t AS (
SELECT call_id, s.id AS symbol_id, 1 AS tier, 1.0 AS confidence FROM c JOIN symbols s ON s.file_id = c.file_id AND s.name = c.name
UNION ALL SELECT call_id, s.id, 2, 0.9 FROM c JOIN imports i ON i.file_id = c.file_id AND i.local_name = c.name JOIN symbols s ON s.file_id = i.resolved_file_id AND s.name = c.name
UNION ALL SELECT call_id, s.id, 3, 0.7 FROM c JOIN symbols s ON s.name = c.name AND s.owner_symbol_id IS NOT NULL WHERE receiver IS NOT NULL
UNION ALL SELECT call_id, w.id, 4, CASE WHEN n = 1 THEN 0.45 ELSE 0.3 END FROM c JOIN (SELECT name, min(id) AS id, count(*) AS n FROM symbols GROUP BY name) w ON w.name = c.name)
SELECT call_id, min_by(symbol_id, (tier, symbol_id)) AS symbol_id, min(tier) AS tier, CAST(min_by(confidence, (tier, symbol_id)) AS DOUBLE) AS confidence FROM t GROUP BY call_id"""),
    "inheritance_edges": (resolve.inheritance_edges, """SELECT DISTINCT h.child_symbol_id AS src, coalesce(parent_symbol_id, a.id, b.id) AS dst, CASE WHEN heritage_kind = 'implements' THEN 'IMPLEMENTS' ELSE 'EXTENDS' END AS edge_kind FROM heritage h
LEFT JOIN (SELECT file_id, name, min(id) AS id FROM symbols GROUP BY ALL) a ON a.file_id = h.file_id AND a.name = h.parent_name LEFT JOIN (SELECT name, min(id) AS id FROM symbols GROUP BY name) b ON b.name = h.parent_name WHERE coalesce(parent_symbol_id, a.id, b.id) <> child_symbol_id"""),
    "define_edges": (resolve.define_edges, "SELECT file_id AS src, id AS dst, 'DEFINES' AS edge_kind FROM symbols"),
    "back_fill_calls": (resolve.back_fill, "SELECT c.id AS call_id, min_by(s.id, (NOT is_exported, s.id)) AS symbol_id, CAST(CASE WHEN bool_or(is_exported) THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM calls c JOIN symbols s ON s.name = c.callee_name WHERE resolved_symbol_id IS NULL GROUP BY c.id"),
    "markdown_headings": (lambda c: x.markdown_headings(_pages_as_files(c)), "SELECT 'p' || page_id || '.md' AS path, CAST(u[1] AS BIGINT) AS line, CAST(u[2] AS BIGINT) AS level, u[3] AS heading, u[4] AS slug FROM (SELECT page_id, unnest([['1', '1', 'Page ' || page_id, 'page-' || page_id], ['3', '2', 'Sub ' || page_id % 7, 'sub-' || page_id % 7]]) AS u FROM pages)"),
    "markdown_links": (lambda c: x.markdown_links(_pages_as_files(c)), "SELECT 'p' || page_id || '.md' AS path, CAST(2 AS BIGINT) AS line, 'docs/x.md' AS target, 'top' AS anchor FROM pages"),
    "extract_routes": (lambda c: x.routes(_routes_source(c)), """SELECT u[1] AS method, u[2] AS path, u[3] AS file_path, u[4] AS framework, CAST(u[5] AS BIGINT) AS line FROM (SELECT unnest([['GET', '/api/' || page_id, 's' || page_id || '.js', 'express', '2'], ['POST', '/x/' || page_id, 's' || page_id || '.js', 'express', '3'], ['PUT', '/p/' || page_id, 's' || page_id || '.py', 'flask', '1'], ['GET', '/q', 's' || page_id || '.py', 'flask', '3'], ['ANY', '/api/u' || page_id || '/[id]', 'app/api/u' || page_id || '/[id]/route.ts', 'nextjs', '1']]) AS u FROM pages)"""),
    "page_links": (lambda c: x.page_links(c.pages), r"""SELECT page_id, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS href FROM pages"""),
}
