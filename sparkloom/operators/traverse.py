"""Bounded traversals by frontier joins, and the queries built on them.

Every closure is (root_id, node_id, depth) with the least depth; direct neighbours have depth 1. Each
step joins the frontier only, drops what was seen before, and every third step is checkpointed, so
that plans stay short and a cycle ends by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import keywords as kw
from sparkloom.functions.scores import impact_tier, rename_tier
from sparkloom.operators.lookup import CALLABLE, named
from sparkloom.plans.catalog import Catalog
from sparkloom.plans.materialize import checkpoint

MAX_DEPTH = 10


def links(edges: DataFrame, kinds: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """Distinct (src, dst), turned round if reverse."""
    e = edges if kinds is None else edges.where(F.col("edge_kind").isin(kinds))
    a, b = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
    return e.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def call_links(cat: Catalog, reverse: bool = False) -> DataFrame:
    """The links of the calls, written once for all steps of a query in either direction."""
    link = cat.kept("call_links", lambda: checkpoint(links(cat.edges, ["CALLS"])))
    return link.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else link


def closure(roots: DataFrame, link: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """Nodes within ``depth`` links of each root_id, the root left out. ``limit`` stops before a step once a frontier has more rows."""
    if depth > MAX_DEPTH * 2:
        raise ValueError(f"depth {depth} exceeds {MAX_DEPTH * 2}")
    seen = roots.select("root_id", F.col("root_id").alias("node_id"), F.lit(0).cast("long").alias("depth")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(link, frontier.node_id == link.src).select("root_id", F.col("dst").alias("node_id")).distinct()
        frontier = step.join(seen.select("root_id", "node_id"), ["root_id", "node_id"], "left_anti").withColumn("depth", F.lit(d).cast("long"))
        if d % 3 == 0 and d < depth:
            frontier = checkpoint(frontier)
            if frontier.isEmpty() or (limit is not None and frontier.limit(limit + 1).count() > limit):
                seen = seen.unionByName(frontier)
                break
        seen = seen.unionByName(frontier)
        if d % 3 == 0 and d < depth:
            seen = checkpoint(seen)
    return seen.where("depth > 0")


def roots_named(cat: Catalog, name: str) -> DataFrame:
    return cat.symbols.where(F.col("name") == name).select(F.col("id").alias("root_id"))


def callers(cat: Catalog, name: str, depth: int = 3) -> DataFrame:
    return _with_names(cat, closure(roots_named(cat, name), call_links(cat, True), depth))


def callees(cat: Catalog, name: str, depth: int = 3) -> DataFrame:
    return _with_names(cat, closure(roots_named(cat, name), call_links(cat), depth))


def _with_names(cat: Catalog, c: DataFrame) -> DataFrame:
    return c.join(named(cat).select(F.col("id").alias("node_id"), "name", "path"), "node_id")


def impact(cat: Catalog, name: str, depth: int = 3) -> DataFrame:
    return callers(cat, name, depth).withColumn("direction", F.lit("caller")).unionByName(callees(cat, name, depth).withColumn("direction", F.lit("callee")))


def impact_by_kind(cat: Catalog, name: str, kind: str, depth: int = 3) -> DataFrame:
    """Callers whose kind contains the word; ``*`` for all."""
    c = callers(cat, name, depth).join(cat.symbols.select(F.col("id").alias("node_id"), "kind"), "node_id")
    return c if kind == "*" else c.where(F.lower("kind").contains(kind.lower()))


def api_impact(cat: Catalog) -> DataFrame:
    """Each route handler: new callers at depth 1, 2 and 3, score 3, 2 and 1 for each, and its tier."""
    handlers = cat.routes.select(F.col("handler_symbol_id").alias("root_id")).distinct().join(cat.symbols.select(F.col("id").alias("root_id")), "root_id")
    c = closure(handlers, call_links(cat, True), 3).groupBy("root_id").agg(*(F.count_if(F.col("depth") == d).alias(f"d{d}") for d in (1, 2, 3)))
    n = handlers.join(c, "root_id", "left").select("root_id", *(F.coalesce(f"d{d}", F.lit(0)).alias(f"d{d}") for d in (1, 2, 3)))
    return n.withColumn("score", F.expr("3 * d1 + 2 * d2 + d3")).withColumn("tier", impact_tier(F.col("score")))


def explain(cat: Catalog, name: str, depth: int = 3) -> DataFrame:
    """Each definition: callers and callees within depth, parents and children."""
    r = roots_named(cat, name)
    up = closure(r, call_links(cat, True), depth).groupBy("root_id").agg(F.count("*").alias("callers"))
    down = closure(r, call_links(cat), depth).groupBy("root_id").agg(F.count("*").alias("callees"))
    parents = cat.heritage.groupBy(F.col("child_symbol_id").alias("root_id")).agg(F.count("*").alias("parents"))
    children = cat.heritage.where("parent_symbol_id IS NOT NULL").groupBy(F.col("parent_symbol_id").alias("root_id")).agg(F.count("*").alias("children"))
    out = r
    for part in (up, down, parents, children):
        out = out.join(part, "root_id", "left")
    return out.na.fill(0)


def affected_tests(cat: Catalog, name: str) -> DataFrame:
    """id, how: direct callers with a test's name, callers within 5 in test files, and those that call a test framework."""
    up = closure(roots_named(cat, name), call_links(cat, True), 5).groupBy(F.col("node_id").alias("id")).agg(F.min("depth").alias("depth")).join(named(cat).select("id", "name", "path"), "id")
    framework = cat.calls.where(F.substring_index("callee_name", "_", 1).isin(kw.TEST_FRAMEWORK)).select(F.col("caller_scope_id").alias("id")).distinct()
    direct = up.where((F.col("depth") == 1) & kw.is_test_name(F.col("name"))).select("id", F.lit("direct_test_name").alias("how"))
    path = up.where(kw.is_test_path(F.col("path"))).select("id", F.lit("test_path").alias("how"))
    names = up.where(kw.is_test_name(F.col("name"))).select("id", F.lit("test_name").alias("how"))
    return direct.union(path).union(names).union(up.join(framework, "id", "left_semi").select("id", F.lit("test_framework").alias("how")))


def validation_plan(cat: Catalog, name: str) -> DataFrame:
    """Each definition: risk 3 * callers + callees + 2 * heritage, tier and number of files affected."""
    e = explain(cat, name)
    up = closure(roots_named(cat, name), call_links(cat, True), 3).join(cat.symbols.select(F.col("id").alias("node_id"), "file_id"), "node_id")
    files = up.groupBy("root_id").agg(F.countDistinct("file_id").alias("affected_files"))
    return e.join(files, "root_id", "left").select("root_id", F.expr("3 * callers + callees + 2 * (parents + children)").alias("risk"), F.coalesce("affected_files", F.lit(0)).alias("affected_files")).withColumn("tier", impact_tier(F.col("risk")))


def semantic_diff(cat: Catalog, changed: DataFrame) -> DataFrame:
    """Symbols of changed files (path) with their callers within 3, most first."""
    p = changed.toDF("path").distinct()
    r = named(cat).join(p, "path", "left_semi").select(F.col("id").alias("root_id"), "name")
    n = closure(r.select("root_id"), call_links(cat, True), 3).groupBy("root_id").agg(F.count("*").alias("callers"))
    return r.join(n, "root_id", "left").select("root_id", "name", F.coalesce("callers", F.lit(0)).alias("callers"))


def _classified(cat: Catalog, name: str, depth: int, label: Column) -> DataFrame:
    c = closure(roots_named(cat, name), call_links(cat), depth).join(cat.symbols.select(F.col("id").alias("node_id"), "name"), "node_id")
    return c.withColumn("label", label).where("label IS NOT NULL")


def side_effects(cat: Catalog, name: str, depth: int = 2) -> DataFrame:
    """Callees whose name holds a keyword for a side effect, and the first such keyword."""
    return _classified(cat, name, depth, kw.first_word(F.col("name"), kw.EFFECTS))


def error_trace(cat: Catalog, name: str, depth: int = 5) -> DataFrame:
    """First classified callees on each way down; the search goes on only through others."""
    label = kw.first_class(F.col("name"), kw.ERRORS)
    s = cat.symbols.select(F.col("id").alias("node_id"), "name").withColumn("label", label)
    stop = s.where("label IS NOT NULL").select(F.col("node_id").alias("src"))
    through = call_links(cat)
    starts = roots_named(cat, name)
    first = through.join(starts, through.src == starts.root_id, "left_semi")
    onward = through.join(stop, "src", "left_anti").union(first).distinct()
    c = closure(starts, onward, depth).join(s, "node_id").where("label IS NOT NULL")
    return c.groupBy("root_id", "name").agg(F.min("depth").alias("depth"), F.first("label").alias("label"))


def resource_lifecycle(cat: Catalog, name: str, depth: int = 2) -> DataFrame:
    """Each definition: callees that create, use and clean up, and whether what is created is cleaned up."""
    c = _classified(cat, name, depth, kw.first_class(F.col("name"), kw.LIFECYCLE))
    g = c.groupBy("root_id").agg(*(F.count_if(F.col("label") == k).alias(k) for k in kw.LIFECYCLE))
    verdict = F.when((F.col("creation") > 0) & (F.col("cleanup") == 0), "leak").when((F.col("creation") > 0) & (F.col("cleanup") > 0), "complete").otherwise("use_only")
    return g.withColumn("verdict", verdict)


def rename_safety(cat: Catalog, old: str, new: str) -> DataFrame:
    """References within 5, their tier, and definitions that already have the new name."""
    n = closure(roots_named(cat, old), call_links(cat, True), 5).agg(F.countDistinct("node_id").alias("references"))
    taken = cat.symbols.where(F.col("name") == new).agg(F.count("*").alias("collisions"))
    return n.crossJoin(taken).withColumn("tier", rename_tier(F.col("references")))


def edit_scope(cat: Catalog, name: str) -> DataFrame:
    """Definitions, direct callers and callees: id and role."""
    r = roots_named(cat, name)
    up, down = (closure(r, call_links(cat, rev), 1).select(F.col("node_id").alias("id"), F.lit(role).alias("role")) for rev, role in ((True, "caller"), (False, "callee")))
    return r.select(F.col("root_id").alias("id"), F.lit("definition").alias("role")).union(up).union(down).distinct()


def change_coupling(cat: Catalog, name: str) -> DataFrame:
    """Siblings: what the direct callers of a name also call, with the number of callers in common."""
    e = call_links(cat)
    r = roots_named(cat, name).select(F.col("root_id").alias("dst"))
    via = e.join(r, "dst", "left_semi").select("src").distinct()
    return e.join(via, "src", "left_semi").join(r, "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("shared_callers"))


def trace_flow(cat: Catalog, symbol_id: int, depth: int, forward: bool = True) -> DataFrame:
    """Data flow by paths, not nodes: (node_id, flow_kind, depth), a row for each path of up to ``depth`` flows."""
    a, b = ("src_symbol_id", "dst_symbol_id") if forward else ("dst_symbol_id", "src_symbol_id")
    f = cat.data_flows.select(F.col(a).alias("from"), F.col(b).alias("node_id"), "flow_kind")
    level = f.where(F.col("from") == symbol_id).select("node_id", "flow_kind", F.lit(1).cast("long").alias("depth"))
    out = level
    for d in range(2, depth + 1):
        level = level.select(F.col("node_id").alias("from")).join(f, "from").select("node_id", "flow_kind", F.lit(d).cast("long").alias("depth"))
        out = out.unionByName(level)
    return out


def cyclic_core(link: DataFrame, rounds: int) -> DataFrame:
    """link without what can't be on a cycle: ends that nothing enters or leaves are peeled off, again and again."""
    n = None
    for i in range(rounds):
        link = link.join(link.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(link.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        if i % 2:
            link = checkpoint(link)
            now = link.count()
            if now == n:
                break
            n = now
    return link


def call_cycles(cat: Catalog, depth: int = 20) -> DataFrame:
    """Nodes that reach themselves within ``depth`` calls, and the length of the shortest cycle; no self loops."""
    link = cyclic_core(call_links(cat).where("src <> dst"), depth)
    link = checkpoint(link)
    reach = closure(link.select(F.col("src").alias("root_id")).distinct(), link, depth - 1)
    return reach.join(link, (reach.node_id == link.src) & (reach.root_id == link.dst)).groupBy(F.col("root_id").alias("id")).agg((F.min("depth") + 1).alias("length"))


def cycle_pairs(cat: Catalog, depth: int = 6) -> DataFrame:
    """Pairs a < b that reach each other within ``depth`` calls."""
    link = checkpoint(cyclic_core(call_links(cat).where("src <> dst"), depth))
    reach = closure(link.select(F.col("src").alias("root_id")).distinct(), link, depth).select(F.col("root_id").alias("a"), F.col("node_id").alias("b"))
    return reach.where("a < b").join(reach.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


def file_links(cat: Catalog) -> DataFrame:
    at = cat.symbols.select("id", "file_id")
    e = cat.edges.select("src_id", "dst_id", "edge_kind").join(at.toDF("src_id", "src"), "src_id").join(at.toDF("dst_id", "dst"), "dst_id")
    return e.where("src <> dst").groupBy("src", "dst", "edge_kind").agg(F.count("*").alias("weight"))


def module_impact(cat: Catalog, symbol_id: int, depth: int = 2, limit: int = 50) -> DataFrame:
    """Edges among the files within ``depth`` file links of the symbol's file, heaviest first."""
    w = file_links(cat)
    root = cat.symbols.where(F.col("id") == symbol_id).select(F.col("file_id").alias("root_id"))
    near = closure(root, w.select("src", "dst").distinct(), depth).select(F.col("node_id").alias("f")).union(root).distinct()
    paths = cat.files.select("id", "path")
    inner = w.join(near.toDF("src"), "src", "left_semi").join(near.toDF("dst"), "dst", "left_semi")
    return inner.join(paths.toDF("src", "src_path"), "src").join(paths.toDF("dst", "dst_path"), "dst").select("src_path", "dst_path", "edge_kind", "weight").orderBy(F.desc("weight"), "src_path", "dst_path", "edge_kind").limit(limit)


def neighborhood(cat: Catalog, symbol_id: int, depth: int = 2) -> DataFrame:
    """Edges with both ends among the nodes reached forwards or backwards."""
    root = cat.symbols.where(F.col("id") == symbol_id).select(F.col("id").alias("root_id"))
    near = closure(root, links(cat.edges), depth).union(closure(root, links(cat.edges, reverse=True), depth)).select(F.col("node_id").alias("i")).union(root).distinct()
    e = cat.edges
    return e.join(near, e.src_id == near.i, "left_semi").join(near, e.dst_id == near.i, "left_semi").select("id", "src_id", "dst_id", "edge_kind")


def undirected(cat: Catalog, kinds: list[str] | None = None) -> DataFrame:
    return links(cat.edges, kinds).union(links(cat.edges, kinds, True)).distinct()


def search_neighborhood(cat: Catalog, text: str, hops: int = 2, most: int = 500) -> DataFrame:
    """Nodes within some undirected hops of the symbols whose name holds the text, nearest first, ``most`` of them at the most."""
    r = cat.symbols.where(F.lower("name").contains(text.lower())).select("id")
    one = r.select(F.lit(0).cast("long").alias("root_id")).distinct()
    entry = one.select(F.col("root_id").alias("src")).crossJoin(r.toDF("dst"))
    near = closure(one, undirected(cat).select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst")).union(entry.select("src", F.col("dst") + 1)), hops + 1)
    return near.select((F.col("node_id") - 1).alias("id"), (F.col("depth") - 1).alias("hops")).orderBy("hops", "id").limit(most)


def trace_paths(cat: Catalog, start: int, goal: int, hops: int = 6, most: int = 5) -> DataFrame:
    """Simple call paths between two symbols, shortest first, with the product of the confidences."""
    e = cat.edges.where("edge_kind = 'CALLS'").select(F.col("src_id").alias("end"), F.col("dst_id").alias("next"), "confidence")
    level = cat.symbols.where(F.col("id") == start).select(F.array("id").alias("path"), F.lit(1.0).alias("confidence"), F.col("id").alias("end"))
    found = None
    for _ in range(hops):
        level = level.where(F.col("end") != goal).join(e.withColumnRenamed("confidence", "c"), "end").where(~F.array_contains("path", F.col("next"))).select(F.concat("path", F.array("next")).alias("path"), (F.col("confidence") * F.col("c")).alias("confidence"), F.col("next").alias("end"))
        hit = level.where(F.col("end") == goal)
        found = hit if found is None else found.unionByName(hit)
    shown = found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"), F.round("confidence", 6).alias("confidence"))
    return shown.orderBy("hops", "path").limit(most)


def import_depth(cat: Catalog, depth: int = 6) -> DataFrame:
    """Files by their distance from files that nothing imports (the order of resolution)."""
    i = cat.imports.where("resolved_file_id IS NOT NULL").select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst")).where("src <> dst").distinct()
    tops = cat.files.select(F.col("id").alias("root_id")).join(i.select(F.col("dst").alias("root_id")), "root_id", "left_anti")
    c = closure(tops, i, depth).groupBy(F.col("node_id").alias("file_id")).agg(F.min("depth").alias("depth"))
    return c.union(tops.select("root_id", F.lit(0).cast("long")))


def cheapest_imports(cat: Catalog, file_id: int, hops: int = 4) -> DataFrame:
    """Least cost to each file over at most ``hops`` imports, each 1 / max(confidence, .1)."""
    i = cat.imports.where("resolved_file_id IS NOT NULL").groupBy(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst")).agg((1 / F.greatest(F.max("confidence"), F.lit(0.1))).alias("c"))
    best = cat.files.where(F.col("id") == file_id).select(F.col("id").alias("file_id"), F.lit(0.0).alias("cost"))
    for _ in range(hops):
        step = best.join(i, best.file_id == i.src).select(F.col("dst").alias("file_id"), (F.col("cost") + F.col("c")).alias("cost"))
        best = best.union(step).groupBy("file_id").agg(F.min("cost").alias("cost"))
    return best.withColumn("cost", F.round("cost", 6))
