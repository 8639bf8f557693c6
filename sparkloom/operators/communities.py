"""Communities, processes, beam search and linearisation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.traverse import call_links, closure
from sparkloom.plans.catalog import Catalog
from sparkloom.plans.materialize import checkpoint

#: Cost of an edge by kind; anything else costs 2.5, and going backwards .5 more.
COSTS = {"CALLS": 1.0, "EXTENDS": 1.5, "IMPLEMENTS": 1.5, "ACCESSES_read": 1.8, "ACCESSES_write": 1.8, "IMPORTS": 2.0, "USES": 2.0, "CONTAINS": 3.0, "DEFINES": 3.0}


#: The links that make communities.
NEAR = ("CALLS", "ACCESSES_read")
#: Rounds of label propagation between two checkpoints.
BLOCK = 4


def near_edges(cat: Catalog, kinds: tuple[str, ...] = NEAR) -> DataFrame:
    """src_id, dst_id, confidence of the edges of these kinds, written once for all steps of a query."""
    return cat.kept("edges_" + "_".join(kinds), lambda: checkpoint(cat.edges.where(F.col("edge_kind").isin(*kinds)).select("src_id", "dst_id", "confidence")))


def weighted(cat: Catalog, kinds: tuple[str, ...] = NEAR) -> DataFrame:
    """u, v, w both ways: summed confidence."""
    e = near_edges(cat, kinds).groupBy("src_id", "dst_id").agg(F.sum("confidence").alias("w"))
    both = e.select(F.col("src_id").alias("u"), F.col("dst_id").alias("v"), "w").union(e.select("dst_id", "src_id", "w"))
    return both.groupBy("u", "v").agg(F.round(F.sum("w"), 6).alias("w"))


def _round(e: DataFrame, label: DataFrame) -> DataFrame:
    """Labels after one more round. Votes are moved once, to the node they are for, which the next round's join finds in place."""
    cast = e.join(label.select(F.col("id").alias("v"), F.col("community").alias("l")), "v").select("u", "l", "w").repartition("u")
    votes = cast.groupBy("u", "l").agg(F.round(F.sum("w"), 6).alias("w"))
    return votes.groupBy("u").agg(F.max(F.struct("w", (-F.col("l")).alias("n"))).alias("m")).select(F.col("u").alias("id"), (-F.col("m.n")).alias("community"))


def communities(cat: Catalog, rounds: int = 20, min_size: int = 3) -> DataFrame:
    """id, community: synchronous label propagation; each node takes the label of most weight around it, the least on ties.

    Rounds run in blocks of four, the first of fewer where they don't divide. If a block ends as the one before, each later one would,
    labels that swap for ever with it, and no more rounds are run. Groups below ``min_size`` then join the neighbouring group
    (of at least that size) with which they share most weight, if there is one.
    """
    e = checkpoint(weighted(cat))
    label = e.select(F.col("u").alias("id"), F.col("u").alias("community")).distinct()
    while rounds > 0:
        new, block = label, rounds % BLOCK or BLOCK
        for _ in range(block):
            new = _round(e, new)
        new = checkpoint(new)
        same = block == BLOCK and new.join(label, ["id", "community"], "left_anti").isEmpty()
        label, rounds = new, rounds - block
        if same:
            break
    return checkpoint(merge_small(label, e, min_size))


def merge_small(label: DataFrame, e: DataFrame, min_size: int) -> DataFrame:
    size = label.groupBy("community").agg(F.count("*").alias("n"))
    at = label.join(size, "community")
    j = e.join(at.select(F.col("id").alias("u"), F.col("community").alias("a"), F.col("n").alias("an")), "u").join(at.select(F.col("id").alias("v"), F.col("community").alias("b"), F.col("n").alias("bn")), "v")
    pull = j.where((F.col("an") < min_size) & (F.col("bn") >= min_size)).groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("w"))
    to = pull.groupBy(F.col("a").alias("community")).agg(F.max(F.struct("w", (-F.col("b")).alias("n"))).alias("m")).select("community", (-F.col("m.n")).alias("into"))
    return label.join(to, "community", "left").select("id", F.coalesce("into", "community").alias("community"))


def community_details(cat: Catalog, label: DataFrame) -> DataFrame:
    """Each community: members, exported members, edges inside and to others, cohesion and coupling."""
    e = near_edges(cat).select("src_id", "dst_id")
    j = e.join(label.toDF("src_id", "a"), "src_id").join(label.toDF("dst_id", "b"), "dst_id")
    inside = j.where("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("internal"))
    out = j.where("a <> b").select(F.explode(F.array("a", "b")).alias("community")).groupBy("community").agg(F.count("*").alias("external"))
    members = label.join(cat.symbols.select("id", "is_exported"), "id").groupBy("community").agg(F.count("*").alias("members"), F.count_if("is_exported").alias("api"))
    g = members.join(inside, "community", "left").join(out, "community", "left").na.fill(0, ["internal", "external"])
    total = F.col("internal") + F.col("external")
    return g.withColumn("cohesion", F.when(total == 0, 0.0).otherwise(F.round(F.col("internal") / total, 6))).withColumn("coupling", F.when(total == 0, 0.0).otherwise(F.round(F.col("external") / total, 6)))


def community_graph(cat: Catalog, label: DataFrame) -> DataFrame:
    e = near_edges(cat).select("src_id", "dst_id")
    return e.join(label.toDF("src_id", "src"), "src_id").join(label.toDF("dst_id", "dst"), "dst_id").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def community_keywords(cat: Catalog, label: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent words of the members' qualified names, in order."""
    words = label.join(cat.symbols.select("id", "qualified_name"), "id").select("community", F.explode(F.split("qualified_name", r"[.:\\/_]+")).alias("word")).where((F.length("word") > 2) & ~F.col("word").rlike("^[0-9]+$"))
    n = words.groupBy("community", "word").agg(F.count("*").alias("n"))
    ranked = n.withColumn("rn", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "word"))).where(F.col("rn") <= top)
    return ranked.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "word"))), lambda x: x["word"]), ",").alias("keywords"))


def update_communities(cat: Catalog, label: DataFrame, affected: DataFrame, rounds: int = 10) -> DataFrame:
    """Communities after a change: those of the affected ids and their neighbours are computed anew, all if that is more than half."""
    touched = label.join(affected.toDF("id").distinct(), "id", "left_semi").select("community").distinct()
    e = weighted(cat)
    near = e.join(label.toDF("u", "a"), "u").join(label.toDF("v", "b"), "v").join(touched.toDF("a"), "a", "left_semi").select(F.col("b").alias("community")).union(touched).distinct()
    if near.count() * 2 > label.select("community").distinct().count():
        return communities(cat, rounds)
    ids = label.join(near, "community", "left_semi").select("id").union(affected.toDF("id")).distinct()
    inner = cat.edges.join(ids.toDF("src_id"), "src_id", "left_semi").join(ids.toDF("dst_id"), "dst_id", "left_semi")
    fresh = communities(cat.replace(edges=inner), rounds)
    return label.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(*label.columns))


def entry_points(cat: Catalog) -> DataFrame:
    """Symbols that call: without callers, exported, handling a route, or named on*, handle* or process*."""
    e = call_links(cat)
    call = e.select(F.col("src").alias("id")).distinct()
    s = cat.symbols.join(call, "id", "left_semi")
    called = e.select(F.col("dst").alias("id")).distinct()
    parts = s.join(called, "id", "left_anti").select("id").union(s.where("is_exported").select("id")).union(s.join(cat.routes.select(F.col("handler_symbol_id").alias("id")), "id", "left_semi").select("id"))
    return parts.union(s.where(F.col("name").rlike("^(on|handle|process).+")).select("id")).distinct()


def processes(cat: Catalog, steps: int = 10, min_steps: int = 3, most: int = 300) -> DataFrame:
    """Traces from entry points: at each step the least callee that the trace hasn't visited. One entry for each distinct trace."""
    e = call_links(cat)
    open_ = entry_points(cat).select(F.array("id").alias("trace"), F.col("id").alias("end"))
    ended = None
    for i in range(1, steps):
        step = open_.join(e, open_.end == e.src).where(~F.array_contains("trace", F.col("dst"))).groupBy("trace").agg(F.min("dst").alias("next"))
        stopped = open_.join(step.select("trace"), "trace", "left_anti").select("trace")
        ended = stopped if ended is None else ended.union(stopped)
        open_ = step.select(F.concat("trace", F.array("next")).alias("trace"), F.col("next").alias("end"))
        if i % 3 == 0:
            open_, ended = checkpoint(open_), checkpoint(ended)
    out = ended.union(open_.select("trace")).where(F.size("trace") >= min_steps).distinct()
    return out.select(F.element_at("trace", 1).alias("entry"), F.size("trace").cast("long").alias("steps"), F.array_join(F.transform("trace", lambda x: x.cast("string")), ">").alias("trace")).orderBy(F.desc("steps"), "entry").limit(most)


def process_steps(found: DataFrame) -> DataFrame:
    """STEP_IN_PROCESS edges of processes: process (its entry), symbol and number of the step."""
    return found.select(F.col("entry").alias("process_id"), F.posexplode(F.split("trace", ">")).alias("step", "id")).select("process_id", F.col("step").cast("long").alias("step"), F.col("id").cast("long").alias("symbol_id"))


def both_ways(cat: Catalog) -> DataFrame:
    """node, next, cost: every edge forwards, and backwards for .5 more; the cheapest where there are several."""
    cost = F.coalesce(*(F.when(F.col("edge_kind") == k, F.lit(c)) for k, c in COSTS.items()), F.lit(2.5))
    e = cat.edges.select("src_id", "dst_id", cost.alias("cost"))
    return e.select(F.col("src_id").alias("node"), F.col("dst_id").alias("next"), "cost").union(e.select("dst_id", "src_id", F.col("cost") + 0.5)).groupBy("node", "next").agg(F.min("cost").alias("cost"))


def beam(cat: Catalog, seeds: DataFrame, depth: int = 5, width: int = 5, heuristic: DataFrame | None = None) -> DataFrame:
    """Evidence paths from each seed (id): depth by depth the ``width`` cheapest new nodes by cost plus heuristic (id, h).

    Returns seed, node, depth, path, cost and confidence 1 / (1 + cost). A node is visited once for a seed.
    """
    if depth > 10 or width > 20:
        raise ValueError("depth is at most 10 and width at most 20")
    e = checkpoint(both_ways(cat))
    level = seeds.toDF("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("depth"), F.array("seed").alias("path"), F.lit(0.0).alias("cost"))
    seen = level
    for d in range(1, depth + 1):
        step = level.join(e.withColumnRenamed("cost", "c"), "node").select("seed", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), (F.col("cost") + F.col("c")).alias("cost"))
        step = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        best = step.groupBy("seed", "node").agg(F.min(F.struct("cost", "path")).alias("m")).select("seed", "node", F.col("m.path").alias("path"), F.col("m.cost").alias("cost"))
        if heuristic is not None:
            best = best.join(heuristic.select(F.col("id").alias("node"), "h"), "node", "left").withColumn("f", F.col("cost") + F.coalesce("h", F.lit(1.0)))
        else:
            best = best.withColumn("f", F.col("cost"))
        ranked = best.withColumn("rn", F.row_number().over(Window.partitionBy("seed").orderBy(F.round("f", 6), "node"))).where(F.col("rn") <= width)
        level = ranked.select("seed", "node", F.lit(d).cast("long").alias("depth"), "path", "cost")
        if d % 2 == 0 and d < depth:
            level = checkpoint(level)
        seen = seen.unionByName(level)
    return seen.where("depth > 0").select("seed", "node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.round("cost", 6).alias("cost"), F.round(1 / (1 + F.col("cost")), 6).alias("confidence"))


def targeted_beam(cat: Catalog, start: int, goal: int, depth: int = 5, width: int = 5) -> DataFrame:
    """The beam's paths from start that end at goal."""
    return beam(cat, cat.symbols.where(F.col("id") == start).select("id"), depth, width).where(F.col("node") == goal)


def linearise(parents: dict, node, known: dict | None = None) -> list | None:
    """C3 order of the ancestors of node, or None if the hierarchy is cyclic or inconsistent.

    Each ancestor is worked out once: known has its order, None while it is being worked out, so that a cycle gives None all the way.
    """
    known = {} if known is None else known
    known[node] = None
    direct = parents.get(node, [])
    lists = []
    for p in direct:
        above = known[p] if p in known else linearise(parents, p, known)
        if above is None:
            return None
        lists.append([p, *above])
    lists.append(list(direct))
    out = []
    while lists := [x for x in lists if x]:
        head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
        if head is None:
            return None
        out.append(head)
        lists = [x[1:] if x[0] == head else x for x in lists]
    known[node] = out
    return out


def c3(heritage: DataFrame, depth: int = 10) -> DataFrame:
    """class_id, order (ids joined by a comma, null if there is none) of every class with a parent.

    heritage: id, child_symbol_id, parent_symbol_id; parents go by id. It is written once for all steps of the closure that gathers
    the ancestors' rows of a class; only the merge itself, which is sequential, runs in Python, over batches of classes.
    """
    h = heritage.where("parent_symbol_id IS NOT NULL AND child_symbol_id IS NOT NULL").select("id", F.col("child_symbol_id").alias("child"), F.col("parent_symbol_id").alias("parent"))
    h = checkpoint(h)
    roots = h.select(F.col("child").alias("root_id")).distinct()
    up = closure(roots, h.select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct(), depth).select("root_id", F.col("node_id").alias("child")).union(roots.select("root_id", "root_id"))
    rows = up.join(h, "child").groupBy("root_id").agg(F.sort_array(F.collect_list(F.struct("id", "child", "parent"))).alias("rows"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, own, orders = batch["rows"].offsets.to_pylist(), batch["rows"].values, []
            child, parent = (own.field(x).to_numpy(zero_copy_only=False) for x in ("child", "parent"))
            for root, i, j in zip(batch["root_id"].to_pylist(), ends, ends[1:], strict=False):
                parents: dict = {}
                for c, p in zip(child[i:j].tolist(), parent[i:j].tolist(), strict=True):
                    parents.setdefault(c, {})[p] = None  # as a set that keeps the order
                order = linearise(parents, root)
                orders.append(None if order is None else ",".join(map(str, order)))
            yield pa.RecordBatch.from_arrays([batch["root_id"], pa.array(orders, pa.string())], ["class_id", "order"])

    return rows.mapInArrow(merge, "class_id long, order string")
