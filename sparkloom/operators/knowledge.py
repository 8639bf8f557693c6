"""The catalog as one typed property graph: nodes, relationships, views by layer, and the context of a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.traverse import closure
from sparkloom.plans.catalog import Catalog
from sparkloom.plans.materialize import checkpoint

#: layer -> kinds of relationships in it
LAYERS = {
    "physical": ["CONTAINS"], "syntax": ["DEFINES", "IMPORTS"], "symbol": ["CALLS", "EXTENDS", "IMPLEMENTS"],
    "semantic": ["USES", "ACCESSES", "ACCESSES_read", "ACCESSES_write"], "behaviour": ["STEP_IN_PROCESS", "ROUTE", "QUERIES"],
}


def nodes(cat: Catalog) -> DataFrame:
    """id (file:1, sym:2), label, name and properties of files and symbols."""
    files = cat.files.select(F.concat(F.lit("file:"), "id").alias("id"), F.lit("File").alias("label"), F.col("path").alias("name"), F.create_map(F.lit("language"), "language", F.lit("repo"), "repo_label").alias("properties"))
    symbols = cat.symbols.select(F.concat(F.lit("sym:"), "id").alias("id"), F.col("kind").alias("label"), "name", F.create_map(F.lit("qualified_name"), "qualified_name", F.lit("exported"), F.col("is_exported").cast("string")).alias("properties"))
    return files.unionByName(symbols)


def relationships(cat: Catalog) -> DataFrame:
    """id (src--TYPE--dst), src, dst, type and the best confidence; files define their symbols."""
    e = cat.edges.select(F.concat(F.lit("sym:"), "src_id").alias("src"), F.concat(F.lit("sym:"), "dst_id").alias("dst"), F.col("edge_kind").alias("type"), "confidence")
    d = cat.symbols.select(F.concat(F.lit("file:"), "file_id").alias("src"), F.concat(F.lit("sym:"), "id").alias("dst"), F.lit("DEFINES").alias("type"), F.lit(1.0).alias("confidence"))
    g = e.unionByName(d).groupBy("src", "type", "dst").agg(F.max("confidence").alias("confidence"))
    return g.select(F.concat_ws("--", "src", "type", "dst").alias("id"), "src", "dst", "type", "confidence")


def layer(relations: DataFrame, name: str) -> DataFrame:
    return relations.where(F.col("type").isin(LAYERS[name]))


def incident(relations: DataFrame, node: str) -> DataFrame:
    return relations.where((F.col("src") == node) | (F.col("dst") == node))


def without_node(relations: DataFrame, node: str) -> DataFrame:
    return relations.where((F.col("src") != node) & (F.col("dst") != node))


def depths(relations: DataFrame, root: str, depth: int = 6) -> DataFrame:
    """node and its least distance from root along relationships."""
    r = relations.sparkSession.createDataFrame([(root,)], "root_id string")
    c = closure(r, relations.select("src", "dst").distinct(), depth)
    return c.select(F.col("node_id").alias("node"), "depth")


def symbol_context(cat: Catalog, symbol_id: int, communities: DataFrame | None = None) -> DataFrame:
    """category, direction, other: all that a symbol is directly linked with.

    Calls, inheritance, uses and imports, accesses, data flow, other symbols of its file, and, with
    communities (id, community), the members of its own.
    """
    category = F.when(F.col("edge_kind") == "CALLS", "calls").when(F.col("edge_kind").isin("EXTENDS", "IMPLEMENTS"), "inheritance").when(F.col("edge_kind").isin("IMPORTS", "USES"), "imports").when(F.col("edge_kind").startswith("ACCESSES"), "accesses").otherwise("other")
    e = cat.edges.withColumn("category", category)
    out = e.where(F.col("src_id") == symbol_id).select("category", F.lit("out").alias("direction"), F.col("dst_id").alias("other")).union(e.where(F.col("dst_id") == symbol_id).select("category", F.lit("in"), "src_id"))
    d = cat.data_flows
    out = out.union(d.where(F.col("src_symbol_id") == symbol_id).select(F.lit("data_flow"), F.lit("out"), "dst_symbol_id")).union(d.where(F.col("dst_symbol_id") == symbol_id).select(F.lit("data_flow"), F.lit("in"), "src_symbol_id"))
    mine = cat.symbols.where(F.col("id") == symbol_id).select("file_id")
    out = out.union(cat.symbols.join(mine, "file_id", "left_semi").where(F.col("id") != symbol_id).select(F.lit("structure"), F.lit("both"), "id"))
    if communities is not None:
        own = communities.where(F.col("id") == symbol_id).select("community")
        out = out.union(communities.join(own, "community", "left_semi").where(F.col("id") != symbol_id).select(F.lit("community"), F.lit("both"), "id"))
    return out.distinct()


def folders(paths: DataFrame) -> DataFrame:
    """u, v: a folder and what is directly in it, for every prefix of the paths (column path)."""
    parts = paths.select(F.split("path", "/").alias("p")).distinct()
    steps = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.array_join(F.slice("p", 1, i), "/").alias("u"), F.array_join(F.slice("p", 1, i + 1), "/").alias("v")))).alias("x"), "p")
    return steps.where(F.size("p") > 1).select("x.u", "x.v").distinct()


def shortest_path(link: DataFrame, start: str, goal: str, hops: int = 12) -> DataFrame:
    """path and hops of a shortest path in an undirected graph (u, v), the first in order; no row if there is none."""
    both = link.select(F.col("u").alias("end"), F.col("v").alias("next")).union(link.select("v", "u")).distinct()
    spark = link.sparkSession
    level = spark.createDataFrame([([start], start)], "path array<string>, end string")
    known = level.select("end")
    if start == goal:
        return level.select(F.array_join("path", " > ").alias("path"), F.lit(0).cast("long").alias("hops"))
    for n in range(1, hops + 1):
        step = level.join(both, "end").select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("end")).join(known, "end", "left_anti")
        level = step.groupBy("end").agg(F.min("path").alias("path")).select("path", "end")
        level = checkpoint(level)
        if level.isEmpty():
            return level.select(F.array_join("path", " > ").alias("path"), F.lit(n).cast("long").alias("hops"))
        hit = level.where(F.col("end") == goal)
        if not hit.isEmpty():
            return hit.select(F.array_join("path", " > ").alias("path"), F.lit(n).cast("long").alias("hops"))
        known = known.union(level.select("end"))
    return level.where("false").select(F.array_join("path", " > ").alias("path"), F.lit(0).cast("long").alias("hops"))
