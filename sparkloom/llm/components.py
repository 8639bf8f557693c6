"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpoint


def _stars(pairs: DataFrame, of_larger: bool) -> DataFrame:
    """pairs(u, v) to the least neighbour of each u: of v > u (large star), or of all given v (small star)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if of_larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges(src, dst) to (node, component): component is the least node id that a node is connected with.

    Ends null, self loops and repeated edges change nothing; nodes without an edge are not returned.
    Every round ends in a reliable checkpoint, and the edge list never grows.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = checkpoint(e)
    mark = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, True).where("u <> v").distinct()
        e = checkpoint(_stars(large, False).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
