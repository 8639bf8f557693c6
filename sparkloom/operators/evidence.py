"""Evidence life cycle, pattern mining, constraints and architecture boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scores import calibrated, character_entropy, reinforced
from sparkloom.plans.catalog import Catalog

STATES = ["Candidate", "Normalized", "Deduplicated", "Enriched", "Calibrated", "Committed", "Updated"]
SYMBOL_KINDS = ["signup", "purchase", "FunctionCall", "SymbolDeclaration", "ImportEdge"]


def content_id(kind: Column, normalized: Column, file: Column, *span: Column) -> Column:
    return F.concat(F.lit("ev_"), F.lower(F.lpad(F.hex(F.xxhash64(kind, normalized, file, *span)), 16, "0")))


def query(cat: Catalog, kind: str | None = None, file: str | None = None, least: float = 0.0, limit: int = 50) -> DataFrame:
    """By kind, the most confident first, or by file in order of lines."""
    e = cat.evidence.where(F.col("confidence") >= least)
    if kind is not None:
        return e.where(F.col("kind") == kind).select("id", "kind", "file", "confidence").orderBy(F.desc("confidence"), "id").limit(limit)
    return e.where(F.col("file") == file).select("id", "kind", "file", "start_line", "confidence").orderBy("start_line", "id").limit(limit)


def stats(cat: Catalog) -> DataFrame:
    return cat.evidence.groupBy("state").agg(F.count("*").alias("n"))


def normalise_and_merge(evidence: DataFrame, key: list[str]) -> DataFrame:
    """Trimmed text, empty ones dropped; rows with the same key become one with the best confidence and how many they were."""
    n = evidence.withColumn("normalized", F.trim("normalized")).where(F.col("normalized") != "")
    return n.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.count("*").alias("merged"), F.min("id").alias("id"))


def advance(evidence: DataFrame, to: str) -> DataFrame:
    """Evidence that may go to a state: only forwards in the order of states, or from Updated to Committed again."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    ok = (rank < STATES.index(to) + 1) | ((F.col("state") == "Updated") & F.lit(to == "Committed"))
    return evidence.withColumn("legal", ok).withColumn("new_state", F.when(ok, to).otherwise(F.col("state")))


def calibrate(cat: Catalog, resolved: DataFrame) -> DataFrame:
    """Calibrated confidence; evidence whose target isn't in resolved (target_ref) counts as unresolved."""
    r = resolved.toDF("target_ref").distinct().withColumn("found", F.lit(True))
    e = cat.evidence.join(r, "target_ref", "left")
    return e.select("id", F.round(calibrated(F.col("extractor") != "heuristic", F.coalesce("found", F.lit(False)), F.col("stability"), F.col("entropy")), 6).alias("confidence"))


def text_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.round(character_entropy(F.col(text)), 6).alias("entropy"))


def violations(cat: Catalog) -> DataFrame:
    """id and the first broken invariant: a heuristic needs no span, others do; symbol kinds need a target; confidence is within 0 and 1."""
    empty = (F.col("start_line") == F.col("end_line")) & (F.col("start_col") >= F.col("end_col"))
    first = F.when(empty & (F.col("extractor") != "heuristic"), "I1").when((F.col("target_ref") == "") & F.col("kind").isin(SYMBOL_KINDS), "I2").when(~F.col("confidence").between(0, 1), "I3")
    return cat.evidence.select("id", first.alias("violation")).where("violation IS NOT NULL")


def rescan(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored and newly seen evidence (id, confidence, stability): seen again is .1 steadier with the better confidence."""
    j = stored.select("id", "confidence", "stability").join(seen.select("id", F.col("confidence").alias("c2")), "id", "full_outer")
    both = F.col("confidence").isNotNull() & F.col("c2").isNotNull()
    return j.select("id", F.greatest("confidence", "c2").alias("confidence"), F.round(F.when(both, F.least(F.col("stability") + 0.1, F.lit(1.0))).otherwise(F.coalesce("stability", F.lit(1.0))), 6).alias("stability"), F.when(both, "seen").when(F.col("c2").isNull(), "missing").otherwise("new").alias("status"))


def mine_patterns(cat: Catalog, least_frequency: int = 3, least_dispersion: float = 0.1) -> DataFrame:
    """Ordered pairs of kinds in a file: how often the first comes before the second, in which share of files, and their score.

    A row adds as many pairs (a, its kind) as rows of kind a came before it, so running counts for each kind do,
    and no row meets another.
    """
    kinds = [r[0] for r in cat.evidence.select("kind").where("kind IS NOT NULL").distinct().orderBy("kind").collect()]  # an enumeration, 13 in all
    w = Window.partitionBy("file").orderBy("timestamp_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.array(*(F.struct(F.lit(k).alias("a"), F.coalesce(F.sum((F.col("kind") == k).cast("long")).over(w), F.lit(0)).alias("n")) for k in kinds))
    pairs = cat.evidence.select("file", "kind", before.alias("x")).select("file", F.col("kind").alias("b"), F.explode("x").alias("x")).where("x.n > 0").groupBy(F.col("x.a").alias("a"), "b", "file").agg(F.sum("x.n").alias("n"))
    files = cat.evidence.agg(F.countDistinct("file").alias("files"))
    g = pairs.groupBy("a", "b").agg(F.sum("n").alias("frequency"), F.count("*").alias("in_files")).crossJoin(F.broadcast(files))
    g = g.select("a", "b", "frequency", (F.col("in_files") / F.col("files")).alias("d")).where((F.col("frequency") >= least_frequency) & (F.col("d") >= least_dispersion))
    return g.select("a", "b", "frequency", F.round("d", 6).alias("dispersion"), F.round(F.least(F.col("frequency"), F.lit(100)) / 100 * F.col("d"), 6).alias("score"))


def pattern_evidence(cat: Catalog, a: str, b: str) -> DataFrame:
    """Evidence of a pattern: rows of either kind in files where some a comes before some b."""
    t = F.struct("timestamp_ms", "event_id")
    f = cat.evidence.groupBy("file").agg(F.min(F.when(F.col("kind") == a, t)).alias("x"), F.max(F.when(F.col("kind") == b, t)).alias("y")).where("x < y").select("file")
    return cat.evidence.where(F.col("kind").isin(a, b)).join(f, "file", "left_semi").select("id")


def synthesise_constraints(cat: Catalog, patterns: DataFrame, least: int = 3, confidence: float = 0.7) -> DataFrame:
    """Forbidden: pairs of kinds that mostly contradict each other. Required: each kind of a pattern with a high score."""
    k = cat.evidence.select("id", "kind")
    e = cat.evidence_edges.join(k.toDF("from_id", "a"), "from_id").join(k.toDF("to_id", "b"), "to_id")
    g = e.groupBy("a", "b").agg(F.count_if(F.col("edge_type") == "contradicts").alias("bad"), F.count("*").alias("n"))
    forbidden = g.where((F.col("bad") >= least) & (F.col("bad") / F.col("n") >= confidence)).select(F.concat_ws(">", "a", "b").alias("name"), F.lit("ForbiddenTransition").alias("kind"), F.round(F.col("bad") / F.col("n"), 6).alias("confidence"))
    required = patterns.where(F.col("score") >= confidence).select(F.explode(F.array("a", "b")).alias("name"), "score").groupBy("name").agg(F.max("score").alias("confidence")).select("name", F.lit("RequiredProperty").alias("kind"), "confidence")
    return forbidden.unionByName(required)


def constraint_violations(cat: Catalog, constraints: DataFrame) -> DataFrame:
    """Supporting links between kinds that a constraint forbids."""
    k = cat.evidence.select("id", "kind")
    e = cat.evidence_edges.where("edge_type = 'supports'").join(k.toDF("from_id", "a"), "from_id").join(k.toDF("to_id", "b"), "to_id").withColumn("name", F.concat_ws(">", "a", "b"))
    return e.join(constraints.where("kind = 'ForbiddenTransition'").select("name"), "name").select(F.col("name").alias("constraint"), F.col("from_id").alias("evidence_id")).distinct()


def layer_of(path: Column, layers: list[tuple[str, list[str]]]) -> Column:
    """The first layer with a prefix that the path starts with or contains."""
    parts = []
    for name, prefixes in layers:
        hit = None
        for p in prefixes:
            hit = path.contains(p) if hit is None else hit | path.contains(p)
        parts.append(F.when(hit, F.lit(name)))
    return F.coalesce(*parts)


def boundary_violations(cat: Catalog, layers: list[tuple[str, list[str]]], rules: list[tuple[str, str, str, bool]]) -> DataFrame:
    """Edges between layers that the first matching rule (name, from, to, allowed) forbids; without a rule an edge is allowed."""
    at = cat.symbols.join(cat.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path", layer_of(F.col("path"), layers).alias("layer")).where("layer IS NOT NULL")
    e = cat.edges.select("src_id", "dst_id", "edge_kind").join(at.toDF("src_id", "from_file", "from_layer"), "src_id").join(at.toDF("dst_id", "to_file", "to_layer"), "dst_id").where("from_layer <> to_layer")
    verdict = F.coalesce(*(F.when((F.col("from_layer") == a) & (F.col("to_layer") == b), F.struct(F.lit(n).alias("rule"), F.lit(ok).alias("allowed"))) for n, a, b, ok in rules))
    return e.withColumn("v", verdict).where("NOT v.allowed").groupBy(F.col("v.rule").alias("rule"), "from_file", "to_file", "edge_kind").agg(F.count("*").alias("n"))


def scan_risk(cat: Catalog) -> DataFrame:
    """.6 * share of unresolved calls + .4 * min(edges / symbols, 10) / 10."""
    c = cat.calls.agg((F.count_if(F.col("resolved_symbol_id").isNull()) / F.count("*")).alias("u"))
    n = cat.edges.agg(F.count("*").alias("e")).crossJoin(cat.symbols.agg(F.count("*").alias("s")))
    return c.crossJoin(n).select(F.round(0.6 * F.coalesce("u", F.lit(0.0)) + 0.4 * F.least(F.col("e") / F.greatest("s", F.lit(1)), F.lit(10.0)) / 10, 6).alias("risk"))


def stability_after(cat: Catalog, alpha: float = 0.1) -> DataFrame:
    return cat.evidence.select("id", F.round(reinforced(F.col("stability"), alpha), 6).alias("seen"), F.round(reinforced(F.col("stability"), alpha, False), 6).alias("missed"))
