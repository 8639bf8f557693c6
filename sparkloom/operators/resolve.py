"""Names to symbols: tiers of candidates, where the first tier that matches decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.catalog import Catalog

#: language -> ways to turn an import into candidate paths, best first, with their confidence
STRATEGIES: dict[str, list[tuple[str, float]]] = {
    "python": [("{p}.py", 0.95), ("{p}/__init__.py", 0.9)], "typescript": [("{p}.ts", 0.95), ("{p}.tsx", 0.95), ("{p}/index.ts", 0.9), ("{p}.js", 0.85)], "javascript": [("{p}.js", 0.95), ("{p}.jsx", 0.95), ("{p}/index.js", 0.9)],
    "rust": [("src/{p}.rs", 0.95), ("src/{p}/mod.rs", 0.9), ("{p}.rs", 0.85)], "go": [("{p}.go", 0.9)], "java": [("src/main/java/{p}.java", 0.95), ("{p}.java", 0.9)], "kotlin": [("{p}.kt", 0.9)], "csharp": [("{p}.cs", 0.85)],
    "c": [("{p}", 0.95), ("include/{p}", 0.9)], "cpp": [("{p}", 0.95), ("include/{p}", 0.9), ("src/{p}", 0.85)], "ruby": [("{p}.rb", 0.95), ("lib/{p}.rb", 0.9)], "php": [("{p}.php", 0.95), ("src/{p}.php", 0.9)], "swift": [("Sources/{p}.swift", 0.85)], "dart": [("lib/{p}.dart", 0.95), ("{p}.dart", 0.9)],
}
WEIGHTS = {"local": 0.55, "import": 0.45, "reexport": 0.40, "namespace": 0.40, "wildcard": 0.30, "owner": 0.20, "global_qualified": 0.35, "global_name": 0.10, "dynamic": 0.02}
ARITY_MATCH, ARITY_MISS, PER_DEPTH, UNLINKED = 0.10, -0.15, -0.02, 0.5
MRO = [0.50, 0.42, 0.36, 0.32, 0.30]


def module_path(source: Column, language: Column) -> Column:
    """Dots and :: become slashes, crate:: and relative starts go, and an alias @/ means src/."""
    dotted = F.when(language.isin("python", "java", "kotlin", "csharp"), F.regexp_replace(source, r"\.", "/")).otherwise(source)
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(dotted, "::", "/"), r"^crate/", ""), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(s, r"^(\./)+", ""), "^@/", "src/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (id, source, language) to id, resolved_file_id, confidence: the first candidate path that exists."""
    p = imports.select("id", "language", module_path(F.col("source"), F.col("language")).alias("p"))
    cases = None
    for language, ways in STRATEGIES.items():
        candidates = F.array(*(F.struct(F.lit(i).alias("ord"), F.concat(*(F.col("p") if x == "{p}" else F.lit(x) for x in _pieces(way))).alias("path"), F.lit(c).alias("confidence")) for i, (way, c) in enumerate(ways)))
        cases = F.when(F.col("language") == language, candidates) if cases is None else cases.when(F.col("language") == language, candidates)
    exploded = p.select("id", F.explode(cases).alias("c")).select("id", "c.*")
    found = exploded.join(files.select(F.col("id").alias("file"), "path"), "path")
    best = found.groupBy("id").agg(F.min(F.struct("ord", "file", "confidence")).alias("m"))
    return imports.select("id").join(best, "id", "left").select("id", F.col("m.file").alias("resolved_file_id"), F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"))


def _pieces(way: str) -> list[str]:
    a, _, b = way.partition("{p}")
    return [x for x in (a, "{p}", b) if x]


def resolve_calls(cat: Catalog) -> DataFrame:
    """call_id, symbol_id, tier, confidence: own file, resolved imports, receiver with an owner, any file.

    Each tier is an equi join; the least (tier, id) wins. A name with one definition anywhere has .45, with more .30.
    """
    c = cat.calls.select(F.col("id").alias("call_id"), "file_id", F.col("callee_name").alias("name"), "receiver")
    s = cat.symbols.select(F.col("id").alias("symbol_id"), F.col("file_id").alias("sf"), "name", "owner_symbol_id")
    local = c.join(s, (c.file_id == s.sf) & (c.name == s.name)).select("call_id", "symbol_id", F.lit(1).alias("tier"), F.lit(1.0).alias("confidence"))
    i = cat.imports.where("resolved_file_id IS NOT NULL").select("file_id", F.col("local_name").alias("name"), F.col("resolved_file_id").alias("sf")).distinct()
    imported = c.join(i, ["file_id", "name"]).join(s.select("symbol_id", "sf", "name"), ["sf", "name"]).select("call_id", "symbol_id", F.lit(2).alias("tier"), F.lit(0.9).alias("confidence"))
    anywhere = s.groupBy("name").agg(F.min("symbol_id").alias("symbol_id"), F.count("*").alias("n"))
    world = c.join(anywhere, "name").select("call_id", "symbol_id", F.lit(4).alias("tier"), F.when(F.col("n") == 1, 0.45).otherwise(0.30).alias("confidence"))
    # the owned tier needs the least id only: reduced by name before the join, it can't fan out
    owned = c.where("receiver IS NOT NULL").join(s.where("owner_symbol_id IS NOT NULL").groupBy("name").agg(F.min("symbol_id").alias("symbol_id")), "name").select("call_id", "symbol_id", F.lit(3).alias("tier"), F.lit(0.7).alias("confidence"))
    best = local.union(imported).union(owned).union(world).groupBy("call_id").agg(F.min(F.struct("tier", "symbol_id", "confidence")).alias("m"))
    return best.select("call_id", F.col("m.symbol_id").alias("symbol_id"), F.col("m.tier").alias("tier"), F.col("m.confidence").alias("confidence"))


def scope_ancestors(scopes: DataFrame, depth: int = 10) -> DataFrame:
    """scope_id, ancestor_id, depth, the scope itself at 0."""
    up = scopes.select("id", "parent_id")
    level = up.select(F.col("id").alias("scope_id"), F.col("id").alias("ancestor_id"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth + 1):
        level = level.join(up.where("parent_id IS NOT NULL"), level.ancestor_id == up.id).select("scope_id", F.col("parent_id").alias("ancestor_id"), F.lit(d).alias("depth"))
        out = out.union(level)
    return out.groupBy("scope_id", "ancestor_id").agg(F.min("depth").alias("depth"))


def owning_symbol(calls: DataFrame, scopes: DataFrame) -> DataFrame:
    """call id -> the symbol that owns the nearest scope around it."""
    owners = scopes.where("owner_symbol_id IS NOT NULL").select(F.col("id").alias("ancestor_id"), "owner_symbol_id")
    j = calls.select("id", F.col("caller_scope_id").alias("scope_id")).join(scope_ancestors(scopes), "scope_id").join(owners, "ancestor_id")
    return j.groupBy("id").agg(F.min_by("owner_symbol_id", "depth").alias("caller_symbol_id"))


def inheritance_edges(cat: Catalog) -> DataFrame:
    """EXTENDS and IMPLEMENTS edges: the parent by id, else by name in the same file, else the least id of the name."""
    h = cat.heritage.select("id", "file_id", F.col("child_symbol_id").alias("src"), "parent_symbol_id", F.col("parent_name").alias("name"), "heritage_kind")
    same = cat.symbols.groupBy("file_id", "name").agg(F.min("id").alias("same"))
    least = cat.symbols.groupBy("name").agg(F.min("id").alias("least"))
    j = h.join(same, ["file_id", "name"], "left").join(least, "name", "left")
    return j.select("src", F.coalesce("parent_symbol_id", "same", "least").alias("dst"), F.when(F.col("heritage_kind") == "implements", "IMPLEMENTS").otherwise("EXTENDS").alias("edge_kind")).where("dst IS NOT NULL AND src <> dst").distinct()


def define_edges(cat: Catalog) -> DataFrame:
    return cat.symbols.select(F.col("file_id").alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("edge_kind"))


def confidence(signals: dict[str, Column], depth: Column, mro_depth: Column, arity: Column, linked: Column) -> Column:
    """Additive resolution evidence, within 0 and 1.

    signals: name in ``WEIGHTS`` -> whether it holds; arity: true, false or null; mro_depth: null if not inherited.
    """
    total = F.lit(0.0)
    for name, holds in signals.items():
        total = total + F.when(holds, WEIGHTS[name]).otherwise(0.0)
    total = total + F.coalesce(PER_DEPTH * depth, F.lit(0.0)) + F.when(arity, ARITY_MATCH).when(~arity, ARITY_MISS).otherwise(0.0)
    inherited = F.get(F.array(*map(F.lit, MRO)), F.least(mro_depth, F.lit(len(MRO) - 1)).cast("int"))
    total = total + F.when(mro_depth.isNotNull(), inherited).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(linked, total).otherwise(total * UNLINKED)))


def back_fill(cat: Catalog) -> DataFrame:
    """Unresolved calls by name: exported definitions with confidence 1, others .5; the least (not exported, id)."""
    best = cat.symbols.groupBy("name").agg(F.min(F.struct((~F.col("is_exported")).alias("p"), "id")).alias("m"))
    c = cat.calls.where("resolved_symbol_id IS NULL").select(F.col("id").alias("call_id"), F.col("callee_name").alias("name"))
    return c.join(best, "name").select("call_id", F.col("m.id").alias("symbol_id"), F.when(F.col("m.p"), 0.5).otherwise(1.0).alias("confidence"))


def strip_nullable(type_name: Column) -> Column:
    """``Foo?``, ``Foo | null``, ``Optional[Foo]`` and ``Option<Foo>`` to ``Foo``."""
    t = F.regexp_replace(F.trim(type_name), r"\?$|\s*\|\s*(null|undefined|None)$|^(null|undefined|None)\s*\|\s*", "")
    return F.regexp_replace(t, r"^(?:Optional\[(.*)\]|Option<(.*)>)$", "$1$2")


def data_flow_edges(assignments: DataFrame, symbols: DataFrame) -> DataFrame:
    """assignments (file_id, target, source, kind, line) to flows; the source may stay open."""
    weight = F.when(F.col("kind") == "property_write", 0.9).when(F.col("kind") == "assignment", 0.85).otherwise(0.8)
    s = symbols.groupBy("file_id", "name").agg(F.min("id").alias("id"))
    j = assignments.join(s.select("file_id", F.col("name").alias("target"), F.col("id").alias("dst_symbol_id")), ["file_id", "target"]).join(s.select("file_id", F.col("name").alias("source"), F.col("id").alias("src_symbol_id")), ["file_id", "source"], "left")
    return j.select("file_id", "src_symbol_id", "dst_symbol_id", F.col("kind").alias("flow_kind"), F.col("target").alias("var_name"), "line", weight.alias("confidence"))
