"""Filters, joins and aggregations over the catalog: everything that needs no iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import keywords as kw
from sparkloom.functions.scores import parent_dir, top_dir
from sparkloom.plans.catalog import Catalog

CALLABLE = ["Function", "Method", "Class"]


def named(cat: Catalog) -> DataFrame:
    """Symbols with the path, language and repository of their file."""
    f = cat.files.select(F.col("id").alias("file_id"), "path", "language", "repo_label")
    return cat.symbols.join(f, "file_id")


def symbols(cat: Catalog, name: str) -> DataFrame:
    return named(cat).where(F.col("name") == name).select("id", "name", "kind", "path", "line", F.when(F.col("is_exported"), "public").otherwise("private").alias("visibility"))


def search_symbols(cat: Catalog, text: str, limit: int = 20) -> DataFrame:
    """Exact before prefix before substring matches, then by name and id."""
    low, t = F.lower("name"), text.lower()
    rank = F.when(low == t, 0).when(low.startswith(t), 1).otherwise(2)
    return cat.symbols.where(low.contains(t)).select("id", "name", "kind", rank.alias("rank")).orderBy("rank", "name", "id").limit(limit)


def paginated(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page in order of id, and on each row whether there is more after the page."""
    page = df.orderBy("id").offset(offset).limit(limit + 1)
    n = F.count("*").over(Window.partitionBy())
    return page.withColumn("rn", F.row_number().over(Window.orderBy("id"))).withColumn("has_more", n > limit).where(F.col("rn") <= limit).drop("rn")


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in the one column of ids."""
    return df.join(ids.toDF(key).distinct(), key, "left_semi")


def edges_of(cat: Catalog, ids: DataFrame) -> DataFrame:
    """Edges with an end in ids: two semi joins and no OR."""
    i = ids.toDF("i").distinct()
    e = cat.edges
    return e.join(i, e.src_id == i.i, "left_semi").unionByName(e.join(i, e.dst_id == i.i, "left_semi")).dropDuplicates(["id"])


def routes(cat: Catalog) -> DataFrame:
    s = cat.symbols.select(F.col("id").alias("handler_symbol_id"), F.col("name").alias("handler"))
    return cat.routes.join(s, "handler_symbol_id", "left").select("id", "method", "path", "file_path", "framework", "line", F.coalesce("handler", F.lit("")).alias("handler"))


def table_counts(cat: Catalog) -> DataFrame:
    """One row for each figure of the store."""
    out = None
    for metric, df in (("files", cat.files), ("symbols", cat.symbols), ("imports", cat.imports), ("calls", cat.calls), ("resolved_calls", cat.calls.where("resolved_symbol_id IS NOT NULL")), ("heritage", cat.heritage), ("edges", cat.edges), ("evidence", cat.evidence)):
        row = df.agg(F.lit(metric).alias("metric"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def repos(cat: Catalog) -> DataFrame:
    s = cat.symbols.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if("is_exported").alias("pub"))
    return cat.files.join(s, cat.files.id == s.file_id, "left").groupBy("repo_label").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("pub"), F.lit(0)).alias("public_symbols"))


def symbol_kinds(cat: Catalog) -> DataFrame:
    return cat.symbols.groupBy("kind").agg(F.count("*").alias("n"))


def context(cat: Catalog, name: str) -> DataFrame:
    """The definitions of a name and their direct callers and callees."""
    roots = cat.symbols.where(F.col("name") == name).select(F.col("id").alias("root_id"))
    e = cat.edges.where("edge_kind = 'CALLS'").select("src_id", "dst_id")
    parts = roots.select("root_id", F.lit("definition").alias("role"), F.col("root_id").alias("id")).union(
        roots.join(e, roots.root_id == e.dst_id).select("root_id", F.lit("caller"), "src_id")).union(roots.join(e, roots.root_id == e.src_id).select("root_id", F.lit("callee"), "dst_id"))
    return parts.distinct().join(named(cat).select("id", "name", "path"), "id")


def shape_check(cat: Catalog, limit: int = 50) -> DataFrame:
    """Route handlers with their numbers of distinct callees and callers."""
    handlers = cat.routes.select(F.col("handler_symbol_id").alias("id")).distinct().join(cat.symbols.select("id", "name"), "id")
    e = cat.edges.where("edge_kind = 'CALLS'")
    out = e.groupBy(F.col("src_id").alias("id")).agg(F.countDistinct("dst_id").alias("callees"))
    into = e.groupBy(F.col("dst_id").alias("id")).agg(F.countDistinct("src_id").alias("callers"))
    return handlers.join(out, "id", "left").join(into, "id", "left").select("id", "name", F.coalesce("callees", F.lit(0)).alias("callees"), F.coalesce("callers", F.lit(0)).alias("callers")).orderBy(F.desc("callees"), F.desc("callers"), "id").limit(limit)


def tool_map(cat: Catalog) -> DataFrame:
    """Route handlers that call something, and callers of input/output names that are no handlers."""
    handlers = cat.routes.select(F.col("handler_symbol_id").alias("id")).distinct()
    callers = cat.edges.where("edge_kind = 'CALLS'").select(F.col("src_id").alias("id")).distinct()
    verb = F.substring_index("callee_name", "_", 1)
    io = cat.calls.where(verb.isin(kw.IO_CALLEES)).select(F.col("caller_scope_id").alias("id")).distinct()
    both = handlers.join(callers, "id", "left_semi").withColumn("how", F.lit("handler")).union(io.join(handlers, "id", "left_anti").withColumn("how", F.lit("io")))
    return both.join(cat.symbols.select("id", "name", "kind"), "id")


def entrypoints(cat: Catalog, limit: int = 100) -> DataFrame:
    return named(cat).where(F.col("is_exported") & F.col("kind").isin(CALLABLE)).select("id", "name", "kind", "path", "line").orderBy("path", "line", "id").limit(limit)


def public_api(cat: Catalog, module: str = "") -> DataFrame:
    return named(cat).where(F.col("is_exported") & F.lower("path").contains(module.lower())).select("id", "name", "kind", "path", "line")


def dead_code(cat: Catalog, limit: int = 50) -> DataFrame:
    """Functions and methods that aren't exported and that no call resolves to."""
    used = cat.calls.where("resolved_symbol_id IS NOT NULL").select(F.col("resolved_symbol_id").alias("id"))
    return named(cat).where(~F.col("is_exported") & F.col("kind").isin("Function", "Method")).join(used, "id", "left_anti").select("id", "name", "kind", "path", "line").orderBy("path", "line", "id").limit(limit)


def hotspots(cat: Catalog, limit: int = 20) -> DataFrame:
    fan = cat.calls.where("resolved_symbol_id IS NOT NULL").groupBy(F.col("resolved_symbol_id").alias("id")).agg(F.count("*").alias("fan_in"))
    return fan.join(cat.symbols.select("id", "name", "kind"), "id").orderBy(F.desc("fan_in"), "id").limit(limit)


def mutual_edges(cat: Catalog, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Pairs of nodes with edges both ways, of the given kinds."""
    e = (cat.edges if kinds is None else cat.edges.where(F.col("edge_kind").isin(kinds))).select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).distinct()
    back = e.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return e.where("a < b").join(back, ["a", "b"], "left_semi").orderBy("a", "b").limit(limit)


def resolution_stats(cat: Catalog) -> DataFrame:
    """section, key, total, hits: overall and by language, confidence buckets, and the most frequent unresolved names."""
    resolved = F.count_if(F.col("resolved_symbol_id").isNotNull())
    calls = cat.calls.join(cat.files.select(F.col("id").alias("file_id"), "language"), "file_id")
    overall = calls.agg(F.lit("overall").alias("section"), F.lit("calls").alias("key"), F.count("*").alias("total"), resolved.alias("hits"))
    language = calls.groupBy(F.lit("language").alias("section"), F.col("language").alias("key")).agg(F.count("*").alias("total"), resolved.alias("hits"))
    c = F.col("confidence")
    bucket = F.when(c >= 0.95, "exact").when(c >= 0.8, "high").when(c >= 0.5, "medium").when(c > 0, "low").otherwise("none")
    buckets = calls.groupBy(F.lit("confidence").alias("section"), bucket.alias("key")).agg(F.count("*").alias("total"), resolved.alias("hits"))
    missing = lambda df, name, key, null: df.where(F.col(null).isNull()).groupBy(F.lit(name).alias("section"), F.col(key).alias("key")).agg(F.count("*").alias("total"), F.lit(0).cast("long").alias("hits")).orderBy(F.desc("total"), "key").limit(20)
    worst = calls.groupBy(F.lit("worst_caller").alias("section"), F.col("caller_scope_id").cast("string").alias("key")).agg(F.count("*").alias("total"), resolved.alias("hits")).where("total - hits > 0").orderBy(F.expr("total - hits").desc(), "key").limit(15)
    out = overall
    for part in (language, buckets, missing(cat.calls, "unresolved_callee", "callee_name", "resolved_symbol_id"), missing(cat.imports, "unresolved_import", "imported_name", "resolved_file_id"), worst):
        out = out.unionByName(part)
    return out


def uncovered(cat: Catalog, limit: int = 50) -> DataFrame:
    """Symbols that aren't exported, that nothing calls and that no test file mentions."""
    tests = cat.files.where(kw.is_test_path(F.col("path"))).select(F.col("id").alias("file_id"))
    called = cat.calls.where("resolved_symbol_id IS NOT NULL").select(F.col("resolved_symbol_id").alias("id"))
    mentioned = cat.calls.join(tests, "file_id", "left_semi").select(F.col("callee_name").alias("name"))
    rows = named(cat).where(~F.col("is_exported")).join(called, "id", "left_anti").join(mentioned, "name", "left_anti")
    return rows.select("id", "name", "kind", "path", "line").orderBy("path", "line", "id").limit(limit)


def boundary_crossings(cat: Catalog) -> DataFrame:
    """kind, from_top, to_top, n: calls and imports between top directories, and links between repositories."""
    f = cat.files.select("id", "path", "repo_label")
    e = cat.edges.where("edge_kind IN ('CALLS', 'IMPORTS')").select("src_id", "dst_id", "edge_kind")
    at = cat.symbols.join(f.withColumnRenamed("id", "file_id"), "file_id").select("id", top_dir(F.col("path")).alias("top"), "repo_label")
    src, dst = at.toDF("src_id", "from_top", "from_repo"), at.toDF("dst_id", "to_top", "to_repo")
    j = e.join(src, "src_id").join(dst, "dst_id")
    tops = j.where("from_top <> to_top").groupBy(F.concat(F.lit("top_"), F.lower("edge_kind")).alias("kind"), "from_top", "to_top").agg(F.count("*").alias("n"))
    repositories = j.where("from_repo <> to_repo").groupBy(F.lit("repo").alias("kind"), F.col("from_repo").alias("from_top"), F.col("to_repo").alias("to_top")).agg(F.count("*").alias("n"))
    return tops.unionByName(repositories)


def scope_violations(cat: Catalog) -> DataFrame:
    """id, name, reason: private symbols called from other files, exported private-looking names, imports of names with a leading underscore."""
    s, c = cat.symbols, cat.calls
    crossing = c.where("resolved_symbol_id IS NOT NULL").select(F.col("resolved_symbol_id").alias("id"), F.col("file_id").alias("from_file")).join(s, "id").where("NOT is_exported AND from_file <> file_id").select("id", "name", F.lit("private_called").alias("reason"))
    looks = s.where(F.col("is_exported") & kw.is_private_name(F.col("name"))).select("id", "name", F.lit("exported_private_name").alias("reason"))
    imported = cat.imports.where(F.col("imported_name").startswith("_")).select(F.col("id"), F.col("imported_name").alias("name"), F.lit("private_import").alias("reason"))
    return crossing.union(looks).union(imported).distinct()


def _first_by(frames: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """Union of frames where the first that has a key wins."""
    out = None
    for i, (method, df) in enumerate(frames):
        part = df.select(*key, F.lit(method).alias("detection_method"), F.lit(i).alias("priority"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*key).agg(F.min(F.struct("priority", "detection_method")).alias("m")).select(*key, F.col("m.detection_method").alias("detection_method"))


def _callers_of(cat: Catalog, condition) -> DataFrame:
    return cat.calls.where(condition).select(F.col("caller_scope_id").alias("id")).distinct().join(cat.symbols, "id").select("name")


def config_map(cat: Catalog) -> DataFrame:
    """Names that deal with configuration: by their words, by calls to the environment, by calls to config readers."""
    verb = F.substring_index("callee_name", "_", 1)
    return _first_by([("keyword", cat.symbols.where(kw.any_word(F.col("name"), kw.CONFIG)).select("name")), ("env_access", _callers_of(cat, verb.isin(kw.ENV_CALLEES))), ("config_reader", _callers_of(cat, verb.isin(kw.READER_CALLEES)))], ["name"])


def concurrency(cat: Catalog) -> DataFrame:
    """Names that deal with concurrency: by their words, by asynchronous calls, by shared state."""
    verb = F.substring_index("callee_name", "_", 1)
    return _first_by([("keyword", cat.symbols.where(kw.any_word(F.col("name"), kw.CONCURRENCY)).select("name")), ("async_call", _callers_of(cat, verb.isin(kw.ASYNC_CALLEES) | F.col("callee_name").rlike("await|spawn|join"))), ("shared_state", _callers_of(cat, verb.isin(kw.SHARED_CALLEES)))], ["name"])


def docs_drift(cat: Catalog, changed_paths: DataFrame, min_degree: int = 1) -> DataFrame:
    """Exported callables of changed files with more than ``min_degree`` edges, and whether the name says little."""
    p = changed_paths.toDF("path").distinct()
    degree = cat.edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    rows = named(cat).where(F.col("is_exported") & F.col("kind").isin(CALLABLE)).join(p, "path", "left_semi").join(degree, "id")
    return rows.where(F.col("degree") > min_degree).select("id", "name", "path", "degree", F.lower(F.substring_index("name", "_", 1)).isin(kw.GENERIC).alias("generic"))


def group_sync(cat: Catalog) -> DataFrame:
    """Imports that an export of another repository can serve: from_repo, to_repo, links and imported names."""
    repo = cat.files.select(F.col("id").alias("file_id"), "repo_label")
    i = cat.imports.where("resolved_file_id IS NULL").join(repo, "file_id").select("id", F.col("imported_name").alias("name"), F.col("repo_label").alias("from_repo"))
    x = cat.exports.join(repo, "file_id").select(F.col("exported_name").alias("name"), F.col("repo_label").alias("to_repo")).distinct()
    return i.join(x, "name").where("from_repo <> to_repo").groupBy("from_repo", "to_repo").agg(F.countDistinct("id").alias("links"), F.countDistinct("name").alias("names"), F.lit(0.8).alias("confidence"))


def deduplicate_symbols(cat: Catalog) -> DataFrame:
    """The least id of each (file, name, line)."""
    w = Window.partitionBy("file_id", "name", "line").orderBy("id")
    return cat.symbols.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def deduplicate_calls(cat: Catalog) -> DataFrame:
    w = Window.partitionBy("file_id", "caller_scope_id", "callee_name", "line").orderBy("id")
    return cat.calls.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def rollup(cat: Catalog) -> DataFrame:
    """level, src, dst, edge_kind, weight: edges between files and between modules (the folders of the files)."""
    at = cat.symbols.join(cat.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path", parent_dir(F.col("path")).alias("module"))
    j = cat.edges.join(at.toDF("src_id", "sp", "sm"), "src_id").join(at.toDF("dst_id", "dp", "dm"), "dst_id")
    # files first: the module edges are then sums of few rows
    files = j.where("sp <> dp").groupBy("sp", "dp", "sm", "dm", "edge_kind").agg(F.count("*").alias("weight"))
    return files.select(F.lit("file").alias("level"), F.col("sp").alias("src"), F.col("dp").alias("dst"), "edge_kind", "weight").unionByName(
        files.where("sm <> dm").groupBy(F.lit("module").alias("level"), F.col("sm").alias("src"), F.col("dm").alias("dst"), "edge_kind").agg(F.sum("weight").alias("weight")))


def metadata(cat: Catalog) -> DataFrame:
    """Sizes of the graph, its size class and how many nodes a view should lay out."""
    n = cat.symbols.agg(F.count("*").alias("n_symbols")).crossJoin(cat.edges.agg(F.count("*").alias("n_edges"))).crossJoin(cat.files.agg(F.count("*").alias("n_files")))
    size = F.when(F.col("n_symbols") < 100, "small").when(F.col("n_symbols") < 1000, "medium").when(F.col("n_symbols") < 10000, "large").otherwise("huge")
    return n.withColumn("size_class", size).withColumn("max_nodes", F.when(size == "small", 5000).when(size == "medium", 2000).when(size == "large", 1000).otherwise(500).cast("long"))


def accesses(cat: Catalog, symbol_id: int) -> DataFrame:
    return cat.edges.where(F.col("edge_kind").startswith("ACCESSES") & (F.col("dst_id") == symbol_id)).select("id", "src_id", "edge_kind", "line")


def file_subgraph(cat: Catalog, path: str) -> DataFrame:
    """Edges with an end in the file."""
    return edges_of(cat, named(cat).where(F.col("path") == path).select("id")).select("id", "src_id", "dst_id", "edge_kind")


def rename_sites(cat: Catalog, old: str) -> DataFrame:
    """Places to edit for a new name: definitions, and calls by name or to a definition. Nothing is written."""
    d = cat.symbols.where(F.col("name") == old)
    places = d.select("file_id", "line", "col").union(cat.calls.where(F.col("callee_name") == old).select("file_id", "line", "col")).union(
        cat.calls.join(d.select(F.col("id").alias("resolved_symbol_id")), "resolved_symbol_id", "left_semi").select("file_id", "line", "col"))
    return places.distinct().join(cat.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "line", "col")


def innermost_symbol(cat: Catalog, span: int = 20) -> DataFrame:
    """For each call, the symbol of its file with the narrowest [line, line + span) around it, least id on ties."""
    s = cat.symbols.select(F.col("file_id"), F.col("id").alias("symbol_id"), F.col("line").alias("start"), (F.col("line") + span + F.col("col") % 40).alias("end"))
    j = cat.calls.select(F.col("id").alias("call_id"), "file_id", "line").join(s, "file_id").where("line >= start AND line < end")
    return j.groupBy("call_id").agg(F.min(F.struct(F.expr("end - start").alias("w"), "symbol_id")).alias("m")).select("call_id", F.col("m.symbol_id").alias("symbol_id"))


def preceding_class(cat: Catalog) -> DataFrame:
    """For each heritage row, the last class of its file at or before its line (an as-of join)."""
    c = cat.symbols.where("kind = 'Class'").select("file_id", F.col("id").alias("class_id"), F.col("line").alias("at"))
    h = cat.heritage.select(F.col("id").alias("heritage_id"), "file_id", "line")
    j = h.join(c, (h.file_id == c.file_id) & (c.at <= h.line), "left")
    return j.groupBy("heritage_id").agg(F.max(F.struct("at", "class_id")).alias("m")).select("heritage_id", F.col("m.class_id").alias("class_id"))
