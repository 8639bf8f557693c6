"""A catalog from a source tree: read, extract, resolve. Everything stays lazy until a table is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.scores import parent_dir
from sparkloom.operators import extract, resolve
from sparkloom.plans.catalog import Catalog, from_tables
from sparkloom.plans.materialize import checkpoint
from sparkloom.plans.schema import conform
from sparkloom.sources.files import sources


def _relative(source, folder):
    """./x and ../x against the folder of the file that imports it."""
    up = F.regexp_replace(folder, "/?[^/]+$", "")
    join = lambda a, b: F.when((a == "") | (a == "."), b).otherwise(F.concat(a, F.lit("/"), b))
    return F.when(source.startswith("./"), join(folder, F.substring(source, 3, 1 << 20))).when(source.startswith("../"), join(up, F.substring(source, 4, 1 << 20))).otherwise(source)


def symbols_of(files: DataFrame, src: DataFrame) -> DataFrame:
    """Definitions as symbols: Python by its syntax tree, other languages by lines. Ids are hashes, the same in every run."""
    py = extract.python_definitions(src).select("path", "line", "kind", "name", "qualified_name", (~F.col("name").startswith("_")).alias("is_exported"))
    other = extract.definitions(src.where("language <> 'python'")).select("path", "line", "kind", "name", F.col("name").alias("qualified_name"), "is_exported")
    rows = py.unionByName(other).join(files.select("path", F.col("id").alias("file_id")), "path")
    keyed = rows.withColumn("id", F.xxhash64("path", "kind", "name", "line")).withColumn("scope_id", F.col("id")).withColumn("col", F.lit(0))
    # the owner of a member is the class that its qualified name begins with
    owner = F.regexp_extract("qualified_name", r"^(.*)\.[^.]+$", 1)
    classes = keyed.where("kind = 'Class'").groupBy("file_id", F.col("qualified_name").alias("owner")).agg(F.min("id").alias("owner_symbol_id"))
    return keyed.withColumn("owner", owner).join(classes, ["file_id", "owner"], "left")


def build(spark: SparkSession, root: str, label: str | None = None) -> Catalog:
    """Tables files, symbols, imports, exports, heritage, calls, edges and routes of a source tree."""
    src = checkpoint(sources(spark, root, label))
    files = src.select(F.xxhash64("path").alias("id"), "path", "hash", "language", F.lit(0).alias("mtime"), F.lit(0).alias("indexed_at"), "repo_label")
    symbols = checkpoint(conform(symbols_of(files, src), "symbols"))
    ids = files.select("path", F.col("id").alias("file_id"))

    found = extract.imports(src).join(ids, "path").withColumn("id", F.xxhash64("path", "line", "imported_name"))
    found = found.withColumn("source", _relative(F.col("source"), parent_dir(F.col("path"))))
    target = resolve.resolve_imports(found.select("id", "source", "language").dropDuplicates(["id"]), files)
    imports = found.join(target, "id").withColumn("local_name", F.col("imported_name"))

    # the caller is the last definition of the file at or before the line
    at = symbols.select("file_id", "line", F.col("id").alias("symbol_id"))
    call = extract.calls(src).join(ids, "path").withColumn("symbol_id", F.lit(None).cast("long"))
    both = call.select("file_id", "line", "symbol_id", "receiver", "callee_name", "col").unionByName(at, allowMissingColumns=True)
    order = Window.partitionBy("file_id").orderBy("line", F.col("callee_name").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("caller_scope_id", F.last("symbol_id", ignorenulls=True).over(order)).where("callee_name IS NOT NULL")
    calls = placed.withColumn("id", F.xxhash64("file_id", "line", "callee_name", "receiver", "col")).dropDuplicates(["id"])
    calls = conform(calls.withColumn("resolved_symbol_id", F.lit(None)).withColumn("confidence", F.lit(0.0)), "calls")

    base = from_tables(spark, {"files": conform(files, "files"), "symbols": symbols, "imports": conform(imports, "imports"), "calls": calls})
    best = resolve.resolve_calls(base)
    calls = checkpoint(conform(calls.drop("resolved_symbol_id", "confidence").join(best.select(F.col("call_id").alias("id"), F.col("symbol_id").alias("resolved_symbol_id"), "confidence"), "id", "left").na.fill(0.0, ["confidence"]), "calls"))

    parent = extract.parents(src).join(ids, "path").join(symbols.select("file_id", "line", "name", F.col("id").alias("child_symbol_id")), ["file_id", "line", "name"])
    heritage = conform(parent.withColumn("id", F.xxhash64("child_symbol_id", "parent")).withColumnRenamed("parent", "parent_name").withColumn("confidence", F.lit(0.9)), "heritage")
    inherited = resolve.inheritance_edges(base.replace(heritage=heritage)).select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), "edge_kind", F.lit(0.9).alias("confidence"))
    called = calls.where("resolved_symbol_id IS NOT NULL AND caller_scope_id IS NOT NULL").groupBy(F.col("caller_scope_id").alias("src_id"), F.col("resolved_symbol_id").alias("dst_id")).agg(F.max("confidence").alias("confidence"), F.min("file_id").alias("file_id"), F.min("line").alias("line")).withColumn("edge_kind", F.lit("CALLS"))
    edges = called.unionByName(inherited, allowMissingColumns=True).withColumn("id", F.xxhash64("src_id", "dst_id", "edge_kind"))
    routes = extract.routes(src).withColumn("id", F.xxhash64("method", "path", "file_path", "line"))
    handler = routes.join(files.select(F.col("path").alias("file_path"), F.col("id").alias("file_id")), "file_path").join(symbols.select("file_id", F.col("line").alias("at"), F.col("id").alias("symbol_id")), "file_id", "left")
    after = handler.groupBy("id").agg(F.min(F.when(F.col("at") >= F.col("line"), F.struct("at", "symbol_id"))).alias("m")).select("id", F.col("m.symbol_id").alias("handler_symbol_id"))
    return base.replace(
        calls=calls, heritage=heritage, edges=conform(edges, "edges"), routes=conform(routes.join(after, "id", "left"), "routes"),
        exports=conform(symbols.where("is_exported").select("id", "file_id", F.col("name").alias("exported_name"), F.col("id").alias("symbol_id"), F.lit(False).alias("is_default")), "exports"))
