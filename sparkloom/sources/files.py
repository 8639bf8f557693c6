"""Directory trees and source files as tables."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.operators.extract import EXTENSIONS, language_of

SKIP = {".git", ".hg", ".svn", "node_modules", "target", "dist", "build", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache"}
MOST_BYTES = 16 << 20
NODES = "path string, name string, depth long, is_dir boolean, is_symlink boolean, is_hidden boolean, is_exec boolean, mode long, size long, repo_label string"


class _Part(InputPartition):
    def __init__(self, top: str | None):
        self.top = top


class _Reader(DataSourceReader):
    """A partition for each folder below the root, and one for the root's own entries."""

    def __init__(self, options):
        self.root = options["path"]
        self.label = options.get("label")
        self.hidden = options.get("hidden", "true").lower() == "true"
        self.depth = int(options.get("maxdepth", 64))

    def _skip(self, name: str) -> bool:
        return name in SKIP or (name.startswith(".") and not self.hidden)

    def partitions(self):
        tops = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not self._skip(e.name))
        return [_Part(None), *map(_Part, tops)]

    def _row(self, entry: os.DirEntry, path: str):
        s = entry.stat(follow_symlinks=False)
        is_dir = entry.is_dir(follow_symlinks=False)
        return (path, entry.name, path.count("/") + 1, is_dir, entry.is_symlink(), entry.name.startswith("."), bool(s.st_mode & stat.S_IXUSR) and not is_dir, stat.S_IMODE(s.st_mode), 0 if is_dir else s.st_size, self.label)

    def read(self, partition):
        stack = [] if partition.top is None else [partition.top]
        if partition.top is None:
            for e in os.scandir(self.root):
                if not self._skip(e.name):
                    yield self._row(e, e.name)
        while stack:
            folder = stack.pop()
            if folder.count("/") + 2 > self.depth:
                continue
            for e in os.scandir(os.path.join(self.root, folder)):
                if self._skip(e.name):
                    continue
                path = f"{folder}/{e.name}"
                yield self._row(e, path)
                if e.is_dir(follow_symlinks=False):
                    stack.append(path)


class TreeSource(DataSource):
    """``spark.read.format("tree").option("path", root).load()``; options label, hidden (true), maxdepth (64)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return NODES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def scan(spark: SparkSession, root: str, label: str | None = None, most: int | None = None, **options) -> DataFrame:
    """Nodes of a tree: folders first, hidden entries last, then by name; at most ``most`` of them in that order."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("path", root)
    for k, v in (options | ({"label": label} if label else {})).items():
        reader = reader.option(k, v)
    nodes = reader.load()
    return nodes if most is None else nodes.orderBy("depth", F.desc("is_dir"), "is_hidden", "name", "path").limit(most)


def scan_group(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Several repositories in one table, told apart by their label."""
    out = None
    for label, root in roots.items():
        part = scan(spark, root, label)
        out = part if out is None else out.unionByName(part)
    return out


def tree_edges(nodes: DataFrame) -> DataFrame:
    """(u, v): each node and its folder."""
    return nodes.where(F.col("path").contains("/")).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("u"), F.col("path").alias("v"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_if("is_dir").alias("dirs"), F.count_if(~F.col("is_dir") & ~F.col("is_symlink")).alias("files"), F.count_if("is_symlink").alias("symlinks"), F.count_if("is_hidden").alias("hidden"), F.sum("size").alias("bytes"))


def sources(spark: SparkSession, root: str, label: str | None = None) -> DataFrame:
    """path, language, size, content, hash of files with a known extension, up to 16 MiB, in valid UTF-8."""
    prefix = os.path.abspath(root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MOST_BYTES)
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS)
    text = F.col("content").cast("string")
    rows = files.where(known).where(F.is_valid_utf8(text)).select(F.substring(path, len(prefix) + 1, 1 << 20).alias("path"), F.col("length").alias("size"), text.alias("content"))
    rows = rows.where(~F.col("path").rlike("(^|/)(" + "|".join(x.replace(".", r"\.") for x in sorted(SKIP)) + ")/"))
    return rows.select("path", language_of(F.col("path")).alias("language"), "size", "content", F.xxhash64("content").alias("hash"), F.lit(label).alias("repo_label"))


def changes(stored: DataFrame, now: DataFrame) -> DataFrame:
    """path and status (added, updated, unchanged, removed) of two (path, hash) tables."""
    j = stored.select("path", F.col("hash").alias("old")).join(now.select("path", F.col("hash").alias("new")), "path", "full_outer")
    return j.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated").alias("status"))


def replace_by_file(table: DataFrame, touched: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """The table without the rows of touched files (removed or changed), and with their fresh rows."""
    return table.join(touched.select(F.col(touched.columns[0]).alias(key)).distinct(), key, "left_anti").unionByName(fresh.select(*table.columns))


def remove_files(tables: dict[str, DataFrame], file_ids: DataFrame) -> dict[str, DataFrame]:
    """All rows of some files taken out: by file_id, and edges also where an end was a symbol of theirs."""
    ids = file_ids.toDF("file_id").distinct()
    out = {n: t.join(ids, "file_id", "left_anti") if "file_id" in t.columns else t for n, t in tables.items()}
    if "files" in out:
        out["files"] = out["files"].join(ids.toDF("id"), "id", "left_anti")
    if "edges" in out and "symbols" in tables:
        gone = tables["symbols"].join(ids, "file_id", "left_semi").select("id")
        out["edges"] = out["edges"].join(gone.toDF("src_id"), "src_id", "left_anti").join(gone.toDF("dst_id"), "dst_id", "left_anti")
    return out
