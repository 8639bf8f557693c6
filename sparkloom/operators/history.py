"""Change history: ownership, co-change, risk and experts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scores import change_tier
from sparkloom.plans.catalog import Catalog


def authors(cat: Catalog) -> DataFrame:
    """Commits, lines, first and last commit and the latest name of each e-mail address."""
    lines = cat.file_commits.groupBy("commit_hash").agg(F.sum("lines_added").alias("a"), F.sum("lines_removed").alias("r"))
    c = cat.commits.join(lines, cat.commits.hash == lines.commit_hash, "left")
    return c.groupBy(F.col("author_email").alias("email")).agg(
        F.max_by("author_name", F.struct("timestamp", "hash")).alias("name"), F.count("*").alias("commit_count"), F.coalesce(F.sum("a"), F.lit(0)).alias("lines_added"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("lines_removed"), F.min("timestamp").alias("first_commit"), F.max("timestamp").alias("last_commit"))


def top_authors(cat: Catalog, limit: int = 10) -> DataFrame:
    return authors(cat).orderBy(F.desc("commit_count"), "email").limit(limit)


def file_history(cat: Catalog, path: str, limit: int = 20) -> DataFrame:
    f = cat.file_commits.where(F.col("file_path") == path)
    return f.join(cat.commits, f.commit_hash == cat.commits.hash).select("hash", "author_name", "timestamp", "message", "lines_added", "lines_removed").orderBy(F.desc("timestamp"), "hash").limit(limit)


def change_hotspots(cat: Catalog, limit: int = 20) -> DataFrame:
    return cat.file_commits.groupBy("file_path").agg(F.count("*").alias("changes"), F.sum(F.col("lines_added") + F.col("lines_removed")).alias("churn")).orderBy(F.desc("changes"), F.desc("churn"), "file_path").limit(limit)


def co_change(cat: Catalog, path: str | None = None, limit: int | None = 20) -> DataFrame:
    """Pairs of files in common commits. With a path only its commits are joined; without one every pair a < b of every commit."""
    f = cat.file_commits.select("file_path", "commit_hash")
    if path is None:
        other = f.withColumnRenamed("file_path", "other_path")
        pairs = f.join(other, "commit_hash").where("file_path < other_path").groupBy("file_path", "other_path").agg(F.count("*").alias("shared"))
        return pairs.orderBy(F.desc("shared"), "file_path", "other_path").limit(limit) if limit else pairs
    mine = f.where(F.col("file_path") == path).select("commit_hash")
    out = f.where(F.col("file_path") != path).join(mine, "commit_hash", "left_semi").groupBy(F.col("file_path").alias("other_path")).agg(F.count("*").alias("shared"))
    return out.orderBy(F.desc("shared"), "other_path").limit(limit) if limit else out


def smart_co_change(cat: Catalog, symbol_id: int, limit: int = 10) -> DataFrame:
    """Files that change with the symbol's file or are linked to it by edges, and which of the two it is."""
    files = cat.files.select(F.col("id").alias("file_id"), "path")
    mine = cat.symbols.where(F.col("id") == symbol_id).join(files, "file_id").select("file_id", "path")
    own = cat.file_commits.join(mine, cat.file_commits.file_path == mine.path, "left_semi").select("commit_hash")
    git = cat.file_commits.join(own, "commit_hash", "left_semi").join(mine, F.col("file_path") == F.col("path"), "left_anti").groupBy(F.col("file_path").alias("other_path")).agg(F.countDistinct("commit_hash").alias("shared"))
    at = cat.symbols.select("id", "file_id")
    e = cat.edges.join(at.toDF("src_id", "sf"), "src_id").join(at.toDF("dst_id", "df"), "dst_id").where("sf <> df")
    m = mine.select(F.col("file_id").alias("m"))
    static = e.join(m, e.sf == F.col("m"), "left_semi").select(F.col("df").alias("file_id")).union(e.join(m, e.df == F.col("m"), "left_semi").select("sf")).distinct().join(files, "file_id").select(F.col("path").alias("other_path"), F.lit(True).alias("static"))
    both = git.join(static, "other_path", "full_outer")
    kind = F.when(F.col("shared").isNull(), "static_only").when(F.col("static").isNull(), "git_only").otherwise("both")
    return both.select("other_path", F.coalesce("shared", F.lit(0)).alias("shared"), kind.alias("signal_type")).orderBy(F.desc("shared"), "other_path").limit(limit)


def git_stats(cat: Catalog) -> DataFrame:
    c = cat.commits.agg(F.count("*").alias("commits"), F.countDistinct("author_email").alias("authors"))
    return c.crossJoin(cat.file_commits.agg(F.count("*").alias("file_commits"), F.countDistinct("file_path").alias("files")))


def symbol_ownership(cat: Catalog, symbol_id: int, limit: int = 5) -> DataFrame:
    """Authors of the symbol's file: commits, first commit and last change of each, and how many authors there are."""
    path = cat.symbols.where(F.col("id") == symbol_id).join(cat.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path")
    f = cat.file_commits.join(path, cat.file_commits.file_path == path.path, "left_semi")
    c = f.join(cat.commits, f.commit_hash == cat.commits.hash)
    by = c.groupBy("author_name").agg(F.count("*").alias("commits"), F.max("timestamp").alias("last_change"), F.min_by("hash", F.struct("timestamp", "hash")).alias("first_hash"))
    return by.withColumn("authors", F.count("*").over(Window.partitionBy())).orderBy(F.desc("commits"), "author_name").limit(limit)


def change_risk(cat: Catalog, as_of: int) -> DataFrame:
    """Commits a day of age, times authors, for every file. ``as_of``: unix seconds that count as now."""
    c = cat.file_commits.join(cat.commits, cat.file_commits.commit_hash == cat.commits.hash)
    g = c.groupBy("file_path").agg(F.count("*").alias("commits"), F.countDistinct("author_email").alias("authors"), F.min("timestamp").alias("first"))
    score = F.col("commits") / F.greatest(F.lit(1), F.floor((F.lit(as_of) - F.col("first")) / 86400)) * F.col("authors")
    return g.select("file_path", "commits", "authors", F.round(score, 6).alias("score")).withColumn("level", change_tier(F.col("score")))


def find_experts(cat: Catalog, path: str, limit: int = 5) -> DataFrame:
    f = cat.file_commits.where(F.col("file_path") == path)
    return f.join(cat.commits, f.commit_hash == cat.commits.hash).groupBy("author_name").agg(
        F.count("*").alias("commits"), F.sum(F.col("lines_added") + F.col("lines_removed")).alias("lines"), F.max("timestamp").alias("last_active")).orderBy(F.desc("commits"), F.desc("lines"), "author_name").limit(limit)


def blame_runs(cat: Catalog, file_id: int | None = None) -> DataFrame:
    """Stretches of consecutive lines of one author and commit (gaps and islands); a line number is there once in a file.

    Only the first and the last line of each stretch are kept, and the last one is the next row after the first: windows over one
    sort, which hold an author's lines of one commit in a file at a time, and no hash table of all stretches.
    """
    b = cat.blame_lines if file_id is None else cat.blame_lines.where(F.col("file_id") == file_id)
    own, line = Window.partitionBy("file_id", "author_name", "commit_hash").orderBy("line_number"), F.col("line_number")
    opens, closes = (F.coalesce(x != 1, F.lit(True)) for x in (line - F.lag(line).over(own), F.lead(line).over(own) - line))
    ends = b.select("file_id", "author_name", "commit_hash", "line_number", opens.alias("opens"), closes.alias("closes")).where("opens OR closes")
    last = F.when(F.col("closes"), line).otherwise(F.lead(line).over(own))
    return ends.withColumn("last", last).where("opens").select("file_id", "author_name", "commit_hash", line.cast("long").alias("first_line"), F.col("last").cast("long").alias("last_line"))


def symbol_blame(cat: Catalog, lines: int = 100) -> DataFrame:
    """For each symbol with blamed lines in [line, line + lines]: its most frequent author and last change. Joined on the file, ranged within it."""
    s = cat.symbols.select("id", "file_id", "line")
    b = cat.blame_lines.select("file_id", "line_number", "author_name", "last_changed_at")
    j = s.join(b, (s.file_id == b.file_id) & b.line_number.between(s.line, s.line + lines))
    n = j.groupBy("id", "author_name").agg(F.count("*").alias("n"), F.max("last_changed_at").alias("t"))
    return n.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "author_name")).alias("m"), F.max("t").alias("last_changed_at")).select("id", F.col("m.author_name").alias("primary_author"), "last_changed_at")


def detect_changes(cat: Catalog, since: int) -> DataFrame:
    """Symbols of the files changed since then, and how many symbols of other files use them."""
    hot = cat.file_commits.join(cat.commits.where(F.col("timestamp") >= since), F.col("commit_hash") == F.col("hash")).select(F.col("file_path").alias("path")).distinct()
    changed = cat.symbols.join(cat.files.select(F.col("id").alias("file_id"), "path"), "file_id").join(hot, "path", "left_semi").select("id", "name", "path")
    users = cat.edges.where("edge_kind = 'CALLS'").groupBy(F.col("dst_id").alias("id")).agg(F.countDistinct("src_id").alias("u"))
    return changed.join(users, "id", "left").select("id", "name", "path", F.coalesce("u", F.lit(0)).alias("affected"))


def contract_changes(cat: Catalog, diff: DataFrame) -> DataFrame:
    """Exported symbols of changed files; NEW if an added line of the diff (path, line) has the name."""
    s = cat.symbols.where("is_exported").join(cat.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    j = s.join(diff.select("path", F.col("line").alias("added")), "path")
    return j.groupBy("id", "name", "path").agg(F.when(F.bool_or(F.col("added").contains(F.col("name"))), "NEW").otherwise("MODIFIED").alias("change"))
