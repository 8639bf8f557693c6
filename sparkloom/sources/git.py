"""Git history as tables. Git itself runs on the driver; the text it prints is parsed by Spark."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "%x01%H%x02%an%x02%ae%x02%at%x02%s"


def log_text(repo: str, most: int | None = None, since: int | None = None) -> str:
    args = ["git", "-C", repo, "log", "--numstat", "--summary", f"--format={FORMAT}"]
    args += [f"-n{most}"] * (most is not None) + [f"--since={since}"] * (since is not None)
    return subprocess.run(args, capture_output=True, text=True, check=True).stdout


def parse_log(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """commits and file_commits of ``log_text``. Binary files count no lines."""
    entries = spark.createDataFrame([(x,) for x in text.split("\x01")[1:]], "entry string")
    head = F.split(F.substring_index("entry", "\n", 1), "\x02")
    rows = entries.select(head.alias("h"), F.split("entry", "\n").alias("lines"))
    commits = rows.select(F.col("h")[0].alias("hash"), F.col("h")[1].alias("author_name"), F.col("h")[2].alias("author_email"), F.col("h")[3].cast("long").alias("timestamp"), F.col("h")[4].alias("message"))
    stat = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    lines = rows.select(F.col("h")[0].alias("commit_hash"), "lines", F.explode("lines").alias("line")).where(F.col("line").rlike(stat))
    path = F.regexp_extract("line", stat, 3)
    number = lambda i: F.coalesce(F.expr("try_cast({} AS BIGINT)".format(f"regexp_extract(line, '^(\\\\d+|-)\\t(\\\\d+|-)\\t(.+)$', {i})")), F.lit(0))
    created = F.exists("lines", lambda x: x.startswith(" create mode") & x.endswith(F.concat(F.lit(" "), path)))
    return commits, lines.select(path.alias("file_path"), "commit_hash", number(1).alias("lines_added"), number(2).alias("lines_removed"), created.alias("is_creation"))


def history(spark: SparkSession, repo: str, most: int | None = None, since: int | None = None) -> tuple[DataFrame, DataFrame]:
    return parse_log(spark, log_text(repo, most, since))


def blame(spark: SparkSession, repo: str, path: str) -> DataFrame:
    """line_number, commit_hash, author_name, last_changed_at of every line of a file."""
    text = subprocess.run(["git", "-C", repo, "blame", "--line-porcelain", path], capture_output=True, text=True, check=True).stdout
    rows, at = [], {}
    for line in text.split("\n"):
        word, _, rest = line.partition(" ")
        if line.startswith("\t"):
            rows.append((at["line"], at["hash"], at["author"], int(at["author-time"])))
        elif len(word) == 40 and all(c in "0123456789abcdef" for c in word):
            at = {"hash": word, "line": int(rest.split(" ")[1])}
        else:
            at[word] = rest
    return spark.createDataFrame(rows, "line_number long, commit_hash string, author_name string, last_changed_at long")
