"""Session and column helpers."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def base_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session on one machine gets a temporary one; a cluster is an error, since its
    executors don't see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="shared-")


def checkpoint(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, so lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base_folder(df.sparkSession))
    return df.checkpoint()


#: Bytes of an Arrow batch on its way to a Python worker; Spark's default is sixteen times that.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, unless the user has set a bound: each is held three or four times over by executor and worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(name, str(BATCH_BYTES))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and ``more``) alone: other columns can't clash with what an operator adds."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(name: str):
    """The column of this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list:
    return [exact(c) for c in df.columns]


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df written as Parquet to the shared folder and read again: no lineage, and its size is known to the planner."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(docs: DataFrame, expansion: float, target: int = 16 << 20) -> int:
    """How many parts of about ``target`` bytes hold ``expansion`` times the text of docs; never fewer than Spark's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * expansion / target))


#: Ids that are sent to every executor (a hash table of some 25 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids; rows with a null id stay. The ids are counted before they are broadcast."""
    gone = stored(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "ids")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(columns(docs))
