"""Streaming forms: an index that follows new files, evidence whose state follows scans, and change rates over time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.extract import definitions


def source_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """path and content of files as they appear in a folder."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"))


def index_stream(files: DataFrame, out: str, checkpoint: str):
    """Definitions of each batch of files, written under the number of the batch: a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("modified")))).where("rn = 1")
        definitions(latest).write.mode("overwrite").parquet(f"{out}/definitions/batch={number}")
        latest.select("path", F.xxhash64("content").alias("hash")).write.mode("overwrite").parquet(f"{out}/files/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """Definitions by the latest batch that held their file."""
    last = spark.read.parquet(f"{out}/files").groupBy("path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/definitions").join(last, ["path", "batch"], "left_semi").drop("batch")


def evidence_feedback(scans: DataFrame, step: float = 0.1) -> DataFrame:
    """A stream of (id, confidence) to (id, confidence, stability, times): seen again, evidence is steadier and keeps its best confidence."""

    def update(key, batches, state: GroupState):
        best, stability, times = state.get if state.exists else (0.0, None, 0)
        for pdf in batches:
            for c in pdf["confidence"]:
                best = max(best, float(c))
                stability = 1.0 if stability is None else min(1.0, stability + step)
                times += 1
        state.update((best, stability, times))
        yield pd.DataFrame({"id": [key[0]], "confidence": [best], "stability": [stability], "times": [times]})

    schema = "confidence double, stability double, times long"
    return scans.groupBy("id").applyInPandasWithState(update, f"id string, {schema}", schema, "update", GroupStateTimeout.NoTimeout)


def change_rate(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Events by time window: tumbling, or sliding with ``slide``; rows later than ``late`` are left out in a stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Bursts of activity: events of a user with less than ``gap`` between them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), by, "n")
