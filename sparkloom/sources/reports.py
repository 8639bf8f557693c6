"""Configuration in, reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "layers array<struct<name:string,paths:array<string>>>, rules array<struct<name:string,`from`:string,`to`:string,allowed:boolean>>"


def boundary_rules(spark: SparkSession, path: str) -> tuple[list, list]:
    """Layers and rules of a JSON file, for ``evidence.boundary_violations``."""
    row = spark.read.schema(RULES).option("multiLine", True).option("mode", "FAILFAST").json(path).first()
    return [(x["name"], x["paths"]) for x in row["layers"]], [(x["name"], x["from"], x["to"], x["allowed"]) for x in row["rules"]]


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON document, fields in order of name."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def dot(edges: DataFrame) -> DataFrame:
    """value: lines of a DOT graph of (src, dst, label), sorted."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), '(["\\\\])', r"\\$1"), F.lit('"'))
    line = F.concat(F.lit("  "), quote("src"), F.lit(" -> "), quote("dst"), F.lit(" [label="), quote("label"), F.lit("];"))
    body = edges.select(F.lit(1).alias("o"), line.alias("value"))
    ends = edges.sparkSession.createDataFrame([(0, "digraph g {"), (2, "}")], "o int, value string")
    return body.union(ends).orderBy("o", "value").select("value")


def sarif(findings: DataFrame, tool: str = "sparkloom") -> DataFrame:
    """value: one SARIF 2.1.0 document of findings (rule, message, path, line)."""
    result = F.struct(F.col("rule").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"))
    runs = F.array(F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), F.sort_array(F.collect_list(result)).alias("results")))
    return findings.agg(F.to_json(F.struct(F.lit("2.1.0").alias("version"), runs.alias("runs"))).alias("value"))
