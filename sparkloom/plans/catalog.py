"""The catalog: named DataFrames with the columns of ``schema.TABLES``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import adapter


class Catalog:
    """Tables by attribute, built when first asked for."""

    def __init__(self, spark: SparkSession, build: Callable[[str], DataFrame]):
        self.spark, self._build, self._tables = spark, build, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self._build(name)
        return self._tables[name]

    def replace(self, **tables: DataFrame) -> Catalog:
        """A catalog with some tables exchanged."""
        out = Catalog(self.spark, self._build)
        out._tables = {n: t for n, t in self._tables.items() if not n.startswith("_") or "edges" not in tables} | tables
        return out

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What is derived from the edges and used more than once: built when first asked for."""
        if f"_{name}" not in self._tables:
            self._tables[f"_{name}"] = build()
        return self._tables[f"_{name}"]

    def save(self, folder: str, names: list[str], mode: str = "overwrite") -> None:
        """Edges are laid out by kind and sorted by source, so that files and row groups can be skipped."""
        for n in names:
            df = getattr(self, n)
            if n == "edges":
                df.repartition("edge_kind", "src_id").sortWithinPartitions("src_id").write.partitionBy("edge_kind").mode(mode).parquet(f"{folder}/{n}")
            else:
                df.write.mode(mode).parquet(f"{folder}/{n}")

    def register(self, names: list[str]) -> None:
        for n in names:
            getattr(self, n).createOrReplaceTempView(n)


def from_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> Catalog:
    return Catalog(spark, lambda name: tables[name])


def load(spark: SparkSession, folder: str) -> Catalog:
    """A catalog that ``Catalog.save`` wrote."""
    return Catalog(spark, lambda name: spark.read.parquet(f"{folder}/{name}"))


def from_test_tables(spark: SparkSession, sf_dir: str) -> Catalog:
    """The adapter's views over the Parquet tables of a folder; names of the tables themselves work too."""

    def build(name: str) -> DataFrame:
        if name in adapter.BASE:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")
        text = adapter.dialect(adapter.VIEWS[name], "spark")
        used = [x for x in (*adapter.BASE, *adapter.VIEWS) if adapter.needed(text, {x: ""})]
        for x in used:
            text = _refer(text, x)
        return spark.sql(text, **{x: getattr(catalog, x) for x in used})

    catalog = Catalog(spark, build)
    return catalog


def _refer(text: str, name: str) -> str:
    return re.sub(rf"\b(FROM|JOIN)(\s+){name}\b", rf"\1\2{{{name}}}", text)
