"""Reading the stored tables.

Parquet scans only: Catalyst prunes columns and pushes filters into the scan,
so callers should select and filter as early as they like and let the plan
show ``ReadSchema`` / ``PushedFilters``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``<root>/<name>.parquet``; ``root`` may be a local or a shared path."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


class Catalog:
    """Lazy handle on the tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str, **tables: DataFrame):
        self.spark = spark
        self.root = root
        self.tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.__dict__.get("tables", {}):
            return self.tables[name]
        if name in TABLE_NAMES:
            return read_table(self.spark, self.root, name)
        raise AttributeError(name)


def replace_table(catalog: Catalog, name: str, frame: DataFrame) -> Catalog:
    """The catalog with one table's frame in place of the stored one."""
    return Catalog(catalog.spark, catalog.root, **{**catalog.tables, name: frame})


def read_source(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalog by its name, or Parquet files by their path
    (anything with a slash)."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)
