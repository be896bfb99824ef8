"""Columnar tables and the catalog."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register(tables: Mapping[str, DataFrame]) -> None:
    """Make frames known to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def has_files(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether paths or patterns name anything; asked of Spark's own listing, nothing is read."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def present(spark: SparkSession, folder: str, names: Iterable[str]) -> DataFrame:
    """Each required name with whether the folder holds files for it."""
    root = folder.rstrip("/")
    # As braces, so that the one or the other is enough.
    rows = [(name, has_files(spark, f"{root}/{{{name},{name}.*}}")) for name in names]
    return spark.createDataFrame(rows, "table_name STRING, present BOOLEAN").orderBy("table_name")


def count_check(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(f"{name}_count"))
