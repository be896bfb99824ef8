"""Table presence, row counts and key checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def key_check(df: DataFrame, name: str, key: Sequence[str], required: Iterable[str]) -> DataFrame:
    """Rows, NULLs in required columns, and keys that occur more than once.

    The table is counted up by its key first, so copies of a key, however many,
    reduce to one row before the shuffle.
    """
    per_key = df.groupBy(*key).agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in required],
    )
    return per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("row_count"),
        F.count("*").alias("distinct_keys"),
        F.count_if(F.col("_rows") > 1).alias("duplicate_keys"),
        F.coalesce(
            reduce(lambda a, b: a + b, [F.sum(f"_null_{c}") for c in required]), F.lit(0)
        ).alias("null_values"),
    ).select(F.lit(name).alias("table_name"), "*")


def missing_tables(spark: SparkSession, required: Iterable[str]) -> list[str]:
    """Names that the catalog does not know."""
    return [name for name in required if not spark.catalog.tableExists(name)]
