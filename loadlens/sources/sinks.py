"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def discard(df: DataFrame) -> None:
    """Run the plan in full and keep nothing, for throughput tests."""
    df.write.format("noop").mode("overwrite").save()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Overwrite a table; ``by`` keeps like-shaped tables apart in one folder."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def insert_into(df: DataFrame, table: str) -> None:
    df.write.insertInto(table)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def preview(df: DataFrame, rows: int = 100) -> list:
    """The first rows on the driver, never more than asked for."""
    return df.limit(rows).collect()
