"""Generated rows that depend on the row id alone, not on the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlens.functions.numbers import hex_text, uniform_double, uniform_int

# Column ranges of the generated sources.
TEXT_LENGTH = 100
COUNT_KEYS = (0, 999)
BIN_KEYS = (0, 99)
AMOUNT = (0, 1000)


def sequence_ids(spark: SparkSession, rows: int, partitions: int | None = None) -> DataFrame:
    """Ids 1 to ``rows``."""
    return spark.range(1, rows + 1, 1, partitions)


def text_rows(ids: DataFrame, ident: str = "id", length: int = TEXT_LENGTH) -> DataFrame:
    return ids.select(F.col(ident).alias("id"), hex_text(F.col(ident), length).alias("data"))


def key_rows(ids: DataFrame, ident: str = "id", keys: tuple[int, int] = COUNT_KEYS) -> DataFrame:
    word = uniform_int(F.col(ident), 1, *keys).cast("int")
    return ids.select(F.col(ident).alias("id"), word.alias("word_id"))


def amount_rows(
    ids: DataFrame,
    ident: str = "id",
    keys: tuple[int, int] = BIN_KEYS,
    amount: tuple[float, float] = AMOUNT,
) -> DataFrame:
    return key_rows(ids, ident, keys).withColumn(
        "amount", uniform_double(F.col("id"), 2, *amount)
    )
