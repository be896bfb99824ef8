"""Row pipelines for throughput tests, and their figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from loadlens.functions.numbers import ratio

# Fixed value: width of an id bin.
BIN_WIDTH = 10_000


def identity(rows: DataFrame) -> DataFrame:
    return rows.select("*")


def key_count(rows: DataFrame, key: str = "word_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("cnt"))


def binned_sum(
    rows: DataFrame,
    ident: str = "id",
    key: str = "word_id",
    amount: str = "amount",
    width: int = BIN_WIDTH,
) -> DataFrame:
    """Sum and count per id bin and key."""
    return rows.groupBy(
        F.floor(F.col(ident) / width).cast("bigint").alias("window_id"), key
    ).agg(F.sum(amount).alias("total_amount"), F.count("*").alias("cnt"))


def query_times(times: DataFrame, query: str = "query", seconds: str = "seconds") -> DataFrame:
    """Time per query and, in the row without a name, in total."""
    return times.rollup(query).agg(
        F.sum(seconds).alias("seconds"), F.grouping(query).cast("int").alias("is_total")
    )


def job_throughput(
    stages: DataFrame, job: str, sums: Sequence[str], records: str, seconds: str
) -> DataFrame:
    """Stage counters added up per job, and records per second of its duration."""
    totals = stages.groupBy(job).agg(
        *[F.sum(c).alias(c) for c in sums], F.max(seconds).alias("seconds")
    )
    return totals.withColumn(
        "records_per_second",
        F.coalesce(ratio(F.col(records).cast("double"), F.col("seconds")), F.lit(0.0)),
    )
