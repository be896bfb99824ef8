"""Summary statistics of a metric per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.operators.joins import null_safe_join
from loadlens.operators.ranks import (
    SLICES,
    SlicedGroups,
    group_moments,
    pick_ranks,
    slice_groups,
)

# The shares and nanosecond limits the reports use.
SUMMARY_SHARES = {"p10": 0.10, "median": 0.50, "p90": 0.90}
LOWER_SHARES = {"p90": 0.90, "p99": 0.99}
TAIL_LIMITS_NS = {
    "gt_10us": 10_000,
    "gt_1ms": 1_000_000,
    "gt_10ms": 10_000_000,
    "gt_100ms": 100_000_000,
    "gt_1s": 1_000_000_000,
}


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Mapping[str, float],
    slices: int = SLICES,
    slice_rows: int | None = None,
) -> DataFrame:
    """Exact percentiles, linear between the two nearest ranks."""
    groups = slice_groups(df, keys, value, slices, slice_rows)
    return _percentiles(groups, shares).select(*keys, *shares)


def _percentiles(groups: SlicedGroups, shares: Mapping[str, float]) -> DataFrame:
    ranks = {}
    for name, share in shares.items():
        ranks[f"{name}_low"] = lambda n, p=share: F.floor((n - 1) * F.lit(p))
        ranks[f"{name}_high"] = lambda n, p=share: F.ceil((n - 1) * F.lit(p))

    def between(name: str, share: float) -> Column:
        low, high = (F.col(f"{name}_{end}").cast("double") for end in ("low", "high"))
        position = (F.col("_n") - 1) * F.lit(share)
        weight = position - F.floor(position)
        return (low * (1 - weight) + high * weight).alias(name)

    found = pick_ranks(groups, ranks)
    return found.select(*groups.keys, *[between(n, share) for n, share in shares.items()])


def approx_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """One-pass sketch of :func:`percentiles`, for callers who accept its error."""
    names = list(shares)
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(value, [shares[n] for n in names], accuracy).alias("_cuts")
    )
    return cuts.select(*keys, *[F.col("_cuts")[i].alias(n) for i, n in enumerate(names)])


def rank_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, slices: int = SLICES,
    slice_rows: int | None = None,
) -> DataFrame:
    """n, min, max, mean and lower-rank percentiles, which are always samples."""
    ranks = {"p50": lambda n: F.floor(n / 2)}
    for name, share in LOWER_SHARES.items():
        ranks[name] = lambda n, p=share: F.floor((n - 1) * F.lit(p))
    groups = slice_groups(df, keys, value, slices, slice_rows)
    plain = group_moments(groups).drop("stdev").where("n > 0")
    picked = pick_ranks(groups, ranks).drop("_n")
    return null_safe_join(plain, picked, groups.keys).drop("_all")


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, min, max and stdev in one pass, where no percentile is wanted."""
    number = F.col(value).cast("double")
    stdev = F.when(F.count(number) == 1, F.lit(0.0)).otherwise(F.stddev_samp(number))
    return df.groupBy(*keys).agg(
        F.count(number).alias("n"),
        F.avg(number).alias("mean"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        stdev.alias("stdev"),
    )


def summarize(
    df: DataFrame, keys: Sequence[str], value: str, slices: int = SLICES,
    slice_rows: int | None = None,
) -> DataFrame:
    """Full summary per group; NULLs are left out, an empty group has n = 0."""
    groups = slice_groups(df, keys, value, slices, slice_rows)
    shares = _percentiles(groups, SUMMARY_SHARES)
    both = null_safe_join(group_moments(groups), shares, groups.keys, "left")
    return both.select(
        *keys,
        "n",
        "mean",
        "median",
        F.col("min").cast("double").alias("min"),
        F.col("max").cast("double").alias("max"),
        "stdev",
        (F.col("stdev") / F.nullif(F.col("mean"), F.lit(0.0))).alias("cv"),
        "p10",
        "p90",
    )


def tail_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    limits: Mapping[str, float] = TAIL_LIMITS_NS,
) -> DataFrame:
    """Zeroes and how many values exceed each limit; the counts overlap."""
    number = F.col(value)
    return df.groupBy(*keys).agg(
        F.count_if(number == 0).alias("zero"),
        *[F.count_if(number > limit).alias(name) for name, limit in limits.items()],
    )
