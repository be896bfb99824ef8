"""Exact order statistics without bringing a group into one task.

One pass gives each group's count, moments, least and largest value. A group that is
small enough is ranked in a window. A larger one is a slice to be cut: its range is
divided evenly, a partial aggregate counts rows per (slice, part), and only the parts
that hold a wanted rank go on, with their own least and largest value, until each is
small enough or all its values are equal. So the rows a window sees are bounded by
``SLICE_ROWS``, whatever a group holds, and a pass reads and ships less than the one
before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from loadlens.operators.joins import BROADCAST_ROWS, fits_broadcast, null_safe_join
from loadlens.session import snapshot

# Parts a slice is cut into at a time.
SLICES = 1024
# About this many rows are sorted at once, by a window or as whole rows.
SLICE_ROWS = 500_000
MAX_SLICES = 8192
# Rows of a group that is cut are dealt to this many copies of its slices.
SALTS = 64
# Below this the logarithmic scale of the first cut is linear.
_SMALLEST = float(1 << 40)


def slice_bounds(df: DataFrame, value: str, slices: int = SLICES) -> list[float]:
    """Increasing cut points that split the column into even parts.

    One pass with a bounded sketch; at most ``slices`` numbers reach the driver. They only steer the work, so they need not be exact.
    """
    if slices < 2:
        return []
    shares = [i / slices for i in range(1, slices)]
    number = df.select(F.col(value).cast("double").alias("_point"))
    # An infinite value is in the first or last slice anyway.
    found = set(number.approxQuantile("_point", shares, 0.5 / slices))
    return sorted(b for b in found if abs(b) != float("inf"))


def with_slice(df: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """Add ``_slice``, which never decreases as the value grows."""
    cutter = Bucketizer(
        splits=[float("-inf"), *bounds, float("inf")], inputCol="_point", outputCol="_cut"
    )
    if not bounds:
        return df.withColumn("_slice", F.lit(0))
    pointed = df.withColumn("_point", F.col(value).cast("double"))
    return cutter.transform(pointed).withColumn("_slice", F.col("_cut").cast("int")).drop(
        "_point", "_cut"
    )


@dataclass(frozen=True)
class SlicedGroups:
    """Rows of groups with one stored profile line per group.

    Without keys all rows are one group, under a key of its own.
    """

    keys: tuple[str, ...]
    rows: DataFrame
    profile: DataFrame
    slices: int
    slice_rows: int
    broadcast_rows: int


def slice_groups(
    df: DataFrame, keys: Sequence[str], value: str, slices: int = SLICES,
    slice_rows: int | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> SlicedGroups:
    """Profile every group in one pass. NaN counts as NULL, and NULLs are not ranked.

    A group of more than ``slice_rows`` rows is cut into ``slices`` parts at a time.
    """
    plain = F.col(value)
    if df.schema[value].dataType.typeName() in ("double", "float"):
        plain = F.nanvl(plain, F.lit(None).cast("double"))
    own = [F.col(k) for k in keys] or [F.lit(0).alias("_all")]
    rows = df.select(*own, plain.alias("_value"))
    keys = tuple(keys) or ("_all",)
    number = F.col("_value").cast("double")
    profile = rows.groupBy(*keys).agg(
        F.count("_value").alias("_n"),
        F.min("_value").alias("_low"),
        F.max("_value").alias("_high"),
        F.avg(number).alias("_mean"),
        F.stddev_samp(number).alias("_dev"),
    )
    return SlicedGroups(
        keys, rows, snapshot(profile, "profile"), max(2, slices),
        SLICE_ROWS if slice_rows is None else slice_rows, broadcast_rows,
    )


def group_moments(groups: SlicedGroups) -> DataFrame:
    """n, mean, min, max and sample deviation per group, from the profile alone."""
    return groups.profile.select(
        *groups.keys,
        F.col("_n").alias("n"),
        F.col("_mean").alias("mean"),
        F.col("_low").alias("min"),
        F.col("_high").alias("max"),
        F.when(F.col("_n") == 1, F.lit(0.0)).when(F.col("_n") > 1, F.col("_dev")).alias("stdev"),
    )


def pick_ranks(
    groups: SlicedGroups, ranks: Mapping[str, Callable[[Column], Column]]
) -> DataFrame:
    """Per group its size ``_n`` and the values at given 0-based ranks.

    ``ranks`` maps an output column to a function of the group's row count.
    """
    keys = list(groups.keys)
    asked = F.array(
        *[
            F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("bigint").alias("rank"))
            for name, rank in ranks.items()
        ]
    )
    sized = groups.profile.where("_n > 0")
    small = sized.where(F.col("_n") <= groups.slice_rows)
    large = sized.where(F.col("_n") > groups.slice_rows)
    wide = not large.isEmpty()
    found = [_pick_small(groups, small, large if wide else None, asked)]
    if wide:
        found += cut_slices(groups, large.withColumn("_asks", asked))[1]
    return reduce(DataFrame.unionByName, found).groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[F.min(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in ranks],
    )


def _pick_small(
    groups: SlicedGroups, small: DataFrame, large: DataFrame | None, asked: Column
) -> DataFrame:
    """(keys, _n, _name, _value) of the groups that one window may hold."""
    keys = list(groups.keys)
    rows = groups.rows.where("_value IS NOT NULL")
    if large is not None:
        # Rows of large groups stay where they are; see _with_slice for the copies.
        rows = _salted_join(rows, large.select(*keys), keys, groups.broadcast_rows, "left_anti")
    counted = rows.groupBy(*keys, "_value").agg(F.count("*").alias("_size"))
    ranked = _running(counted, keys)
    sized = ranked.withColumn("_n", F.sum("_size").over(Window.partitionBy(*keys)))
    return _hits(sized, keys, asked)


def _running(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    run = Window.partitionBy(*by).orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return counted.withColumn("_upto", F.sum("_size").over(run))


def _hits(ranked: DataFrame, keys: Sequence[str], asks: Column) -> DataFrame:
    """The (name, value) of each wanted rank that a counted value covers."""
    ask = F.col("_ask.rank")
    return ranked.withColumn(
        "_ask",
        F.explode(F.filter(asks, lambda a: (a["rank"] < F.col("_upto"))
                           & (a["rank"] >= F.col("_upto") - F.col("_size")))),
    ).where(ask.isNotNull()).select(*keys, "_n", F.col("_ask.name").alias("_name"), "_value")


def _salted_join(
    rows: DataFrame, few: DataFrame, keys: Sequence[str], broadcast_rows: int, how: str
) -> DataFrame:
    """Join rows with lines of large groups, every one of which is a hot key.

    The lines are broadcast if they measure small. Otherwise each is copied to
    ``SALTS`` sub-keys, over which the rows are dealt by their place.
    """
    if fits_broadcast(few, broadcast_rows):
        return null_safe_join(rows, F.broadcast(few), keys, how)
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return null_safe_join(
        rows.withColumn("_salt", place), copies.hint("merge"), [*keys, "_salt"], how
    ).drop("_salt")


def _scaled(value: Column) -> Column:
    """A logarithmic scale for both signs; it never decreases as the value grows."""
    number = value.cast("double")
    return F.signum(number) * F.log1p(F.abs(number) * _SMALLEST)


def _part(value: Column, low: Column, high: Column, parts: int, log: bool) -> Column:
    """Which even part of the range from ``low`` to ``high`` a value lies in.

    Equal values share a part and a larger value is never in an earlier one, whatever
    rounding does. Infinite values have the first or last part to themselves.
    """
    if log:
        at, begin, end = (_scaled(x) for x in (value, low, high))
    else:
        at, begin, end = value, low, high
    span = (end - begin).cast("double")
    share = (at - begin).cast("double") / F.nullif(span, F.lit(0.0))
    number = value.cast("double")
    inner = F.least(F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * parts),
                    F.lit(parts - 1))
    return (
        F.when(number == float("inf"), F.lit(parts))
        .when(number == float("-inf"), F.lit(-1))
        .otherwise(F.greatest(inner, F.lit(0)))
        .cast("int")
    )


def cut_slices(groups: SlicedGroups, large: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Cut large groups down to the slices that hold their wanted ranks.

    ``large`` has the group's profile and ``_asks``, its wanted (name, rank). Returns the
    stored slices of every level and frames of (keys, _n, _name, _value).
    """
    keys = list(groups.keys)
    rows = groups.rows.where("_value IS NOT NULL")
    slices = large.select(
        *keys, "_n", F.col("_n").alias("_size"), "_low", "_high", "_asks",
        F.monotonically_increasing_id().alias("_id"),
    )
    levels, found = [], []
    while True:
        slices = snapshot(slices, "slices")
        levels.append(slices)
        equal = F.col("_low") == F.col("_high")
        # All values of a slice are equal: every rank in it has that value.
        found.append(slices.where(equal).withColumn("_ask", F.explode("_asks")).select(
            *keys, "_n", F.col("_ask.name").alias("_name"), F.col("_low").alias("_value")))
        fits = slices.where(~equal & (F.col("_size") <= groups.slice_rows))
        found.append(_pick_slices(groups, rows, fits))
        wide = slices.where(~equal & (F.col("_size") > groups.slice_rows))
        if wide.isEmpty():
            return levels, found
        slices = _cut(groups, rows, wide, log=len(levels) % 2 == 1)


def _with_slice(groups: SlicedGroups, rows: DataFrame, slices: DataFrame) -> DataFrame:
    """The rows of given slices, which are disjoint ranges of values of their groups."""
    met = _salted_join(rows, slices, groups.keys, groups.broadcast_rows, "inner")
    return met.where(F.col("_value").between(F.col("_low"), F.col("_high")))


def _pick_slices(groups: SlicedGroups, rows: DataFrame, fits: DataFrame) -> DataFrame:
    keys = list(groups.keys)
    own = _with_slice(groups, rows, fits.select(*keys, "_id", "_low", "_high"))
    counted = own.groupBy("_id", "_value").agg(F.count("*").alias("_size"))
    lines = fits.select(F.col("_id").alias("_sid"), *keys, "_n", "_asks")
    ranked = _running(counted, ["_id"])
    return _hits(ranked.join(lines, F.col("_id") == F.col("_sid")), keys, F.col("_asks"))


def _cut(groups: SlicedGroups, rows: DataFrame, wide: DataFrame, log: bool) -> DataFrame:
    """The parts of each slice that hold a wanted rank, as slices of the next level."""
    keys = list(groups.keys)
    own = _with_slice(groups, rows, wide.select(*keys, "_id", "_low", "_high"))
    part = _part(F.col("_value"), F.col("_low"), F.col("_high"), groups.slices, log)
    parts = own.groupBy("_id", part.alias("_part")).agg(
        F.count("*").alias("_size"), F.min("_value").alias("_low"), F.max("_value").alias("_high")
    )
    # At most ``slices + 2`` lines per window.
    run = Window.partitionBy("_id").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = parts.withColumn("_before", F.sum("_size").over(run) - F.col("_size"))
    lines = wide.select(F.col("_id").alias("_sid"), *keys, "_n", "_asks")
    inside = F.transform(
        F.filter("_asks", lambda a: (a["rank"] >= F.col("_before"))
                 & (a["rank"] < F.col("_before") + F.col("_size"))),
        lambda a: F.struct(a["name"].alias("name"), (a["rank"] - F.col("_before")).alias("rank")),
    )
    return (
        placed.join(lines, F.col("_id") == F.col("_sid"))
        .select(*keys, "_n", "_size", "_low", "_high", inside.alias("_asks"))
        .where(F.size("_asks") > 0)
        .withColumn("_id", F.monotonically_increasing_id())
    )
