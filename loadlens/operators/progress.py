"""Progress of many entities over time: rates, spread, fairness.

Samples are ``run, entity, t, ticks`` with cumulative ticks and an integer
time. Samples are first reduced to one per entity and grid cell, so what a
window sees is bounded by the length of the grid, not by the number of samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadlens.functions.numbers import ratio
from loadlens.operators.joins import lookup_join, null_safe_join
from loadlens.session import snapshot

ENTITY = ["run", "entity"]
# Grid cells that a window sees at once.
CHUNK = 4096


def grid_cell(t: Column, step: int) -> Column:
    """Number of the first grid point at or after ``t``."""
    return F.ceil(t / F.lit(step)).cast("bigint")


def _chunk(cell: str = "cell") -> Column:
    return F.floor(F.col(cell) / CHUNK).cast("bigint")


def _carried(cells: DataFrame, columns: dict[str, Column], window, **added: Column) -> DataFrame:
    """Columns added to each cell from the line of its (entity, chunk).

    ``columns`` reduce a chunk, ``added`` look along an entity's chunks. A chunk has at
    most ``CHUNK`` cells, so no key of this join is hot.
    """
    lines = cells.groupBy(*ENTITY, "_chunk").agg(*[c.alias(n) for n, c in columns.items()])
    lines = lines.withColumns({n: c.over(window) for n, c in added.items()}).drop(*columns)
    return null_safe_join(cells, lines, [*ENTITY, "_chunk"])


def cumulate(increments: DataFrame, step: int, amount: str = "amount") -> DataFrame:
    """Cumulative ticks per entity from single increments, one per grid cell.

    Sums run within chunks of cells; a chunk begins at the sum of those before it.
    """
    cells = increments.groupBy(*ENTITY, grid_cell(F.col("t"), step).alias("cell")).agg(
        F.sum(amount).alias("_sum"), F.max("t").alias("t")
    ).withColumn("_chunk", _chunk())
    earlier = Window.partitionBy(*ENTITY).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    begun = _carried(cells, {"_total": F.sum("_sum")}, earlier, _before=F.sum("_total"))
    run = (
        Window.partitionBy(*ENTITY, "_chunk")
        .orderBy("cell")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ticks = F.sum("_sum").over(run) + F.coalesce("_before", F.lit(0))
    return begun.select(*ENTITY, "t", ticks.alias("ticks"))


def _every_cell(spans: DataFrame, first: str, last: str) -> DataFrame:
    """One row per ``cell`` from ``first`` to ``last``, both included.

    A span is cut at multiples of 2**30, 2**20 and 2**10 cells, one after another, so that
    the list a row is multiplied by has at most 1,024 entries up to 10**12 cells. Spans of
    more than 2**20 cells are dealt out anew once they are cut to that.
    """
    begin, end = F.col(first), F.col(last)

    def cut(rows: DataFrame, bits: int) -> DataFrame:
        size = F.lit(1 << bits)
        pieces = F.sequence(F.floor(F.col("_a") / size), F.floor(F.col("_b") / size))
        piece = rows.withColumn("_piece", F.explode(pieces))
        return piece.withColumns({
            "_a": F.greatest("_a", F.col("_piece") * size),
            "_b": F.least("_b", F.col("_piece") * size + size - 1),
        }).drop("_piece")

    rows = spans.where(begin <= end).withColumns({"_a": begin, "_b": end})
    short = rows.where(F.col("_b") - F.col("_a") < 1 << 20)
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = cut(cut(rows.where(F.col("_b") - F.col("_a") >= 1 << 20), 30), 20).repartition(
        tasks, *ENTITY, "_a"
    )
    return (
        cut(short.unionByName(long), 10)
        .withColumn("cell", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    )


def align(samples: DataFrame, step: int, between: tuple[int, int] | None = None) -> DataFrame:
    """Every entity's latest ticks at each grid point of its run.

    An entity appears from its first sample on and is carried forward to the
    last grid point of the run. ``run`` must not be NULL. ``between`` asks for the grid
    points with these first and last numbers only, and others are not made.

    Neighbours are looked for within chunks of cells; the last cell of a chunk goes on
    to the first one of the next chunk that has any.
    """
    cells = samples.groupBy(*ENTITY, grid_cell(F.col("t"), step).alias("cell")).agg(
        F.max_by("ticks", "t").alias("ticks"), F.min("t").alias("_first")
    ).withColumn("_chunk", _chunk())
    cells = snapshot(cells, "cells")
    ends = cells.groupBy("run").agg(F.max("cell").alias("_end"))
    along = Window.partitionBy(*ENTITY).orderBy("_chunk")
    carried = _carried(
        cells, {"_begin": F.min("cell"), "_earliest": F.min("_first")}, along,
        _after=F.lead("_begin"), first_t=F.min("_earliest"),
    )
    within = Window.partitionBy(*ENTITY, "_chunk").orderBy("cell")
    spans = carried.withColumn("_next", F.coalesce(F.lead("cell").over(within), "_after"))
    spans = lookup_join(spans, ends, "run").withColumns(
        {"_from": F.col("cell"), "_until": F.coalesce(F.col("_next") - 1, "_end")}
    )
    if between is not None:
        spans = spans.withColumns({
            "_from": F.greatest("_from", F.lit(between[0])),
            "_until": F.least("_until", F.lit(between[1])),
        })
    spans = snapshot(spans.select(*ENTITY, "ticks", "first_t", "_from", "_until"), "spans")
    return _every_cell(spans, "_from", "_until").select(
        *ENTITY, "ticks", "first_t", "cell", (F.col("cell") * F.lit(step)).alias("grid_t")
    )


def skew_by_time(aligned: DataFrame) -> DataFrame:
    """Per grid point: tick spread, Jain fairness and CV of the tick rates."""
    elapsed = F.col("grid_t") - F.col("first_t")
    rates = aligned.withColumn("_rate", F.when(elapsed > 0, F.col("ticks") / elapsed))
    x = F.col("_rate")
    return rates.groupBy("run", "cell", "grid_t").agg(
        F.count("*").alias("entities"),
        (F.max("ticks") - F.min("ticks")).alias("spread_ticks"),
        (F.pow(F.sum(x), F.lit(2)) / F.nullif(F.count(x) * F.sum(x * x), F.lit(0.0))).alias(
            "jain_index"
        ),
        (F.stddev_pop(x) / F.nullif(F.avg(x), F.lit(0.0))).alias("cv"),
    )


def skew_summary(skew: DataFrame, warmup: int = 0) -> DataFrame:
    """Per run: worst and final values, and the worst ones after the warm-up."""
    skew = snapshot(skew, "skew")
    begin = skew.groupBy("run").agg(F.min("grid_t").alias("_begin"))
    timed = null_safe_join(skew, begin, ["run"])
    steady = F.col("grid_t") > F.col("_begin") + F.lit(warmup)
    return timed.groupBy("run").agg(
        F.max("spread_ticks").alias("max_spread_ticks"),
        F.max_by("spread_ticks", "grid_t").alias("final_spread_ticks"),
        F.max_by("jain_index", "grid_t").alias("final_jain_index"),
        F.max_by("cv", "grid_t").alias("final_cv"),
        F.max(F.when(steady, F.col("spread_ticks"))).alias("steady_max_spread_ticks"),
        F.min(F.when(steady, F.col("jain_index"))).alias("steady_min_jain_index"),
        F.max(F.when(steady, F.col("cv"))).alias("steady_max_cv"),
    )


def progress_rates(samples: DataFrame, brackets: DataFrame, per_second: float) -> DataFrame:
    """Events per own second and per host second of each entity.

    ``per_second`` is how many time units make a second. Entities are reduced
    before the brackets, one per run, are looked up.
    """
    totals = samples.groupBy(*ENTITY).agg(
        F.max_by("ticks", "t").alias("events"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
    )
    host = brackets.select("run", "host_start", "host_end")
    both = lookup_join(totals, host, "run", "left")
    unit = F.lit(float(per_second))
    return both.select(
        *ENTITY,
        "events",
        ratio(F.col("events"), (F.col("last_t") - F.col("first_t")) / unit).alias(
            "events_per_own_second"
        ),
        ratio(F.col("events"), (F.col("host_end") - F.col("host_start")) / unit).alias(
            "events_per_host_second"
        ),
    )


def compare_phases(
    summary: DataFrame, by: Sequence[str], phase: str, value: str, first: str, second: str
) -> DataFrame:
    """One phase against another: both values side by side and their ratio."""
    wide = summary.groupBy(*by).pivot(phase, [first, second]).agg(F.max(value))
    return wide.withColumn("ratio", ratio(F.col(second), F.col(first)))
