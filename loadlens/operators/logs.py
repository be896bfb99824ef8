"""Benchmark result logs: line classes, metrics per setup, comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from loadlens import schemas
from loadlens.functions.numbers import ratio, ratio_label, signed64
from loadlens.functions.text import stripped
from loadlens.operators.stats import summarize
from loadlens.session import snapshot

# Setups listed first in every report, the first being the base.
SETUP_ORDER = ("baremetal.log", "upstream.log")


@dataclass(frozen=True)
class LogKind:
    """What one benchmark's result rows must hold and which metrics they give."""

    name: str
    required: tuple[str, ...] = ()
    metrics: dict[str, str] = field(default_factory=dict)
    latency: str | None = None
    headline: str = ""
    # Shown beside the headline where setups are compared.
    beside: str = ""

    @property
    def row_type(self) -> T.StructType:
        return schemas.schema(schemas.LOGS[self.name])


def _latency(key: str, *names: str) -> dict[str, str]:
    prefix = "wait" if key == "t0_wait_ns" else "lat"
    return {f"{prefix}_{n}_ns": f"{key}.{n}" for n in names}


def _tails(*names: str) -> dict[str, str]:
    return {f"tail_{n}": f"tail_counts.{n}" for n in names}


def _thread(name: str, reduced: str) -> str:
    """A reduction over one field of the nested thread results of a row."""
    values = f"filter(transform(thread_results, t -> CAST(t.{name} AS DOUBLE)), v -> v IS NOT NULL)"
    mean = f"aggregate({values}, 0D, (a, v) -> a + v) / nullif(size({values}), 0)"
    return reduced.format(
        mean=mean, low=f"array_min({values})", high=f"array_max({values})"
    )


# Metric names of each report and the row fields they come from.
KINDS = {
    "timer_jitter": LogKind(
        "timer_jitter",
        required=tuple(f"wake_latency_ns.{s}" for s in ("mean", "p50", "p90", "p99", "min", "max")),
        metrics={
            **_latency("wake_latency_ns", "mean", "p50", "p90", "p99", "min", "max"),
            "period_us": "period_us",
            "samples_per_run": "wake_latency_ns.n",
            "cpu": "cpu",
            "warmup_iters": "warmup_iters",
            **_tails("zero", "gt_1ms", "gt_100ms", "gt_1s"),
        },
        latency="wake_latency_ns",
        headline="lat_p50_ns",
        beside="lat_p99_ns",
    ),
    "smp_barrier": LogKind(
        "smp_barrier",
        required=("elapsed_ns", "rounds_per_sec")
        + tuple(f"t0_wait_ns.{s}" for s in ("mean", "p50", "p90", "p99", "max")),
        metrics={
            "rps": "rounds_per_sec",
            "elapsed_ms": "elapsed_ns / 1e6D",
            "elapsed_signed_ms": "elapsed_signed_ns / 1e6D",
            **_latency("t0_wait_ns", "mean", "p50", "p90", "p99", "max"),
            "cpu_first": "cpu_first",
            "cpu_last": "cpu_last",
            **_tails("zero", "gt_10ms", "gt_100ms"),
        },
        headline="rps",
    ),
    "smp_pingpong": LogKind(
        "smp_pingpong",
        required=tuple(f"round_trip_ns.{s}" for s in ("mean", "p50", "p90", "p99", "min", "max")),
        metrics={
            **_latency("round_trip_ns", "mean", "p50", "p90", "p99", "min", "max"),
            "iters": "iters",
            **_tails("zero", "gt_10ms", "gt_100ms", "gt_1s"),
        },
        latency="round_trip_ns",
        headline="lat_p50_ns",
        beside="lat_p99_ns",
    ),
    "simple_compute": LogKind(
        "simple_compute",
        metrics={
            "aggregate_iterations_per_sec": "aggregate_iterations_per_sec",
            "elapsed_window_ms": "elapsed_window_ns / 1e6D",
            "threads": "threads",
            "iterations_per_thread": "iterations_per_thread",
            "cpu_first": "cpu_first",
            "cpu_last": "cpu_last",
            "start_skew_ns": "start_skew_ns",
            "finish_skew_ns": "finish_skew_ns",
            "clock_regressions": "clock_regressions",
            "thread_elapsed_mean_ns": _thread("elapsed_ns", "{mean}"),
            "thread_elapsed_min_ns": _thread("elapsed_ns", "{low}"),
            "thread_elapsed_max_ns": _thread("elapsed_ns", "{high}"),
            "thread_rate_mean": _thread("iterations_per_sec", "{mean}"),
            "thread_rate_min": _thread("iterations_per_sec", "{low}"),
            "thread_rate_max": _thread("iterations_per_sec", "{high}"),
            "thread_rate_imbalance_pct": _thread(
                "iterations_per_sec", "({high} - {low}) / nullif({mean}, 0D) * 100"
            ),
        },
        headline="aggregate_iterations_per_sec",
    ),
}


def _spelled(kind: T.DataType) -> T.DataType:
    """The type with every number as text, so that its spelling is kept."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _spelled(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_spelled(kind.elementType))
    return T.StringType() if isinstance(kind, T.NumericType) else kind


def _number(text: Column, kind: T.DataType) -> Column:
    """The number that is spelled; NULL if it is none or the type cannot hold it."""
    plain = F.btrim(text, F.lit('"'))
    value = plain.try_cast(kind)
    if isinstance(kind, T.IntegralType):
        wide = plain.try_cast("double")
        value = F.coalesce(value, F.when(wide == F.floor(wide), wide.try_cast(kind)))
    return value


def _typed(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = [_typed(value[f.name], f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _typed(v, kind.elementType))
    return _number(value, kind) if isinstance(kind, T.NumericType) else value


def _misspelled(value: Column, typed: Column, kind: T.DataType) -> Column:
    """Whether any number of the value is present but could not be read."""
    if isinstance(kind, T.StructType):
        found = [
            _misspelled(value[f.name], typed[f.name], f.dataType)
            for f in kind
            if _spelled(f.dataType) != f.dataType
        ]
        return reduce(Column.__or__, found, F.lit(False))
    if isinstance(kind, T.ArrayType):
        found = F.zip_with(value, typed, lambda v, t: _misspelled(v, t, kind.elementType))
        return F.coalesce(F.exists(found, lambda wrong: wrong), F.lit(False))
    return value.isNotNull() & typed.isNull()


def classify(lines: DataFrame, kind: LogKind, blank: bool = False) -> DataFrame:
    """Add ``row`` (the parsed result) and ``reason`` (why a line is not one).

    Numbers count in any JSON spelling, floats for integers, quoted, NaN and
    Infinity included; a line with a number field that holds anything else is
    skipped as ``unreadable field``.

    Blank lines drop out, or with ``blank`` stay with that reason, for those who count
    lines; ``reason`` is NULL for result rows. The text is parsed
    as a one-element list followed by an empty object, so that a line with
    anything after its object fails like any other broken one.
    """
    text = stripped(F.col("value"))
    wrapped = F.when(
        F.col("_text").startswith("{"), F.concat(F.lit("["), F.col("_text"), F.lit(",{}]"))
    )
    # As the output of a generator the parsed text is computed once per line;
    # as a plain column every later use would parse it again. Its numbers are read there
    # too: beside the reasons they make a method that is too long for Java to compile.
    known = lines.withColumn("_text", text)
    spelled = F.from_json(wrapped, T.ArrayType(_spelled(kind.row_type)))
    both = F.transform(
        spelled, lambda s: F.struct(s.alias("spelled"), _typed(s, kind.row_type).alias("row"))
    )
    judged = F.transform(both, lambda b: F.struct(
        b["row"].alias("row"), _misspelled(b["spelled"], b["row"], kind.row_type).alias("wrong")
    ))
    parsed = (known if blank else known.where("_text <> ''")).withColumn(
        "_rows", F.explode(F.array(judged))
    )
    first = F.get("_rows", F.lit(0))
    row = first["row"]
    other = row["bench"].isNull() | (row["bench"] != kind.name)
    if kind.latency:
        other = other | row[kind.latency].isNull()
        wrong = F.lit(f"not {kind.name}")
    else:
        wrong = F.when(row["bench"].isNull(), "bench=None").otherwise(
            F.concat(F.lit("bench='"), row["bench"], F.lit("'"))
        )
    reason = (
        F.when(F.col("_text") == "", "blank")
        .when(~F.col("_text").startswith("{"), "non-json")
        .when(F.coalesce(F.size("_rows"), F.lit(-1)) != 2, "json error")
        .when(other, wrong)
        .when(first["wrong"], "unreadable field")
    )
    for name in kind.required:
        needed = reduce(lambda value, part: value[part], name.split("."), row)
        reason = reason.when(needed.isNull(), "missing field")
    return (
        parsed.withColumn("row", row)
        .withColumn("reason", reason)
        .drop("_text", "_rows")
    )


def result_rows(classified: DataFrame) -> DataFrame:
    """The parsed rows with the file they came from."""
    kept = classified.where("reason IS NULL")
    others = [c for c in classified.columns if c not in ("row", "reason", "value")]
    return kept.select(*others, "row.*")


def skipped_lines(classified: DataFrame) -> DataFrame:
    others = [c for c in classified.columns if c not in ("row", "value")]
    return classified.where("reason IS NOT NULL").select(*others)


def skipped_preview(
    skipped: DataFrame, preferred: Sequence[str] = SETUP_ORDER, count: int = 20
) -> DataFrame:
    """The first skipped lines in report order, with how many follow."""
    total = skipped.agg(F.count("*").alias("n")).scalar()
    first = skipped.orderBy(setup_rank(F.col("file"), preferred), "file", "line").limit(count)
    return first.select(
        F.concat_ws(":", "file", F.col("line").cast("string"), F.concat(F.lit(" "), "reason"))
        .alias("skipped"),
        "file",
        "line",
        "reason",
        F.greatest(total - F.lit(count), F.lit(0)).cast("bigint").alias("more"),
    )


def setup_rank(name: Column, preferred: Sequence[str] = SETUP_ORDER) -> Column:
    """Place of a setup among the preferred ones; all others share the last."""
    order = F.array(*[F.lit(p) for p in preferred])
    place = F.nullif(F.array_position(order, name), F.lit(0))
    return F.coalesce(place, F.lit(len(preferred) + 1)).cast("int")


def metric_table(rows: DataFrame, kind: LogKind) -> DataFrame:
    """The file and every metric of each result row; NULL where missing."""
    if kind.name == "smp_barrier":
        rows = rows.withColumn("elapsed_signed_ns", signed64(F.col("elapsed_ns")))
    return rows.select(
        "file",
        *[
            F.nanvl(F.expr(f"CAST({text} AS DOUBLE)"), F.lit(None).cast("double")).alias(name)
            for name, text in kind.metrics.items()
        ],
    )


def summarize_metrics(
    rows: DataFrame, kind: LogKind, files: DataFrame | None = None
) -> DataFrame:
    """Summary of every metric per file.

    With ``files`` (a listing), files without a result row appear with n = 0.
    """
    # Stored, so that the text is parsed once and not in every pass.
    stored = snapshot(metric_table(rows, kind), "metrics")
    values = stored.unpivot("file", list(kind.metrics), "metric", "value")
    summary = summarize(values, ["file", "metric"], "value")
    if files is None:
        return summary
    names = F.array(*[F.lit(m) for m in kind.metrics])
    expected = files.select("file").distinct().select("file", F.explode(names).alias("metric"))
    full = expected.join(summary, ["file", "metric"], "left")
    return full.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def worker_rows(rows: DataFrame) -> DataFrame:
    """One row per nested thread result."""
    keep = [c for c in rows.columns if c != "thread_results"]
    return rows.select(*keep, F.explode("thread_results").alias("_t")).select(*keep, "_t.*")


def per_cpu_summary(rows: DataFrame) -> DataFrame:
    """Summary per file and CPU of the nested thread results."""
    threads = rows.select("file", F.explode("thread_results").alias("t")).where("t.cpu IS NOT NULL")
    wide = threads.select(
        "file",
        F.col("t.cpu").alias("cpu"),
        F.col("t.elapsed_ns").cast("double").alias("elapsed_ns"),
        F.col("t.iterations_per_sec").alias("iterations_per_sec"),
        F.col("t.clock_regression").cast("int").cast("double").alias("clock_regression"),
    )
    long = snapshot(wide, "cpus").unpivot(
        ["file", "cpu"],
        ["elapsed_ns", "iterations_per_sec", "clock_regression"],
        "metric",
        "value",
    )
    return summarize(long, ["file", "cpu", "metric"], "value")


def is_incomplete(declared: Column, results: Column) -> Column:
    """A run that reports another number of results than it declared."""
    return declared.isNotNull() & (declared != results)


def incomplete_runs(rows: DataFrame) -> DataFrame:
    results = F.size(F.coalesce("thread_results", F.array()))
    return rows.groupBy("file").agg(
        F.count_if(is_incomplete(F.col("threads"), results)).alias("incomplete_runs")
    )


def run_spread(workers: DataFrame, run: Sequence[str], elapsed: str, rate: str) -> DataFrame:
    """Per run: mean, min and max of elapsed time and rate, and the imbalance.

    Takes worker rows rather than arrays, so that a run of any size is reduced
    by partial aggregates.
    """
    shown = []
    for name, column in (("elapsed", elapsed), ("rate", rate)):
        value = F.col(column).cast("double")
        shown += [
            F.avg(value).alias(f"thread_{name}_mean"),
            F.min(value).alias(f"thread_{name}_min"),
            F.max(value).alias(f"thread_{name}_max"),
        ]
    gap = F.col("thread_rate_max") - F.col("thread_rate_min")
    return workers.groupBy(*run).agg(*shown).withColumn(
        "imbalance_pct", ratio(gap, F.col("thread_rate_mean")) * 100
    )


def run_window(
    workers: DataFrame, run: Sequence[str], start: str, end: str, work: str | Column
) -> DataFrame:
    """Per run: first start to last end, skews, total work and overall rate.

    ``start`` and ``end`` are nanosecond columns.
    """
    work = F.col(work) if isinstance(work, str) else work
    base = workers.groupBy(*run).agg(
        F.count("*").alias("workers"),
        F.min(start).alias("first_start"),
        (F.max(start) - F.min(start)).alias("start_skew_ns"),
        (F.max(end) - F.min(end)).alias("finish_skew_ns"),
        F.greatest(F.max(end) - F.min(start), F.lit(0)).alias("elapsed_window_ns"),
        F.sum(work).alias("total_work"),
        F.count_if(F.col(end) < F.col(start)).alias("clock_regressions"),
    )
    span = F.col("elapsed_window_ns")
    return base.withColumn(
        "aggregate_rate",
        F.when(span > 0, F.col("total_work") / (span / F.lit(1e9))).otherwise(F.lit(0.0)),
    )


def wrapped_counts(rows: DataFrame, counter: str, by: Sequence[str] = ("file",)) -> DataFrame:
    """How many counters went below zero and wrapped."""
    value = signed64(F.col(counter))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(value < 0).alias("wrapped_count"),
        F.min(F.when(value < 0, value)).alias("lowest_wrapped"),
    )


def wrapped_rows(rows: DataFrame, counter: str) -> DataFrame:
    """The wrapped counters themselves, read as signed."""
    return rows.withColumn("signed", signed64(F.col(counter))).where("signed < 0")


def base_value(
    summary: DataFrame, setup: str, value: str, preferred: Sequence[str] = SETUP_ORDER
) -> Column:
    """Value of the base setup: the first in report order. A scalar subquery."""
    first = summary.orderBy(setup_rank(F.col(setup), preferred), setup).limit(1)
    return first.select(value).scalar()


def compare_setups(
    summary: DataFrame, setup: str, value: str, preferred: Sequence[str] = SETUP_ORDER
) -> DataFrame:
    """Each setup's value relative to the base, both ways, with labels."""
    # One row per setup; stored, as it is read for the base and for the ratios.
    values = snapshot(summary.select(setup, value), "setups")
    with_base = values.withColumn("base", base_value(values, setup, value, preferred))
    mine, other = F.col(value), F.col("base")
    return with_base.select(
        setup,
        value,
        setup_rank(F.col(setup), preferred).alias("place"),
        ratio(mine, other).alias("ratio"),
        ratio(other, mine).alias("slowdown"),
        ratio_label(mine, other).alias("ratio_label"),
    )
