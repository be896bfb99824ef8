"""Reports on a folder of benchmark logs, one setup per file."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlens.functions.numbers import fixed_text, short_number, span_label
from loadlens.operators import logs
from loadlens.operators.joins import lookup_join
from loadlens.operators.logs import KINDS, SETUP_ORDER, LogKind
from loadlens.session import snapshot
from loadlens.sources.logs import (
    bad_files, completeness, list_files, scan_lines, seen_per_file, store_sound, with_ids,
    with_line_numbers,
)


@dataclass(frozen=True)
class LogAnalysis:
    """Results of a folder, made from its lines as they were stored when it was analysed.

    ``files`` has a verdict for every listed file; those in ``errors`` count nowhere else.
    """

    kind: LogKind
    rows: DataFrame
    skipped: DataFrame
    errors: DataFrame
    files: DataFrame

    @cached_property
    def summary(self) -> DataFrame:
        """Every metric per file; files without a result row have n = 0."""
        found = logs.summarize_metrics(self.rows, self.kind, self.files.select("file"))
        return snapshot(found, "summary")

    def report(self, preferred: Sequence[str] = SETUP_ORDER) -> DataFrame:
        """One line per setup; with wrapped times of a barrier, mode and CPUs of a ping-pong."""
        found = setup_report(self.summary, self.kind, preferred)
        more = None
        if self.kind.name == "smp_barrier":
            counts = logs.wrapped_counts(self.rows, "elapsed_ns")
            more = counts.select("file", F.col("wrapped_count").alias("wrapped"))
        if self.kind.name == "smp_pingpong":
            more = pair_labels(self.rows)
        if more is None:
            return found
        # One line per setup on both sides.
        met = lookup_join(found, more, ("setup", "file"), "left", even=True).drop("file")
        return met.orderBy(logs.setup_rank(F.col("setup"), preferred), "setup")

    def comparison(self, preferred: Sequence[str] = SETUP_ORDER) -> DataFrame:
        """Readable setups relative to the base; NULL where a median is missing."""
        head = self.summary.where(F.col("metric") == self.kind.headline)
        read = lookup_join(head, self.errors, "file", "left_anti", even=True)
        compared = logs.compare_setups(
            read.withColumnRenamed("median", "value"), "file", "value", preferred
        )
        if not self.kind.beside:
            return compared
        beside = self.summary.where(F.col("metric") == self.kind.beside).select(
            F.col("file").alias("_file"), F.col("median").alias(self.kind.beside)
        )
        return lookup_join(compared, beside, ("file", "_file"), "left", even=True).drop("_file")

    def warnings(self) -> DataFrame:
        """What a reader should know before trusting a setup's figures."""
        found = [self.errors.select("file", F.concat(F.lit("file is "), "reason").alias("warning"))]

        def add(rows: DataFrame, condition: Column, *text: str | Column) -> None:
            parts = [F.lit(t) if isinstance(t, str) else t.cast("string") for t in text]
            found.append(rows.where(condition).select("file", F.concat(*parts).alias("warning")))

        if self.kind.name == "simple_compute":
            most = F.col("max").cast("bigint")
            regressions = self.summary.where("metric = 'clock_regressions'")
            add(regressions, most > 0, "clock went back up to ", most, " times in a run")
            short = F.col("incomplete_runs")
            add(logs.incomplete_runs(self.rows), short > 0, short, " runs lack thread results")
        if self.kind.name == "smp_barrier":
            wrapped = F.col("wrapped_count")
            counts = logs.wrapped_counts(self.rows, "elapsed_ns")
            add(counts, wrapped > 0, wrapped, " elapsed times wrapped below zero")
        return reduce(DataFrame.unionByName, found)


def analyze(
    spark: SparkSession, folder: str, kind: str, line_numbers: bool = True,
    pattern: str = "*.log",
) -> LogAnalysis:
    """Everything a benchmark's report needs from the logs of a folder.

    The folder is scanned once, every line parsed once and stored in its class. A file that
    is damaged, breaks off or changed since it was listed counts in whole or not at all.
    """
    spec = KINDS[kind]
    files = list_files(spark, folder, pattern)

    def classed(lines: DataFrame) -> DataFrame:
        sized = with_ids(lines).withColumn("_bytes", F.octet_length("value").cast("bigint"))
        return logs.classify(sized, spec, blank=True).drop("value")

    every, damaged = store_sound(scan_lines(spark, folder, pattern), classed, "classified")
    verdicts = snapshot(
        completeness(files, seen_per_file(every, F.col("_bytes")), damaged), "files"
    )
    errors = bad_files(verdicts)
    paths = verdicts.where("verdict IN ('breaks off', 'unreadable')").select("path")
    lines = lookup_join(every, paths, "path", "left_anti", spread_by="row").drop("_bytes")
    classified = lines.where("reason IS NULL OR reason <> 'blank'")
    rows = logs.result_rows(classified)
    skipped = logs.skipped_lines(classified)
    if line_numbers:
        skipped = with_line_numbers(skipped, lines)
    return LogAnalysis(
        kind=spec,
        rows=rows,
        skipped=skipped,
        errors=errors,
        files=verdicts,
    )


# Report columns as (title, metric, statistic, digits); digits as a
# number shorten with K and M, as text (".3") they show the plain number.
REPORTS = {
    "timer_jitter": (
        ("cpu", "cpu", "median", 0),
        ("period us", "period_us", "median", 0),
        ("samples/run", "samples_per_run", "median", 0),
        ("warmup", "warmup_iters", "median", 0),
        ("mean ns", "lat_mean_ns", "median", 1),
        ("p50 ns", "lat_p50_ns", "median", 1),
        ("p90 ns", "lat_p90_ns", "median", 1),
        ("p99 ns", "lat_p99_ns", "median", 1),
        ("max ns", "lat_max_ns", "median", 1),
        ("mean CV", "lat_mean_ns", "cv", ".3"),
        ("zero", "tail_zero", "median", 0),
        (">100ms", "tail_gt_100ms", "median", 0),
        (">1s", "tail_gt_1s", "median", 0),
    ),
    "smp_barrier": (
        ("rps mean", "rps", "mean", 2),
        ("rps median", "rps", "median", 2),
        ("rps min", "rps", "min", 2),
        ("rps max", "rps", "max", 2),
        ("rps CV", "rps", "cv", ".3"),
        ("elapsed median ms", "elapsed_signed_ms", "median", ".3"),
        ("wait mean ns", "wait_mean_ns", "median", ".1"),
        ("wait p50 ns", "wait_p50_ns", "median", ".1"),
        ("wait p90 ns", "wait_p90_ns", "median", ".1"),
        ("wait p99 ns", "wait_p99_ns", "median", ".1"),
        ("wait max ns", "wait_max_ns", "median", ".1"),
        ("zero", "tail_zero", "median", 0),
        (">10ms", "tail_gt_10ms", "median", 0),
        (">100ms", "tail_gt_100ms", "median", 0),
    ),
    "smp_pingpong": (
        ("iters", "iters", "median", 0),
        ("mean ns", "lat_mean_ns", "median", 1),
        ("p50 ns", "lat_p50_ns", "median", 1),
        ("p90 ns", "lat_p90_ns", "median", 1),
        ("p99 ns", "lat_p99_ns", "median", 1),
        ("max ns", "lat_max_ns", "median", 1),
        ("mean CV", "lat_mean_ns", "cv", ".3"),
        ("zero", "tail_zero", "median", 0),
        (">10ms", "tail_gt_10ms", "median", 0),
        (">100ms", "tail_gt_100ms", "median", 0),
    ),
    "simple_compute": (
        ("threads", "threads", "median", 0),
        ("aggregate iter/s", "aggregate_iterations_per_sec", "median", 1),
        ("aggregate CV", "aggregate_iterations_per_sec", "cv", ".3"),
        ("thread min iter/s", "thread_rate_min", "median", 1),
        ("thread max iter/s", "thread_rate_max", "median", 1),
        ("imbalance %", "thread_rate_imbalance_pct", "median", ".2"),
        ("start skew ns", "start_skew_ns", "median", 1),
        ("clock regressions", "clock_regressions", "max", 0),
    ),
}


def _stat(metric: str, stat: str) -> Column:
    return F.max(F.when(F.col("metric") == metric, F.col(stat)))


def setup_report(
    summary: DataFrame, kind: LogKind, preferred: Sequence[str] = SETUP_ORDER
) -> DataFrame:
    """One line of readable figures per setup, in report order."""
    shown = [F.max(F.when(F.col("metric") == kind.headline, F.col("n"))).alias("n")]
    if "cpu_first" in kind.metrics:
        shown.append(
            span_label(
                short_number(_stat("cpu_first", "median"), 0),
                short_number(_stat("cpu_last", "median"), 0),
            ).alias("cpus")
        )
    for title, metric, stat, digits in REPORTS[kind.name]:
        value = _stat(metric, stat)
        plain = isinstance(digits, str)
        text = fixed_text(value, int(digits[1:])) if plain else short_number(value, digits)
        shown.append(text.alias(title))
    place = logs.setup_rank(F.col("file"), preferred)
    return summary.groupBy("file").agg(*shown).orderBy(place, "file").withColumnRenamed(
        "file", "setup"
    )


def pair_labels(rows: DataFrame) -> DataFrame:
    """Mode and CPU pair of each file's first ping-pong run."""
    first = F.min_by(F.struct("mode", "cpu_a", "cpu_b"), F.struct("_start", "_id"))
    return rows.groupBy("file").agg(first.alias("_r")).select(
        "file", F.coalesce("_r.mode", F.lit("?")).alias("mode"),
        span_label(F.col("_r.cpu_a"), F.col("_r.cpu_b"), "->").alias("cpus"),
    )
