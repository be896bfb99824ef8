"""The standard operation mixes on one evolving table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loadlens.operators.keyed import (
    MIX_CHOICE,
    MIXES,
    apply_rmw,
    apply_writes,
    op_log,
    op_report,
    range_scan,
)
from loadlens.session import scratch_path
from loadlens.sources.sinks import write_parquet


def load_table(rows: DataFrame, path: str) -> DataFrame:
    """Start from a fresh table, replacing what was there."""
    write_parquet(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def apply_mix(table: DataFrame, log: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """The snapshot after one batch; only the steps its mix calls for."""
    if {"update", "insert", "delete"} & set(kinds):
        table = apply_writes(table, log)
    if "rmw" in kinds:
        table = apply_rmw(table, log)
    return table


def _report(name: str, log: DataFrame, table: DataFrame) -> DataFrame:
    """:func:`op_report` of a mix, with the rows its reads and scans return."""
    scanned = F.lit(0).cast("bigint")
    if "scan" in MIXES[name]:
        asked = log.where("op = 'scan'").select(
            F.col("seq").alias("req_id"), F.col("key").alias("start"), "scan_len"
        )
        scanned = range_scan(asked, table).agg(F.count("*").alias("n")).scalar()
    rows = F.when(F.col("op") == "scan", scanned).when(
        F.col("op").isin("read", "rmw"), F.col("hits")
    )
    return op_report(log, table).select(
        F.lit(name).alias("mix"), "*", F.coalesce(rows, F.lit(0)).alias("rows_read")
    )


def run_mixes(
    table: DataFrame, ids: DataFrame, ident: str = "id", mixes: Sequence[str] = tuple(MIXES)
) -> tuple[DataFrame, DataFrame]:
    """Run the mixes one after the other; returns the report and the last table.

    Every log and snapshot is written to shared storage before the next mix reads it, so
    plans stay short and a lost executor costs one step at most. Keys drawn are
    those of the table as loaded, in a mix that reads the latest ones those up to the
    newest key there is; every mix inserts above the keys of those before it.
    """
    spark = table.sparkSession
    folder = scratch_path(spark, "mixes")
    current = load_table(table.select("key", "val"), f"{folder}/start")
    first, last = current.agg(F.min("key"), F.max("key")).first()
    if first is None:
        raise ValueError("the table is empty")
    top = ids.agg(F.max(ident)).first()[0] or 0
    next_key = last + 1
    reports = []
    for number, name in enumerate(mixes):
        choice = MIX_CHOICE.get(name, "uniform")
        newest = current.agg(F.max("key")).first()[0] if choice == "latest" else None
        drawn = op_log(
            ids, MIXES[name], first, last - first + 1,
            seed=10 * number, ident=ident, next_key=next_key, choice=choice, newest=newest,
        )
        log = load_table(drawn, f"{folder}/log_{name}")
        reports.append(_report(name, log, current))
        if "insert" in MIXES[name]:
            next_key += top + 1
        if set(MIXES[name]) - {"read", "scan"}:
            changed = apply_mix(current, log, list(MIXES[name]))
            current = load_table(changed, f"{folder}/after_{name}")
    return reduce(DataFrame.unionByName, reports), current
