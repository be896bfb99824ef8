"""Keyed-table work: lookups, range scans and operation logs, as batch jobs.

A table is a snapshot with a unique ``key``. An operation log has the columns
``seq, op, key, val, scan_len`` and is applied in ``seq`` order. Reads of a
batch see the snapshot as it was before the batch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadlens.functions.numbers import scatter32, scatter63, skewed_rank, uniform_int
from loadlens.operators.joins import BROADCAST_ROWS, fits_broadcast, lookup_join
from loadlens.operators.sorted_table import SortedTable, scan_ranges, sort_table
from loadlens.session import snapshot

# Share of each operation, in percent, per standard mix.
MIXES = {
    "a": {"read": 50, "update": 50},
    "b": {"read": 95, "update": 5},
    "c": {"read": 100},
    "d": {"read": 95, "insert": 5},
    "e": {"scan": 95, "insert": 5},
    "f": {"read": 50, "rmw": 50},
}
MAX_SCAN = 100
# How keys are drawn, and the standard mixes that do not draw them uniformly.
CHOICES = ("uniform", "skewed", "latest")
MIX_CHOICE = {"d": "latest"}


def op_log(
    ids: DataFrame,
    mix: Mapping[str, int],
    first_key: int | Column,
    records: int | Column,
    seed: int = 0,
    ident: str = "id",
    next_key: int | Column | None = None,
    choice: str = "uniform",
    newest: int | None = None,
) -> DataFrame:
    """One operation per id (0 or more), drawn from a mix in percent.

    ``choice`` says how keys are drawn: ``uniform``; ``skewed``, where few keys scattered
    over the range take most operations; or ``latest``, where the keys up to ``newest``
    (by default the last one) are the more likely the newer they are. The last two need
    ``records`` as a number.

    Inserts take the key ``next_key`` plus id, which must lie above every existing
    one (by default: above the drawn keys); the rest fall on the ``records`` keys
    from ``first_key`` on. ``val`` is the written value or, for read-modify-write, the
    amount to add.
    """
    seq = F.col(ident).cast("bigint")
    if choice not in CHOICES or (choice != "uniform" and isinstance(records, Column)):
        raise ValueError(f"choose keys by one of {CHOICES}, and skewed ones from a known number")
    first, count = (F.lit(x) if not isinstance(x, Column) else x for x in (first_key, records))
    if next_key is None:
        above = first + count
    else:
        above = next_key if isinstance(next_key, Column) else F.lit(next_key)
    die = scatter32(seq, seed) % 100
    op, upto = None, 0
    for name, share in mix.items():
        upto += share
        op = F.when(die < upto, name) if op is None else op.when(die < upto, name)
    if upto != 100:
        raise ValueError("a mix must add up to 100")
    drawn = ids.select(
        seq.alias("seq"), op.alias("op"), scatter63(seq, seed + 1).alias("_draw"),
        scatter32(seq, seed + 4).alias("_die"),
    )
    key = first + F.col("_draw") % count
    if choice != "uniform":
        rank = skewed_rank(F.col("_die"), F.col("_draw"), records)
        drawn = drawn.withColumn("_rank", rank)
        last = newest if newest is not None else first_key + records - 1
        key = F.lit(last) - F.col("_rank")
    if choice == "skewed":
        key = first + scatter63(F.col("_rank"), seed + 5) % count
    return drawn.select(
        "seq",
        "op",
        F.when(F.col("op") == "insert", above + F.col("seq"))
        .otherwise(key)
        .cast("bigint")
        .alias("key"),
        (uniform_int(F.col("seq"), seed + 2, 0, 99_999) / 100).alias("val"),
        F.when(F.col("op") == "scan", uniform_int(F.col("seq"), seed + 3, 1, MAX_SCAN))
        .cast("int")
        .alias("scan_len"),
    )


def point_lookup(
    requests: DataFrame, table: DataFrame, key: str = "key", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Every request with the row of its key, or NULLs and ``found = false``."""
    marked = table.withColumn("found", F.lit(True))
    looked = lookup_join(requests, marked, key, "left", broadcast_rows=broadcast_rows)
    return looked.withColumn("found", F.coalesce("found", F.lit(False)))


def range_scan(
    requests: DataFrame,
    table: DataFrame | SortedTable,
    slices: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """For each ``req_id, start, scan_len``: the first rows from ``start`` on.

    A :class:`SortedTable` is read where the requests need it. A plain table is sorted
    and stored first, so sort it once where it is scanned again.
    """
    if isinstance(table, DataFrame):
        table = sort_table(table)
    return scan_ranges(requests, table, slices, broadcast_rows)


def read_latest(table: DataFrame, count: int, seq: str) -> DataFrame:
    """The most recently inserted rows, newest first."""
    return table.orderBy(F.desc(seq)).limit(count)


def insert_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def delete_keys(
    table: DataFrame, keys: DataFrame, key: str = "key", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    return lookup_join(
        table, keys.select(key).distinct(), key, "left_anti",
        even=True, broadcast_rows=broadcast_rows,
    )


def net_effect(log: DataFrame, upsert: bool = False) -> DataFrame:
    """What a log does to each key, reduced to one row per key.

    ``_exists`` is true or false if the last insert or delete decides it, else
    NULL; ``_written`` is the last value written. With ``upsert`` an update of an
    unknown key creates it.
    """
    op, seq = F.col("op"), F.col("seq")
    makes = op == "insert"
    if upsert:
        makes = makes | (op == "update")
    decides = makes | (op == "delete")
    writes = op.isin("insert", "update")
    return log.where(op.isin("insert", "update", "delete")).groupBy("key").agg(
        F.max(F.when(decides, F.struct(seq, makes.alias("makes"))))["makes"].alias("_exists"),
        F.max(F.when(writes, F.struct(seq, F.col("val"))))["val"].alias("_written"),
    )


def apply_writes(
    table: DataFrame,
    log: DataFrame,
    upsert: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The snapshot after the inserts, updates and deletes of a log.

    An update, or a delete, of a key that does not exist at its turn does
    nothing (unless ``upsert``). A log that touches few keys is sent to the
    table; otherwise both are shuffled, each holding a key once.
    """
    effect = snapshot(net_effect(log, upsert), "effect").withColumnRenamed("key", "_key")
    others = [c for c in table.columns if c not in ("key", "val")]
    alive = F.coalesce("_exists", "_held", F.lit(False))
    held = table.withColumn("_held", F.lit(True))
    match = F.col("key") == F.col("_key")
    changed = [
        F.coalesce("key", "_key").alias("key"), F.coalesce("_written", "val").alias("val"), *others
    ]
    if not fits_broadcast(effect, broadcast_rows):
        return held.join(effect, match, "full").where(alive).select(changed)

    kept = held.join(F.broadcast(effect), match, "left").where(alive).select(changed)
    made = effect.where("_exists")
    known = table.select("key").join(F.broadcast(made), match, "left_semi")
    new = made.join(known, match, "left_anti")
    return kept.unionByName(
        new.select(F.col("_key").alias("key"), F.col("_written").alias("val")),
        allowMissingColumns=True,
    )


def apply_updates(
    table: DataFrame, log: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Last update per key wins; keys the table does not hold are ignored."""
    last = log.where("op = 'update'").groupBy("key").agg(F.max_by("val", "seq").alias("_new"))
    merged = lookup_join(
        table, snapshot(last, "updates"), "key", "left", even=True, broadcast_rows=broadcast_rows
    )
    return merged.withColumn("val", F.coalesce("_new", "val")).drop("_new")


def apply_rmw(
    table: DataFrame, log: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add up the read-modify-write amounts per key; amounts commute."""
    added = log.where("op = 'rmw'").groupBy("key").agg(F.sum("val").alias("_added"))
    merged = lookup_join(
        table, snapshot(added, "added"), "key", "left", even=True, broadcast_rows=broadcast_rows
    )
    return merged.withColumn("val", F.col("val") + F.coalesce("_added", F.lit(0.0))).drop("_added")


def op_report(
    log: DataFrame, table: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Operations, hits, misses and distinct keys by type.

    The log is counted up per (op, key) first, so a hot key is one row here.
    """
    per_key = log.groupBy("op", "key").agg(F.count("*").alias("_ops"))
    known = table.select("key", F.lit(True).alias("_held"))
    looked = lookup_join(
        per_key, known, "key", "left", even=True, broadcast_rows=broadcast_rows
    )
    hits = F.coalesce(F.sum(F.when(F.col("_held"), F.col("_ops"))), F.lit(0))
    return looked.groupBy("op").agg(
        F.sum("_ops").alias("ops"),
        hits.alias("hits"),
        (F.sum("_ops") - hits).alias("misses"),
        F.count("*").alias("keys_touched"),
    )
