"""A table kept sorted by key, with a stored directory of its blocks.

The directory has one line per block of ``BLOCK`` rows: its first key and its rank, the
number of rows before it. Requests meet the directory, not the table. What is then read
of the table are the parts and the key range that hold the blocks asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from loadlens.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join
from loadlens.operators.ranks import MAX_SLICES, slice_bounds, with_slice
from loadlens.session import scratch_path, snapshot

BLOCK = 128
# A row's place in its partition is in the lower bits of its running number.
_PLACE = (1 << 33) - 1
# Directory lines that are looked through at once.
_SLICE_LINES = 100_000


@dataclass(frozen=True)
class SortedTable:
    """Stored rows with ``_part`` and ``_at``, their part and place there, and the directory.

    ``parts`` has (part, rows before it, its rows) of each task that sorted the table.
    """

    columns: tuple[str, ...]
    rows: DataFrame
    directory: DataFrame
    parts: tuple[tuple[int, int, int], ...]

    def offsets(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame(
            [(part, before) for part, before, _ in self.parts], "_part INT, _offset BIGINT"
        )

    def size(self) -> int:
        return sum(rows for _, _, rows in self.parts)


def sort_table(table: DataFrame, parts: int | None = None, path: str | None = None) -> SortedTable:
    """Sort a table by its unique ``key`` and store it, one folder per part."""
    spark = table.sparkSession
    path = path or scratch_path(spark, "sorted")
    dealt = table.repartitionByRange(*([parts] if parts else []), "key")
    placed = (
        dealt.withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", "key")
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))
    )
    placed.write.mode("overwrite").partitionBy("_part").parquet(path)
    order = [c for c in placed.columns if c != "_part"] + ["_part"]
    rows = spark.read.schema(placed.select(*order).schema).parquet(path)
    directory = snapshot(
        rows.groupBy("_part", block_in_part().alias("_block")).agg(
            F.min("key").alias("_first"), F.count("*").alias("_rows")
        ),
        "blocks",
    )
    # One line per task that sorted the table.
    held = directory.groupBy("_part").agg(F.sum("_rows")).orderBy("_part").collect()
    before, counted = 0, []
    for part, count in held:
        counted.append((part, before, count))
        before += count
    found = SortedTable(tuple(table.columns), rows, directory, tuple(counted))
    lines = directory.join(F.broadcast(found.offsets()), "_part").select(
        "_part", "_block", "_first", (F.col("_offset") + F.col("_block") * BLOCK).alias("_rank")
    )
    return replace(found, directory=lines)


def block_in_part() -> Column:
    return F.floor(F.col("_at") / BLOCK).cast("bigint")


def _home_blocks(starts: DataFrame, table: SortedTable, slices: int | None) -> DataFrame:
    """(start, _rank, _part, _block, _begin): the last block that does not begin after the start.

    Starts and directory are merged in even slices of the key range; what the slices
    before hold is one line each. A start before every key has no block.
    """
    lines = table.directory.select(
        F.col("_first").alias("key"),
        F.struct("_rank", "_part", "_block", F.col("_first").alias("_begin")).alias("_home"),
    )
    slices = slices or max(1, min(MAX_SLICES, table.size() // BLOCK // _SLICE_LINES))
    bounds = slice_bounds(lines, "key", slices)
    both = with_slice(
        lines.withColumn("_asked", F.lit(0)).unionByName(
            starts.select(F.col("start").alias("key"), F.lit(1).alias("_asked")),
            allowMissingColumns=True,
        ),
        "key", bounds,
    )
    run = (
        Window.partitionBy("_slice").orderBy("key", "_asked")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = both.withColumn("_home", F.max("_home").over(run)).where("_asked = 1")
    if not bounds:
        return found.select(F.col("key").alias("start"), "_home.*")
    # At most MAX_SLICES lines, so one window and a broadcast hold them.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = with_slice(lines, "key", bounds).groupBy("_slice").agg(F.max("_home").alias("_last"))
    all_slices = table.rows.sparkSession.range(len(bounds) + 1).select(
        F.col("id").cast("int").alias("_slice")
    )
    carried = all_slices.join(carried, "_slice", "left").select(
        "_slice", F.max("_last").over(earlier).alias("_carried")
    )
    return found.join(F.broadcast(carried), "_slice").select(
        F.col("key").alias("start"), F.coalesce("_home", "_carried").alias("_home")
    ).select("start", "_home.*")


def _read(table: SortedTable, parts: list[int], least, beyond) -> DataFrame:
    """The rows of some parts and of keys in [least, beyond); None is no bound."""
    rows = table.rows.where(F.col("_part").isin(parts))
    if least is not None:
        rows = rows.where(F.col("key") >= F.lit(least))
    return rows if beyond is None else rows.where(F.col("key") < F.lit(beyond))


def scan_ranges(
    requests: DataFrame, table: SortedTable, slices: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """For each ``req_id, start, scan_len``: the first rows from ``start`` on.

    A start's rank is that of its home block plus the keys of that block below it. Its
    rows are then a run of ranks, which lies in few even blocks of ranks.
    """
    asked = requests.where("scan_len > 0 AND start IS NOT NULL")
    starts = snapshot(
        _home_blocks(asked.select("start").distinct(), table, slices), "starts"
    )
    # The set is one of part numbers.
    homes, lowest, least, top, count = starts.agg(
        F.collect_set("_part"), F.min("_begin"), F.min("start"), F.max("start"), F.count("*")
    ).first()
    if least is None:
        return _nothing(requests, table)
    held = _read(table, homes, lowest, None).where(F.col("key") < F.lit(top)).select(
        F.concat_ws(":", "_part", block_in_part()).alias("_place"), F.col("key").alias("_key")
    )
    home = starts.where("_part IS NOT NULL").select(
        F.col("start").alias("_s"), "_rank", F.concat_ws(":", "_part", "_block").alias("_home")
    )
    # Few numbers a start.
    few = count <= broadcast_rows
    if few:
        inside = held.join(F.broadcast(home), F.col("_place") == F.col("_home"))
    else:
        # `held` has at most BLOCK rows per block; many starts may share one.
        inside = lookup_join(home, held, ("_home", "_place"), broadcast_rows=0)
    counted = inside.where("_key < _s").groupBy("_s", "_rank").agg(F.count("*").alias("_below"))
    ranked = starts.select(
        F.col("start").alias("_s"), F.coalesce("_rank", F.lit(0)).alias("_rank"),
        F.lit(0).cast("bigint").alias("_below"),
    ).unionByName(counted).groupBy("_s").agg(F.max(F.col("_rank")) + F.sum("_below"))
    ranked = snapshot(ranked.toDF("_s", "_first"), "ranks")
    met = (
        _known_join(asked, F.broadcast(ranked)) if few
        else lookup_join(asked, ranked, ("start", "_s"), broadcast_rows=0).drop("_s")
    )
    placed = met.withColumn("_last", F.col("_first") + F.col("scan_len") - 1)
    blocks = F.floor(F.col("_last") / BLOCK) - F.floor(F.col("_first") / BLOCK) + 1
    width = F.octet_length(F.coalesce(F.col("req_id").cast("string"), F.lit(""))) + 32
    first, last, lines, size = placed.agg(
        F.min("_first"), F.max("_last"), F.sum(blocks), F.sum(blocks * width)
    ).first()
    parts = [part for part, before, rows in table.parts if before <= last and before + rows > first]
    from_block, beyond = table.directory.agg(
        F.max(F.when(F.col("_rank") <= first, F.col("_first"))),
        F.min(F.when(F.col("_rank") > last, F.col("_first"))),
    ).first()
    stored = (
        _read(table, parts, from_block, beyond)
        .join(F.broadcast(table.offsets()), "_part")
        .withColumn("_rank", F.col("_offset") + F.col("_at"))
        .withColumn("_block", F.floor(F.col("_rank") / BLOCK))
        .select("_rank", "_block", F.struct(*[F.col(c) for c in table.columns]).alias("_row"))
    )
    spans = placed.select("req_id", "_first", "_last", F.explode(
        F.sequence(F.floor(F.col("_first") / BLOCK), F.floor(F.col("_last") / BLOCK))
    ).alias("_block"))
    if lines <= broadcast_rows and size <= BROADCAST_BYTES:
        found = stored.join(F.broadcast(spans), "_block")
    else:
        # `stored` holds at most BLOCK rows per block.
        found = lookup_join(spans, stored, "_block", broadcast_rows=broadcast_rows)
    found = found.where(F.col("_rank").between(F.col("_first"), F.col("_last")))
    return found.select("req_id", (F.col("_rank") - F.col("_first")).alias("pos"), "_row.*")


def _known_join(asked: DataFrame, ranked: DataFrame) -> DataFrame:
    return asked.join(ranked, F.col("start") == F.col("_s")).drop("_s")


def _nothing(requests: DataFrame, table: SortedTable) -> DataFrame:
    named = {f.name: f for f in [*requests.schema, *table.rows.schema]}
    columns = [named["req_id"], T.StructField("pos", T.LongType()), *[named[c] for c in table.columns]]
    return table.rows.sparkSession.createDataFrame([], T.StructType(columns))
