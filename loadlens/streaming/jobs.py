"""Streaming forms of the pipelines.

Each job takes a streaming frame and a folder on shared storage. The folder
holds both the job's state and its output, so a restarted job goes on where it
stopped and a repeated micro-batch overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loadlens.functions.dates import instant, wall_time
from loadlens.operators.logs import LogKind, classify, result_rows, skipped_lines
from loadlens.sources.logs import with_ids, with_line_numbers

# Micro-batches whose changes are merged into one snapshot.
COMPACT_EVERY = 16
# Micro-batches whose skipped lines are numbered together.
NUMBER_EVERY = 64


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, under the schema they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_log_stream(
    spark: SparkSession, path: str, pattern: str = "*.log", files_per_batch: int | None = None
) -> DataFrame:
    """Lines of log files as they appear."""
    reader = spark.readStream.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    meta = F.col("_metadata")
    return reader.text(path).select(
        meta["file_name"].alias("file"), meta["file_path"].alias("path"), "value",
        meta["file_block_start"].alias("_start"), meta["file_block_length"].alias("_length"),
    )


def copy_stream(rows: DataFrame, folder: str) -> DataFrame:
    """Write every row once; returns the table written."""
    query = (
        rows.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


def running_count(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """Count per key so far. State grows with the number of keys."""
    counts = rows.groupBy(key).agg(F.count("*").alias("cnt"))
    return _latest(counts, [key], folder)


def tumbling_sum(
    rows: DataFrame, time: str, key: str, amount: str, folder: str,
    width: str = "1 day", delay: str = "1 day",
) -> DataFrame:
    """Sum and count per window and key.

    Rows later than the delay are dropped, and a window's state with them.
    Windows that are still open are part of the result.
    """
    timed = rows.withColumn(time, instant(F.col(time))).withWatermark(time, delay)
    sums = (
        timed.groupBy(F.window(time, width).alias("w"), key)
        .agg(F.sum(amount).alias("total_amount"), F.count("*").alias("cnt"))
        .select(
            wall_time(F.col("w.start")).alias("window_start"),
            key, "total_amount", "cnt",
        )
    )
    return _latest(sums, ["window_start", key], folder)


def ingest_logs(
    lines: DataFrame | Sequence[DataFrame], kind: LogKind, folder: str, every: int = NUMBER_EVERY
) -> tuple[DataFrame, DataFrame]:
    """Parse lines as they come; returns the tables of result rows and skipped lines.

    A file belongs to one micro-batch as a whole, so the skipped lines of any batches can be
    numbered together as a scan of these files does: ``line`` is the line's number in its
    file. Without the columns of :func:`read_log_stream` that tell a line's place it is NULL.

    A micro-batch is one job, which parses its lines and stores them. Lines are numbered by
    epochs of ``every`` batches, which are published as in :func:`_latest`; those of the
    open epoch are numbered when they are read.

    Several streams, of equal columns and of which no two read a file, run side by side into
    one table: a stream's batches come one after the other, which leaves most of a cluster
    idle if they are small. Each has its own state; pass them in the same order again.
    """
    streams = [lines] if isinstance(lines, DataFrame) else list(lines)
    parts = [""] if isinstance(lines, DataFrame) else [f"/stream={n}" for n in range(len(streams))]
    numbered = {"path", "_start", "_length"} <= set(streams[0].columns)
    spark = streams[0].sparkSession
    schema = classify(streams[0], kind, blank=True).schema
    plain = [f for f in schema if f.name not in ("_start", "_length")]
    ids = [T.StructField("_id", T.LongType())] if numbered else []
    parsed = T.StructType([*schema.fields, *ids])
    told = T.StructType([*plain, T.StructField("line", T.LongType())])

    def skipped(session: SparkSession, epochs: Sequence[str]) -> DataFrame:
        base = f"{folder}/classed"
        stored = session.read.schema(parsed).option("basePath", base).parquet(
            *[f"{base}{epoch}" for epoch in epochs]
        )
        bad = stored.where("reason <> 'blank'")
        none = F.lit(None).cast("bigint")
        bad = with_line_numbers(bad, stored) if numbered else bad.withColumn("line", none)
        return bad.select(*told.names)

    def open_epoch(session: SparkSession, part: str, epoch: int) -> None:
        session.createDataFrame([], parsed).write.mode("ignore").parquet(
            f"{folder}/classed{part}/epoch={epoch}/batch=-1"
        )

    def start(stream: DataFrame, part: str) -> StreamingQuery:
        published = f"{folder}/published{part}"

        def write(batch: DataFrame, number: int) -> None:
            # Parsing gives one row a line, so ids given after it grow along each split too.
            session, epoch = batch.sparkSession, number // every
            stored = with_ids(batch) if numbered else batch
            stored.write.mode("overwrite").parquet(
                f"{folder}/classed{part}/epoch={epoch}/batch={number}"
            )
            if number % every == every - 1 and _published(session, published) < epoch:
                skipped(session, [f"{part}/epoch={epoch}"]).write.mode("overwrite").parquet(
                    f"{folder}/skipped{part}/epoch={epoch}"
                )
                open_epoch(session, part, epoch + 1)
                _publish(session, published, epoch)

        open_epoch(spark, part, 0)
        _publish(spark, published, -1, "ignore")
        return _start(classify(stream, kind, blank=True), "append", f"{folder}/state{part}", write)

    _await(start(stream, part) for stream, part in zip(streams, parts))
    stored = spark.read.schema(parsed).parquet(f"{folder}/classed").select(*[f.name for f in plain])
    newest = {part: _published(spark, f"{folder}/published{part}") for part in parts}
    bad = skipped(spark, [f"{part}/epoch={epoch + 1}" for part, epoch in newest.items()])
    closed = [
        f"{folder}/skipped{part}/epoch={n}" for part, epoch in newest.items() for n in range(epoch + 1)
    ]
    if closed:
        read = spark.read.schema(told).option("basePath", f"{folder}/skipped").parquet(*closed)
        bad = read.select(*told.names).unionByName(bad)
    return result_rows(stored), skipped_lines(bad)


def _start_empty(rows: DataFrame, path: str) -> None:
    """A table without rows, so that a feed without input reads as empty."""
    rows.sparkSession.createDataFrame([], rows.schema).write.mode("ignore").parquet(path)


def _published(spark: SparkSession, path: str) -> int:
    """The newest epoch that is published, -1 before the first."""
    return spark.read.schema("epoch BIGINT").parquet(path).agg(F.max("epoch")).first()[0]


def _publish(spark: SparkSession, path: str, epoch: int, mode: str = "append") -> None:
    spark.createDataFrame([(epoch,)], "epoch BIGINT").coalesce(1).write.mode(mode).parquet(path)


def _start(rows: DataFrame, mode: str, state: str, write) -> StreamingQuery:
    return (
        rows.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def _await(queries: Iterable[StreamingQuery]) -> None:
    """Start and end all; a fault of one ends the others too."""
    started = []
    try:
        for query in queries:
            started.append(query)
        for query in started:
            query.awaitTermination()
    finally:
        for query in started:
            query.stop()


def _latest(
    updates: DataFrame, keys: Sequence[str], folder: str, every: int = COMPACT_EVERY
) -> DataFrame:
    """Store each micro-batch's changed groups; the newest of each group counts.

    Changes lie in epochs of ``every`` batches. The last batch of an epoch merges them
    with the snapshot before into a new one; only then the new version is published, by
    one committed file. So a read touches one snapshot and the changes of one epoch,
    however long the job has run. A batch that is repeated after a fault overwrites its
    own changes, and a published version is never written again.
    """
    spark = updates.sparkSession
    schema = T.StructType([*updates.schema.fields, T.StructField("batch", T.LongType())])
    values = [c for c in updates.columns if c not in keys]
    published = f"{folder}/published"

    def merged(session: SparkSession, epoch: int) -> DataFrame:
        """Everything up to the changes of the epoch after a published one."""
        read = session.read.schema(schema)
        stored = read.parquet(f"{folder}/snapshots/epoch={epoch}").unionByName(
            read.parquet(f"{folder}/changes/epoch={epoch + 1}")
        )
        newest = stored.groupBy(*keys).agg(
            F.max_by(F.struct(*values), "batch").alias("_v"), F.max("batch").alias("batch")
        )
        return newest.select(*keys, "_v.*", "batch").select(*schema.names)

    def open_epoch(session: SparkSession, epoch: int) -> None:
        session.createDataFrame([], updates.schema).write.mode("overwrite").parquet(
            f"{folder}/changes/epoch={epoch}/batch=-1"
        )

    def write(batch: DataFrame, number: int) -> None:
        session, epoch = batch.sparkSession, number // every
        batch.write.mode("overwrite").parquet(f"{folder}/changes/epoch={epoch}/batch={number}")
        if number % every == every - 1 and _published(session, published) < epoch:
            merged(session, epoch - 1).write.mode("overwrite").parquet(
                f"{folder}/snapshots/epoch={epoch}"
            )
            open_epoch(session, epoch + 1)
            _publish(session, published, epoch)

    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/snapshots/epoch=-1")
    _start_empty(updates, f"{folder}/changes/epoch=0/batch=-1")
    _publish(spark, published, -1, "ignore")
    _await([_start(updates, "update", f"{folder}/state", write)])
    return merged(spark, _published(spark, published)).drop("batch")
