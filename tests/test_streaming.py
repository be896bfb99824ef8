import datetime as dt
import json
import re
import shutil

import pytest
from pyspark.sql import functions as F

from loadlens.operators.logs import KINDS
from loadlens.plans import catalog, log_reports
from loadlens.session import scratch_path
from loadlens.streaming import jobs
from tests.test_logs import TIMER


@pytest.fixture
def feed(spark, tmp_path):
    path = str(tmp_path / "feed")
    base = dt.datetime(2024, 1, 1)

    def add(rows):
        typed = [(base + dt.timedelta(hours=h), k, v) for h, k, v in rows]
        spark.createDataFrame(typed, "ts timestamp_ntz, k string, v double").coalesce(1).write.mode(
            "append"
        ).parquet(path)

    return path, add


def test_running_count_goes_on_after_a_restart(spark, feed):
    path, add = feed
    folder = scratch_path(spark, "count")
    add([(0, "a", 1.0), (1, "b", 1.0)])

    def run():
        rows = jobs.read_stream(spark, path, files_per_batch=1)
        return {r.k: r.cnt for r in jobs.running_count(rows, "k", folder).collect()}

    assert run() == {"a": 1, "b": 1}
    add([(2, "a", 1.0), (3, "c", 1.0)])
    add([(2, "a", 1.0)])
    assert run() == {"a": 3, "b": 1, "c": 1}
    assert run() == {"a": 3, "b": 1, "c": 1}


def test_copy_writes_each_row_once(spark, feed):
    path, add = feed
    folder = scratch_path(spark, "copy")
    add([(0, "a", 1.0)])
    assert jobs.copy_stream(jobs.read_stream(spark, path), folder).count() == 1
    add([(0, "b", 1.0)])
    assert jobs.copy_stream(jobs.read_stream(spark, path), folder).count() == 2


def test_late_rows_are_dropped(spark, feed):
    path, add = feed
    folder = scratch_path(spark, "tumbling")

    def run():
        rows = jobs.read_stream(spark, path)
        sums = jobs.tumbling_sum(rows, "ts", "k", "v", folder, "1 day", "1 hour")
        return {(r.window_start.day, r.k): (r.total_amount, r.cnt) for r in sums.collect()}

    add([(1, "a", 1.0), (2, "a", 2.0), (49, "a", 4.0)])
    assert run() == {(1, "a"): (3.0, 2), (3, "a"): (4.0, 1)}
    add([(3, "a", 100.0), (50, "a", 8.0)])
    assert run() == {(1, "a"): (3.0, 2), (3, "a"): (12.0, 2)}


def test_logs_are_ingested_as_they_grow(spark, tmp_path):
    feed = tmp_path / "logs"
    feed.mkdir()
    folder = scratch_path(spark, "ingest")

    def run():
        lines = jobs.read_log_stream(spark, str(feed))
        rows, skipped = jobs.ingest_logs(lines, KINDS["timer_jitter"], folder)
        return (
            sorted((r.file, r.cpu) for r in rows.collect()),
            sorted((r.file, r.reason) for r in skipped.collect()),
        )

    (feed / "a.log").write_text(json.dumps(TIMER) + "\nnoise\n\n")
    assert run() == ([("a.log", TIMER["cpu"])], [("a.log", "non-json")])
    (feed / "b.log").write_text(json.dumps(TIMER) + "\n{\n")
    assert run() == (
        [("a.log", TIMER["cpu"]), ("b.log", TIMER["cpu"])], [("a.log", "non-json"), ("b.log", "json error")]
    )


def test_feeds_without_input_read_as_empty(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed = spark.readStream.schema("word STRING").parquet(str(tmp_path / "in"))
    assert jobs.running_count(feed, "word", str(tmp_path / "count")).count() == 0
    lines = spark.readStream.schema("file STRING, value STRING").parquet(str(tmp_path / "in"))
    ok, skipped = jobs.ingest_logs(lines, KINDS["timer_jitter"], str(tmp_path / "logs"))
    assert ok.count() == 0 and skipped.count() == 0


def test_changes_are_merged_every_few_batches(spark, feed, tmp_path):
    path, add = feed
    folder = str(tmp_path / "job")

    def run(folder=folder):
        counts = jobs.read_stream(spark, path, files_per_batch=1).groupBy("k").agg(F.count("*").alias("n"))
        found = jobs._latest(counts, ["k"], folder, every=3)
        return {r.k: r.n for r in found.collect()}, found.inputFiles()

    wanted = {}
    for n in range(8):
        key = "abc"[n % 3]
        add([(n, key, 1.0)])
        wanted[key] = wanted.get(key, 0) + 1
        if n % 2:
            counted, read = run()
            assert counted == wanted
            # One snapshot and the changes of one epoch.
            assert len({re.search("/snapshots/epoch=(-?[0-9]+)", f)[1] for f in read if "/snapshots/" in f}) == 1
            assert len({f.split("/batch=")[1].split("/")[0] for f in read if "/changes/" in f}) <= 1 + 3
    published = sorted(r.epoch for r in spark.read.parquet(f"{folder}/published").collect())
    assert published == [-1, 0, 1]
    # A batch repeated after a fault: what is published stays, what is not is done again.
    newest = max(int(p.name) for p in (tmp_path / "job/state/commits").iterdir() if p.name.isdigit())
    uncommitted = shutil.ignore_patterns(f"{newest}", f".{newest}.crc")
    again = tmp_path / "again"
    shutil.copytree(folder, again, ignore=lambda at, names: uncommitted(at, names)
                    if at.endswith("/commits") else set())
    assert run(str(again))[0] == wanted
    # The ninth batch ends an epoch; a fault before it was published repeats the merge.
    add([(9, "a", 1.0)])
    wanted["a"] += 1
    once = tmp_path / "once"
    shutil.copytree(folder, once)
    assert run(str(once))[0] == wanted
    twice = tmp_path / "twice"
    shutil.copytree(once, twice, ignore=lambda at, names: {
        n for n in names if n in ("8", ".8.crc")} if at.endswith("/commits") else set())
    spark.createDataFrame([(-1,), (0,), (1,)], "epoch BIGINT").coalesce(1).write.mode(
        "overwrite").parquet(f"{twice}/published")
    counted, read = run(str(twice))
    assert counted == wanted and any("/snapshots/epoch=2/" in f for f in read)


def test_streamed_line_numbers_are_those_of_a_scan(spark, tmp_path):
    feed = tmp_path / "logs"
    feed.mkdir()
    good = json.dumps(TIMER)
    for name, count in (("a", 40), ("b", 3), ("c", 0), ("d", 17)):
        text = "".join(("", "noise", good, "{", "  ")[n % 5] + "\n" for n in range(count))
        (feed / f"{name}.log").write_text(text)
    lines = jobs.read_log_stream(spark, str(feed), files_per_batch=1)
    rows, skipped = jobs.ingest_logs(lines, KINDS["timer_jitter"], scratch_path(spark, "ingest"))
    scan = log_reports.analyze(spark, str(feed), "timer_jitter")
    told = lambda df: sorted((r.file, r.line, r.reason) for r in df.collect())
    assert told(skipped) == told(scan.skipped) and skipped.count() > 10
    assert rows.count() == scan.rows.count()


def test_lines_numbered_by_epochs_are_those_of_a_scan(spark, tmp_path):
    feed, folder = tmp_path / "logs", tmp_path / "ingest"
    feed.mkdir()
    good = json.dumps(TIMER)

    def add(*numbers):
        for n in numbers:
            text = "".join(("noise", good, "", "{")[(i + n) % 4] + "\n" for i in range(2 * n + 3))
            (feed / f"{n}.log").write_text(text)

    def run(folder=folder):
        lines = jobs.read_log_stream(spark, str(feed), files_per_batch=1)
        rows, skipped = jobs.ingest_logs(lines, KINDS["timer_jitter"], str(folder), every=2)
        scan = log_reports.analyze(spark, str(feed), "timer_jitter")
        told = sorted((r.file, r.line, r.reason) for r in skipped.collect())
        assert told == sorted((r.file, r.line, r.reason) for r in scan.skipped.collect())
        assert rows.count() == scan.rows.count()
        return skipped, told

    add(0, 1, 2, 3)
    before, told = run()
    # A fault after the second epoch was published repeats its last batch, one before also its numbers.
    again = tmp_path / "again"
    shutil.copytree(folder, again, ignore=lambda at, names: {
        n for n in names if n in ("3", ".3.crc")} if at.endswith("/commits") else set())
    spark.createDataFrame([(-1,), (0,)], "epoch BIGINT").coalesce(1).write.mode("overwrite").parquet(
        f"{again}/published")
    run(again)
    add(4, 5, 6)
    run()
    # What an earlier run returned still stands.
    assert told == sorted((r.file, r.line, r.reason) for r in before.collect())
    assert sorted(r.epoch for r in spark.read.parquet(f"{folder}/published").collect()) == [-1, 0, 1, 2]


def test_a_micro_batch_of_lines_is_one_job(spark, tmp_path):
    feed = tmp_path / "logs"
    feed.mkdir()
    files = 12
    for n in range(files):
        (feed / f"{n}.log").write_text(json.dumps(TIMER) + "\nnoise\n")

    def jobs_so_far():
        spark.range(1).collect()
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup())

    before = jobs_so_far()
    lines = jobs.read_log_stream(spark, str(feed), files_per_batch=1)
    _, skipped = jobs.ingest_logs(lines, KINDS["timer_jitter"], scratch_path(spark, "ingest"))
    # All else is done once for the whole run.
    assert jobs_so_far() - before < files + 20
    assert [r.line for r in skipped.collect()] == [2] * files


def test_streams_side_by_side_are_one_table(spark, tmp_path):
    feed, folder = tmp_path / "logs", tmp_path / "ingest"
    good = json.dumps(TIMER)

    def add(*numbers):
        for n in numbers:
            (feed / f"run={n}").mkdir(parents=True)
            text = "".join(("noise", good, "", "{")[(i + n) % 4] + "\n" for i in range(2 * n + 3))
            (feed / f"run={n}/a.log").write_text(text)

    def run(folder=folder):
        lines = [
            jobs.read_log_stream(spark, f"{feed}/run=*{end}", files_per_batch=1)
            for end in ("[02468]", "[13579]", "[!0-9]")
        ]
        rows, skipped = jobs.ingest_logs(lines, KINDS["timer_jitter"], str(folder), every=2)
        scan = log_reports.analyze(spark, str(feed), "timer_jitter")
        told = sorted((r.path, r.line, r.reason) for r in skipped.collect())
        assert told == sorted((r.path, r.line, r.reason) for r in scan.skipped.collect())
        assert rows.count() == scan.rows.count()
        return skipped, told

    add(0, 1, 2, 3, 4, 6)
    before, told = run()
    # A fault of the first stream alone, before its second epoch was published.
    again = tmp_path / "again"
    shutil.copytree(folder, again, ignore=lambda at, names: {
        n for n in names if n in ("3", ".3.crc")} if at.endswith("/stream=0/commits") else set())
    spark.createDataFrame([(-1,), (0,)], "epoch BIGINT").coalesce(1).write.mode("overwrite").parquet(
        f"{again}/published/stream=0")
    run(again)
    add(5, 7, 10)
    run()
    # What an earlier run returned still stands.
    assert told == sorted((r.path, r.line, r.reason) for r in before.collect())
    epochs = lambda n: sorted(r.epoch for r in spark.read.parquet(f"{folder}/published/stream={n}").collect())
    assert [epochs(n) for n in range(3)] == [[-1, 0, 1], [-1, 0, 1], [-1]]


def test_a_fault_of_one_stream_ends_them_all(spark, tmp_path):
    lines = []
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.log").write_text(json.dumps(TIMER) + "\n")
        lines.append(jobs.read_log_stream(spark, str(tmp_path / name)))
    lines[0] = lines[0].withColumn("value", F.raise_error(F.lit("no such line")).cast("string"))
    with pytest.raises(Exception, match="no such line"):
        jobs.ingest_logs(lines, KINDS["timer_jitter"], str(tmp_path / "ingest"))
    assert spark.streams.active == []


def test_streamed_buckets_of_every_last_digit_count(spark, tmp_path):
    events = spark.range(0, 75_000, 300).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01'").alias("ts"),
        F.lit(1).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"),
        F.lit(2.5).alias("value"), F.lit("{}").alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    told = lambda name: sorted(
        tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    found = told("stream_log_lines")
    assert found == told("log_lines_numbered") and len({r[0] for r in found}) == 25
