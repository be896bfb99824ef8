import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loadlens.operators import progress
from loadlens.sources import progress as source


def frame(spark, rows):
    return spark.createDataFrame(rows, "run string, entity string, t bigint, ticks bigint")


def skew(spark, rows, step=100):
    return progress.skew_by_time(progress.align(frame(spark, rows), step))


def test_equal_workers_have_no_skew(spark):
    rows = [("r", e, t, t * 3) for e in "ab" for t in range(0, 1001, 100)]
    for r in skew(spark, rows).where("grid_t > 0").collect():
        assert (r.entities, r.spread_ticks, r.jain_index, r.cv) == (2, 0, pytest.approx(1), 0)


def test_one_idle_of_two(spark):
    rows = [("r", "a", t, t) for t in (0, 100, 200)] + [("r", "b", t, 0) for t in (0, 100, 200)]
    last = skew(spark, rows).orderBy("cell").collect()[-1]
    assert last.spread_ticks == 200
    assert last.jain_index == pytest.approx(0.5)
    assert last.jain_index == pytest.approx(1 / (1 + last.cv**2))


def test_ragged_sampling_is_carried_forward(spark):
    rows = [("r", "a", 10, 1), ("r", "a", 190, 5), ("r", "a", 480, 9), ("r", "b", 250, 2)]
    aligned = {(r.entity, r.cell): r.ticks for r in progress.align(frame(spark, rows), 100).collect()}
    assert aligned == {("a", 1): 1, ("a", 2): 5, ("a", 3): 5, ("a", 4): 5, ("a", 5): 9,
                       ("b", 3): 2, ("b", 4): 2, ("b", 5): 2}


def test_runs_do_not_mix_and_the_invariant_holds(spark):
    rows = [(f"r{n}", f"e{i}", t, (i + 1) * t + (t * i * n) % 13)
            for n in range(3) for i in range(4) for t in range(0, 500 + 100 * n, 50)]
    found = skew(spark, rows).collect()
    assert {r.run: r.entities for r in found} == {"r0": 4, "r1": 4, "r2": 4}
    for r in found:
        if r.jain_index is not None:
            assert r.jain_index == pytest.approx(1 / (1 + r.cv**2))


def test_summary_leaves_the_warm_up_out(spark):
    rows = [("r", "a", t, t) for t in range(0, 1001, 100)]
    rows += [("r", "b", t, 0 if t < 300 else t - 50) for t in range(0, 1001, 100)]
    row = progress.skew_summary(skew(spark, rows), warmup=300).first()
    assert (row.max_spread_ticks, row.final_spread_ticks) == (200, 50)
    assert row.steady_max_spread_ticks == 50
    assert row.final_jain_index == pytest.approx(1 / (1 + row.final_cv**2))
    assert row.steady_min_jain_index <= row.final_jain_index


def brute_align(rows, step):
    cells, ends = {}, {}
    for run, e, t, n in rows:
        cell = -(-t // step)
        cells.setdefault((run, e), []).append((t, cell, n))
        ends[run] = max(ends.get(run, cell), cell)
    found = set()
    for (run, e), samples in cells.items():
        samples.sort()
        for cell in range(samples[0][1], ends[run] + 1):
            found.add((run, e, cell, [n for _, c, n in samples if c <= cell][-1], samples[0][0]))
    return found


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_alignment_over_chunks_with_and_without_samples(spark, monkeypatch, chunk):
    monkeypatch.setattr(progress, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(f"r{n % 2}", f"e{n % 5}", rng.randrange(-500, 9000) if n % 7 else rng.randrange(40), n)
            for n in range(60)]
    rows = list({r[:3]: r for r in rows}.values())
    found = progress.align(frame(spark, rows), 100)
    assert {(r.run, r.entity, r.cell, r.ticks, r.first_t) for r in found.collect()} == brute_align(rows, 100)
    some = progress.align(frame(spark, rows), 100, between=(10, 20)).collect()
    assert {(r.run, r.entity, r.cell, r.ticks, r.first_t) for r in some} == {
        x for x in brute_align(rows, 100) if 10 <= x[2] <= 20}
    parts = spark.createDataFrame(
        [(r, e, t, 1) for r, e, t, _ in rows], "run string, entity string, t bigint, amount bigint")
    sums = {(r.run, r.entity, r.t): r.ticks for r in progress.cumulate(parts, 1).collect()}
    assert sums == {(r, e, t): sum(1 for x in rows if x[:2] == (r, e) and x[2] <= t) for r, e, t, _ in rows}


def test_a_gap_of_any_length_needs_no_list_of_its_cells(spark):
    rows = [("r", "a", 0, 1), ("r", "a", 10**10, 2), ("r", "b", 5, 7)]
    ends = progress.align(frame(spark, rows), 1, between=(10**10 - 3, 10**12))
    assert {(r.entity, r.cell, r.ticks) for r in ends.collect()} == {
        ("a", 10**10 - i, 1) for i in (1, 2, 3)} | {("a", 10**10, 2)} | {
        ("b", 10**10 - i, 7) for i in range(4)}
    # Every cell of a long gap, dealt to several tasks.
    whole = progress.align(frame(spark, [("r", "a", 0, 1), ("r", "a", 3 * 10**7, 2)]), 1)
    row = whole.agg(F.count("*").alias("n"), F.sum("cell").alias("s"), F.max("ticks").alias("m")).first()
    assert (row.n, row.s, row.m) == (3 * 10**7 + 1, 3 * 10**7 * (3 * 10**7 + 1) // 2, 2)
    assert whole.groupBy(F.spark_partition_id()).count().count() > 1


def test_cumulate(spark):
    df = spark.createDataFrame(
        [("r", "a", 10, 2), ("r", "a", 20, 3), ("r", "a", 150, 4), ("r", "b", 10, 1)],
        "run string, entity string, t bigint, amount bigint",
    )
    found = sorted((r.entity, r.t, r.ticks) for r in progress.cumulate(df, 100).collect())
    assert found == [("a", 20, 5), ("a", 150, 9), ("b", 10, 1)]


def write_run(base, name, entities, bracket):
    path = base / name
    path.mkdir()
    for entity, samples in entities.items():
        (path / f"cpu_{entity}.json").write_text(json.dumps({
            "metadata": {"label": entity}, "mono_start": 0, "mono_end": 1, "started_at": "x",
            "samples": [{"mono_ns": t, "ticks": n} for t, n in samples]}, indent=2))
    (path / "cpu_loop.host_bracket.json").write_text(json.dumps(
        {"host_start_ns": bracket[0], "host_end_ns": bracket[1]}))


def test_result_files_rates_and_phases(spark, tmp_path):
    second = 10**9
    for number, rate in enumerate((100, 90)):
        write_run(tmp_path, f"clean_nosync_2026-06-0{number + 1}_03-25-48",
                  {"vm-0": [(0, 0), (second, rate)], "vm-1": [(5, 0), (second + 5, rate)]},
                  (0, 2 * second))
    write_run(tmp_path, "clean_sync_2026-06-09_03-25-48",
              {"vm-0": [(0, 0), (second, 50)]}, (0, 4 * second))
    samples = source.read_samples(spark, str(tmp_path))
    assert samples.count() == 10
    first = samples.where("phase = 'clean_sync'").first()
    assert (first.entity, str(first.started)) == ("cpu_vm-0", "2026-06-09 03:25:48")
    rates = progress.progress_rates(samples, source.read_brackets(spark, str(tmp_path)), 1e9)
    found = {(r.run[:10], r.run[-21:-9], r.entity): r for r in rates.collect()}
    one = rates.where("run LIKE 'clean_sync%'").first()
    assert (one.events, one.events_per_own_second, one.events_per_host_second) == (50, 50.0, 12.5)
    assert len(found) == 5
    phases = samples.select("run", "phase").distinct()
    per_phase = rates.join(phases, "run")
    from loadlens.operators.stats import summarize

    summary = summarize(per_phase, ["phase"], "events_per_own_second")
    wide = progress.compare_phases(
        summary.selectExpr("'rate' AS metric", "phase", "median"),
        ["metric"], "phase", "median", "clean_nosync", "clean_sync",
    ).first()
    assert wide.ratio == pytest.approx(50 / 95)
    assert not math.isnan(wide.clean_nosync)


def test_a_long_document_is_read_by_several_tasks(spark, tmp_path):
    run = tmp_path / "clean_sync_2026-06-09_03-25-48"
    run.mkdir()
    samples = [{"mono_ns": 10 * n, "ticks": n} for n in range(20_000)]
    document = {"metadata": {"label": 'a}{"mono_ns": 7}'}, "mono_start": -1, "samples": samples, "mono_end": 9}
    (run / "cpu_a.json").write_text(json.dumps(document))
    (run / "cpu_b.json").write_text(json.dumps({"samples": [], "mono_start": 3}))
    (run / "cpu_c.json").write_text('{"samples": [{"ticks": 5, "mono_ns": 6}, {"mono_ns": 8, "ti')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = source.read_samples(spark, str(tmp_path))
        assert rows.where("entity = 'cpu_a'").groupBy(F.spark_partition_id()).count().count() > 4
        found = rows.where("entity = 'cpu_a'").orderBy("t").collect()
        documents = {r.entity: r for r in source.read_documents(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.t, r.ticks) for r in found] == [(s["mono_ns"], s["ticks"]) for s in samples]
    assert found[0].run == run.name
    assert [documents[n].closed for n in ("cpu_a", "cpu_b", "cpu_c")] == [True, True, False]
    a, b = documents["cpu_a"], documents["cpu_b"]
    assert (a.mono_start, a.mono_end, a.samples) == (-1, 9, 20_000)
    assert (b.mono_start, b.mono_end, b.samples) == (3, None, 0)
    assert rows.where("entity = 'cpu_c' and t = 6").first().ticks == 5


def test_an_object_nested_in_a_sample_fails_the_read(spark, tmp_path):
    (tmp_path / "cpu_a.json").write_text('{"samples": [{"mono_ns": 1, "ticks": 2, "more": {"x": 1}}]}')
    with pytest.raises(Exception, match="nested object"):
        source.read_samples(spark, str(tmp_path)).collect()
