import math
import random

from pyspark.sql import functions as F

from loadlens.functions import numbers, text
from loadlens.sources import generated


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()[0]


def test_signed64(spark):
    cases = {"0": 0, str(2**63 - 1): 2**63 - 1, str(2**63): -(2**63), str(2**64 - 1): -1}
    for written, meant in cases.items():
        wide = F.lit(written).cast("decimal(20,0)")
        assert one(spark, numbers.signed64(wide)) == meant


def test_rates_and_lateness(spark):
    assert one(spark, numbers.rate_per_second(F.lit(100), F.lit(0))) == 0.0
    assert one(spark, numbers.rate_per_second(F.lit(100), F.lit(5 * 10**8))) == 200.0
    assert one(spark, numbers.lateness(F.lit(5), F.lit(9))) == 0
    assert one(spark, numbers.lateness(F.lit(9), F.lit(5))) == 4
    assert one(spark, numbers.null_if_nan(F.lit(math.nan))) is None


def test_labels(spark):
    shown = {950.0: "950.0", 1500.0: "1.5K", 2_300_000.0: "2.3M", -1500.0: "-1.5K", math.nan: "nan"}
    for value, label in shown.items():
        assert one(spark, numbers.short_number(F.lit(value))) == label
    assert one(spark, numbers.short_number(F.lit(2.5), 0)) == "2"
    assert one(spark, numbers.short_number(F.lit(None).cast("double"))) == "nan"
    assert one(spark, numbers.ratio_label(F.lit(3.0), F.lit(2.0))) == "1.500x"
    assert one(spark, numbers.ratio_label(F.lit(3.0), F.lit(0.0))) == "nan"
    assert one(spark, numbers.span_label(F.lit(2), F.lit(3))) == "2-3"
    assert one(spark, numbers.span_label(F.lit(0), F.lit(None), "->")) == "0->?"


def test_fixed_text_is_what_python_prints(spark):
    rng = random.Random(4)
    values = [0.0, 0.5, 1.5, 2.5, 0.15, 0.25, 0.35, 1.005, 2.675, 123.45, 999.95, 1e15, 4.5e15,
              1e22, -0.25, -1.15, 0.05, 0.0005, 5e-324, 1 / 3]
    values += [rng.randrange(10**6) / 10 ** rng.randrange(1, 6) for _ in range(1500)]
    values += [rng.uniform(-1e7, 1e7) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shown = df.select(
        "v", *[numbers.fixed_text(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2, 3)]
    ).collect()
    for row in shown:
        for d in (0, 1, 2, 3):
            assert row[f"d{d}"] == f"{row.v:.{d}f}", (row.v, d)


def test_text(spark):
    assert one(spark, text.stripped(F.lit(" \t {x} \xa0\n"))) == "{x}"
    assert one(spark, text.stripped(F.lit("   　\x1f"))) == ""
    assert one(spark, text.phase_label(F.lit("clean.sync"))) == "clean_sync"
    assert one(spark, text.is_synced(F.lit("clean.sync"))) == "sync"
    assert one(spark, text.is_synced(F.lit("clean.nosync"))) == "disabled"
    assert one(spark, text.is_perturbed(F.lit("perturbed.sync"))) is True
    path = F.lit("file:/x/clean_sync_2026-06-09_03-25-48/cpu_vm-0.json")
    assert one(spark, text.run_phase(path)) == "clean_sync"
    assert str(one(spark, text.run_started(path))) == "2026-06-09 03:25:48"
    assert one(spark, text.run_started(F.lit("file:/x/other/a.json"))) is None


def test_generated_rows_do_not_depend_on_partitions(spark):
    few = generated.amount_rows(generated.sequence_ids(spark, 5000, 1)).collect()
    many = generated.amount_rows(generated.sequence_ids(spark, 5000, 7)).collect()
    assert sorted(few) == sorted(many)
    ids = [r.id for r in few]
    assert (min(ids), max(ids), len(set(ids))) == (1, 5000, 5000)
    assert {r.word_id for r in few} == set(range(100))
    assert all(0 <= r.amount < 1000 for r in few)
    assert abs(sum(r.amount for r in few) / 5000 - 500) < 15


def test_generated_text(spark):
    rows = generated.text_rows(generated.sequence_ids(spark, 50)).collect()
    assert {len(r.data) for r in rows} == {100}
    assert len({r.data for r in rows}) == 50


def test_scatter_handles_large_ids(spark):
    ids = [0, 1, 2**32 + 5, 2**40 + 7, 2**62]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    values = [r[0] for r in df.select(numbers.scatter32(F.col("id"), 3)).collect()]
    assert all(0 <= v < 2**32 for v in values)
    assert len(set(values)) == len(ids)


def test_draws_reach_all_64_bits_and_seeds_are_independent(spark):
    df = spark.range(0, 20000).select(
        *[numbers.scatter63(F.col("id"), s).alias(f"s{s}") for s in (0, 1)],
        numbers.uniform_int(F.col("id"), 5, 0, 2**34 - 1).alias("wide"),
    )
    rows = df.collect()
    first, second = ([r[f"s{s}"] for r in rows] for s in (0, 1))
    assert not set(first) & set(second)
    assert 0 <= min(first) and 2**62 < max(first) < 2**63
    assert abs(sum(x >= 2**62 for x in first) / 20000 - 0.5) < 0.02
    assert abs(sum((x ^ y) & 1 for x, y in zip(first, second)) / 20000 - 0.5) < 0.02
    assert abs(sum(r.wide >= 2**33 for r in rows) / 20000 - 0.5) < 0.02


def test_ids_that_share_their_lower_half_differ(spark):
    df = spark.range(0, 5000).select((F.col("id") * 2**32 + 7).alias("id"))
    values = {r[0] for r in df.select(numbers.scatter63(F.col("id"), 1)).collect()}
    assert len(values) == 5000
