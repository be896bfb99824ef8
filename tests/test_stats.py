import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from loadlens.operators import ranks, stats

# Both sides of several limits, a limit itself being within it.
DELAYS = [0, 0, 10_000, 10_001, 999_999, 2_500_000, 30_000_000, 99_999_999, 400_000_000,
          1_000_000_000, 7_000_000_000]


def deciles(values):
    """The first and last decile with linear interpolation between the sorted values."""
    if len(values) == 1:
        return values[0], values[0]
    cuts = statistics.quantiles(values, n=10, method="inclusive")
    return cuts[0], cuts[-1]


def check(rows, found):
    groups = {}
    for g, v in rows:
        groups.setdefault(g, [])
        if v is not None and not math.isnan(v):
            groups[g].append(v)
    assert {r.g for r in found} == set(groups)
    for r in found:
        values = groups[r.g]
        assert r.n == len(values)
        if not values:
            assert (r.mean, r.median, r.min, r.max, r.stdev, r.cv, r.p10, r.p90) == (None,) * 8
            continue
        close = lambda x: pytest.approx(x, rel=1e-9, abs=1e-9)
        assert r.mean == close(statistics.fmean(values))
        assert r.median == close(statistics.median(values))
        assert (r.min, r.max) == (min(values), max(values))
        p10, p90 = deciles(values)
        assert r.p10 == close(p10)
        assert r.p90 == close(p90)
        stdev = statistics.stdev(values) if len(values) > 1 else 0.0
        assert r.stdev == pytest.approx(stdev, rel=1e-6, abs=1e-6)
        mean = statistics.fmean(values)
        if mean == 0:
            assert r.cv is None


def skewed_rows():
    rng = random.Random(5)
    rows = [("hot", rng.lognormvariate(8, 3)) for _ in range(3000)]
    rows += [("copies", 42.0)] * 1500 + [("copies", rng.random()) for _ in range(20)]
    rows += [(None, float(i % 7)) for i in range(100)]
    rows += [("one", 3.5), ("zero", -1.0), ("zero", 1.0), ("none", None), ("nan", math.nan)]
    rows += [(f"g{i % 50}", rng.gauss(0, 5)) for i in range(1000)]
    return rows


@pytest.mark.parametrize("slices", [1, 7, 1024])
def test_summary_of_skewed_groups(spark, slices):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "g string, v double")
    check(rows, stats.summarize(df, ["g"], "v", slices).collect())


@pytest.mark.parametrize("slices,slice_rows", [(2, 1), (16, 10), (1024, 100), (5, 1600)])
def test_summary_when_groups_are_cut(spark, slices, slice_rows):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "g string, v double")
    check(rows, stats.summarize(df, ["g"], "v", slices, slice_rows).collect())


def test_cut_groups_that_are_too_many_to_broadcast(spark):
    df = spark.createDataFrame(skewed_rows(), "g string, v double")
    ranks_of = {"p50": lambda n: F.floor(n / 2), "last": lambda n: n - 1}
    few = ranks.pick_ranks(ranks.slice_groups(df, ["g"], "v"), ranks_of)
    many = ranks.pick_ranks(
        ranks.slice_groups(df, ["g"], "v", 4, slice_rows=15, broadcast_rows=0), ranks_of
    )
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))


@pytest.mark.parametrize("spread", ["rand(3)", "exp(40 * rand(3) - 20)", "-exp(300 * rand(3))",
                                    "if(rand(3) < 0.5, 7D, 1e300 * rand(4))"])
def test_no_window_outgrows_the_limit(spark, spread):
    """Ten times the rows: more levels, but slices that are sorted stay below the limit."""
    for count in (4_000, 40_000):
        drawn = spark.range(count).selectExpr("'all' AS g", f"{spread} AS v")
        df = spark.createDataFrame(drawn.collect())
        groups = ranks.slice_groups(df, ["g"], "v", 8, slice_rows=200)
        asks = F.array(*[
            F.struct(F.lit(str(i)).alias("name"), F.lit(i * count // 10).cast("bigint").alias("rank"))
            for i in range(10)
        ])
        levels, found = ranks.cut_slices(groups, groups.profile.withColumn("_asks", asks))
        data = sorted(r.v for r in df.collect())
        got = {int(r._name): r._value for f in found for r in f.collect()}
        assert got == {i: data[i * count // 10] for i in range(10)}
        # Only slices within the limit are sorted; the last level holds no other.
        assert len(levels) > 1
        assert all(r._size <= 200 or r._low == r._high for r in levels[-1].collect())


def test_infinite_values_in_cut_groups(spark):
    rows = [("g", math.inf)] * 30 + [("g", -math.inf)] * 30 + [("g", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, v double")
    row = stats.rank_percentiles(df, ["g"], "v", 4, slice_rows=5).first()
    assert (row.n, row.p50, row.p90) == (100, 20.0, math.inf)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b"]),
            st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False, width=32)),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_summary_of_any_rows(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    check(rows, stats.summarize(df, ["g"], "v", 4).collect())


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "g string, v double")
    check([("a", None)], stats.summarize(df, ["g"], "v").collect())
    assert stats.summarize(df.where("false"), ["g"], "v").collect() == []


def test_summary_without_groups(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    row = stats.summarize(df, [], "v").first()
    assert (row.n, row.median, row.max) == (3, 2.0, 4.0)


def test_rank_percentiles_take_samples(spark):
    rng = random.Random(1)
    for size in (1, 2, 3, 10, 101):
        values = [rng.randrange(2**64) for _ in range(size)]
        df = spark.createDataFrame([("r", str(v)) for v in values], "run string, t string")
        df = df.selectExpr("run", "CAST(t AS DECIMAL(20,0)) AS v")
        row = stats.rank_percentiles(df, ["run"], "v", slices=8).first()
        data = sorted(values)
        assert row.n == size
        assert (int(row.min), int(row.max)) == (data[0], data[-1])
        assert int(row.p50) == data[size // 2]
        assert int(row.p90) == data[int((size - 1) * 0.90)]
        assert int(row.p99) == data[int((size - 1) * 0.99)]


def test_tail_counts_overlap(spark):
    df = spark.createDataFrame([("r", v) for v in DELAYS], "run string, v bigint")
    row = stats.tail_counts(df, ["run"], "v").first().asDict()
    assert row == {"run": "r", "zero": 2, "gt_10us": 8, "gt_1ms": 6, "gt_10ms": 5,
                   "gt_100ms": 3, "gt_1s": 1}


def test_moments_alone_agree_with_the_summary(spark):
    df = spark.createDataFrame(skewed_rows()[3000:], "g string, v double").where("g <> 'nan'")
    a = {r.g: r for r in stats.moments(df, ["g"], "v").collect()}
    for r in stats.summarize(df, ["g"], "v").collect():
        assert a[r.g].n == r.n
        if r.n:
            assert a[r.g].mean == pytest.approx(r.mean)
            assert a[r.g].stdev == pytest.approx(r.stdev)


def test_approximate_percentiles_are_near(spark):
    df = spark.range(10_001).selectExpr("'x' AS g", "CAST(id AS DOUBLE) AS v")
    row = stats.approx_percentiles(df, ["g"], "v", {"p50": 0.5, "p90": 0.9}).first()
    assert abs(row.p50 - 5000) < 20 and abs(row.p90 - 9000) < 20


def test_infinite_values_are_summarised(spark):
    rows = [("g", math.inf), ("g", 1.0), ("g", 2.0)]
    found = stats.summarize(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()
    assert (found[0].n, found[0].min, found[0].max, found[0].median) == (3, 1.0, math.inf, 2.0)
