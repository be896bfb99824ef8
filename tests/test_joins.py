import pytest

from loadlens.operators import joins
from loadlens.operators.joins import fits_broadcast, hot_keys, lookup_join, null_safe_join


@pytest.fixture(scope="module")
def sides(spark):
    # Key 1 holds half of the left side, NULL a fifth; key 7 is not on the right.
    rows = [(i, 1 if i % 2 else (None if i % 5 == 0 else i % 11)) for i in range(2000)]
    left = spark.createDataFrame(rows, "id bigint, k bigint")
    right = spark.createDataFrame(
        [(k, f"name {k}") for k in range(40) if k != 7], "k bigint, name string"
    )
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("spread", ["content", "row"])
@pytest.mark.parametrize("rows", [0, 1000])
def test_same_as_a_plain_join(sides, how, spread, rows):
    left, right = sides
    mine = lookup_join(left, right, "k", how, spread_by=spread, broadcast_rows=rows)
    plain = left.join(right, "k", how).select(mine.columns)
    assert sorted(map(str, mine.collect())) == sorted(map(str, plain.collect()))


def test_differently_named_keys_and_repeated_right_rows(spark, sides):
    left, right = sides
    twice = right.unionByName(right).withColumnRenamed("k", "rk")
    mine = lookup_join(left, twice, ("k", "rk"), broadcast_rows=0)
    plain = left.join(twice, left.k == twice.rk)
    assert mine.columns == plain.columns
    assert sorted(map(str, mine.collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_are_found_and_spread(sides):
    left, right = sides
    assert 1 in hot_keys(left, "k")
    joined = lookup_join(left, right, "k", broadcast_rows=0, hot=[1])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_hot_keys_of_empty_and_of_sparse_partitions(spark, sides):
    left, _ = sides
    assert hot_keys(left.where("false"), "k") == []
    assert hot_keys(left.where("k IS NULL"), "k") == []
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert hot_keys(left.repartition(3), "k")[0] == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_string_keys(spark):
    left = spark.createDataFrame([("a",)] * 300 + [("b",)], "k string")
    right = spark.createDataFrame([("a", 1), ("c", 2)], "k string, v int")
    assert hot_keys(left, "k") == ["a"]
    assert lookup_join(left, right, "k", "left", broadcast_rows=0).where("v = 1").count() == 300


def test_size_check_counts_rows_and_bytes(spark):
    wide = spark.createDataFrame([("x" * 1000,)] * 100, "s string")
    assert fits_broadcast(wide)
    assert not fits_broadcast(wide, max_rows=99)
    assert not fits_broadcast(wide, max_bytes=50_000)
    assert not fits_broadcast(wide, max_rows=0)


def test_outer_joins_are_refused(sides):
    with pytest.raises(ValueError):
        lookup_join(*sides, "k", "full")


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "g int, x int")
    b = spark.createDataFrame([(None, 10), (1, 20)], "g int, y int")
    found = {tuple(r) for r in null_safe_join(a, b, ["g"]).collect()}
    assert found == {(None, 1, 10), (1, 2, 20)}
    assert joins.SALTS > 1


def test_join_beyond_the_broadcast_limit_shuffles_both_sides(spark):
    from loadlens.operators.joins import lookup_join

    left = spark.range(1000).selectExpr("id % 3 AS k", "id")
    right = spark.range(3).selectExpr("id AS k", "id * 2 AS v")
    joined = lookup_join(left, right, "k", broadcast_rows=0)
    assert joined.count() == 1000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
