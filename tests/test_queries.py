import re

import pytest

import __spark_entry__ as driver
from loadlens.plans import catalog
from tests.compare import differences, oracle

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SMALL)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_agrees_with_sql(spark, con, name):
    assert differences(spark, con, SMALL, name) == []


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(driver.queries())


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def _plan(df):
    utils = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize(
    "name",
    ["pricing_summary", "promo_effect_shuffled", "late_shipments_shuffled", "metric_summary",
     "progress_skew", "range_scan_shuffled", "upsert_delete", "baseline_ratio", "log_skipped"],
)
def test_plans_stay_on_the_jvm_without_cross_joins(spark, name):
    plan = _plan(driver.queries()[name](spark, SMALL))
    assert not re.search("CartesianProduct|NestedLoopJoin|PythonUDF|EvalPython|InPandas", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(driver.queries()["forecast_revenue"](spark, SMALL))
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan)[1]
    for part in ("GreaterThanOrEqual(l_shipdate", "LessThan(l_shipdate", "LessThan(l_quantity,24.0)",
                 "GreaterThanOrEqual(l_discount,0.05)", "LessThanOrEqual(l_discount,0.07)"):
        assert part in pushed
    assert re.search(r"ReadSchema: struct<(.*)>", plan)[1].count(":") == 4
    plan = _plan(driver.queries()["late_shipments"](spark, SMALL))
    assert "GreaterThanOrEqual(l_shipdate,2000-01-01" in plan


def test_limits_are_top_k(spark):
    for name in ("late_shipments", "fact_dim_lookup", "read_latest"):
        assert "TakeOrderedAndProject" in _plan(driver.queries()[name](spark, SMALL))
