import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.plans import pipelines, reports


def star(spark, sales):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    return (
        frame(sales, "cs_sold_date_sk int, cs_ship_date_sk int, cs_warehouse_sk int, "
                     "cs_ship_mode_sk int, cs_call_center_sk int"),
        frame([(1, "A warehouse with a very long name"), (2, "A warehouse with a v")],
              "w_warehouse_sk int, w_warehouse_name string"),
        frame([(1, "AIR"), (2, "SEA")], "sm_ship_mode_sk int, sm_type string"),
        frame([(1, "North")], "cc_call_center_sk int, cc_name string"),
        frame([(d, 1199 if d < 1000 else 1212 if d >= 2000 else 1205) for d in range(900, 2100)],
              "d_date_sk int, d_month_seq int"),
    )


def test_delay_classes_at_their_edges(spark):
    gaps = [-5, 0, 30, 31, 60, 61, 90, 91, 120, 121, 500]
    sales = [(1500 - g, 1500, 1 + i % 2, 1, 1) for i, g in enumerate(gaps)]
    sales += [(None, 1500, 1, 2, 1), (1490, 950, 1, 1, 1), (1490, 2050, 1, 1, 1),
              (1490, 1500, 9, 1, 1), (1490, None, 1, 1, 1)]
    rows = [tuple(r) for r in reports.late_shipments(*star(spark, sales)).collect()]
    # Both names share their first 20 characters; an unknown sale date counts nowhere.
    assert rows == [
        ("A warehouse with a v", "AIR", "North", 3, 2, 2, 2, 2),
        ("A warehouse with a v", "SEA", "North", 0, 0, 0, 0, 0),
    ]


def test_sales_of_other_days_are_dropped_before_they_are_counted(spark, capsys):
    sales = [(1500 - n, 900 + 7 * n % 1200, 1 + n % 2, 1, 1) for n in range(400)] * 2
    sales += [(None, 1500, 1, 2, 1), (1490, None, 1, 1, 1)]
    found, by_day = {}, {}
    *dims, days = star(spark, sales)
    # A day that comes twice counts twice.
    days = days.unionByName(days.where("d_date_sk = 1502"))
    for limit in (2000, 0):
        report = reports.late_shipments(*dims, days, broadcast_rows=limit)
        report.explain("simple")
        by_day[limit] = "HashAggregate(keys=[cs_ship_date_sk" in capsys.readouterr().out
        found[limit] = [tuple(r) for r in report.collect()]
    assert found[2000] == found[0] and len(found[0]) == 2
    assert by_day == {2000: False, 0: True}
    reports.late_shipments(*dims, days).explain("simple")
    assert "HashAggregate(keys=[cs_ship_date_sk" not in capsys.readouterr().out


def test_report_keeps_the_first_hundred(spark):
    _, _, mode, centre, days = star(spark, [])
    warehouse = spark.range(150).select(
        F.col("id").cast("int").alias("w_warehouse_sk"),
        F.format_string("w%03d", "id").alias("w_warehouse_name"),
    )
    sales = spark.range(150).selectExpr(
        "1490 AS cs_sold_date_sk", "1500 AS cs_ship_date_sk", "CAST(id AS INT) AS cs_warehouse_sk",
        "1 AS cs_ship_mode_sk", "1 AS cs_call_center_sk",
    )
    rows = reports.late_shipments(sales, warehouse, mode, centre, days).collect()
    assert [r.warehouse_name for r in rows] == [f"w{i:03d}" for i in range(100)]


def lines(spark, rows):
    """Rows of (partkey, quantity, price, discount, tax, ship date) as a typed table."""
    names = "l_partkey int, l_quantity decimal(15,2), l_extendedprice decimal(15,2), " \
            "l_discount decimal(15,2), l_tax decimal(15,2), l_shipdate date"
    typed = [(p, *[Decimal(str(x)) for x in n], dt.date.fromisoformat(d)) for p, *n, d in rows]
    return spark.createDataFrame(typed, names).withColumns(
        {"l_returnflag": F.lit("A"), "l_linestatus": F.lit("F")}
    )


def test_forecast_bounds_are_inclusive_on_typed_money(spark):
    rows = [
        (1, 23, 100, d, 0, day)
        for d in ("0.04", "0.05", "0.06", "0.07", "0.08")
        for day in ("1993-12-31", "1994-01-01", "1994-12-31", "1995-01-01")
    ] + [(1, 24, 1000, "0.06", 0, "1994-06-01")]
    found = reports.forecast_revenue(lines(spark, rows)).first().revenue
    assert found == Decimal("36.00")
    doubles = lines(spark, rows).withColumns(
        {c: F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount")}
    )
    assert abs(reports.forecast_revenue(doubles).first().revenue - 36) < 1e-9


def test_forecast_without_rows_is_null(spark):
    rows = lines(spark, [(1, 1, 1, 0, 0, "1999-01-01")])
    assert [r.revenue for r in reports.forecast_revenue(rows).collect()] == [None]


def test_pricing_date_edge(spark):
    rows = [(1, 10, 100, "0.1", "0.2", "1998-09-02"), (1, 10, 100, "0.1", "0.2", "1998-09-03")]
    row = reports.pricing_summary(lines(spark, rows)).first()
    assert (row.count_order, row.sum_charge, row.avg_disc) == (1, Decimal("108"), Decimal("0.1"))


def test_promo_share(spark):
    part = spark.createDataFrame(
        [(1, "PROMO TIN"), (2, "SMALL PROMO"), (3, "PROMO X")], "p_partkey int, p_type string"
    )
    rows = [(1, 1, 100, 0, 0, "1995-09-01"), (1, 1, 100, 0, 0, "1995-09-30"),
            (2, 1, 600, 0, 0, "1995-09-15"), (3, 1, 900, 0, 0, "1995-10-01"),
            (99, 1, 900, 0, 0, "1995-09-02")]
    for limit in (0, 100):
        found = reports.promo_effect(lines(spark, rows), part, broadcast_rows=limit).first()
        assert float(found.promo_revenue) == 25.0
    none = reports.promo_effect(lines(spark, rows), part, "2001-01-01").first()
    assert none.promo_revenue is None


def test_web_sales_lookup(spark):
    ddl = schemas.columns(schemas.TPCDS["web_sales"])
    assert len(ddl) == 34 and ddl[17] == "ws_order_number"
    sales = spark.createDataFrame(
        [(5, 1, 10), (4, 1, None), (3, 2, 11), (2, 9, 12)],
        "ws_order_number int, ws_warehouse_sk int, ws_ship_date_sk int",
    )
    warehouse = spark.createDataFrame([(1, "x"), (2, "y")], "w_warehouse_sk int, w_warehouse_name string")
    shown = ["ws_order_number", "ws_warehouse_sk", "ws_ship_date_sk", "w_warehouse_name"]
    rows = reports.fact_lookup(
        sales, warehouse, ("ws_warehouse_sk", "w_warehouse_sk"), shown, "ws_ship_date_sk"
    ).collect()
    assert [tuple(r) for r in rows] == [(3, 2, 11, "y"), (5, 1, 10, "x")]


def test_bins_and_throughput(spark):
    rows = spark.createDataFrame(
        [(1, 7, 1.0), (9999, 7, 2.0), (10000, 7, 4.0)], "id bigint, word_id int, amount double"
    )
    found = sorted(tuple(r) for r in pipelines.binned_sum(rows).collect())
    assert found == [(0, 7, 3.0, 2), (1, 7, 4.0, 1)]
    stages = spark.createDataFrame([("a", 10, 2.0), ("a", 5, 2.0), ("b", 9, 0.0)],
                                   "job string, records bigint, seconds double")
    rates = {r.job: r.records_per_second for r in pipelines.job_throughput(
        stages, "job", ["records"], "records", "seconds").collect()}
    assert rates == {"a": 7.5, "b": 0.0}
    times = spark.createDataFrame([("q1", 1.5), ("q6", 0.5)], "query string, seconds double")
    found = {r.query: r.seconds for r in pipelines.query_times(times).collect()}
    assert found == {"q1": 1.5, "q6": 0.5, None: 2.0}
