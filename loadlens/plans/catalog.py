"""Registered queries, each with the SQL another engine checks it by.

Every query reads the whole of the given tables, or rows derived from them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlens import schemas
from loadlens.functions import numbers, text
from loadlens.functions.dates import epoch_micros
from loadlens.functions.numbers import scatter32_sql, scatter63_sql, skewed_rank_sql
from loadlens.operators import checks, keyed, logs, progress, stats
from loadlens.operators.joins import lookup_join, null_safe_join
from loadlens.operators.sorted_table import sort_table
from loadlens.plans import mixes, pipelines, reports
from loadlens.plans.log_reports import analyze, setup_report
from loadlens.session import scratch_path, snapshot
from loadlens.sources import delimited, generated, logs as log_files, progress as results, sinks
from loadlens.sources.tables import DRIVER_TABLES, list_tables, present, read_table, register
from loadlens.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round sums of doubles, whose last digits depend on the order of adding."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


# --- decision-support reports ------------------------------------------------

_PRICING = """
    SELECT l_returnflag, l_linestatus,
           round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 6) AS avg_qty,
           round(avg(l_extendedprice), 6) AS avg_price,
           round(avg(l_discount), 6) AS avg_disc,
           count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL 90 DAY
    GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""


def _pricing_rounded(df: DataFrame) -> DataFrame:
    df = rounded(df, 2, "sum_qty", "sum_base_price", "sum_disc_price", "sum_charge")
    return rounded(df, 6, "avg_qty", "avg_price", "avg_disc")


@query("pricing_summary", _PRICING)
def pricing_summary(spark, sf):
    return _pricing_rounded(reports.pricing_summary(read_table(spark, sf, "lineitem")))


@query(
    "forecast_revenue",
    """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
       WHERE l_shipdate >= DATE '1996-01-01'
         AND l_shipdate < DATE '1996-01-01' + INTERVAL 1 YEAR
         AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
def forecast_revenue(spark, sf):
    lineitem = read_table(spark, sf, "lineitem")
    return rounded(reports.forecast_revenue(lineitem, "1996-01-01"), 2, "revenue")


@query(
    "forecast_revenue_empty",
    """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
       WHERE l_shipdate >= DATE '1994-01-01'
         AND l_shipdate < DATE '1994-01-01' + INTERVAL 1 YEAR
         AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
def forecast_revenue_empty(spark, sf):
    lineitem = read_table(spark, sf, "lineitem")
    return rounded(reports.forecast_revenue(lineitem), 2, "revenue")


_PROMO = """
    SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%'
                                  THEN l_extendedprice * (1 - l_discount) ELSE 0 END)
                 / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= DATE '1995-09-01'
      AND l_shipdate < DATE '1995-09-01' + INTERVAL 1 MONTH"""


@query("promo_effect", _PROMO)
def promo_effect(spark, sf):
    lineitem, part = (read_table(spark, sf, t) for t in ("lineitem", "part"))
    return rounded(reports.promo_effect(lineitem, part), 6, "promo_revenue")


@query("promo_effect_shuffled", _PROMO)
def promo_effect_shuffled(spark, sf):
    lineitem, part = (read_table(spark, sf, t) for t in ("lineitem", "part"))
    return rounded(
        reports.promo_effect(lineitem, part, broadcast_rows=0), 6, "promo_revenue"
    )


_DELAYS = """
           CAST(sum(CASE WHEN lag <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS days_30,
           CAST(sum(CASE WHEN lag > 30 AND lag <= 60 THEN 1 ELSE 0 END) AS BIGINT) AS days_31_60,
           CAST(sum(CASE WHEN lag > 60 AND lag <= 90 THEN 1 ELSE 0 END) AS BIGINT) AS days_61_90,
           CAST(sum(CASE WHEN lag > 90 AND lag <= 120 THEN 1 ELSE 0 END) AS BIGINT) AS days_91_120,
           CAST(sum(CASE WHEN lag > 120 THEN 1 ELSE 0 END) AS BIGINT) AS days_over_120"""
_LATE = f"""
    WITH s AS (
      SELECT substr(s_name, 1, 20) AS warehouse_name, o_orderpriority AS ship_mode,
             n_name AS call_center,
             date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lag
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      WHERE (year(l_shipdate) - 1900) * 12 + month(l_shipdate) - 1 BETWEEN 1200 AND 1211)
    SELECT warehouse_name, ship_mode, call_center, {_DELAYS}
    FROM s GROUP BY ALL ORDER BY warehouse_name, ship_mode, call_center LIMIT 100"""


def _late(spark, sf, **options):
    return reports.late_orders(
        *(read_table(spark, sf, t) for t in ("lineitem", "orders", "supplier", "nation")),
        **options,
    )


@query("late_shipments", _LATE)
def late_shipments(spark, sf):
    return _late(spark, sf)


@query("late_shipments_shuffled", _LATE)
def late_shipments_shuffled(spark, sf):
    return _late(spark, sf, broadcast_rows=0)


@query("late_shipments_star", _LATE)
def late_shipments_star(spark, sf):
    """The star-schema report on a star derived from the order tables."""
    lineitem, orders, supplier, nation = (
        read_table(spark, sf, t) for t in ("lineitem", "orders", "supplier", "nation")
    )
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    lines = lineitem.select("l_orderkey", "l_suppkey", day("l_shipdate").alias("ship"))
    sold = orders.select("o_orderkey", "o_orderpriority", day("o_orderdate").alias("sold"))
    places = supplier.select("s_suppkey", "s_nationkey")
    ordered = lookup_join(lines, sold, ("l_orderkey", "o_orderkey"), spread_by="row")
    sales = lookup_join(ordered, places, ("l_suppkey", "s_suppkey")).select(
        F.col("sold").alias("cs_sold_date_sk"),
        F.col("ship").alias("cs_ship_date_sk"),
        F.col("l_suppkey").alias("cs_warehouse_sk"),
        F.col("o_orderpriority").alias("cs_ship_mode_sk"),
        F.col("s_nationkey").alias("cs_call_center_sk"),
    )
    days = lineitem.select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    return reports.late_shipments(
        sales,
        supplier.select(
            F.col("s_suppkey").alias("w_warehouse_sk"), F.col("s_name").alias("w_warehouse_name")
        ),
        orders.select(
            F.col("o_orderpriority").alias("sm_ship_mode_sk"),
            F.col("o_orderpriority").alias("sm_type"),
        ).distinct(),
        nation.select(
            F.col("n_nationkey").alias("cc_call_center_sk"), F.col("n_name").alias("cc_name")
        ),
        days.select(
            F.unix_date("d").alias("d_date_sk"),
            ((F.year("d") - 1900) * 12 + F.month("d") - 1).alias("d_month_seq"),
        ),
    )


@query(
    "fact_dim_lookup",
    """SELECT l_orderkey, l_suppkey, l_shipdate, s_name
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate IS NOT NULL
       ORDER BY l_orderkey, l_suppkey, l_shipdate, s_name LIMIT 100""",
)
def fact_dim_lookup(spark, sf):
    return reports.fact_lookup(
        read_table(spark, sf, "lineitem"),
        read_table(spark, sf, "supplier"),
        ("l_suppkey", "s_suppkey"),
        ["l_orderkey", "l_suppkey", "l_shipdate", "s_name"],
        "l_shipdate",
    )


# --- table checks ------------------------------------------------------------


@query(
    "table_counts",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in DRIVER_TABLES
    ),
)
def table_counts(spark, sf):
    return checks.table_counts({t: read_table(spark, sf, t) for t in DRIVER_TABLES})


_CHECKED = {
    t: schemas.TPCH_KEYS[t]
    for t in ("lineitem", "orders", "customer", "part", "supplier", "nation", "region")
}
_REQUIRED = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "nation": ["n_nationkey", "n_regionkey"],
    "region": ["r_regionkey"],
}


def _check_sql(table: str) -> str:
    key = ", ".join(_CHECKED[table])
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in _REQUIRED[table])
    return f"""
        SELECT '{table}' AS table_name, CAST(sum(n) AS BIGINT) AS row_count,
               count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicate_keys,
               CAST(sum(nulls) AS BIGINT) AS null_values
        FROM (SELECT {key}, count(*) AS n, {nulls} AS nulls FROM {table} GROUP BY {key})"""


@query("table_check", " UNION ALL ".join(_check_sql(t) for t in _CHECKED))
def table_check(spark, sf):
    parts = [
        checks.key_check(read_table(spark, sf, t), t, key, _REQUIRED[t])
        for t, key in _CHECKED.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- row pipelines -----------------------------------------------------------


@query("identity", "SELECT * FROM events")
def identity(spark, sf):
    return pipelines.identity(read_table(spark, sf, "events"))


@query("key_count", "SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type")
def key_count(spark, sf):
    return pipelines.key_count(read_table(spark, sf, "events"), "event_type")


@query(
    "binned_sum",
    """SELECT CAST(floor(event_id / 1000) AS BIGINT) AS window_id, event_type,
              round(sum(value), 2) AS total_amount, count(*) AS cnt
       FROM events GROUP BY ALL""",
)
def binned_sum(spark, sf):
    events = read_table(spark, sf, "events")
    sums = pipelines.binned_sum(events, "event_id", "event_type", "value", 1000)
    return rounded(sums, 2, "total_amount")


_WORD = f"CAST({scatter63_sql('o_orderkey', 1)} % {{n}} AS INTEGER)"
_AMOUNT = f"(({scatter63_sql('o_orderkey', 2)} >> 10) / 9007199254740992.0::DOUBLE * 1000)"
_TEXT = "substr(" + " || ".join(f"md5(o_orderkey || ':{i}')" for i in range(4)) + ", 1, 100)"


@query("generated_identity", f"SELECT o_orderkey AS id, {_TEXT} AS data FROM orders")
def generated_identity(spark, sf):
    orders = read_table(spark, sf, "orders")
    return pipelines.identity(generated.text_rows(orders, "o_orderkey"))


@query(
    "generated_key_count",
    f"""SELECT {_WORD.format(n=1000)} AS word_id, count(*) AS cnt FROM orders GROUP BY ALL""",
)
def generated_key_count(spark, sf):
    orders = read_table(spark, sf, "orders")
    return pipelines.key_count(generated.key_rows(orders, "o_orderkey"))


@query(
    "generated_binned_sum",
    f"""SELECT CAST(floor(o_orderkey / 10000) AS BIGINT) AS window_id,
               {_WORD.format(n=100)} AS word_id,
               round(sum({_AMOUNT}), 4) AS total_amount, count(*) AS cnt
        FROM orders GROUP BY ALL""",
)
def generated_binned_sum(spark, sf):
    orders = read_table(spark, sf, "orders")
    sums = pipelines.binned_sum(generated.amount_rows(orders, "o_orderkey"))
    return rounded(sums, 4, "total_amount")


@query(
    "datagen_profile",
    f"""SELECT count(*) AS n, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id,
               min({_WORD.format(n=100)}) AS min_word, max({_WORD.format(n=100)}) AS max_word,
               round(min({_AMOUNT}), 4) AS min_amount, round(max({_AMOUNT}), 4) AS max_amount,
               round(avg({_AMOUNT}), 6) AS mean_amount FROM orders""",
)
def datagen_profile(spark, sf):
    rows = generated.amount_rows(read_table(spark, sf, "orders"), "o_orderkey")
    profile = rows.agg(
        F.count("*").alias("n"),
        F.min("id").alias("min_id"),
        F.max("id").alias("max_id"),
        F.min("word_id").alias("min_word"),
        F.max("word_id").alias("max_word"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        F.avg("amount").alias("mean_amount"),
    )
    return rounded(rounded(profile, 4, "min_amount", "max_amount"), 6, "mean_amount")


@query(
    "query_times",
    """SELECT event_type AS query, round(sum(value), 2) AS seconds,
              CAST(grouping(event_type) AS INTEGER) AS is_total
       FROM events GROUP BY ROLLUP (event_type)""",
)
def query_times(spark, sf):
    times = read_table(spark, sf, "events").select(
        F.col("event_type").alias("query"), F.col("value").alias("seconds")
    )
    return rounded(pipelines.query_times(times), 2, "seconds")


@query(
    "job_throughput",
    """SELECT l_suppkey, round(sum(l_quantity), 2) AS records_in,
              round(sum(l_extendedprice), 2) AS bytes_in,
              CAST(max(l_linenumber) AS DOUBLE) AS seconds,
              round(sum(l_quantity) / max(l_linenumber), 6) AS records_per_second
       FROM lineitem GROUP BY l_suppkey""",
)
def job_throughput(spark, sf):
    stages = read_table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.col("l_quantity").alias("records_in"),
        F.col("l_extendedprice").alias("bytes_in"),
        F.col("l_linenumber").cast("double").alias("seconds"),
    )
    totals = pipelines.job_throughput(
        stages, "l_suppkey", ["records_in", "bytes_in"], "records_in", "seconds"
    )
    totals = rounded(totals, 2, "records_in", "bytes_in", "seconds")
    return rounded(totals, 6, "records_per_second")


# --- statistics --------------------------------------------------------------

_SUMMARY = """count({v}) AS n, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median,
              min({v}) AS min, max({v}) AS max,
              round(CASE WHEN count({v}) = 1 THEN 0.0 ELSE stddev_samp({v}) END, 6) AS stdev,
              round(CASE WHEN count({v}) = 1 THEN 0.0 ELSE stddev_samp({v}) END
                    / nullif(avg({v}), 0), 6) AS cv,
              round(quantile_cont({v}, 0.1), 6) AS p10, round(quantile_cont({v}, 0.9), 6) AS p90"""
_SUMMARY_ROUNDED = ("mean", "median", "stdev", "cv", "p10", "p90")


@query(
    "metric_summary",
    f"SELECT event_type, {_SUMMARY.format(v='value')} FROM events GROUP BY event_type",
)
def metric_summary(spark, sf):
    summary = stats.summarize(read_table(spark, sf, "events"), ["event_type"], "value")
    return rounded(summary, 6, *_SUMMARY_ROUNDED)


@query(
    "rank_percentiles",
    """WITH r AS (SELECT event_type, value,
                         row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k,
                         count(*) OVER (PARTITION BY event_type) AS n
                  FROM events WHERE value IS NOT NULL)
       SELECT event_type, max(n) AS n, min(value) AS min, max(value) AS max,
              round(avg(value), 6) AS mean,
              max(CASE WHEN k = n // 2 THEN value END) AS p50,
              max(CASE WHEN k = floor((n - 1) * 0.9::DOUBLE) THEN value END) AS p90,
              max(CASE WHEN k = floor((n - 1) * 0.99::DOUBLE) THEN value END) AS p99
       FROM r GROUP BY event_type""",
)
def rank_percentiles(spark, sf):
    found = stats.rank_percentiles(read_table(spark, sf, "events"), ["event_type"], "value")
    return rounded(found, 6, "mean")


@query(
    "tail_counts",
    """SELECT event_type, count(*) FILTER (value = 0) AS zero,
              count(*) FILTER (value > 10) AS gt_10, count(*) FILTER (value > 50) AS gt_50,
              count(*) FILTER (value > 100) AS gt_100
       FROM events GROUP BY event_type""",
)
def tail_counts(spark, sf):
    return stats.tail_counts(
        read_table(spark, sf, "events"), ["event_type"], "value",
        {"gt_10": 10, "gt_50": 50, "gt_100": 100},
    )


@query(
    "baseline_ratio",
    """WITH m AS (SELECT event_type, median(value) AS v FROM events GROUP BY event_type),
            b AS (SELECT v AS base FROM m WHERE event_type = 'click')
       SELECT event_type, round(v, 6) AS value,
              CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS place,
              round(v / nullif(base, 0), 6) AS ratio, round(base / nullif(v, 0), 6) AS slowdown,
              printf('%.3fx', v / base) AS ratio_label
       FROM m, b""",
)
def baseline_ratio(spark, sf):
    events = read_table(spark, sf, "events")
    medians = stats.percentiles(events, ["event_type"], "value", {"value": 0.5})
    compared = logs.compare_setups(medians, "event_type", "value", ("click", "view"))
    return rounded(compared, 6, "value", "ratio", "slowdown")


@query(
    "value_labels",
    """WITH v AS (SELECT o_orderkey, o_totalprice AS a, -o_totalprice / 1000 AS b FROM orders)
       SELECT o_orderkey,
              CASE WHEN abs(a) >= 1e6 THEN printf('%.1fM', a / 1e6)
                   WHEN abs(a) >= 1e3 THEN printf('%.1fK', a / 1e3) ELSE printf('%.1f', a) END AS short,
              CASE WHEN abs(b) >= 1e6 THEN printf('%.2fM', b / 1e6)
                   WHEN abs(b) >= 1e3 THEN printf('%.2fK', b / 1e3) ELSE printf('%.2f', b) END AS negative,
              CASE WHEN a >= 1e6 THEN printf('%.0fM', a / 1e6)
                   WHEN a >= 1e3 THEN printf('%.0fK', a / 1e3) ELSE printf('%.0f', a) END AS whole,
              printf('%.3fx', a / 1000.0) AS ratio, o_orderkey || '-' || (o_orderkey + 1) AS span,
              CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE a / ((o_orderkey % 3) / 1e9) END AS rate,
              greatest(1000 - o_orderkey, 0) AS late
       FROM v""",
)
def value_labels(spark, sf):
    """Every label and rate function over the orders."""
    a = F.col("o_totalprice")
    key = F.col("o_orderkey")
    return read_table(spark, sf, "orders").select(
        "o_orderkey",
        numbers.short_number(a).alias("short"),
        numbers.short_number(-a / 1000, 2).alias("negative"),
        numbers.short_number(a, 0).alias("whole"),
        numbers.ratio_label(a, F.lit(1000.0)).alias("ratio"),
        numbers.span_label(key, key + 1).alias("span"),
        numbers.rate_per_second(a, key % 3).alias("rate"),
        numbers.lateness(F.lit(1000).cast("bigint"), key).alias("late"),
    )


# --- benchmark logs ----------------------------------------------------------

# Lines of every class, made from the events: the rules are on event_id.
_LINE_CLASS = """CASE WHEN event_id % 7 = 0 THEN 'text' WHEN event_id % 11 = 0 THEN 'broken'
                      WHEN event_id % 13 = 0 THEN 'blank' WHEN event_id % 17 = 0 THEN 'other'
                      WHEN event_id % 19 = 0 THEN 'trailing'
                      WHEN event_id % 23 = 0 THEN 'partial' ELSE 'ok' END"""


def _log_lines(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events").withColumn("class", F.expr(_LINE_CLASS))
    count = lambda factor: F.floor(F.col("value") * factor).cast("bigint")
    latency = F.struct(
        F.lit(10).alias("n"),
        count(5).alias("min"),
        F.col("value").alias("mean"),
        count(10).alias("p50"),
        count(20).alias("p90"),
        F.when(F.col("class") != "partial", count(30)).alias("p99"),
        count(40).alias("max"),
    )
    tails = F.struct(
        (F.col("event_id") % 3).alias("zero"),
        (F.col("event_id") % 4).alias("gt_1ms"),
        (F.col("event_id") % 2).alias("gt_100ms"),
        F.lit(0).alias("gt_1s"),
    )
    good = F.to_json(
        F.struct(
            F.lit("timer_jitter").alias("bench"),
            (F.col("user_id") % 4).alias("cpu"),
            F.lit(1000).alias("period_us"),
            latency.alias("wake_latency_ns"),
            F.when(F.col("event_id") % 5 != 0, tails).alias("tail_counts"),
        )
    )
    text = (
        F.when(F.col("class") == "text", F.concat(F.lit("run "), F.col("event_id").cast("string")))
        .when(F.col("class") == "broken", '{"bench": "timer_jitter", "cpu"')
        .when(F.col("class") == "blank", "  \t ")
        .when(F.col("class") == "other", '{"bench": "smp_barrier"}')
        .when(F.col("class") == "trailing", F.concat(good, F.lit(" done")))
        .otherwise(good)
    )
    return events.select(
        F.concat("event_type", F.lit(".log")).alias("file"),
        F.col("event_id").alias("line"),
        # From a generator, so that the text is made once however often it is used.
        F.explode(F.array(text)).alias("value"),
    )


_REASON = f"""CASE {_LINE_CLASS} WHEN 'text' THEN 'non-json' WHEN 'broken' THEN 'json error'
                   WHEN 'other' THEN 'not timer_jitter' WHEN 'trailing' THEN 'json error'
                   WHEN 'partial' THEN 'missing field' END"""
_OK_EVENTS = f"SELECT * FROM events WHERE {_LINE_CLASS} = 'ok'"
_TIMER = logs.KINDS["timer_jitter"]


@query(
    "log_parse",
    f"""SELECT event_type || '.log' AS file, coalesce({_REASON}, 'ok') AS reason,
               count(*) AS lines
        FROM events WHERE {_LINE_CLASS} <> 'blank' GROUP BY ALL""",
)
def log_parse(spark, sf):
    classified = logs.classify(_log_lines(spark, sf), _TIMER)
    return classified.groupBy("file", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count("*").alias("lines")
    )


@query(
    "log_skipped",
    f"""WITH s AS (SELECT event_type || '.log' AS file, event_id AS line, {_REASON} AS reason
                   FROM events WHERE {_LINE_CLASS} NOT IN ('ok', 'blank'))
        SELECT file || ':' || line || ': ' || reason AS skipped, file, line, reason,
               (SELECT greatest(count(*) - 20, 0) FROM s) AS more
        FROM s ORDER BY CASE file WHEN 'view.log' THEN 1 ELSE 2 END, file, line LIMIT 20""",
)
def log_skipped(spark, sf):
    skipped = logs.skipped_lines(logs.classify(_log_lines(spark, sf), _TIMER))
    return logs.skipped_preview(skipped, ("view.log",))


_TIMER_SQL = {
    "lat_mean_ns": "value",
    "lat_p50_ns": "floor(value * 10)",
    "lat_p90_ns": "floor(value * 20)",
    "lat_p99_ns": "floor(value * 30)",
    "lat_min_ns": "floor(value * 5)",
    "lat_max_ns": "floor(value * 40)",
    "period_us": "1000",
    "samples_per_run": "10",
    "cpu": "user_id % 4",
    "warmup_iters": "NULL",
    "tail_zero": "CASE WHEN event_id % 5 <> 0 THEN event_id % 3 END",
    "tail_gt_1ms": "CASE WHEN event_id % 5 <> 0 THEN event_id % 4 END",
    "tail_gt_100ms": "CASE WHEN event_id % 5 <> 0 THEN event_id % 2 END",
    "tail_gt_1s": "CASE WHEN event_id % 5 <> 0 THEN 0 END",
}
_TIMER_VALUES = " UNION ALL ".join(
    f"SELECT event_type || '.log' AS file, '{m}' AS metric, CAST({e} AS DOUBLE) AS v FROM ok"
    for m, e in _TIMER_SQL.items()
)
_LOG_SUMMARY = f"""
    WITH ok AS ({_OK_EVENTS}), vals AS ({_TIMER_VALUES})
    SELECT file, metric, {_SUMMARY.format(v='v')} FROM vals GROUP BY file, metric"""


@query("log_summary", _LOG_SUMMARY)
def log_summary(spark, sf):
    rows = logs.result_rows(logs.classify(_log_lines(spark, sf), _TIMER))
    return rounded(logs.summarize_metrics(rows, _TIMER), 6, *_SUMMARY_ROUNDED)


@query(
    "log_report",
    f"""WITH ok AS ({_OK_EVENTS})
        SELECT event_type || '.log' AS setup, count(*) AS n,
               printf('%.1f', round(median(floor(value * 10)), 1)) AS p50,
               printf('%.3f', stddev_samp(value) / avg(value)) AS cv,
               'nan' AS warmup
        FROM ok GROUP BY event_type""",
)
def log_report(spark, sf):
    rows = logs.result_rows(logs.classify(_log_lines(spark, sf), _TIMER))
    report = setup_report(logs.summarize_metrics(rows, _TIMER), _TIMER)
    return report.select(
        "setup", "n", F.col("p50 ns").alias("p50"), F.col("mean CV").alias("cv"), "warmup"
    )


@query(
    "log_scan",
    f"""SELECT coalesce({_REASON}, 'ok') AS reason, count(*) AS lines FROM events
        WHERE {_LINE_CLASS} <> 'blank' GROUP BY ALL""",
)
def log_scan(spark, sf):
    """The lines as files: written, read back in splits, numbered and classed."""
    folder = scratch_path(spark, "logs")
    _log_lines(spark, sf).select("value").write.text(folder)
    lines = log_files.read_lines(spark, folder, "part-*")
    classified = logs.classify(lines, _TIMER)
    good = classified.where("reason IS NULL").select(F.lit("ok").alias("reason"))
    numbered = log_files.with_line_numbers(logs.skipped_lines(classified), lines)
    skipped = numbered.where("line >= 1").select("reason")
    return good.unionByName(skipped).groupBy("reason").agg(F.count("*").alias("lines"))


_NUMBERED_LINES = 3000


def _bucket() -> Column:
    return F.regexp_extract("path", "bucket=([0-9]+)/", 1).cast("bigint").alias("bucket")


def _numbered_folder(spark: SparkSession, sf: str) -> str:
    folder = scratch_path(spark, "numbered")
    lines = _log_lines(spark, sf).select(
        F.expr(f"line DIV {_NUMBERED_LINES}").alias("bucket"), "line", "value"
    )
    # One task, and so one file, holds a bucket in order.
    for rest, codec in ((0, "none"), (1, "gzip")):
        part = lines.where(F.col("bucket") % 2 == rest).repartition("bucket")
        part.sortWithinPartitions("bucket", "line").select("bucket", "value").write.mode(
            "append"
        ).option("compression", codec).partitionBy("bucket").text(folder)
    return folder


@query(
    "log_lines_numbered",
    f"""WITH l AS (SELECT event_id // {_NUMBERED_LINES} AS bucket, {_LINE_CLASS} AS class, {_REASON} AS reason,
                      row_number() OVER (PARTITION BY event_id // {_NUMBERED_LINES} ORDER BY event_id) AS line
               FROM events)
        SELECT bucket, line, reason FROM l WHERE class NOT IN ('ok', 'blank')""",
)
def log_lines_numbered(spark, sf):
    """Plain and compressed files of known lines, analysed as a folder: file, line, reason."""
    found = analyze(spark, _numbered_folder(spark, sf), "timer_jitter", pattern="part-*")
    return found.skipped.select(_bucket(), "line", "reason")


@query(
    "log_files",
    f"""SELECT event_id // {_NUMBERED_LINES} AS bucket, count(*) AS lines, 'whole' AS verdict
        FROM events GROUP BY ALL""",
)
def log_files_query(spark, sf):
    """The verdict on each of these files, with the lines that were read of it."""
    found = analyze(spark, _numbered_folder(spark, sf), "timer_jitter", False, "part-*")
    return found.files.select(_bucket(), "lines", "verdict")


@query("stream_log_lines", ORACLE["log_lines_numbered"])
def stream_log_lines(spark, sf):
    """The same files as streams, dealt by the bucket's last digit, two in a micro-batch."""
    folder = _numbered_folder(spark, sf)
    lines = [
        jobs.read_log_stream(spark, f"{folder}/bucket=*{digit}", "part-*", files_per_batch=2)
        for digit in range(10)
    ]
    _, skipped = jobs.ingest_logs(lines, _TIMER, scratch_path(spark, "ingest"))
    return skipped.select(_bucket(), "line", "reason")


@query(
    "json_field",
    """SELECT event_type, count(json_extract(props, '$.k')) AS n,
              CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k,
              count(json_extract(props, '$.missing')) AS n_missing
       FROM events GROUP BY event_type""",
)
def json_field(spark, sf):
    props = F.from_json("props", "k BIGINT, missing BIGINT")
    return (
        read_table(spark, sf, "events")
        .select("event_type", props.alias("p"))
        .groupBy("event_type")
        .agg(
            F.count("p.k").alias("n"),
            F.sum("p.k").alias("total_k"),
            F.count("p.missing").alias("n_missing"),
        )
    )


@query(
    "nested_imbalance",
    """SELECT l_orderkey, round(avg(l_quantity), 6) AS thread_elapsed_mean,
              min(l_quantity) AS thread_elapsed_min, max(l_quantity) AS thread_elapsed_max,
              round(avg(l_extendedprice), 6) AS thread_rate_mean,
              min(l_extendedprice) AS thread_rate_min, max(l_extendedprice) AS thread_rate_max,
              round((max(l_extendedprice) - min(l_extendedprice))
                    / nullif(avg(l_extendedprice), 0) * 100, 6) AS imbalance_pct
       FROM lineitem GROUP BY l_orderkey""",
)
def nested_imbalance(spark, sf):
    workers = read_table(spark, sf, "lineitem")
    spread = logs.run_spread(workers, ["l_orderkey"], "l_quantity", "l_extendedprice")
    return rounded(spread, 6, "thread_elapsed_mean", "thread_rate_mean", "imbalance_pct")


@query(
    "per_worker_summary",
    f"""SELECT l_linenumber, {_SUMMARY.format(v='l_extendedprice')}
        FROM lineitem GROUP BY l_linenumber""",
)
def per_worker_summary(spark, sf):
    workers = read_table(spark, sf, "lineitem")
    summary = stats.summarize(workers, ["l_linenumber"], "l_extendedprice")
    return rounded(summary, 6, *_SUMMARY_ROUNDED)


@query(
    "incomplete_runs",
    """WITH r AS (SELECT l_orderkey, max(l_linenumber) AS declared, count(*) AS results
                  FROM lineitem GROUP BY l_orderkey)
       SELECT declared AS threads, count(*) AS runs,
              count(*) FILTER (declared <> results) AS incomplete_runs
       FROM r GROUP BY declared""",
)
def incomplete_runs(spark, sf):
    runs = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_linenumber").alias("threads"), F.count("*").alias("results")
    )
    return runs.groupBy("threads").agg(
        F.count("*").alias("runs"),
        F.count_if(logs.is_incomplete(F.col("threads"), F.col("results"))).alias(
            "incomplete_runs"
        ),
    )


_DAY_NS = 86_400_000_000_000


@query(
    "run_window",
    f"""WITH w AS (
          SELECT l_suppkey, epoch_us(l_shipdate) * 1000 AS s,
                 epoch_us(l_shipdate) * 1000 + CAST((l_quantity - 5) AS BIGINT) * {_DAY_NS} AS e,
                 l_extendedprice AS work FROM lineitem),
        g AS (
          SELECT l_suppkey, count(*) AS workers, min(s) AS first_start,
                 max(s) - min(s) AS start_skew_ns, max(e) - min(e) AS finish_skew_ns,
                 greatest(max(e) - min(s), 0) AS elapsed_window_ns, sum(work) AS total_work,
                 count(*) FILTER (e < s) AS clock_regressions FROM w GROUP BY l_suppkey)
        SELECT l_suppkey, workers, first_start, start_skew_ns, finish_skew_ns,
               elapsed_window_ns, round(total_work, 2) AS total_work, clock_regressions,
               round(CASE WHEN elapsed_window_ns > 0
                          THEN total_work / (elapsed_window_ns / 1e9) ELSE 0 END, 9)
                 AS aggregate_rate FROM g""",
)
def run_window(spark, sf):
    start = epoch_micros(F.col("l_shipdate")) * 1000
    workers = read_table(spark, sf, "lineitem").select(
        "l_suppkey",
        start.alias("start_ns"),
        (start + (F.col("l_quantity") - 5).cast("bigint") * F.lit(_DAY_NS)).alias("end_ns"),
        "l_extendedprice",
    )
    windows = logs.run_window(workers, ["l_suppkey"], "start_ns", "end_ns", "l_extendedprice")
    return rounded(rounded(windows, 2, "total_work"), 9, "aggregate_rate")


@query(
    "wrapped_counters",
    """SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 10 = 0) AS wrapped_count,
              min(CASE WHEN event_id % 10 = 0 THEN -event_id - 1 END) AS lowest_wrapped
       FROM events GROUP BY event_type""",
)
def wrapped_counters(spark, sf):
    wide = F.col("event_id").cast("decimal(20,0)")
    top = F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")
    rows = read_table(spark, sf, "events").select(
        "event_type", F.when(F.col("event_id") % 10 == 0, top - wide).otherwise(wide).alias("c")
    )
    return logs.wrapped_counts(rows, "c", ["event_type"])


@query(
    "raw_samples",
    """SELECT count(*) AS n, count(*) FILTER (v = 0) AS zero, count(*) FILTER (v > 100) AS gt_100,
              CAST(min(v) AS BIGINT) AS min, CAST(max(v) AS BIGINT) AS max,
              CAST(max(CASE WHEN k = n // 2 THEN v END) AS BIGINT) AS p50,
              CAST(max(CASE WHEN k = floor((n - 1) * 0.99::DOUBLE) THEN v END) AS BIGINT) AS p99
       FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n
             FROM (SELECT floor(value) AS v FROM events))""",
)
def raw_samples(spark, sf):
    """Sample values as a text file: one unsigned number per line."""
    folder = scratch_path(spark, "samples")
    read_table(spark, sf, "events").select(
        F.floor("value").cast("string").alias("value")
    ).write.text(folder)
    samples = log_files.read_samples(spark, folder, "part-*").withColumn("run", F.lit("all"))
    ranks = stats.rank_percentiles(samples, ["run"], "v")
    tails = stats.tail_counts(samples, ["run"], "v", {"gt_100": 100})
    both = null_safe_join(ranks, tails, ["run"])
    return both.select(
        "n", "zero", "gt_100", *[F.col(c).cast("bigint").alias(c) for c in ("min", "max", "p50", "p99")]
    )


@query("delimited_scan", _PRICING)
def delimited_scan(spark, sf):
    """The pricing report on the table as delimited text with a closing delimiter."""
    lineitem = read_table(spark, sf, "lineitem")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lineitem.schema)
    folder = scratch_path(spark, "lineitem")
    delimited.write_delimited(lineitem, folder)
    return _pricing_rounded(
        reports.pricing_summary(delimited.read_delimited(spark, folder, ddl))
    )


# --- progress of many entities -----------------------------------------------

_DAY_US = 86_400_000_000
_CUMULATED = f"""
    cells AS (SELECT user_id % 4 AS run, user_id AS entity,
                     CAST(ceil(epoch_us(ts) / {{step}}.0::DOUBLE) AS BIGINT) AS cell,
                     count(*) AS c, max(epoch_us(ts)) AS t
              FROM events GROUP BY ALL),
    samples AS (SELECT run, entity, cell, t, CAST(sum(c) OVER
                       (PARTITION BY run, entity ORDER BY cell) AS BIGINT) AS ticks FROM cells)"""


def _increments(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("run"),
        F.col("user_id").alias("entity"),
        epoch_micros(F.col("ts")).alias("t"),
        F.lit(1).alias("amount"),
    )


@query(
    "progress_rates",
    f"""WITH {_CUMULATED.format(step=_DAY_US)},
        b AS (SELECT user_id % 4 AS run, min(epoch_us(ts)) AS s, max(epoch_us(ts)) AS e
              FROM events GROUP BY ALL)
        SELECT run, entity, max(ticks) AS events,
               round(max(ticks) / nullif((max(t) - min(t)) / 1e6, 0), 12) AS events_per_own_second,
               round(max(ticks) / nullif((max(e) - max(s)) / 1e6, 0), 12) AS events_per_host_second
        FROM samples JOIN b USING (run) GROUP BY run, entity""",
)
def progress_rates(spark, sf):
    increments = _increments(spark, sf)
    samples = progress.cumulate(increments, _DAY_US)
    brackets = increments.groupBy("run").agg(
        F.min("t").alias("host_start"), F.max("t").alias("host_end")
    )
    rates = progress.progress_rates(samples, brackets, 1e6)
    return rounded(rates, 12, "events_per_own_second", "events_per_host_second")


_ALIGNED = f"""
    {_CUMULATED.format(step=_DAY_US)},
    ends AS (SELECT run, max(cell) AS last FROM samples GROUP BY run),
    spans AS (SELECT s.*, coalesce(lead(cell) OVER w - 1, last) AS until,
                     min(t) OVER (PARTITION BY run, entity) AS first_t
              FROM samples s JOIN ends USING (run) WINDOW w AS (PARTITION BY run, entity ORDER BY cell)),
    aligned AS (SELECT run, entity, ticks, first_t, unnest(generate_series(cell, until)) AS cell
                FROM spans),
    rated AS (SELECT *, cell * {_DAY_US} AS grid_t,
                     CASE WHEN cell * {_DAY_US} > first_t
                          THEN ticks / CAST(cell * {_DAY_US} - first_t AS DOUBLE) END AS x
              FROM aligned),
    skew AS (SELECT run, cell, grid_t, count(*) AS entities, max(ticks) - min(ticks) AS spread_ticks,
                    pow(sum(x), 2) / nullif(count(x) * sum(x * x), 0) AS jain_index,
                    stddev_pop(x) / nullif(avg(x), 0) AS cv
             FROM rated GROUP BY run, cell, grid_t)"""


def _skew(spark: SparkSession, sf: str) -> DataFrame:
    samples = progress.cumulate(_increments(spark, sf), _DAY_US)
    return progress.skew_by_time(progress.align(samples, _DAY_US))


@query(
    "progress_skew",
    f"""WITH {_ALIGNED} SELECT run, cell, grid_t, entities, spread_ticks,
               round(jain_index, 6) AS jain_index, round(cv, 6) AS cv FROM skew""",
)
def progress_skew(spark, sf):
    return rounded(_skew(spark, sf), 6, "jain_index", "cv")


@query(
    "skew_summary",
    f"""WITH {_ALIGNED}, b AS (SELECT run, min(grid_t) + 3 * {_DAY_US} AS warm FROM skew GROUP BY run)
        SELECT run, max(spread_ticks) AS max_spread_ticks,
               max_by(spread_ticks, grid_t) AS final_spread_ticks,
               round(max_by(jain_index, grid_t), 6) AS final_jain_index,
               round(max_by(cv, grid_t), 6) AS final_cv,
               max(spread_ticks) FILTER (grid_t > warm) AS steady_max_spread_ticks,
               round(min(jain_index) FILTER (grid_t > warm), 6) AS steady_min_jain_index,
               round(max(cv) FILTER (grid_t > warm), 6) AS steady_max_cv
        FROM skew JOIN b USING (run) GROUP BY run""",
)
def skew_summary(spark, sf):
    summary = progress.skew_summary(_skew(spark, sf), 3 * _DAY_US)
    return rounded(
        summary, 6, "final_jain_index", "final_cv", "steady_min_jain_index", "steady_max_cv"
    )


@query(
    "phase_compare",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, avg(value) AS v
                  FROM events GROUP BY ALL)
       SELECT day, round(max(v) FILTER (event_type = 'click'), 6) AS click,
              round(max(v) FILTER (event_type = 'view'), 6) AS view,
              round(max(v) FILTER (event_type = 'view')
                    / nullif(max(v) FILTER (event_type = 'click'), 0), 6) AS ratio
       FROM d GROUP BY day""",
)
def phase_compare(spark, sf):
    daily = read_table(spark, sf, "events").groupBy(
        F.col("ts").cast("date").alias("day"), "event_type"
    ).agg(F.avg("value").alias("v"))
    wide = progress.compare_phases(daily, ["day"], "event_type", "v", "click", "view")
    return rounded(wide, 6, "click", "view", "ratio")


@query(
    "run_variance",
    f"""WITH r AS (SELECT event_type AS phase, CAST(ts AS DATE) AS day, round(sum(value), 2) AS v
                   FROM events GROUP BY ALL)
        SELECT phase, {_SUMMARY.format(v='v')} FROM r GROUP BY phase""",
)
def run_variance(spark, sf):
    runs = read_table(spark, sf, "events").groupBy(
        F.col("event_type").alias("phase"), F.col("ts").cast("date").alias("day")
    ).agg(F.round(F.sum("value"), 2).alias("v"))
    summary = stats.summarize(snapshot(runs, "runs"), ["phase"], "v")
    return rounded(summary, 6, *_SUMMARY_ROUNDED)


# --- keyed tables ------------------------------------------------------------


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("val")
    )


_LOOKUP = """SELECT event_id AS req_id, user_id * 15 AS key, c_acctbal AS val,
                    c_custkey IS NOT NULL AS found
             FROM events LEFT JOIN customer ON user_id * 15 = c_custkey"""


def _requests(spark: SparkSession, sf: str, key: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("req_id"),
        (F.col("user_id") * 15).alias(key),
        (F.col("event_id") % 20 + 1).cast("int").alias("scan_len"),
    )


@query("point_lookup", _LOOKUP)
def point_lookup(spark, sf):
    requests = _requests(spark, sf, "key").drop("scan_len")
    return keyed.point_lookup(requests, _customers(spark, sf))


@query("point_lookup_shuffled", _LOOKUP)
def point_lookup_shuffled(spark, sf):
    requests = _requests(spark, sf, "key").drop("scan_len")
    return keyed.point_lookup(requests, _customers(spark, sf), broadcast_rows=0)


_SCAN = """
    WITH t AS (SELECT c_custkey AS key, c_acctbal AS val,
                      row_number() OVER (ORDER BY c_custkey) - 1 AS rank FROM customer),
         r AS (SELECT event_id AS req_id, user_id * 15 AS start, event_id % 20 + 1 AS scan_len
               FROM events),
         s AS (SELECT start, (SELECT count(*) FROM customer WHERE c_custkey < start) AS first
               FROM (SELECT DISTINCT start FROM r))
    SELECT req_id, rank - first AS pos, key, val
    FROM r JOIN s USING (start) JOIN t ON rank BETWEEN first AND first + scan_len - 1"""


@query("range_scan", _SCAN)
def range_scan(spark, sf):
    return keyed.range_scan(_requests(spark, sf, "start"), _customers(spark, sf))


@query("range_scan_shuffled", _SCAN)
def range_scan_shuffled(spark, sf):
    return keyed.range_scan(
        _requests(spark, sf, "start"), _customers(spark, sf), slices=64, broadcast_rows=0
    )


@query("range_scan_stored", _SCAN)
def range_scan_stored(spark, sf):
    """Two batches of requests on one sorted table."""
    table, requests = sort_table(_customers(spark, sf)), _requests(spark, sf, "start")
    batches = [
        keyed.range_scan(requests.where(F.col("req_id") % 2 == rest), table) for rest in (0, 1)
    ]
    return batches[0].unionByName(batches[1])


# Events as an operation log: the type of an event decides the operation.
_OPS = {
    "click": "update", "view": "read", "purchase": "insert", "signup": "rmw", "error": "delete",
}
_OPS_SQL = "CASE event_type " + " ".join(
    f"WHEN '{event}' THEN '{op}'" for event, op in _OPS.items()
) + " END"
_LOG_SQL = f"""ops AS (SELECT event_id AS seq, {_OPS_SQL} AS op, user_id * 15 AS key, value AS val
                       FROM events),
               t AS (SELECT c_custkey AS key, c_acctbal AS val FROM customer)"""


def _event_log(spark: SparkSession, sf: str) -> DataFrame:
    op: Column = F.lit(None)
    for event, name in _OPS.items():
        op = F.when(F.col("event_type") == event, name).otherwise(op)
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        op.alias("op"),
        (F.col("user_id") * 15).alias("key"),
        F.col("value").alias("val"),
    )


@query(
    "upsert_delete",
    f"""WITH {_LOG_SQL},
        e AS (SELECT key, max_by(op = 'insert', seq) FILTER (op IN ('insert', 'delete')) AS made,
                     max_by(val, seq) FILTER (op IN ('insert', 'update')) AS written
              FROM ops WHERE op IN ('insert', 'update', 'delete') GROUP BY key)
        SELECT coalesce(t.key, e.key) AS key, coalesce(written, val) AS val
        FROM t FULL JOIN e ON t.key = e.key
        WHERE coalesce(made, t.key IS NOT NULL)""",
)
def upsert_delete(spark, sf):
    return keyed.apply_writes(_customers(spark, sf), _event_log(spark, sf))


@query("upsert_delete_shuffled", ORACLE["upsert_delete"])
def upsert_delete_shuffled(spark, sf):
    return keyed.apply_writes(_customers(spark, sf), _event_log(spark, sf), broadcast_rows=0)


@query(
    "update_apply",
    f"""WITH {_LOG_SQL},
        u AS (SELECT key, max_by(val, seq) AS new FROM ops WHERE op = 'update' GROUP BY key)
        SELECT t.key, coalesce(new, val) AS val FROM t LEFT JOIN u USING (key)""",
)
def update_apply(spark, sf):
    return keyed.apply_updates(_customers(spark, sf), _event_log(spark, sf))


@query(
    "rmw_apply",
    f"""WITH {_LOG_SQL},
        a AS (SELECT key, sum(val) AS added FROM ops WHERE op = 'rmw' GROUP BY key)
        SELECT t.key, round(val + coalesce(added, 0), 4) AS val FROM t LEFT JOIN a USING (key)""",
)
def rmw_apply(spark, sf):
    return rounded(keyed.apply_rmw(_customers(spark, sf), _event_log(spark, sf)), 4, "val")


@query(
    "delete_batch",
    f"""WITH {_LOG_SQL} SELECT key, val FROM t
        WHERE key NOT IN (SELECT key FROM ops WHERE op = 'delete')""",
)
def delete_batch(spark, sf):
    gone = _event_log(spark, sf).where("op = 'delete'")
    return keyed.delete_keys(_customers(spark, sf), gone)


@query(
    "insert_batch",
    f"""WITH {_LOG_SQL} SELECT key, val FROM t UNION ALL
        SELECT 1000000000 + seq AS key, val FROM ops WHERE op = 'insert'""",
)
def insert_batch(spark, sf):
    new = _event_log(spark, sf).where("op = 'insert'").select(
        (F.lit(1_000_000_000) + F.col("seq")).alias("key"), "val"
    )
    return keyed.insert_rows(_customers(spark, sf), new)


@query(
    "read_latest",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 50",
)
def read_latest(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return keyed.read_latest(orders, 50, "o_orderkey")


def _op_log_sql(
    mix: str, seed: int, inserted: int = 0, choice: str = "uniform", newest: str = "lo + cnt - 1"
) -> str:
    """:func:`keyed.op_log` over the order ids and the customer keys, as SQL.

    ``inserted`` earlier mixes took a range of keys as long as that of the ids each.
    """
    count = "SELECT max(c_custkey) - min(c_custkey) + 1 FROM customer"
    pick = scatter63_sql("o_orderkey", seed + 1)
    key = "lo + pick % cnt"
    if choice != "uniform":
        pick = skewed_rank_sql("o_orderkey", seed + 1, seed + 4, f"({count})")
        key = f"({newest}) - pick"
    if choice == "skewed":
        key = f"lo + {scatter63_sql('pick', seed + 5)} % cnt"
    cases, upto = [], 0
    for op, share in keyed.MIXES[mix].items():
        upto += share
        cases.append(f"WHEN die < {upto} THEN '{op}'")
    return f"""
        SELECT seq, op, CASE WHEN op = 'insert' THEN lo + cnt + {inserted} * span + seq
                             ELSE {key} END AS key, draw % 100000 / 100.0::DOUBLE AS val,
               CASE WHEN op = 'scan' THEN 1 + reach % {keyed.MAX_SCAN} END AS scan_len
        FROM (SELECT o_orderkey AS seq, CASE {' '.join(cases)} END AS op, pick, draw, reach, lo, cnt, span
              FROM (SELECT o_orderkey, {scatter32_sql('o_orderkey', seed)} % 100 AS die,
                           {pick} AS pick,
                           {scatter63_sql('o_orderkey', seed + 2)} AS draw,
                           {scatter63_sql('o_orderkey', seed + 3)} AS reach, lo, cnt, span
                    FROM orders, (SELECT max(o_orderkey) + 1 AS span FROM orders), (SELECT min(c_custkey) AS lo,
                                         max(c_custkey) - min(c_custkey) + 1 AS cnt
                                  FROM customer)))"""


def _report_sql(log: str, table: str) -> str:
    return f"""
        SELECT op, count(*) AS ops, count(h.key) AS hits, count(*) - count(h.key) AS misses,
               count(DISTINCT l.key) AS keys_touched
        FROM {log} l LEFT JOIN {table} h ON l.key = h.key GROUP BY op"""


@query(
    "op_mix",
    f"""WITH l AS ({_op_log_sql('a', 0)}), t AS (SELECT c_custkey AS key FROM customer)
        {_report_sql('l', 't')}""",
)
def op_mix(spark, sf):
    table = _customers(spark, sf)
    first, last = table.agg(F.min("key"), F.max("key")).first()
    log = keyed.op_log(
        read_table(spark, sf, "orders"), keyed.MIXES["a"], first, last - first + 1,
        ident="o_orderkey",
    )
    return keyed.op_report(log, table)


@query(
    "op_mix_skewed",
    f"""WITH l AS ({_op_log_sql('f', 100, choice='skewed')}), t AS (SELECT c_custkey AS key FROM customer)
        SELECT op, key, count(*) AS ops, CAST(max(seq) AS BIGINT) AS last FROM l GROUP BY op, key""",
)
def op_mix_skewed(spark, sf):
    """How often each key is drawn where few keys take most operations."""
    first, last = _customers(spark, sf).agg(F.min("key"), F.max("key")).first()
    log = keyed.op_log(
        read_table(spark, sf, "orders"), keyed.MIXES["f"], first, last - first + 1, seed=100,
        ident="o_orderkey", choice="skewed",
    )
    return log.groupBy("op", "key").agg(F.count("*").alias("ops"), F.max("seq").alias("last"))


def _mix_steps() -> tuple[str, str, str]:
    """CTEs of all mixes in turn, the name of the last table, and the reports."""
    steps, table, found = ["t AS (SELECT c_custkey AS key, c_acctbal AS val FROM customer)"], "t", []
    inserted = 0
    for number, mix in enumerate(keyed.MIXES):
        log, after = f"l_{mix}", f"t_{mix}"
        drawn = _op_log_sql(
            mix, 10 * number, inserted, keyed.MIX_CHOICE.get(mix, "uniform"),
            f"SELECT max(key) FROM {table}",
        )
        steps.append(f"{log} AS MATERIALIZED ({drawn})")
        inserted += "insert" in keyed.MIXES[mix]
        scanned = f"""(SELECT CAST(coalesce(sum(least(scan_len, total - rank)), 0) AS BIGINT)
                       FROM (SELECT * FROM {log} WHERE op = 'scan') s ASOF JOIN
                            (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank,
                                    count(*) OVER () AS total FROM {table}) r ON s.key <= r.key)"""
        found.append(
            f"""SELECT '{mix}' AS mix, *, CASE WHEN op = 'scan' THEN {scanned}
                       WHEN op IN ('read', 'rmw') THEN hits ELSE 0 END AS rows_read
                FROM ({_report_sql(log, table)})"""
        )
        steps.append(
            f"""{after} AS MATERIALIZED (
              SELECT coalesce(h.key, e.key) AS key, coalesce(new, val) + coalesce(added, 0) AS val
              FROM {table} h FULL JOIN (
                SELECT key, max_by(val, seq) FILTER (op IN ('update', 'insert')) AS new,
                       sum(val) FILTER (op = 'rmw') AS added,
                       count(*) FILTER (op = 'insert') AS made FROM {log} GROUP BY key) e
              ON h.key = e.key WHERE h.key IS NOT NULL OR made > 0)"""
        )
        table = after
    return ", ".join(steps), table, " UNION ALL ".join(found)


_STEPS, _LAST, _REPORTS = _mix_steps()


def _run_mixes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ids = read_table(spark, sf, "orders").select("o_orderkey")
    return mixes.run_mixes(_customers(spark, sf), ids, "o_orderkey")


@query("mix_report", f"WITH {_STEPS} {_REPORTS}")
def mix_report(spark, sf):
    return _run_mixes(spark, sf)[0]


@query("mix_table", f"WITH {_STEPS} SELECT key, round(val, 4) AS val FROM {_LAST}")
def mix_table(spark, sf):
    return rounded(_run_mixes(spark, sf)[1], 4, "val")


@query(
    "many_tables",
    """SELECT CAST(c_nationkey AS INTEGER) AS table_id, count(*) AS n, round(sum(c_acctbal), 2) AS total
       FROM customer GROUP BY c_nationkey""",
)
def many_tables(spark, sf):
    """Like-shaped tables kept in one folder, one partition each."""
    folder = scratch_path(spark, "tables")
    rows = read_table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("int").alias("table_id"), "c_custkey", "c_acctbal"
    )
    sinks.write_parquet(rows, folder, ["table_id"])
    stored = spark.read.schema(rows.schema).parquet(folder)
    totals = stored.groupBy("table_id").agg(
        F.count("*").alias("n"), F.sum("c_acctbal").alias("total")
    )
    return rounded(totals, 2, "total")


# --- streaming ---------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    # In braces, as a stream's path must be a folder or a pattern.
    return jobs.read_stream(spark, f"{sf.rstrip('/')}/{{events}}.parquet")


@query("stream_identity", "SELECT * FROM events")
def stream_identity(spark, sf):
    return jobs.copy_stream(_event_stream(spark, sf), scratch_path(spark, "copy"))


@query("stream_key_count", ORACLE["key_count"])
def stream_key_count(spark, sf):
    return jobs.running_count(
        _event_stream(spark, sf), "event_type", scratch_path(spark, "count")
    )


@query(
    "stream_tumbling",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type,
              round(sum(value), 2) AS total_amount, count(*) AS cnt
       FROM events GROUP BY ALL""",
)
def stream_tumbling(spark, sf):
    sums = jobs.tumbling_sum(
        _event_stream(spark, sf), "ts", "event_type", "value", scratch_path(spark, "tumbling")
    )
    return rounded(sums, 2, "total_amount")


@query(
    "stream_log_ingest",
    f"""SELECT coalesce({_REASON}, 'ok') AS reason, count(*) AS lines FROM events
        WHERE {_LINE_CLASS} <> 'blank' GROUP BY ALL""",
)
def stream_log_ingest(spark, sf):
    folder = scratch_path(spark, "feed")
    _log_lines(spark, sf).select("value").write.text(folder)
    lines = jobs.read_log_stream(spark, folder, "part-*")
    rows, skipped = jobs.ingest_logs(lines, _TIMER, scratch_path(spark, "ingest"))
    reasons = rows.select(F.lit("ok").alias("reason")).unionByName(skipped.select("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("lines"))


# --- logs of other spellings and kinds ---------------------------------------


def _spelled_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as other writers spell them: floats, quoted numbers, NaN, broken fields."""
    cpu = F.expr("""CASE event_id % 5 WHEN 0 THEN concat(user_id % 4, '.0')
                                      WHEN 1 THEN concat('"', user_id % 4, '"')
                                      WHEN 2 THEN 'NaN' WHEN 3 THEN '"x"' ELSE 'null' END""")
    text = F.format_string(
        '{"bench": "timer_jitter", "extra": [1], "cpu": %s, "period_us": 1.5e3, "wake_latency_ns": '
        '{"mean": 2, "p50": %s.5, "p90": 4, "p99": 5, "min": 1, "max": 6E0}}',
        cpu, (F.col("event_id") % 100).cast("string"),
    )
    return read_table(spark, sf, "events").select(
        F.concat("event_type", F.lit(".log")).alias("file"), F.explode(F.array(text)).alias("value")
    )


_SPELLED = {
    "cpu": "CASE WHEN event_id % 5 < 2 THEN user_id % 4 END",
    "period_us": "1500", "lat_p50_ns": "event_id % 100 + 0.5", "lat_max_ns": "6",
}


def _metric_rows_sql(values: dict[str, str], where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT event_type || '.log' AS file, '{m}' AS metric, CAST({e} AS DOUBLE) AS v "
        f"FROM events WHERE {where}"
        for m, e in values.items()
    )


@query(
    "log_spellings",
    f"""WITH vals AS ({_metric_rows_sql(_SPELLED, 'event_id % 5 <> 3')})
        SELECT file, metric, {_SUMMARY.format(v='v')} FROM vals GROUP BY file, metric""",
)
def log_spellings(spark, sf):
    rows = logs.result_rows(logs.classify(_spelled_lines(spark, sf), _TIMER))
    summary = logs.summarize_metrics(rows, _TIMER).where(F.col("metric").isin(*_SPELLED))
    return rounded(summary, 6, *_SUMMARY_ROUNDED)


@query(
    "log_unreadable",
    """SELECT event_type || '.log' AS file, 'unreadable field' AS reason, count(*) AS lines
       FROM events WHERE event_id % 5 = 3 GROUP BY ALL""",
)
def log_unreadable(spark, sf):
    skipped = logs.skipped_lines(logs.classify(_spelled_lines(spark, sf), _TIMER))
    return skipped.groupBy("file", "reason").agg(F.count("*").alias("lines"))


def _kind_summary(spark: SparkSession, sf: str, kind: str, line: str, values: dict[str, str],
                  shown: dict[str, str]) -> DataFrame:
    """Lines of a kind made from the events, parsed and summarised."""
    text_of = F.format_string(line, *[F.expr(e).cast("string") for e in values.values()])
    lines = read_table(spark, sf, "events").select(
        F.concat("event_type", F.lit(".log")).alias("file"), F.explode(F.array(text_of)).alias("value")
    )
    rows = logs.result_rows(logs.classify(lines, logs.KINDS[kind]))
    summary = logs.summarize_metrics(rows, logs.KINDS[kind])
    kept = summary.where(F.col("metric").isin(*shown))
    return rounded(kept, 6, *_SUMMARY_ROUNDED, "min", "max")


_ROUNDED_SUMMARY = f"""s AS (SELECT file, metric, {_SUMMARY.format(v='v')} FROM vals GROUP BY file, metric)
        SELECT * REPLACE (round(min, 6) AS min, round(max, 6) AS max) FROM s"""
_BARRIER_SQL = {
    "rps": "value", "cpu_first": "user_id % 4", "cpu_last": "7",
    "elapsed_signed_ms": "CASE WHEN event_id % 10 = 0 THEN -event_id - 1 ELSE event_id * 1000 END / 1e6::DOUBLE",
    "wait_mean_ns": "value / 2", "wait_p50_ns": "event_id % 100", "wait_p90_ns": "200",
    "wait_p99_ns": "300", "wait_max_ns": "event_id", "tail_zero": "event_id % 3",
    "tail_gt_10ms": "event_id % 5", "tail_gt_100ms": "NULL",
}


@query(
    "log_barrier",
    f"WITH vals AS ({_metric_rows_sql(_BARRIER_SQL)}), {_ROUNDED_SUMMARY}",
)
def log_barrier(spark, sf):
    line = (
        '{"bench": "smp_barrier", "cpu_first": %s, "cpu_last": 7, "elapsed_ns": %s, '
        '"rounds_per_sec": %s, "t0_wait_ns": {"mean": %s, "p50": %s, "p90": 200, "p99": 300, "max": %s}, '
        '"tail_counts": {"zero": %s, "gt_10ms": %s}}'
    )
    values = {
        "cpu": "user_id % 4",
        "elapsed": """if(event_id % 10 = 0, CAST(18446744073709551615 - event_id AS DECIMAL(20,0)),
                         CAST(event_id * 1000 AS DECIMAL(20,0)))""",
        "rps": "value", "mean": "value / 2", "p50": "event_id % 100", "max": "event_id",
        "zero": "event_id % 3", "gt": "event_id % 5",
    }
    return _kind_summary(spark, sf, "smp_barrier", line, values, _BARRIER_SQL)


_PINGPONG_SQL = {
    "lat_mean_ns": "value", "lat_p50_ns": "event_id % 50 + 0.5", "lat_p90_ns": "90",
    "lat_p99_ns": "event_id % 1000", "lat_min_ns": "1", "lat_max_ns": "event_id",
    "iters": "512", "tail_zero": "0", "tail_gt_10ms": "event_id % 3", "tail_gt_100ms": "event_id % 2",
    "tail_gt_1s": "NULL",
}


@query(
    "log_pingpong",
    f"WITH vals AS ({_metric_rows_sql(_PINGPONG_SQL)}), {_ROUNDED_SUMMARY}",
)
def log_pingpong(spark, sf):
    line = (
        '{"bench": "smp_pingpong", "cpu_a": 3, "cpu_b": 9, "iters": 512, "mode": "futex", '
        '"round_trip_ns": {"mean": %s, "p50": %s.5, "p90": 90, "p99": %s, "min": 1, "max": %s}, '
        '"tail_counts": {"zero": 0, "gt_10ms": %s, "gt_100ms": %s}}'
    )
    values = {
        "mean": "value", "p50": "event_id % 50", "p99": "event_id % 1000", "max": "event_id",
        "ten": "event_id % 3", "hundred": "event_id % 2",
    }
    return _kind_summary(spark, sf, "smp_pingpong", line, values, _PINGPONG_SQL)


_COMPUTE = logs.KINDS["simple_compute"]


def _compute_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A run of two workers per event, written and parsed as a log line."""
    text = F.format_string(
        '{"bench": "simple_compute", "threads": 2, "elapsed_window_ns": %s, "thread_results": ['
        '{"cpu": %s, "elapsed_ns": %s, "iterations_per_sec": %s, "clock_regression": %s}, '
        '{"cpu": 4, "elapsed_ns": 500, "iterations_per_sec": 25.0, "clock_regression": false}]}',
        *[F.expr(e).cast("string") for e in (
            "event_id % 1000 * 1000", "user_id % 4", "event_id % 1000", "value", "event_id % 3 = 0"
        )],
    )
    lines = read_table(spark, sf, "events").select(
        F.concat("event_type", F.lit(".log")).alias("file"), F.explode(F.array(text)).alias("value")
    )
    return logs.result_rows(logs.classify(lines, _COMPUTE))


_IN_ROW = {
    "elapsed_window_ms": "event_id % 1000 / 1000.0::DOUBLE",
    "threads": "2",
    "thread_elapsed_min_ns": "least(event_id % 1000, 500)",
    "thread_rate_mean": "(value + 25) / 2",
    "thread_rate_max": "greatest(value, 25.0)",
    "thread_rate_imbalance_pct": "abs(value - 25) / ((value + 25) / 2) * 100",
}


@query(
    "log_threads",
    f"""WITH vals AS ({_metric_rows_sql(_IN_ROW)}),
             s AS (SELECT file, metric, {_SUMMARY.format(v='v')} FROM vals GROUP BY file, metric)
        SELECT * REPLACE (round(min, 6) AS min, round(max, 6) AS max) FROM s""",
)
def log_threads(spark, sf):
    summary = logs.summarize_metrics(_compute_rows(spark, sf), _COMPUTE)
    kept = summary.where(F.col("metric").isin(*_IN_ROW))
    return rounded(kept, 6, *_SUMMARY_ROUNDED, "min", "max")


_CPU_VALUES = " UNION ALL ".join(
    f"""SELECT event_type || '.log' AS file, CAST({cpu} AS INTEGER) AS cpu, '{metric}' AS metric,
               CAST({value} AS DOUBLE) AS v FROM events"""
    for cpu, values in (
        ("user_id % 4", ("event_id % 1000", "value", "CAST(event_id % 3 = 0 AS INTEGER)")),
        ("4", ("500", "25", "0")),
    )
    for metric, value in zip(("elapsed_ns", "iterations_per_sec", "clock_regression"), values)
)


@query(
    "log_cpus",
    f"""WITH vals AS ({_CPU_VALUES})
        SELECT file, cpu, metric, {_SUMMARY.format(v='v')} FROM vals GROUP BY file, cpu, metric""",
)
def log_cpus(spark, sf):
    summary = logs.per_cpu_summary(_compute_rows(spark, sf))
    return rounded(summary, 6, *_SUMMARY_ROUNDED)


# --- text tables and sinks ---------------------------------------------------

_BALANCES = """c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total
               FROM customer GROUP BY c_nationkey"""


def _balances(rows: DataFrame, *by: str) -> DataFrame:
    totals = rows.groupBy(*by, "c_nationkey").agg(
        F.count("*").alias("n"), F.sum("c_acctbal").alias("total")
    )
    return rounded(totals, 2, "total")


def _accounts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS BIGINT) AS c_custkey", "CAST(c_nationkey AS INT) AS c_nationkey",
        "CAST(c_acctbal AS DOUBLE) AS c_acctbal",
    )


_ACCOUNT_DDL = "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE"


_BROKEN = """CASE WHEN c_custkey % 97 = 0 THEN 'a value of another type'
                       WHEN c_custkey % 89 = 0 THEN '2 of 3 fields'
                       WHEN c_custkey % 83 = 0 THEN '4 of 3 fields' END"""


@query(
    "bulk_load",
    f"""WITH l AS (SELECT *, {_BROKEN} AS reason FROM customer)
        SELECT 'loaded' AS kind, CAST(c_nationkey AS VARCHAR) AS what, count(*) AS n,
               round(sum(c_acctbal), 2) AS total FROM l WHERE reason IS NULL GROUP BY ALL
        UNION ALL SELECT 'rejected', reason, count(*), NULL FROM l WHERE reason IS NOT NULL GROUP BY ALL""",
)
def bulk_load(spark, sf):
    """Text with broken lines, loaded as a whole; the rows and what was kept apart."""
    folder, target = scratch_path(spark, "text"), scratch_path(spark, "loaded")
    parts = {"key": "c_custkey", "nation": "c_nationkey", "total": "c_acctbal"}
    text = {n: F.col(c).cast("string") for n, c in parts.items()}
    key = F.col("c_custkey")
    line = F.concat_ws("|", *text.values(), F.lit(""))
    broken = (
        F.when(key % 97 == 0, F.concat_ws("|", text["key"], F.lit("none"), text["total"], F.lit("")))
        .when(key % 89 == 0, F.concat_ws("|", text["key"], text["nation"], F.lit("")))
        .when(key % 83 == 0, F.concat(line, F.lit("more|")))
        .otherwise(line)
    )
    _accounts(spark, sf).select(broken.alias("value")).write.text(f"{folder}/account.tbl")
    delimited.bulk_load(spark, folder, target, {"account": _ACCOUNT_DDL}, most_rejected=None)
    loaded = delimited.loaded_table(spark, target, "account", _ACCOUNT_DDL).groupBy(
        F.lit("loaded").alias("kind"), F.col("c_nationkey").cast("string").alias("what")
    ).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"))
    rejected = delimited.rejected_lines(spark, target, "account").groupBy(
        F.lit("rejected").alias("kind"), F.col("reason").alias("what")
    ).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("total"))
    return rounded(loaded, 2, "total").unionByName(rejected)


@query(
    "web_sales_scan",
    """SELECT CAST(l_partkey AS INTEGER) AS ws_item_sk, CAST(l_orderkey AS INTEGER) AS ws_order_number,
              n_name AS w_warehouse_name
       FROM lineitem JOIN nation ON l_suppkey % 30 = n_nationkey
       WHERE l_linenumber % 5 <> 0 ORDER BY ws_item_sk, ws_order_number, w_warehouse_name LIMIT 100""",
)
def web_sales_scan(spark, sf):
    """Sales and warehouses as text under their declared schemas, joined."""
    folder = scratch_path(spark, "web")
    sold = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_orderkey"))
    values = {
        "web_sales": ("lineitem", {
            "ws_sold_date_sk": sold, "ws_item_sk": F.col("l_partkey"),
            "ws_order_number": F.col("l_orderkey"), "ws_warehouse_sk": F.col("l_suppkey") % 30,
        }),
        "warehouse": ("nation", {
            "w_warehouse_sk": F.col("n_nationkey"), "w_warehouse_name": F.col("n_name"),
        }),
    }
    read = {}
    for name, (source, known) in values.items():
        ddl = schemas.TPCDS[name]
        columns = [
            known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.schema(ddl)
        ]
        delimited.write_delimited(read_table(spark, sf, source).select(*columns), f"{folder}/{name}")
        read[name] = delimited.read_delimited(spark, f"{folder}/{name}", ddl)
    return reports.fact_lookup(
        read["web_sales"], read["warehouse"], ("ws_warehouse_sk", "w_warehouse_sk"),
        ["ws_item_sk", "ws_order_number", "w_warehouse_name"], "ws_sold_date_sk",
    )


@query(
    "view_sql",
    "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL",
)
def view_sql(spark, sf):
    """A table registered as a view, asked in SQL."""
    name = f"accounts_{uuid.uuid4().hex}"
    register({name: read_table(spark, sf, "customer")})
    totals = spark.sql(
        f"SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS total FROM `{name}` GROUP BY c_mktsegment"
    )
    return rounded(totals, 2, "total")


_ASKED_TABLES = (*DRIVER_TABLES, "partsupp", "line")


@query(
    "required_tables",
    "SELECT * FROM (VALUES " + ", ".join(
        f"('{name}', {str(name in DRIVER_TABLES).lower()})" for name in _ASKED_TABLES
    ) + ") v(table_name, present)",
)
def required_tables(spark, sf):
    return present(spark, sf, _ASKED_TABLES)


@query("discard_rows", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def discard_rows(spark, sf):
    """All rows run into the sink that keeps nothing; their counts come from the same plan."""
    rows = pipelines.identity(read_table(spark, sf, "events"))
    sinks.discard(rows)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "preview_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def preview_rows(spark, sf):
    """What a user would see first, never more than asked for."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    rows = sinks.preview(orders.orderBy(F.desc("o_totalprice"), "o_orderkey"), 25)
    return spark.createDataFrame(rows, orders.schema)


_PHASES = ("clean.nosync", "clean.sync", "perturbed.nosync", "perturbed.sync")


@query(
    "result_files",
    f"""WITH r AS (SELECT user_id % 4 AS n, event_type, event_id FROM events)
        SELECT replace(phase, '.', '_') AS phase,
               CASE WHEN phase LIKE '%.sync' THEN 'sync' ELSE 'disabled' END AS mode,
               phase LIKE 'perturbed%' AS perturbed, '2026-06-0' || (n + 1) || ' 03:25:48' AS started,
               count(DISTINCT event_type) AS entities, count(*) AS samples,
               CAST(sum(event_id) AS BIGINT) AS ticks
        FROM r JOIN (VALUES {', '.join(f"({n}, '{p}')" for n, p in enumerate(_PHASES))}) p(n, phase) USING (n)
        GROUP BY ALL""",
)
def result_files(spark, sf):
    """Result documents, one per run and entity, in folders named by phase and time."""
    samples = results.read_samples(spark, _result_folder(spark, sf), "part-*")
    phase = F.col("phase")
    return samples.groupBy(
        text.phase_label(phase).alias("phase"), text.is_synced(phase).alias("mode"),
        text.is_perturbed(phase).alias("perturbed"),
        F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"),
    ).agg(
        F.count_distinct("entity").alias("entities"), F.count("*").alias("samples"),
        F.sum("ticks").alias("ticks"),
    )


def _result_folder(spark, sf):
    folder = scratch_path(spark, "results")
    sample = F.struct(epoch_micros(F.col("ts")).alias("mono_ns"), F.col("event_id").alias("ticks"))
    docs = read_table(spark, sf, "events").groupBy(
        (F.col("user_id") % 4).alias("run"), "event_type"
    ).agg(
        F.min(sample["mono_ns"]).alias("mono_start"),
        F.sort_array(F.collect_list(sample)).alias("samples"),
        F.max(sample["mono_ns"]).alias("mono_end"),
    )
    docs = snapshot(docs, "documents")
    for n, phase in enumerate(_PHASES):
        one = docs.where(F.col("run") == n).drop("run", "event_type")
        one.write.option("maxRecordsPerFile", 1).json(f"{folder}/{phase}_2026-06-0{n + 1}_03-25-48")
    return folder


@query(
    "result_documents",
    f"""SELECT replace(p.phase, '.', '_') AS phase, epoch_us(min(ts)) AS mono_start,
               epoch_us(max(ts)) AS mono_end, count(*) AS samples, true AS closed
        FROM (SELECT *, user_id % 4 AS n FROM events) e
        JOIN (VALUES {', '.join(f"({n}, '{p}')" for n, p in enumerate(_PHASES))}) p(n, phase) USING (n)
        GROUP BY p.phase, event_type""",
)
def result_documents(spark, sf):
    """Time brackets and completeness of each result document."""
    found = results.read_documents(spark, _result_folder(spark, sf), "part-*")
    return found.select(
        text.phase_label(F.col("phase")).alias("phase"), "mono_start", "mono_end", "samples", "closed"
    )


@query(
    "external_scan",
    f"""SELECT true AS listed, CAST(c_nationkey AS INTEGER) AS {_BALANCES}""",
)
def external_scan(spark, sf):
    """Text declared as an external table, listed, scanned and dropped again."""
    folder, name = scratch_path(spark, "accounts"), f"accounts_{uuid.uuid4().hex}"
    delimited.write_delimited(_accounts(spark, sf), folder)
    delimited.declare_external(spark, name, _ACCOUNT_DDL, folder)
    listed = name in list_tables(spark)
    totals = snapshot(_balances(spark.table(name)), "balances")
    delimited.drop_tables(spark, [name])
    return totals.select(F.lit(listed).alias("listed"), "*")


@query(
    "sink_round_trip",
    " UNION ALL ".join(
        f"SELECT '{sink}' AS sink, CAST(c_nationkey AS INTEGER) AS {_BALANCES}"
        for sink in ("csv", "json", "insert")
    ),
)
def sink_round_trip(spark, sf):
    """The same rows through the CSV, JSON and table sinks, read back."""
    rows, name = _accounts(spark, sf), f"sink_{uuid.uuid4().hex}"
    csv, json, stored = (scratch_path(spark, f"sink-{s}") for s in ("csv", "json", "table"))
    sinks.write_csv(rows, csv)
    sinks.write_json(rows, json)
    spark.sql(f"CREATE TABLE `{name}` ({_ACCOUNT_DDL}) USING parquet LOCATION '{stored}'")
    sinks.insert_into(rows, name)
    delimited.drop_tables(spark, [name])
    back = spark.read.schema(_ACCOUNT_DDL)
    parts = [
        part.withColumn("sink", F.lit(sink))
        for sink, part in (("csv", back.csv(csv)), ("json", back.json(json)), ("insert", back.parquet(stored)))
    ]
    return _balances(parts[0].unionByName(parts[1]).unionByName(parts[2]), "sink")
