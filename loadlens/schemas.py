"""Declared schemas of everything the library reads."""

from __future__ import annotations

from pyspark.sql.types import StructType

# TPC-DS column names and types, in file order.
TPCDS = {
    "catalog_sales": """
        cs_sold_date_sk INT, cs_sold_time_sk INT, cs_ship_date_sk INT,
        cs_bill_customer_sk INT, cs_bill_cdemo_sk INT, cs_bill_hdemo_sk INT,
        cs_bill_addr_sk INT, cs_ship_customer_sk INT, cs_ship_cdemo_sk INT,
        cs_ship_hdemo_sk INT, cs_ship_addr_sk INT, cs_call_center_sk INT,
        cs_catalog_page_sk INT, cs_ship_mode_sk INT, cs_warehouse_sk INT,
        cs_item_sk INT, cs_promo_sk INT, cs_order_number INT, cs_quantity INT,
        cs_wholesale_cost DECIMAL(7,2), cs_list_price DECIMAL(7,2),
        cs_sales_price DECIMAL(7,2), cs_ext_discount_amt DECIMAL(7,2),
        cs_ext_sales_price DECIMAL(7,2), cs_ext_wholesale_cost DECIMAL(7,2),
        cs_ext_list_price DECIMAL(7,2), cs_ext_tax DECIMAL(7,2),
        cs_coupon_amt DECIMAL(7,2), cs_ext_ship_cost DECIMAL(7,2),
        cs_net_paid DECIMAL(7,2), cs_net_paid_inc_tax DECIMAL(7,2),
        cs_net_paid_inc_ship DECIMAL(7,2), cs_net_paid_inc_ship_tax DECIMAL(7,2),
        cs_net_profit DECIMAL(7,2)""",
    "warehouse": """
        w_warehouse_sk INT, w_warehouse_id STRING, w_warehouse_name STRING,
        w_warehouse_sq_ft INT, w_street_number STRING, w_street_name STRING,
        w_street_type STRING, w_suite_number STRING, w_city STRING,
        w_county STRING, w_state STRING, w_zip STRING, w_country STRING,
        w_gmt_offset DECIMAL(5,2)""",
    "ship_mode": """
        sm_ship_mode_sk INT, sm_ship_mode_id STRING, sm_type STRING,
        sm_code STRING, sm_carrier STRING, sm_contract STRING""",
    "call_center": """
        cc_call_center_sk INT, cc_call_center_id STRING, cc_rec_start_date DATE,
        cc_rec_end_date DATE, cc_closed_date_sk INT, cc_open_date_sk INT,
        cc_name STRING, cc_class STRING, cc_employees INT, cc_sq_ft INT,
        cc_hours STRING, cc_manager STRING, cc_mkt_id INT, cc_mkt_class STRING,
        cc_mkt_desc STRING, cc_market_manager STRING, cc_division INT,
        cc_division_name STRING, cc_company INT, cc_company_name STRING,
        cc_street_number STRING, cc_street_name STRING, cc_street_type STRING,
        cc_suite_number STRING, cc_city STRING, cc_county STRING, cc_state STRING,
        cc_zip STRING, cc_country STRING, cc_gmt_offset DECIMAL(5,2),
        cc_tax_percentage DECIMAL(5,2)""",
    "date_dim": """
        d_date_sk INT, d_date_id STRING, d_date DATE, d_month_seq INT,
        d_week_seq INT, d_quarter_seq INT, d_year INT, d_dow INT, d_moy INT,
        d_dom INT, d_qoy INT, d_fy_year INT, d_fy_quarter_seq INT,
        d_fy_week_seq INT, d_day_name STRING, d_quarter_name STRING,
        d_holiday STRING, d_weekend STRING, d_following_holiday STRING,
        d_first_dom INT, d_last_dom INT, d_same_day_ly INT, d_same_day_lq INT,
        d_current_day STRING, d_current_week STRING, d_current_month STRING,
        d_current_quarter STRING, d_current_year STRING""",
    "web_sales": """
        ws_sold_date_sk INT, ws_sold_time_sk INT, ws_ship_date_sk INT,
        ws_item_sk INT, ws_bill_customer_sk INT, ws_bill_cdemo_sk INT,
        ws_bill_hdemo_sk INT, ws_bill_addr_sk INT, ws_ship_customer_sk INT,
        ws_ship_cdemo_sk INT, ws_ship_hdemo_sk INT, ws_ship_addr_sk INT,
        ws_web_page_sk INT, ws_web_site_sk INT, ws_ship_mode_sk INT,
        ws_warehouse_sk INT, ws_promo_sk INT, ws_order_number INT,
        ws_quantity INT, ws_wholesale_cost DECIMAL(7,2),
        ws_list_price DECIMAL(7,2), ws_sales_price DECIMAL(7,2),
        ws_ext_discount_amt DECIMAL(7,2), ws_ext_sales_price DECIMAL(7,2),
        ws_ext_wholesale_cost DECIMAL(7,2), ws_ext_list_price DECIMAL(7,2),
        ws_ext_tax DECIMAL(7,2), ws_coupon_amt DECIMAL(7,2),
        ws_ext_ship_cost DECIMAL(7,2), ws_net_paid DECIMAL(7,2),
        ws_net_paid_inc_tax DECIMAL(7,2), ws_net_paid_inc_ship DECIMAL(7,2),
        ws_net_paid_inc_ship_tax DECIMAL(7,2), ws_net_profit DECIMAL(7,2)""",
}

# TPC-H column names and types, in file order. Text lengths are
# not enforced by Spark, so CHAR and VARCHAR are plain strings here.
TPCH = {
    "nation": """
        n_nationkey INT NOT NULL, n_name STRING NOT NULL,
        n_regionkey INT NOT NULL, n_comment STRING""",
    "region": "r_regionkey INT NOT NULL, r_name STRING NOT NULL, r_comment STRING",
    "part": """
        p_partkey INT NOT NULL, p_name STRING NOT NULL, p_mfgr STRING NOT NULL,
        p_brand STRING NOT NULL, p_type STRING NOT NULL, p_size INT NOT NULL,
        p_container STRING NOT NULL, p_retailprice DECIMAL(15,2) NOT NULL,
        p_comment STRING NOT NULL""",
    "supplier": """
        s_suppkey INT NOT NULL, s_name STRING NOT NULL, s_address STRING NOT NULL,
        s_nationkey INT NOT NULL, s_phone STRING NOT NULL,
        s_acctbal DECIMAL(15,2) NOT NULL, s_comment STRING NOT NULL""",
    "partsupp": """
        ps_partkey INT NOT NULL, ps_suppkey INT NOT NULL,
        ps_availqty INT NOT NULL, ps_supplycost DECIMAL(15,2) NOT NULL,
        ps_comment STRING NOT NULL""",
    "customer": """
        c_custkey INT NOT NULL, c_name STRING NOT NULL, c_address STRING NOT NULL,
        c_nationkey INT NOT NULL, c_phone STRING NOT NULL,
        c_acctbal DECIMAL(15,2) NOT NULL, c_mktsegment STRING NOT NULL,
        c_comment STRING NOT NULL""",
    "orders": """
        o_orderkey INT NOT NULL, o_custkey INT NOT NULL,
        o_orderstatus STRING NOT NULL, o_totalprice DECIMAL(15,2) NOT NULL,
        o_orderdate DATE NOT NULL, o_orderpriority STRING NOT NULL,
        o_clerk STRING NOT NULL, o_shippriority INT NOT NULL,
        o_comment STRING NOT NULL""",
    "lineitem": """
        l_orderkey INT NOT NULL, l_partkey INT NOT NULL, l_suppkey INT NOT NULL,
        l_linenumber INT NOT NULL, l_quantity DECIMAL(15,2) NOT NULL,
        l_extendedprice DECIMAL(15,2) NOT NULL, l_discount DECIMAL(15,2) NOT NULL,
        l_tax DECIMAL(15,2) NOT NULL, l_returnflag STRING NOT NULL,
        l_linestatus STRING NOT NULL, l_shipdate DATE NOT NULL,
        l_commitdate DATE NOT NULL, l_receiptdate DATE NOT NULL,
        l_shipinstruct STRING NOT NULL, l_shipmode STRING NOT NULL,
        l_comment STRING NOT NULL""",
}

TPCH_KEYS = {
    "nation": ["n_nationkey"],
    "region": ["r_regionkey"],
    "part": ["p_partkey"],
    "supplier": ["s_suppkey"],
    "partsupp": ["ps_partkey", "ps_suppkey"],
    "customer": ["c_custkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
}

# Field names of the benchmark result rows. Measurements may be spelled as
# integers or floats; counters that can wrap are unsigned 64-bit, hence DECIMAL(20,0).
LATENCY_STATS = (
    "STRUCT<n DOUBLE, min DOUBLE, mean DOUBLE, p50 DOUBLE, p90 DOUBLE, p99 DOUBLE, max DOUBLE>"
)
TAIL_COUNTS = (
    "STRUCT<zero DOUBLE, gt_10us DOUBLE, gt_1ms DOUBLE, gt_10ms DOUBLE, "
    "gt_100ms DOUBLE, gt_1s DOUBLE>"
)
LOGS = {
    "timer_jitter": f"""
        bench STRING, clock STRING, cpu DOUBLE, period_us DOUBLE,
        warmup_iters DOUBLE, wake_latency_ns {LATENCY_STATS},
        tail_counts {TAIL_COUNTS}""",
    "smp_barrier": f"""
        bench STRING, threads DOUBLE, iters DOUBLE, work_cycles DOUBLE, mode STRING,
        clock STRING, cpu_first DOUBLE, cpu_last DOUBLE, elapsed_ns DECIMAL(20,0),
        rounds_per_sec DOUBLE, t0_wait_ns {LATENCY_STATS},
        tail_counts {TAIL_COUNTS}""",
    "smp_pingpong": f"""
        bench STRING, cpu_a INT, cpu_b INT, iters DOUBLE, mode STRING,
        clock STRING, round_trip_ns {LATENCY_STATS}, tail_counts {TAIL_COUNTS}""",
    "simple_compute": """
        bench STRING, clock STRING, compute_kernel STRING, threads DOUBLE,
        cpu_first DOUBLE, cpu_last DOUBLE, iterations_per_thread DOUBLE,
        total_iterations DOUBLE, elapsed_window_ns DECIMAL(20,0),
        aggregate_iterations_per_sec DOUBLE, start_skew_ns DECIMAL(20,0),
        finish_skew_ns DECIMAL(20,0), clock_regressions DOUBLE,
        thread_results ARRAY<STRUCT<cpu INT, start_ns DECIMAL(20,0),
            end_ns DECIMAL(20,0), elapsed_ns DECIMAL(20,0),
            iterations_per_sec DOUBLE, checksum DECIMAL(20,0),
            clock_regression BOOLEAN>>""",
}

PROGRESS = """
    metadata STRUCT<label STRING, exp_label STRING, vm_label STRING>,
    mono_start BIGINT, mono_end BIGINT, started_at STRING, finished_at STRING,
    samples ARRAY<STRUCT<mono_ns BIGINT, ticks BIGINT>>"""
BRACKET = "host_start_ns BIGINT, host_end_ns BIGINT"


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(" ".join(ddl.split()))


def columns(ddl: str) -> list[str]:
    return schema(ddl).fieldNames()


def column_ddl(ddl: str) -> str:
    """The schema as one column list for CREATE TABLE."""
    return ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in schema(ddl))
