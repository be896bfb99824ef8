"""Decision-support reports over star-schema tables.

Column names are parameters where the tables at hand may name them otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions.dates import until_days_before, within_month_seq, within_months
from loadlens.operators.joins import BROADCAST_ROWS, fits_broadcast, lookup_join

MONEY = "decimal(15,2)"


def pricing_summary(lineitem: DataFrame, date: str = "1998-12-01", days: int = 90) -> DataFrame:
    """Totals and averages per return flag and line status up to a date."""
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    net = price * (1 - discount)
    return (
        lineitem.where(until_days_before(F.col("l_shipdate"), date, days))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.sum(price).alias("sum_base_price"),
            F.sum(net).alias("sum_disc_price"),
            F.sum(net * (1 + F.col("l_tax"))).alias("sum_charge"),
            F.avg("l_quantity").alias("avg_qty"),
            F.avg(price).alias("avg_price"),
            F.avg(discount).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def forecast_revenue(
    lineitem: DataFrame,
    start: str = "1994-01-01",
    discount: str = "0.06",
    quantity: int = 24,
) -> DataFrame:
    """Revenue a year's small discounted orders would have added.

    The discount bounds are decimal literals: as floats they would lose an edge.
    """
    wanted = F.expr(f"l_discount BETWEEN {discount} - 0.01 AND {discount} + 0.01")
    return lineitem.where(
        within_months(F.col("l_shipdate"), start, 12) & wanted & (F.col("l_quantity") < quantity)
    ).agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))


def promo_effect(
    lineitem: DataFrame,
    part: DataFrame,
    start: str = "1995-09-01",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Share of a month's revenue that promoted parts brought.

    Revenue is added up per part before the join, so a part with very many
    lines is one row by then.
    """
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sold = (
        lineitem.where(within_months(F.col("l_shipdate"), start, 1))
        .groupBy("l_partkey")
        .agg(F.sum(net).alias("net"))
    )
    promoted = part.select("p_partkey", F.col("p_type").startswith("PROMO").alias("is_promo"))
    both = lookup_join(
        sold, promoted, ("l_partkey", "p_partkey"),
        even=True, broadcast_rows=broadcast_rows,
    )
    promo = F.sum(F.when(F.col("is_promo"), F.col("net")).otherwise(0))
    return both.agg(
        (100 * promo / F.nullif(F.sum("net"), F.lit(0))).alias("promo_revenue")
    )


# Upper day limits and names of the delay classes.
DELAY_CLASSES = (
    ("days_30", None, 30),
    ("days_31_60", 30, 60),
    ("days_61_90", 60, 90),
    ("days_91_120", 90, 120),
    ("days_over_120", 120, None),
)


def delay_counts(delay: Column, weight: Column | None = None) -> list[Column]:
    """Rows per delay class; a NULL delay counts in none."""
    weight = F.lit(1) if weight is None else weight
    counts = []
    for name, above, upto in DELAY_CLASSES:
        inside = F.lit(True)
        if above is not None:
            inside = inside & (delay > above)
        if upto is not None:
            inside = inside & (delay <= upto)
        counts.append(F.sum(F.when(inside, weight).otherwise(F.lit(0))).alias(name))
    return counts


def delay_totals() -> list[Column]:
    return [F.sum(name).alias(name) for name, _, _ in DELAY_CLASSES]


def late_shipments(
    sales: DataFrame,
    warehouse: DataFrame,
    ship_mode: DataFrame,
    call_center: DataFrame,
    date_dim: DataFrame,
    month_seq: int = 1200,
    months: int = 12,
    rows: int = 100,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Shipments per delay class, warehouse, ship mode and call centre.

    Sales are counted up by dimension keys before the names are looked up. If the days asked
    for are few, sales of other days are dropped before that. Else sales are first counted up
    by day and dimension keys, so that equal sales of one day are one row when the day is
    looked up.
    """
    shipped = date_dim.where(
        F.col("d_month_seq").between(month_seq, month_seq + months - 1)
    ).select("d_date_sk")
    places = ["cs_warehouse_sk", "cs_ship_mode_sk", "cs_call_center_sk"]
    delay = F.col("cs_ship_date_sk") - F.col("cs_sold_date_sk")
    if fits_broadcast(shipped, broadcast_rows):
        dated = sales.join(F.broadcast(shipped), F.col("cs_ship_date_sk") == F.col("d_date_sk"))
        by_key = dated.groupBy(*places).agg(*delay_counts(delay))
    else:
        by_day = sales.groupBy("cs_ship_date_sk", *places).agg(*delay_counts(delay))
        by_key = (
            lookup_join(by_day, shipped, ("cs_ship_date_sk", "d_date_sk"), broadcast_rows=0)
            .groupBy(*places)
            .agg(*delay_totals())
        )
    named = by_key
    for keys, dim in (
        (("cs_warehouse_sk", "w_warehouse_sk"), warehouse.select("w_warehouse_sk", "w_warehouse_name")),
        (("cs_ship_mode_sk", "sm_ship_mode_sk"), ship_mode.select("sm_ship_mode_sk", "sm_type")),
        (("cs_call_center_sk", "cc_call_center_sk"), call_center.select("cc_call_center_sk", "cc_name")),
    ):
        named = lookup_join(named, dim, keys)
    return _ranked_delays(
        named, F.substring("w_warehouse_name", 1, 20), F.col("sm_type"), F.col("cc_name"), rows
    )


def _ranked_delays(
    named: DataFrame, warehouse: Column, ship_mode: Column, call_center: Column, rows: int
) -> DataFrame:
    order = ["warehouse_name", "ship_mode", "call_center"]
    return (
        named.groupBy(
            warehouse.alias("warehouse_name"),
            ship_mode.alias("ship_mode"),
            call_center.alias("call_center"),
        )
        .agg(*delay_totals())
        .orderBy(*order)
        .limit(rows)
    )


def late_orders(
    lineitem: DataFrame,
    orders: DataFrame,
    supplier: DataFrame,
    nation: DataFrame,
    month_seq: int = 1200,
    months: int = 12,
    rows: int = 100,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """:func:`late_shipments` on order tables.

    ``lineitem`` comes straight from a scan. Supplier, order priority and nation stand for warehouse, ship mode and call
    centre; the delay is from order to shipping.
    """
    shipped = lineitem.where(
        within_month_seq(F.col("l_shipdate"), month_seq, months)
    ).select("l_orderkey", "l_suppkey", "l_shipdate")
    ordered = orders.select("o_orderkey", "o_orderdate", "o_orderpriority")
    both = lookup_join(
        shipped, ordered, ("l_orderkey", "o_orderkey"),
        spread_by="row", broadcast_rows=broadcast_rows,
    )
    by_key = both.groupBy("l_suppkey", "o_orderpriority").agg(
        *delay_counts(F.datediff("l_shipdate", "o_orderdate"))
    )
    named = lookup_join(
        by_key, supplier.select("s_suppkey", "s_name", "s_nationkey"), ("l_suppkey", "s_suppkey"),
        even=True, broadcast_rows=broadcast_rows,
    )
    # Nations are few by nature, suppliers of one nation may be many: counted up
    # before this join.
    by_nation = named.groupBy(
        F.substring("s_name", 1, 20).alias("_name"), "o_orderpriority", "s_nationkey"
    ).agg(*delay_totals())
    placed = lookup_join(
        by_nation, nation.select("n_nationkey", "n_name"), ("s_nationkey", "n_nationkey")
    )
    return _ranked_delays(
        placed, F.col("_name"), F.col("o_orderpriority"), F.col("n_name"), rows
    )


def fact_lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: tuple[str, str],
    shown: Sequence[str],
    not_null: str,
    rows: int = 100,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The first fact rows, in order of all shown columns, with a looked-up name.

    ``facts`` comes straight from a scan.
    """
    kept = facts.where(F.col(not_null).isNotNull())
    both = lookup_join(kept, dim, on, spread_by="row", broadcast_rows=broadcast_rows)
    return both.select(*shown).orderBy(*shown).limit(rows)
