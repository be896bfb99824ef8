"""Joins that hold for any size of the looked-up side and any hot key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
SALTS = 64
# A key is hot when it holds at least this share of the rows, so that there can
# never be more than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 256

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_SALTED = ("inner", "left", "left_semi", "left_anti")


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a side: few enough rows, and few enough bytes in them."""
    if max_rows <= 0 or df.count() > max_rows:
        return False
    fixed = 8 * len(df.columns)
    texts = [f.name for f in df.schema if not isinstance(f.dataType, _FIXED_WIDTH)]
    if not texts:
        return True
    width = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in texts],
    )
    size = df.agg(F.coalesce(F.sum(width + fixed), F.lit(0))).first()[0]
    return size <= max_bytes


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys holding at least ``share`` of the rows, from a bounded sketch.

    Sketches are merged in two steps on the executors; what reaches the driver
    is bounded by ``2 / share`` items. A key missed or reported wrongly only
    changes how rows are spread, never the result.
    """
    items = int(2 / share)
    parts = df.select(key, F.pmod(F.spark_partition_id(), F.lit(256)).alias("_part"))
    sketches = parts.groupBy("_part").agg(
        F.count("*").alias("_n"),
        F.expr(f"approx_top_k_accumulate(`{key}`, {items * 8})").alias("_sketch"),
    )
    # Grouped by a constant, as combining fails on a task that got no sketch.
    row = sketches.groupBy(F.pmod("_part", F.lit(1))).agg(
        F.sum("_n").alias("n"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(_sketch, {items * 8}), {items})").alias(
            "top"
        ),
    ).first()
    return [
        item["item"]
        for item in (row["top"] if row else [])
        if item["item"] is not None and item["count"] >= row["n"] * share
    ]


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | tuple[str, str],
    how: str = "inner",
    *,
    even: bool = False,
    spread_by: str = "content",
    broadcast_rows: int = BROADCAST_ROWS,
    hot: Sequence | None = None,
) -> DataFrame:
    """Join many rows on the left with their key's rows on the right.

    A right side measured to be small is broadcast. Otherwise both sides are
    shuffled; keys that hold a large share of the left are spread over
    ``SALTS`` sub-keys, the few right rows of those keys being repeated. Pass
    ``even`` when no key can hold many left rows, as after counting up by it;
    the search for hot keys, a pass over the left's keys, is then left out.

    ``spread_by="content"`` picks the sub-key from the whole left row, so full
    copies of one row should be counted up beforehand; ``"row"`` uses the row
    position and is for frames that come straight from a scan.
    """
    if how not in _SALTED:
        raise ValueError(f"lookup_join does not support {how}")
    left_key, right_key = (on, on) if isinstance(on, str) else on

    if fits_broadcast(right, broadcast_rows):
        return _joined(left, F.broadcast(right), [(left_key, right_key)], how)
    if even:
        return _joined(left, right.hint("merge"), [(left_key, right_key)], how)
    if hot is None:
        hot = hot_keys(left, left_key)

    place = (
        F.monotonically_increasing_id() if spread_by == "row" else F.xxhash64(*left.columns)
    )
    is_hot = F.col(left_key).isNull()
    copies = F.array(F.lit(0))
    if hot:
        is_hot = is_hot | F.col(left_key).isin(list(hot))
        copies = F.when(
            F.col(right_key).isin(list(hot)), F.sequence(F.lit(0), F.lit(SALTS - 1))
        ).otherwise(copies)
    salted_left = left.withColumn(
        "_salt", F.when(is_hot, F.pmod(place, F.lit(SALTS)).cast("int")).otherwise(0)
    )
    salted_right = right.withColumn("_copy", F.explode(copies))
    # Without the hint Spark may broadcast a side that was measured to be too large.
    joined = _joined(
        salted_left, salted_right.hint("merge"), [(left_key, right_key), ("_salt", "_copy")], how
    )
    return joined.drop("_salt", "_copy")


def _joined(
    left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str
) -> DataFrame:
    """Equi-join keeping one column where both sides name the key alike."""
    renamed = right
    pairs = []
    for left_key, right_key in keys:
        if left_key == right_key:
            right_key = f"_right_{left_key}"
            renamed = renamed.withColumnRenamed(left_key, right_key)
        pairs.append((left_key, right_key))
    condition = [F.col(a) == F.col(b) for a, b in pairs]
    joined = left.join(renamed, condition, how)
    return joined.drop(*[b for _, b in pairs if b.startswith("_right_")])


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on keys where NULL is a group of its own, as GROUP BY has it."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_right_{key}")
    condition: list[Column] = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
