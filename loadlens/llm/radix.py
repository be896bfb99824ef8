"""Exact duplicates by distributed MSD radix partitioning.

A text is read as a string that begins with its length in bytes, ``12:some
content``. Rows are split by successive digits of it, each a run of whole UTF-8
characters: first the length with the first ``HEAD`` characters, then runs that grow
``GROWTH`` times a round, up to ``WIDEST``. A group is split by counting (group,
digit), a partial aggregate, and looking the counts up; each part that has more than
one row gets a number of its own. Bytes are compared as such, no digest decides
anything. A row leaves as soon as its part holds it alone, a part as soon as its texts
end, which they do together as they are equally long. Only rows that still share all
digits with another row are stored and shuffled again, so a round costs what the
copies weigh, and there are about log(longest copy) rounds.

A part of any size is only counted and looked up, never gathered: looked-up splits
are broadcast if measured small, otherwise both sides are shuffled and the at most
``1 / HOT_SHARE`` largest parts are spread over ``SALTS`` tasks.

Equal means: identical after lower-casing A-Z and nothing else; a null text is an
empty one, and empty texts are copies of each other. Of equal texts the row with the
largest id stays, a null id being the smallest; of rows that share that id, too, one
stays (the last as they were stored). Every row counts, full copies too. An empty
table gives an empty result. Other columns are ignored, whatever their names. The
documents are read twice; pass a stored frame if they are costly to make.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.operators.joins import BROADCAST_ROWS, fits_broadcast, lookup_join
from loadlens.session import snapshot

HEAD = 32
GROWTH = 16
WIDEST = 1 << 20
SALTS = 64
HOT_SHARE = 1 / 256
# Shared rows, and their bytes, that a task of a round takes at least.
TASK_ROWS = 4096
TASK_BYTES = 32 << 20
# How much of a digit tells a hot part from others; more parts may be spread, none is missed.
LEAD = 64
_ALL = (1 << 31) - 1


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case; null is empty."""
    return F.translate(
        F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase
    )


def _first_splits(docs: DataFrame, text: str, head: int) -> DataFrame:
    """(_head, _n, _next) of every length and beginning that several texts share."""
    plain = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(_head(plain, normalised(F.substring(plain, 1, head))).alias("_head"))
    return snapshot(
        counted.groupBy("_head").agg(F.count("*").alias("_n")).where("_n > 1")
        .withColumn("_next", F.monotonically_increasing_id()),
        "radix-heads",
    )


def _head(whole: Column, beginning: Column) -> Column:
    return F.concat_ws(":", F.octet_length(whole).cast("string"), beginning)


def _hot_limit(splits: DataFrame) -> float:
    total = splits.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return max(2.0, total * HOT_SHARE)


def _split(open_rows: DataFrame, width: int, tasks: int) -> DataFrame:
    """(_group, _digit, _n, _best, _next) of the parts that hold more than one row."""
    parts = open_rows.groupBy("_group", F.substring("_rest", 1, width).alias("_digit")).agg(
        F.count("*").alias("_n"), F.max(F.struct("_id", "_rid")).alias("_best")
    )
    shared = parts.where("_n > 1").coalesce(tasks)
    return snapshot(shared.withColumn("_next", F.monotonically_increasing_id()), "radix-splits")


def _look_up(rows: DataFrame, splits: DataFrame, broadcast_rows: int) -> DataFrame:
    """Every open row with the part that it falls into; NULLs if it is alone there."""
    found = splits.withColumnsRenamed({"_group": "_g", "_digit": "_d"})
    match = (F.col("_group") == F.col("_g")) & (F.col("_digit") == F.col("_d"))
    if fits_broadcast(found, broadcast_rows):
        return rows.join(F.broadcast(found), match, "left")

    def lead(group: str, digit: str) -> Column:
        return F.concat_ws(":", F.col(group).cast("string"), F.substring(digit, 1, LEAD))

    # No more than 1 / HOT_SHARE parts can be this large.
    large = found.where(F.col("_n") >= _hot_limit(splits))
    hot = [r[0] for r in large.select(lead("_g", "_d")).distinct().collect()]
    copies = F.when(
        lead("_g", "_d").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))
    ).otherwise(F.array(F.lit(0)))
    salt = F.when(lead("_group", "_digit").isin(hot), F.pmod("_rid", F.lit(SALTS)).cast("int"))
    salted = rows.withColumn("_salt", F.coalesce(salt, F.lit(0)))
    return salted.join(
        found.withColumn("_copy", F.explode(copies)).hint("merge"),
        match & (F.col("_salt") == F.col("_copy")), "left",
    )


def exact_groups(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    carry: Mapping[str, Callable[[Column], Column]] | None = None,
    head: int = HEAD,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(id, keep_id, group_size, kept, ...) of every row, dropped ones too.

    ``carry`` adds columns, each made from the normalised text or, as the function may
    ignore that, from columns of ``docs``.
    """
    carry = dict(carry or {})
    own = [F.struct(*[make(normalised(F.col(text))).alias(n) for n, make in carry.items()])
           if carry else F.lit(None).cast("int")]
    splits = _first_splits(docs, text, head)
    hot = [r[0] for r in splits.where(F.col("_n") >= _hot_limit(splits)).select("_head").collect()]
    norm = normalised(F.col(text))
    rows = docs.select(
        F.col(ident).cast("bigint").alias("_id"), own[0].alias("_own"), norm.alias("_text"),
        _head(norm, F.substring(norm, 1, head)).alias("_head"),
    )
    met = lookup_join(
        rows, splits, "_head", "left", spread_by="row", broadcast_rows=broadcast_rows, hot=hot
    )
    shared = F.col("_next").isNotNull()
    state = snapshot(met.select(
        F.monotonically_increasing_id().alias("_rid"), "_id", "_own",
        F.col("_next").alias("_group"), F.lit(None).cast("bigint").alias("_n"),
        F.lit(None).cast("bigint").alias("_keep_id"), F.lit(None).cast("bigint").alias("_keep_rid"),
        shared.alias("_open"), F.when(shared, F.substring("_text", head + 1, _ALL)).alias("_rest"),
    ), "radix-rows")

    done, width = [], head
    while True:
        done.append(state.where("NOT _open"))
        open_rows = state.where("_open").select("_rid", "_id", "_own", "_group", "_rest")
        count, size = open_rows.agg(F.count("*"), F.sum(F.octet_length("_rest"))).first()
        if not count:
            break
        # Few rows are still open in each file, so tasks take several; never more than there are.
        tasks = 1 + count // TASK_ROWS + size // TASK_BYTES
        open_rows = open_rows.coalesce(tasks)
        width = min(width * GROWTH, WIDEST)
        splits = _split(open_rows, width, tasks)
        cut = open_rows.withColumn("_digit", F.substring("_rest", 1, width))
        rest = F.substring("_rest", width + 1, _ALL)
        still = F.col("_next").isNotNull() & (rest != "")
        state = snapshot(_look_up(cut, splits, broadcast_rows).select(
            "_rid", "_id", "_own", F.col("_next").alias("_group"), "_n",
            F.col("_best._id").alias("_keep_id"), F.col("_best._rid").alias("_keep_rid"),
            still.alias("_open"), F.when(still, rest).alias("_rest"),
        ), "radix-rows")
    alone = F.col("_group").isNull()
    return reduce(DataFrame.unionByName, done).select(
        F.col("_id").alias(ident),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep_id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("_rid") == F.col("_keep_rid"))).alias("kept"),
        *[F.col("_own")[name].alias(name) for name in carry],
    )


def unique(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns as they were."""
    whole = {"_row": lambda _: F.struct(*[F.col(f"`{c}`") for c in docs.columns])}
    return exact_groups(docs, ident, text, whole).where("kept").select("_row.*")


EXACT_SQL = f"""
WITH normalised AS (
    SELECT doc_id,
           translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t
    FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM normalised
"""
