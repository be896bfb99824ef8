"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Everything is DataFrame and SQL functions.

1. Targets: sources weigh in a repeating pattern and share the total size; no target
   exceeds ``max_repeats`` times its source's size, the excess is reshared by weight.
2. A source's documents are dealt into blocks by a hash. A target is a number of
   whole passes over the source's blocks plus a rest; the rest is drawn from the
   blocks in a permuted order until it is reached. The last block is drawn document
   by document in a permuted order, and the last document is cut to the words that
   are missing, so each source gets its target to the word.
3. Every pass of a block is one unit. The units' sources form quotas, which a tree
   splits among the output shards: a node holds exact counts by source, and half of
   its units, a random subset, go to the left child. The counts of a random subset
   are what a multivariate hypergeometric draw gives. At the leaves each (source,
   shard) has a count of blocks, and takes that many from the source's permuted
   order, where those of the shard before it end.
4. Rows carry a random key; sorted by it within their shard they are shuffled.

There are at most ``MAX_BLOCKS`` blocks plus one per source, whatever the input, so
the windows that run over all blocks are bounded; the tree moves blocks only. A
source that holds a third of all rows has a third of the blocks, and documents meet
their block's draws under (source, block). Only the documents of the block where a
rest ends are put in order.

Sizes count runs of anything but ASCII white space; a null text has none. The null
source is a source of its own, the last. A document without words is never drawn.
Repeated rows, also those of one id, are drawn independently. A null id is an id.
Extra columns are ignored by ``draws`` and kept by ``mixed``, but for names that
begin with ``_mix``, which are reserved. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadlens.session import snapshot

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
MAX_BLOCKS = 16384
BLOCK_WORDS = 20_000
SHARD_BLOCKS = 64
SEED = "mix"

WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def _hash(*parts: str | Column) -> Column:
    """32 hexadecimal digits that depend on the parts and not on the engine."""
    whole = [
        F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("-")) for p in parts
    ]
    return F.md5(F.concat_ws(":", F.lit(SEED), *whole).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, order) of every document; ``order`` permutes them."""
    return docs.select(
        "doc_id", "source", size_of(F.col("text")).alias("size"), _hash("doc_id").alias("order")
    )


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source.

    With sources in order of the share at which they reach their limit, those that
    do are a prefix: the first at which the others' common share fits all of them.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weigh = F.element_at(
        F.array(*map(F.lit, weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")
    ).cast("bigint")
    limited = sources.withColumn("_weight", weigh).withColumn(
        "_limit", F.col("source_size") * max_repeats
    )
    by_share = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_share.rowsBetween(Window.unboundedPreceding, -1)
    after = by_share.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    shared = limited.withColumn(
        "_level",
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_limit").over(before), F.lit(0)))
        / F.sum("_weight").over(after),
    ).withColumn("_fits", F.col("_level") * F.col("_weight") <= F.col("_limit"))
    # The first level that fits holds for all sources from there on.
    level = F.min(F.when(F.col("_fits"), F.struct(
        F.col("_limit") / F.col("_weight"), F.col("source").isNull(), "source", "_level"
    ))).over(Window.partitionBy())["_level"]
    filled = shared.withColumn("_chosen", level)
    own = F.col("_chosen") * F.col("_weight")
    return filled.select(
        "source", "source_size",
        F.when(own <= F.col("_limit"), own).otherwise(F.col("_limit").cast("double")).alias("target"),
    )


def plan(rows: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: size, target, words of the target, whole passes, rest, number of blocks."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = targets(sources, max_repeats=max_repeats)
    total = F.sum("source_size").over(Window.partitionBy())
    width = F.greatest(F.lit(BLOCK_WORDS), F.ceil(total / MAX_BLOCKS))
    words = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    return (
        aimed.withColumn("_words", words).withColumn("_passes", passes.cast("bigint"))
        .withColumn("_rest", F.col("_words") - F.col("_passes") * F.col("source_size"))
        .withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / width)).cast("bigint"))
    )


def _block(order: Column, blocks: Column) -> Column:
    """A document's block: the first eight digits of its hash, modulo the blocks."""
    return F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint"), blocks)


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on keys where null equals null; the right side's keys are left out."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = None
    for key in keys:
        same = _same_source(key, f"_r_{key}")
        condition = same if condition is None else condition & same
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])


def block_plan(rows: DataFrame, per_source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their block, and per (source, block) its size and what is drawn of it.

    ``_drawn`` counts the words of the last, incomplete pass: all, some, or none.
    """
    placed = _joined(rows, per_source, "source").withColumn(
        "_block", _block(F.col("order"), F.col("_blocks"))
    )
    sizes = placed.groupBy("source", "_block").agg(F.sum("size").alias("_block_size"))
    # Bounded by MAX_BLOCKS and the number of sources.
    order = Window.partitionBy("source").orderBy(_hash("source", "_block"), "_block")
    before = F.coalesce(
        F.sum("_block_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    blocks = (
        _joined(sizes, per_source.select("source", "_passes", "_rest"), "source")
        .withColumn("_place", F.row_number().over(order) - 1)
        .withColumn("_drawn", F.greatest(
            F.lit(0), F.least(F.col("_block_size"), F.col("_rest") - before)
        ))
    )
    return placed, blocks


def quotas(blocks: DataFrame) -> DataFrame:
    """(source, _block, _pass, _incomplete, _words, shard) of every unit that is drawn.

    ``_incomplete`` marks the pass after a source's whole ones.
    """
    order = Window.partitionBy("source").orderBy("_pass", _hash("source", "_block", "_pass"), "_block")
    units = (
        blocks.where(F.col("_block_size") > 0)
        .withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_passes"))))
        .withColumn("_words", F.when(
            F.col("_pass") < F.col("_passes"), F.col("_block_size")
        ).otherwise(F.col("_drawn")))
        .where(F.col("_words") > 0)
        .select(
            "source", "_block", "_pass", (F.col("_pass") == F.col("_passes")).alias("_incomplete"),
            "_words", F.row_number().over(order).alias("_unit"),
        )
    )
    units = snapshot(units, "mix-units")
    count = units.count()
    levels = max(0, (max(1, count // SHARD_BLOCKS) - 1).bit_length())
    # One anonymous unit for each quota; the tree never looks at the blocks themselves.
    tree = units.select("source", "_unit", F.lit(0).cast("bigint").alias("_node"))
    for level in range(levels):
        within = Window.partitionBy("_node")
        rank = F.row_number().over(
            within.orderBy(_hash(F.lit(level), "source", "_unit"), "source", "_unit")
        )
        left = F.floor((F.count("*").over(within) + 1) / 2)
        tree = tree.withColumn("_node", F.col("_node") * 2 + F.when(rank <= left, 0).otherwise(1))
    counts = tree.groupBy("source", "_node").count()
    ends = Window.partitionBy("source").orderBy("_node")
    ranges = counts.select(
        "source", F.col("_node").alias("shard"), F.sum("count").over(ends).alias("_end"),
        F.col("count").alias("_count"),
    )
    leaves = ranges.select(
        "source", "shard",
        F.explode(F.sequence(F.col("_end") - F.col("_count") + 1, F.col("_end"))).alias("_unit"),
    )
    return _joined(units, leaves, "source", "_unit").drop("_unit")


def drawn_units(blocks: DataFrame) -> DataFrame:
    """The blocks with ``_passes`` and ``_drawn`` as the leaves of the tree have them.

    All shards of a block are added up: its units of whole passes, and the words of
    the incomplete one. A block that no shard draws has none of either.
    """
    drawn = quotas(blocks).groupBy("source", "_block").agg(
        F.count_if(~F.col("_incomplete")).alias("_passes"),
        F.coalesce(F.sum(F.when(F.col("_incomplete"), F.col("_words"))), F.lit(0)).alias("_drawn"),
    )
    left = blocks.select("source", "_block", "_block_size", "_place").alias("b")
    right = drawn.alias("d")
    return left.join(
        right, F.col("b.source").eqNullSafe(F.col("d.source")) & (F.col("b._block") == F.col("d._block")),
        "left",
    ).select(
        "b.source", "b._block", "_block_size", "_place",
        F.coalesce("_passes", F.lit(0)).cast("bigint").alias("_passes"),
        F.coalesce("_drawn", F.lit(0)).cast("bigint").alias("_drawn"),
    )


def _last_words(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document the words that the incomplete pass takes of it, and its block's draws."""
    met = _joined(placed.drop("_passes", "_rest"), blocks.drop("_place"), "source", "_block")
    whole = met.where((F.col("_drawn") == F.col("_block_size")) | (F.col("_drawn") == 0)).withColumn(
        "_last", F.when(F.col("_drawn") > 0, F.col("size")).otherwise(0)
    )
    # One block per source at most is drawn in part.
    order = Window.partitionBy("source", "_block").orderBy("order", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    cut = met.where((F.col("_drawn") < F.col("_block_size")) & (F.col("_drawn") > 0)).withColumn(
        "_last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_drawn") - before))
    )
    return whole.unionByName(cut)


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    What is taken is what the shards at the tree's leaves draw, added up.
    """
    rows = snapshot(sized(docs), "mix-sizes")
    per_source = snapshot(plan(rows), "mix-sources")
    placed, blocks = block_plan(rows, per_source)
    blocks = snapshot(blocks, "mix-blocks")
    return _last_words(placed, snapshot(drawn_units(blocks), "mix-drawn")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("_passes") * F.col("size") + F.col("_last")).alias("taken"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix: a row per draw of a document, with ``_mix_shard`` and ``_mix_order``.

    A draw that takes only some words has the text's first so many. ``n_chars``, if
    there, counts the text's characters. Other columns keep their names and values.
    """
    names, plain = docs.columns, {"doc_id", "source", "text", "n_chars"}
    # Names that cannot clash with those used on the way.
    docs = docs.toDF(*[c if c in plain else f"_mix_own_{n}" for n, c in enumerate(names)])
    kept = docs.withColumns({
        "_mix_size": size_of(F.col("text")), "_mix_hash": _hash("doc_id"),
    })
    rows = snapshot(
        kept.select("doc_id", "source", F.col("_mix_size").alias("size"), F.col("_mix_hash").alias("order")),
        "mix-sizes",
    )
    per_source = snapshot(plan(rows), "mix-sources")
    placed, blocks = block_plan(rows, per_source)
    blocks = snapshot(blocks, "mix-blocks")
    drawn = quotas(blocks)
    # Which block a document is in follows from its row alone, so it meets the draws by key.
    at_block = _joined(
        kept, per_source.select("source", "_blocks"), "source"
    ).withColumn("_block", _block(F.col("_mix_hash"), F.col("_blocks"))).drop("_blocks")
    cut = (
        _last_words(placed, blocks.where((F.col("_drawn") < F.col("_block_size")) & (F.col("_drawn") > 0)))
    )
    # The documents of the blocks that are drawn in part: a few, by hash and size. Rows
    # alike in both are told apart by a number.
    alike = Window.partitionBy("source", "_block", "order", "size").orderBy(F.col("_last").desc())
    parts = cut.select(
        "source", "_block", F.col("order").alias("_mix_hash"), F.col("size").alias("_mix_size"),
        F.col("_last"), F.row_number().over(alike).alias("_n"),
    )
    draws = _joined(drawn, blocks.select("source", "_block", "_block_size"), "source", "_block").select(
        "source", "_block", "_pass", "shard",
        (F.col("_incomplete") & (F.col("_words") < F.col("_block_size"))).alias("_partial"),
    )
    met = _joined(at_block, draws, "source", "_block")
    whole = met.where(~F.col("_partial")).withColumn("_take", F.col("_mix_size"))
    # A block's documents of one hash and size are copies of one row's id.
    same = Window.partitionBy("source", "_block", "_mix_hash", "_mix_size").orderBy("text")
    some = _joined(
        met.where("_partial").withColumn("_n", F.row_number().over(same)), parts,
        "source", "_block", "_mix_hash", "_mix_size", "_n",
    ).withColumnRenamed("_last", "_take").drop("_n")
    out = whole.unionByName(some).where(F.col("_take") > 0)
    # Words with the white space before them.
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first_words = F.array_join(F.slice(words, F.lit(1), F.col("_take").cast("int")), "")
    text = F.when(F.col("_take") < F.col("_mix_size"), first_words).otherwise(F.col("text"))
    shaped = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        shaped = shaped.withColumn(
            "n_chars",
            F.when(F.col("_take") < F.col("_mix_size"), F.length("text").cast(docs.schema["n_chars"].dataType))
            .otherwise(F.col("n_chars")),
        )
    return shaped.select(
        *[F.col(own).alias(name) for own, name in zip(docs.columns, names)],
        F.col("shard").alias("_mix_shard"),
        _hash("shard", "_pass", "doc_id").alias("_mix_order"),
    )


def shuffled(draws: DataFrame) -> DataFrame:
    """The mix dealt out by shard, each shard in its random order."""
    return (
        draws.repartition("_mix_shard").sortWithinPartitions("_mix_shard", "_mix_order")
        .drop("_mix_shard", "_mix_order")
    )


# The same words for another engine; the tree decides shards, not how much is taken.
TAKEN_SQL = r"""
WITH rows AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS ord
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM rows GROUP BY source),
levels AS (
    SELECT *, source_size * 3 AS cap,
           ((SELECT sum(source_size) FROM sources) - coalesce(sum(source_size * 3) OVER (
               ORDER BY source_size * 3 / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
           row_number() OVER (ORDER BY source_size * 3 / weight, source NULLS LAST) AS place
    FROM sources),
aimed AS (
    SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (
        SELECT CAST(level AS DOUBLE) FROM levels WHERE level * weight <= cap ORDER BY place LIMIT 1)) AS target
    FROM levels),
plan AS (
    SELECT *, CASE WHEN source_size > 0
                   THEN CAST(floor(CAST(round(target) AS BIGINT) / source_size) AS BIGINT) ELSE 0 END AS passes,
           greatest(1, CAST(ceil(source_size / greatest(20000,
               ceil((SELECT sum(source_size) FROM sources) / 16384))) AS BIGINT)) AS blocks
    FROM aimed),
placed AS (
    SELECT r.*, p.source_size, p.target, p.passes,
           CAST(round(p.target) AS BIGINT) - p.passes * p.source_size AS rest,
           CAST('0x' || r.ord[1:8] AS BIGINT) % p.blocks AS block
    FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source),
sums AS (
    SELECT source, block, rest, sum(size) AS block_size,
           md5('mix:' || coalesce(source, '-') || ':' || CAST(block AS VARCHAR)) AS ord
    FROM placed GROUP BY source, block, rest),
drawn AS (
    SELECT *, greatest(0, least(block_size, rest - coalesce(sum(block_size) OVER (
        PARTITION BY source ORDER BY ord, block
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS drawn
    FROM sums)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, p.source_size, p.target,
       CAST(p.passes * p.size + greatest(0, least(p.size, d.drawn - coalesce(sum(p.size) OVER (
           PARTITION BY p.source, p.block ORDER BY p.ord, p.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM placed p JOIN drawn d ON p.source IS NOT DISTINCT FROM d.source AND p.block = d.block
"""
