"""What several operators share: linking rows that meet under a key, and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadlens.operators.joins import BROADCAST_ROWS, lookup_join
from loadlens.session import snapshot

# Rows of one key that a task compares at once; a key with more is dealt out in
# pairs of chunks, so no task holds more than two chunks and no pair is lost.
CHUNK = 4096
# Up to this many rows of a key are compared by shifting whole batches.
SMALL_GROUP = 16


def bucket_rows(
    keys: DataFrame, identity: str, chunk: int = CHUNK, counted: DataFrame | None = None
) -> DataFrame:
    """Deal (``key``, ...) rows out so that all rows of a key meet, pair by pair.

    Adds ``chunk``, ``part_a`` and ``part_b``. Rows of a key with at most ``chunk``
    rows get 0 for all. Rows of a larger key are cut into chunks by a hash of
    ``identity``; each goes to every pair of chunks that has its own. The result is
    partitioned by key and pair and sorted by them within each partition.

    The keys are made twice, once to count them and once to deal the rows out, so
    that they need not be stored. ``counted`` has the same keys in narrower rows.
    """
    heavy = (
        (counted or keys).groupBy("key").count().where(F.col("count") > chunk)
        .select("key", F.ceil(F.col("count") / chunk).cast("int").alias("_chunks"))
    )
    rows = lookup_join(keys, heavy, "key", "left")
    own = F.when(
        F.col("_chunks").isNotNull(), F.pmod(F.xxhash64(identity), F.col("_chunks")).cast("int")
    ).otherwise(0)
    other = F.when(
        F.col("_chunks").isNotNull(), F.sequence(F.lit(0), F.col("_chunks") - 1)
    ).otherwise(F.array(F.lit(0)))
    spread = rows.withColumn("chunk", own).withColumn("_other", F.explode(other))
    return (
        spread.withColumn("part_a", F.least("chunk", "_other"))
        .withColumn("part_b", F.greatest("chunk", "_other"))
        .drop("_chunks", "_other")
        .repartition("key", "part_a", "part_b")
        .sortWithinPartitions("key", "part_a", "part_b", identity)
    )


def key_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted batches, with where each group begins.

    A group that runs over the end of a batch waits for the next one.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        table = pa.Table.from_batches(waiting)
        begins = _begins(table)
        if len(begins) == 1:
            continue
        whole = table.slice(0, int(begins[-1]))
        waiting = table.slice(int(begins[-1])).combine_chunks().to_batches()
        yield whole, np.append(begins[:-1], whole.num_rows)
    if waiting:
        table = pa.Table.from_batches(waiting)
        yield table, np.append(_begins(table), table.num_rows)


def _begins(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for name in ("key", "part_a", "part_b"):
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def close_pairs(
    begins: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray],
    block: Callable[[int, int], Iterator[tuple[np.ndarray, np.ndarray]]],
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i < j) of the same group for which the test holds.

    ``near(i, j)`` tests arrays of pairs, ``block(first, end)`` gives the pairs
    of one large group.
    """
    sizes = np.diff(begins)
    total = int(begins[-1])
    left = np.repeat(np.where(sizes <= SMALL_GROUP, begins[1:], 0), sizes)
    rows = np.arange(total)
    for step in range(1, SMALL_GROUP):
        i = np.flatnonzero(rows + step < left)
        if not len(i):
            break
        hit = near(i, i + step)
        yield i[hit], i[hit] + step
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        yield from block(int(begins[g]), int(begins[g + 1]))


class Forest:
    """Union-find over the rows of one table; keeps the links that joined trees."""

    def __init__(self, size: int):
        self.parent = list(range(size))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((a, b))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the links; root is the component's smallest node.

    Alternates two star steps until nothing changes: each node hands its larger
    neighbours to its smallest one, then its smaller ones. Every round is one table
    in the shared folder, so no round depends on what an executor held. Neighbours
    are never collected: a node's smallest is a partial aggregate.
    """
    edges = snapshot(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    before = None
    while True:
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before or state["n"] == 0:
            break
        before = state
        few = 2 * state["n"] <= BROADCAST_ROWS
        edges = snapshot(_star(_star(edges, True, few), False, few), "links")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    ).distinct()


def _star(edges: DataFrame, larger: bool, few: bool) -> DataFrame:
    if larger:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("_m")).select(
        F.col("u").alias("_c"), F.least("u", "_m").alias("m")
    )
    if few:
        # Two numbers per node, and there are at most two nodes to a link.
        met = around.join(F.broadcast(least), F.col("u") == F.col("_c"))
    else:
        # The smallest node of a component meets most of its links.
        met = lookup_join(around, least, ("u", "_c"), broadcast_rows=0)
    if larger:
        pairs = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("_c").alias("u"), F.col("m").alias("v"))
        )
    return pairs.where(F.col("u") != F.col("v")).distinct()
