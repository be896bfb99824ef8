"""Hard negatives by Strassen products of integer tiles and mergeable heaps.

Rows are integer vectors with a label. Candidates are cut into blocks, each stored as
one row; blocks of anchors are sent to every candidate block. There an anchor block
and a stretch of candidates, padded with zeros to even sides, are multiplied by
Strassen's recursion in int64. Additions there wrap around, and as wrapping is a ring,
every score that fits 64 bits is exact whatever the intermediate sums do.

Two rounds use the same tiles. The first keeps the best rows of the anchor's label, the
positives, in one bounded heap per anchor; the second, now that positive scores are
known, keeps the best rows of other labels in one heap per (anchor, positive), of scores
within that positive's window. A heap holds the k best by score, ties to the smaller id,
and two heaps merge into the heap of both, so the heaps of all blocks are merged by rank.
Nothing is sampled or cut off: every anchor meets every row.

Rows with a null id, label or vector or any null or non-finite component take no part.
Rows alike in id, label and vector count once. Where an id repeats with other contents,
each of its rows is an anchor and a candidate of its own, ties between them go by a hash
of the content, and none is a positive or negative of the same id. Where lengths differ,
missing components count as zero; an empty vector scores zero. Components are clipped to
23 bits, so that scores fit a long. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loadlens.session import snapshot

SCALE = 256
CLIP = 1 << 23
# Rows of a candidate block: at most this many, and this many numbers.
BLOCK_ROWS = 16_384
BLOCK_CELLS = 1 << 20
ANCHOR_ROWS = 512
STRETCH = 2048
LEAF = 32
POSITIVES = 5
NEGATIVES = 10
LOW_PCT, HIGH_PCT = 30, 90


def labelled(
    vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = SCALE,
) -> DataFrame:
    """(id, label, key, values): floor(scale * component) of every sound row, each once."""
    x: Column = F.col(vector)
    sound = F.col(ident).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    limit = F.lit(float(CLIP))
    values = F.transform(x, lambda v: F.greatest(
        -limit, F.least(limit, F.floor(v.cast("double") * scale).cast("double"))).cast("int"))
    rows = vectors.where(sound).select(
        F.col(ident).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        values.alias("values"),
    )
    return rows.distinct().withColumn("key", F.xxhash64("label", "values"))


# --- products ---------------------------------------------------------------------


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b in int64, seven half-size products a level; odd sides get a line of zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), dtype=np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heap:
    """The k best (score, id, key) seen: higher scores first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.scores = self.ids = self.keys = np.zeros(0, dtype=np.int64)

    def push(self, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        if len(self.scores) == self.k:
            able = scores >= self.scores[-1]
            scores, ids, keys = scores[able], ids[able], keys[able]
        if not len(scores):
            return
        if len(scores) > 4 * self.k:
            able = scores >= -np.partition(-scores, self.k - 1)[self.k - 1]
            scores, ids, keys = scores[able], ids[able], keys[able]
        scores = np.concatenate([self.scores, scores])
        ids = np.concatenate([self.ids, ids])
        keys = np.concatenate([self.keys, keys])
        best = np.lexsort((keys, ids, -scores))[:self.k]
        self.scores, self.ids, self.keys = scores[best], ids[best], keys[best]

    def merge(self, other: Heap) -> None:
        self.push(other.scores, other.ids, other.keys)


# --- blocks -----------------------------------------------------------------------


class Block:
    """Rows of one packed block as arrays; short vectors are filled up with zeros."""

    def __init__(self, packed: pa.StructArray, dims: int):
        column = dict(zip([f.name for f in packed.type], packed.flatten()))
        self.ids, self.labels, self.keys = (
            column[n].to_numpy(zero_copy_only=False) for n in ("id", "label", "key")
        )
        lengths = column["values"].value_lengths().to_numpy(zero_copy_only=False)
        self.matrix = np.zeros((len(self.ids), dims), dtype=np.int64)
        self.matrix[np.arange(dims) < lengths[:, None]] = column["values"].flatten().to_numpy()
        self.windows = column["windows"] if "windows" in column else None


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, rows): the rows of a block, which are distinct and so spread evenly, as a list."""
    fields = [c for c in ("id", "label", "key", "values", "windows") if c in rows.columns]
    block = F.pmod(F.xxhash64("id", "key"), F.lit(blocks)).cast("int")
    return rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct(*fields)).alias("rows"))


def _met(anchors: DataFrame, index: DataFrame, blocks: int, anchor_rows: int) -> DataFrame:
    """Every block of anchors beside every candidate block, in the order of the latter."""
    count = max(1, -(-anchors.count() // anchor_rows))
    sent = _packed(anchors, count).select(
        F.col("rows").alias("anchors"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    return sent.join(index.hint("merge"), "block")


def _pairs(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[Block, Block]]:
    at, candidates = None, None
    for batch in batches:
        columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("block", "rows", "anchors")}
        for i in range(batch.num_rows):
            block = columns["block"][i].as_py()
            if block != at:
                at, candidates = block, Block(columns["rows"][i].values, dims)
            yield Block(columns["anchors"][i].values, dims), candidates


def _tiles(anchors: Block, candidates: Block, stretch: int) -> Iterator[tuple[slice, np.ndarray]]:
    for begin in range(0, len(candidates.ids), stretch):
        part = slice(begin, begin + stretch)
        yield part, strassen(anchors.matrix, np.ascontiguousarray(candidates.matrix[part].T))


def _lines(parts: list[list[np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    columns = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in zip(*parts)]
    if not columns:
        columns = [np.zeros(0, dtype=np.int64) for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)


_FOUND = ("anchor_id", "anchor_key", "id", "key", "score")
_MINED = ("anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score",
          "id", "key", "score")


def _schema(names: tuple[str, ...]) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


def _spark_schema(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} BIGINT" for n in names)


def _best_positives(met: DataFrame, dims: int, k: int, stretch: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, candidates in _pairs(batches, dims):
            heaps = [Heap(k) for _ in anchors.ids]
            for part, scores in _tiles(anchors, candidates, stretch):
                ids, labels, keys = candidates.ids[part], candidates.labels[part], candidates.keys[part]
                for a, heap in enumerate(heaps):
                    able = (labels == anchors.labels[a]) & (ids != anchors.ids[a])
                    heap.push(scores[a, able], ids[able], keys[able])
            yield _lines([
                [np.full(len(h.ids), i), np.full(len(h.ids), key), h.ids, h.keys, h.scores]
                for i, key, h in zip(anchors.ids, anchors.keys, heaps)
            ], _schema(_FOUND))

    found = met.mapInArrow(run, _spark_schema(_FOUND))
    return _ranked(found, ["anchor_id", "anchor_key"], k)


def _best_negatives(met: DataFrame, dims: int, k: int, low: int, high: int, stretch: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, candidates in _pairs(batches, dims):
            # (anchor, positive, lowest and highest score of its window, heap)
            slots = [
                (a, w, -(-low * w["score"] // 100), high * w["score"] // 100, Heap(k))
                for a, own in enumerate(anchors.windows.to_pylist()) for w in own
            ]
            for part, scores in _tiles(anchors, candidates, stretch):
                ids, labels, keys = candidates.ids[part], candidates.labels[part], candidates.keys[part]
                other, at = None, None
                for a, _, least, most, heap in slots:
                    if a != at:
                        at, other = a, (labels != anchors.labels[a]) & (ids != anchors.ids[a])
                    able = other & (scores[a] >= least) & (scores[a] <= most)
                    heap.push(scores[a, able], ids[able], keys[able])
            yield _lines([
                [np.full(len(h.ids), x) for x in (
                    anchors.ids[a], anchors.keys[a], w["id"], w["key"], w["score"])]
                + [h.ids, h.keys, h.scores]
                for a, w, _, _, h in slots
            ], _schema(_MINED))

    found = met.mapInArrow(run, _spark_schema(_MINED))
    return _ranked(found, ["anchor_id", "anchor_key", "positive_id", "positive_key"], k)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The heaps of all blocks merged: ``rank`` from 1 to k within each slot."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW_PCT,
    high: int = HIGH_PCT,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
    stretch: int = STRETCH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` and ``anchors`` are frames of :func:`labelled`. For each anchor and each of
    its best ``positives``: the first ``negatives`` rows of other labels whose score lies
    between ``low`` and ``high`` percent of the positive's, bounds included.
    """
    rows, anchors = snapshot(rows, "mining-rows"), snapshot(anchors, "mining-anchors")
    count, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("values")), F.lit(0))).first()
    size = max(1, min(block_rows, BLOCK_CELLS // max(1, dims)))
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    # Enough blocks for all cores, as far as a block still fills a stretch.
    blocks = max(1, -(-count // size), min(tasks, -(-count // stretch)))
    index = snapshot(_packed(rows, blocks), "mining-blocks")

    met = _met(anchors, index, blocks, anchor_rows)
    best = snapshot(_best_positives(met, dims, positives, stretch), "mining-positives")
    # A list has at most `positives` entries.
    windows = best.groupBy("anchor_id", "anchor_key").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "key", "score"))).alias("windows")
    )
    asked = anchors.join(
        windows, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key"))
    ).select("id", "label", "key", "values", "windows")
    mined = _best_negatives(
        _met(asked, index, blocks, anchor_rows), dims, negatives, low, high, stretch
    )
    return mined.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


MINED_SQL = """
WITH v AS (
    SELECT vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
           CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
    FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER w AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
