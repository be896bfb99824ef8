"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Rows are integer vectors. The index is cut into blocks of rows by a hash of their
id; each block is one packed row. In a block every dimension has its postings sorted
by value and cut into segments of ``1 << STEP_BITS`` values. For a query the
segments of all dimensions are ordered by their quantised impact, the largest
|weight * value| that they can hold, and added to the accumulators from the top
down. A row that a dimension has not reached yet can gain at most the impact of the
next segment there, so accumulator plus that bound is the most a row can score. Once
few rows can still beat the k-th best exact score known, which is the proof for all
the others, the rest is scored exactly. The stop never decides a result: when it
comes late, more segments are added; when it comes early, more rows are rescored.

A query block meets each index block in one equi-join of packed rows; every pair of
blocks returns at most k rows per query, and those are ranked.

Vectors that are null or hold null or non-finite components take no part, nor do
rows with a null id. Rows that repeat id and vector count once. A candidate with the
query's own id is the query's own row; where an id repeats with different vectors, its
rows are candidates of their own, and as queries they share one ranking of their scores.
An empty table gives an empty result. Where lengths differ, missing components count
as zero. Components are clipped to 23 bits, so that scores fit a long. An empty
vector scores zero. Extra columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loadlens.session import snapshot

SCALE = 256
CLIP = 1 << 23
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
STEP_BITS = 4
CHECK_EVERY = 128
# The share of a block, one in so many, that may be left to exact scoring.
RESCORED = 16


def quantised(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding",
              scale: int = SCALE) -> DataFrame:
    """(id, values): floor(scale * component) of every sound vector, as integers."""
    x: Column = F.col(vector)
    sound = F.col(ident).isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    limit = F.lit(float(CLIP))
    values = F.transform(
        x, lambda v: F.greatest(-limit, F.least(limit, F.floor(v.cast("double") * scale).cast("double")))
        .cast("int")
    )
    return vectors.where(sound).select(F.col(ident).cast("bigint").alias("id"), values.alias("values"))


# --- packed blocks --------------------------------------------------------------


def _pack(ids: np.ndarray, lists: pa.ListArray) -> tuple[bytes, bytes, int]:
    """Distinct rows, ordered by id, as bytes; short lists are filled up with zeros."""
    lengths = lists.value_lengths().to_numpy()
    width = int(lengths.max(initial=0))
    matrix = np.zeros((len(ids), width), dtype=np.int32)
    matrix[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    both = np.unique(np.column_stack([ids, matrix.astype(np.int64)]), axis=0)
    return both[:, 0].tobytes(), both[:, 1:].astype(np.int32).tobytes(), width


def packed(rows: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """(block, ids, matrix, width) of about ``block_rows`` rows each, and how many blocks."""
    blocks = max(1, -(-rows.count() // block_rows))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        lists = pa.concat_arrays(table.column("values").chunks)
        own, matrix, width = _pack(ids, lists)
        return pa.table(
            {"block": [key[0].as_py()], "ids": [own], "matrix": [matrix], "width": [width]},
            schema=pa.schema([("block", pa.int32()), ("ids", pa.binary()),
                              ("matrix", pa.binary()), ("width", pa.int32())]),
        )

    by_block = rows.withColumn("block", F.pmod(F.xxhash64("id", "values"), F.lit(blocks)).cast("int"))
    out = by_block.groupBy("block").applyInArrow(
        run, "block INT, ids BINARY, matrix BINARY, width INT"
    )
    return out, blocks


def _unpack(ids: bytes, matrix: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, dtype=np.int64)
    return own, np.frombuffer(matrix, dtype=np.int32).reshape(len(own), width)


# --- the index of one block -------------------------------------------------------


class ImpactIndex:
    """Postings of each dimension sorted by value and cut into quantised segments."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, step_bits: int = STEP_BITS):
        self.ids = ids
        self.matrix = matrix.astype(np.int64)
        count, self.dims = matrix.shape
        rows, values, dim, begin, end, size = [], [], [], [], [], []
        for d in range(self.dims):
            order = np.argsort(matrix[:, d], kind="stable")
            own = self.matrix[order, d]
            cuts = np.flatnonzero(np.diff(own >> step_bits)) + 1
            begins = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [count]))
            rows.append(order)
            values.append(own.astype(np.float64))
            dim += [d] * len(begins)
            begin += (begins + d * count).tolist()
            end += (ends + d * count).tolist()
            size += np.maximum(np.abs(own[begins]), np.abs(own[ends - 1])).tolist()
        # All postings in one array, each segment a stretch of it.
        self.rows = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        self.values = np.concatenate(values) if values else np.zeros(0)
        self.dim, self.size = np.array(dim, dtype=np.int64), np.array(size, dtype=np.int64)
        self.length = np.array(end, dtype=np.int64) - np.array(begin, dtype=np.int64)
        self.stretch = [slice(a, b) for a, b in zip(begin, end)]

    def search(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, ties to the smaller id; the own id is left out."""
        weights = np.zeros(self.dims, dtype=np.int64)
        shared = min(len(query), self.dims)
        weights[:shared] = query[:shared]
        count = len(self.ids)
        some = self._survivors(weights, own_id, k) if count > 4 * k else np.arange(count)
        some = some[self.ids[some] != own_id]
        scores = self.matrix[some] @ weights
        best = np.lexsort((self.ids[some], -scores))[:k]
        return self.ids[some[best]], scores[best]

    def _survivors(self, weights: np.ndarray, own_id: int, k: int) -> np.ndarray:
        """Rows that may be among the k best; all others are proven not to be."""
        impact = np.abs(weights)[self.dim] * self.size
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        count = len(self.ids)
        gained = np.zeros(count)
        reached = np.zeros(count, dtype=np.int64)
        # A dimension's largest impact bounds the rows it has not reached at all.
        unopened = np.zeros(self.dims, dtype=np.int64)
        np.maximum.at(unopened, self.dim, impact)
        opened = np.zeros(self.dims, dtype=bool)
        enough = max(4 * k, count // RESCORED)
        known = None
        for at in range(0, len(order), CHECK_EVERY):
            some = order[at:at + CHECK_EVERY]
            stretches = [self.stretch[s] for s in some.tolist()]
            rows = np.concatenate([self.rows[s] for s in stretches])
            gains = np.concatenate([self.values[s] for s in stretches])
            gains *= np.repeat(weights[self.dim[some]], self.length[some])
            # Sums of integers, exact below 2 ** 53.
            gained += np.bincount(rows, gains, count)
            reached += np.bincount(rows, minlength=count)
            opened[self.dim[some]] = True
            following = at + CHECK_EVERY
            level = int(impact[order[following]]) if following < len(order) else 0
            rest = int(np.minimum(unopened[~opened], level).sum())
            most = gained + rest + level * (int(opened.sum()) - reached)
            known = self._kth(weights, own_id, k, gained, known)
            possible = most >= known if known is not None else np.ones(count, dtype=bool)
            if level == 0 or np.count_nonzero(possible) <= enough:
                return np.flatnonzero(possible)
        return np.arange(count)

    def _kth(self, weights, own_id, k, gained, known):
        """The k-th best exact score among the rows that lead now: none of the k best is lower."""
        lead = np.argpartition(-gained, 4 * k - 1)[:4 * k]
        lead = lead[self.ids[lead] != own_id]
        if len(lead) < k:
            # Too many rows share the query's id to know a bound yet.
            return known
        exact = np.sort(self.matrix[lead] @ weights)[-k]
        return exact if known is None else max(exact, known)


def top_k(rows: DataFrame, queries: DataFrame, k: int,
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k best rows of (id, values) for every query row."""
    index, blocks = packed(rows, block_rows)
    index = snapshot(index, "impact-blocks")
    asked, _ = packed(queries, query_rows)
    sent = asked.select(
        F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"),
        F.col("width").alias("query_width"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    # A block's task takes its query blocks one after another, so the index moves once.
    pairs = sent.join(index.hint("merge"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, built = None, None
        for batch in batches:
            for row in (r for n in range(batch.num_rows) for r in batch.slice(n, 1).to_pylist()):
                if row["block"] != at:
                    ids, matrix = _unpack(row["ids"], row["matrix"], row["width"])
                    at, built = row["block"], ImpactIndex(ids, matrix)
                query_ids, query_matrix = _unpack(
                    row["query_ids"], row["query_matrix"], row["query_width"]
                )
                out = ([], [], [])
                for own, query in zip(query_ids.tolist(), query_matrix.astype(np.int64)):
                    found, scores = built.search(query, own, k)
                    out[0].append(np.full(len(found), own))
                    out[1].append(found)
                    out[2].append(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in out],
                    names=["query_id", "id", "score"],
                )

    found = pairs.mapInArrow(run, "query_id BIGINT, id BIGINT, score BIGINT")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
