"""Near-duplicate vectors by spherical-cap filters of random product codes.

Random rotations each carry a product code: the rotated space is cut into two blocks,
each with a code of random directions, and every choice of one direction per block is
a filter direction of length one. A unit vector belongs to each filter whose direction
it exceeds by a limit. It is list-decoded to all of them at once: the scores of the two
blocks are sorted out, and only pairs of partial codes that can reach the limit are
looked at. Vectors that meet in a filter are verified by cosine in double precision.

:func:`layout` fits the limit and the number of filters to the dimension, the
threshold and the number of vectors, from the exact areas of a cap and of two caps'
overlap on the sphere. Two vectors at exactly the threshold share ``SHARED`` filters on
average, so that recall is 0.95 or more from 2 to 1,024 dimensions (measured in the
tests at two sizes) and higher for closer pairs. Caps are as small as these bounds allow: a filter
need not hold fewer than ``FILTER_ROWS`` of vectors spread evenly, a vector has about
``MOST_FILTERS`` filters at most, and the codes take ``CODE_NUMBERS`` numbers at most.
So a vector's filters stay few and a filter's rows grow only beyond the last bound,
where large filters are compared chunk by chunk.

Null, empty and zero vectors and those with null or non-finite components link with
nothing. Equal vectors are one node that counts as often as it occurs. Vectors of
different dimensions never link. Rows with a null ``vec_id`` take part: they count
as links of others. Repeated rows are copies. An empty table gives an empty one. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadlens.llm.base import Forest, bucket_rows, components, key_groups
from loadlens.operators.joins import lookup_join
from loadlens.session import snapshot

THRESHOLD = 0.9
SHARED = 8.0
MOST_FILTERS = 64
FILTER_ROWS = 16
ROTATIONS = 32
BLOCKS = 2
MOST_CODE = 1024
CODE_NUMBERS = 1 << 22
# Rotations beyond this many numbers are made of the first ones by exchanging axes.
ROTATION_NUMBERS = 1 << 21
SEED = 20240917


def _tail(dim: int, limit: np.ndarray, steps: int = 4000) -> np.ndarray:
    """Share of the unit sphere whose first coordinate is at least each limit."""
    limit = np.clip(limit, -1.0, 1.0)
    if dim == 1:
        return np.where(limit <= -1, 1.0, 0.5)
    angle = (np.arange(steps) + 0.5) * (np.pi / steps)
    mass = np.concatenate([[0.0], np.cumsum(np.sin(angle) ** (dim - 2))])
    edges = np.linspace(0, np.pi, steps + 1)
    return np.interp(np.arccos(limit), edges, mass / mass[-1])


def cap_shares(dim: int, limit: float, cosine: float) -> tuple[float, float]:
    """Chance that a random filter holds a vector, and that it holds both of two."""
    angle = np.linspace(0, np.arccos(limit), 2001)
    middle = (angle[1:] + angle[:-1]) / 2
    own = np.cos(middle)
    slices = np.diff(-_tail(dim, np.cos(angle))) * -1
    reach = (limit - cosine * own) / (np.sqrt(1 - cosine**2) * np.sin(middle))
    return float(slices.sum()), float((slices * _tail(dim - 1, reach)).sum())


@lru_cache(maxsize=64)
def layout(dim: int, rows: int, threshold: float = THRESHOLD) -> tuple[float, int, int]:
    """(limit, directions per block, rotations) for so many vectors of a dimension."""
    if dim == 1:
        return 0.5, 2, 1
    cosine = min(max(threshold, 0.1), 0.9999)
    code_bound = int(np.clip(CODE_NUMBERS // (ROTATIONS * dim), 8, MOST_CODE))
    best = None
    for limit in np.arange(0.0, 0.96, 0.01):
        one, both = cap_shares(dim, float(limit), cosine)
        if both <= 0:
            break
        count = SHARED / both
        fits = count <= ROTATIONS * code_bound**2 and one * count <= MOST_FILTERS
        if best is None or (fits and one * rows >= FILTER_ROWS):
            best = float(limit), count
    limit, count = best
    code = int(np.clip(np.sqrt(count / ROTATIONS), 2, code_bound))
    sizes = [2 if width == 1 else code for width in _widths(dim)]
    return limit, code, int(np.ceil(count / np.prod(sizes)))


def _widths(dim: int) -> list[int]:
    return np.diff(np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)).tolist()


@lru_cache(maxsize=8)
def _codes(dim: int, code: int, count: int) -> tuple[list, list[tuple[int, np.ndarray]], list]:
    """Rotations, which of them and what order of axes each code has, and the codes."""
    rng = np.random.default_rng((SEED, dim))
    made = min(count, max(1, ROTATION_NUMBERS // dim**2))
    rotations = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(made)]
    axes, codes = [], []
    for r in range(count):
        axes.append((r % made, rng.permutation(dim)))
        own = []
        for width in _widths(dim):
            points = rng.standard_normal((code, width))
            if width == 1:
                points = np.array([[1.0], [-1.0]])
            # Each block's directions have the share of length that its width has.
            points *= np.sqrt(width / dim) / np.linalg.norm(points, axis=1, keepdims=True)
            own.append(points)
        codes.append(own)
    return rotations, axes, codes


def _sums(parts: list[np.ndarray]) -> np.ndarray:
    """Scores of every choice of one direction from each of the blocks."""
    total = parts[0]
    for part in parts[1:]:
        total = (total[:, :, None] + part[:, None, :]).reshape(len(total), -1)
    return total


def filters_of(
    unit: np.ndarray, rows: int = 1 << 20, threshold: float = THRESHOLD
) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter direction that each unit vector exceeds."""
    dim = unit.shape[1]
    limit, code, count = layout(dim, rows, threshold)
    row_parts, filters = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    rotations, axes, codes = _codes(dim, code, count)
    bounds = np.cumsum([0, *_widths(dim)]).tolist()
    turned = [unit @ rotation for rotation in rotations]
    for r, (which, order) in enumerate(axes):
        mine = turned[which][:, order]
        parts = [mine[:, a:b] @ c.T for a, b, c in zip(bounds, bounds[1:], codes[r])]
        half = (len(parts) + 1) // 2
        first = _sums(parts[:half])
        last = _sums(parts[half:]) if parts[half:] else np.zeros((len(unit), 1))
        best = last.max(axis=1)
        row, left = np.nonzero(first + best[:, None] >= limit)
        for at in range(0, len(row), 4096):
            own, part = row[at:at + 4096], left[at:at + 4096]
            pair, right = np.nonzero(first[own, part][:, None] + last[own] >= limit)
            row_parts.append(own[pair])
            filters.append((r * first.shape[1] + part[pair]) * last.shape[1] + right)
    return np.concatenate(row_parts), np.concatenate(filters).astype(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def filter_rows(
    nodes: DataFrame, rows: int, threshold: float = THRESHOLD, narrow: bool = False
) -> DataFrame:
    """(key, node, copies, vector, filters): a row for each filter of each node.

    ``rows`` is about the number of nodes. With ``narrow`` only the keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lengths = batch.column("vector").value_lengths().to_numpy()
                for dim in np.unique(lengths):
                    some = batch.filter(pa.array(lengths == dim))
                    row, filters = filters_of(
                        _unit(_matrix(some.column("vector"))), rows, threshold
                    )
                    order = np.lexsort((filters, row))
                    row, filters = row[order], filters[order]
                    # Vectors of another dimension never share a key.
                    key = pa.array(filters | int(dim) << 32)
                    if narrow:
                        yield pa.RecordBatch.from_arrays([key], names=["key"])
                        continue
                    offsets = np.zeros(some.num_rows + 1, dtype=np.int32)
                    offsets[1:] = np.cumsum(np.bincount(row, minlength=some.num_rows))
                    lists = pa.ListArray.from_arrays(
                        pa.array(offsets), pa.array(filters.astype(np.int32))
                    )
                    taken = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            key, some.column("node").take(taken),
                            some.column("copies").take(taken), some.column("vector").take(taken),
                            lists.take(taken),
                        ],
                        names=["key", "node", "copies", "vector", "filters"],
                    )

    kind = nodes.schema["vector"].dataType.simpleString()
    wide = f"key BIGINT, node BIGINT, copies BIGINT, vector {kind}, filters ARRAY<INT>"
    return nodes.select("node", "copies", "vector").mapInArrow(
        run, "key BIGINT" if narrow else wide
    )


def _first_shared(i: np.ndarray, j: np.ndarray, lists: np.ndarray, key: int) -> np.ndarray:
    """Whether ``key`` is the smallest filter that both rows of each pair hold."""
    first = np.ones(len(i), dtype=bool)
    for at in range(0, len(i), 8192):
        a, b = lists[i[at:at + 8192]], lists[j[at:at + 8192]]
        a = np.where(a < key, a, -1)
        shared = np.zeros(len(a), dtype=bool)
        for n in range(b.shape[1]):
            mine = b[:, n]
            live = (mine >= 0) & (mine < key)
            if not live.any():
                break
            shared |= live & (a == mine[:, None]).any(axis=1)
        first[at:at + 8192] = ~shared
    return first


def _verify(threshold: float):
    """Counts and links of each task: (a, NULL, copies linked) and (a, b, NULL)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in key_groups(batches):
            keys = table.column("key").to_numpy()
            parts = table.column("part_a").to_numpy(), table.column("part_b").to_numpy()
            chunks = table.column("chunk").to_numpy()
            nodes = table.column("node").to_numpy()
            copies = table.column("copies").to_numpy()
            vectors = table.column("vector").combine_chunks()
            filters = table.column("filters").combine_chunks()
            counted = np.zeros(table.num_rows, dtype=np.int64)
            forest = Forest(table.num_rows)
            for first, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
                if end - first < 2:
                    continue
                unit = _unit(_matrix(vectors.slice(first, end - first)))
                spans = filters.slice(first, end - first)
                lengths = spans.value_lengths().to_numpy()
                lists = np.full((end - first, lengths.max()), -1, dtype=np.int32)
                lists[np.arange(lists.shape[1]) < lengths[:, None]] = spans.flatten().to_numpy()
                # Of two chunks only pairs across count; each alone is another group.
                across = parts[0][first] != parts[1][first]
                side = chunks[first:end]
                for at in range(0, end - first, 512):
                    cosine = unit[at:at + 512] @ unit.T
                    i, j = np.nonzero(cosine >= threshold)
                    i = i + at
                    keep = i < j
                    if across:
                        keep &= side[i] != side[j]
                    i, j = i[keep], j[keep]
                    forest.add(i + first, j + first)
                    new = _first_shared(i, j, lists, int(keys[first]) & 0xFFFFFFFF)
                    i, j = i[new] + first, j[new] + first
                    np.add.at(counted, i, copies[j])
                    np.add.at(counted, j, copies[i])
            some = np.flatnonzero(counted)
            if len(some):
                yield _result(nodes[some], None, counted[some])
            if forest.links:
                i, j = np.array(forest.links).T
                yield _result(nodes[i], nodes[j], None)

    return run


def _result(a: np.ndarray, b: np.ndarray | None, linked: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a),
            none if b is None else pa.array(b),
            none if linked is None else pa.array(linked),
        ],
        names=["a", "b", "linked"],
    )


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    sound = (
        F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    # Adding zero makes -0.0 and 0.0 equal.
    same = F.transform(values, lambda x: x + F.lit(0.0)).cast(vectors.schema["embedding"].dataType)
    rows = vectors.select("vec_id", F.when(sound, same).alias("vector"))
    # Equal vectors share a digest of 128 bits, so that groups of copies are counted
    # by a short key; a hot group is a partial aggregate.
    marked = rows.withColumn("print", F.md5(F.to_json(F.struct("vector"))))
    distinct = snapshot(
        marked.where(F.col("vector").isNotNull()).groupBy("print").agg(
            F.min("vec_id").alias("first_id"), F.count("*").alias("copies"),
            F.any_value("vector").alias("vector"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "distinct-vectors",
    )
    # A power of two, so that a few rows more change no filter.
    rows = 1 << distinct.count().bit_length()
    dealt = bucket_rows(
        filter_rows(distinct, rows, threshold), "node",
        counted=filter_rows(distinct, rows, threshold, narrow=True),
    )
    met = snapshot(
        dealt.mapInArrow(
            _verify(threshold), "a BIGINT, b BIGINT, linked BIGINT"
        ),
        "cap-links",
    )
    roots = components(met.where(F.col("b").isNotNull()))
    linked = met.where(F.col("b").isNull()).groupBy("a").agg(F.sum("linked").alias("linked"))
    roots = snapshot(roots, "roots")
    firsts = (
        distinct.select("node", "first_id").join(roots, "node")
        .groupBy("root").agg(F.min("first_id").alias("component_id"))
    )
    # A component may hold a third of all vectors.
    rooted = lookup_join(roots, snapshot(firsts, "firsts"), "root").select("node", "component_id")
    facts = snapshot(
        distinct.select("print", "node", "first_id", "copies")
        .join(rooted, "node", "left")
        .join(linked, distinct["node"] == linked["a"], "left")
        .select(
            "print", F.coalesce("component_id", "first_id").alias("component_id"),
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        ),
        "vector-facts",
    )
    return lookup_join(
        marked.select("vec_id", "print"), facts, "print", "left", spread_by="row"
    ).select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False))
        .alias("kept"),
    )
