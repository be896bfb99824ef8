"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments of 22, 21 and 21 bits, each
read as a word of the perfect (23, 12) Golay code. Two fingerprints that differ in
at most ``MAX_BITS`` = 4 bits either agree on one whole segment, or have two
segments with at most one differing bit each (errors 1, 1 and at most 2). So they
share a key of one of these kinds:

* the segment itself, for each of the three;
* for each two segments, the codeword that the first decodes to with one of the
  codewords within four bits of the second, or the other way round. A word one bit
  away decodes to a codeword at most 3 + 1 bits away, so it is among those.

Every word lies within three bits of one codeword; a word at exactly three bits has
five further codewords at four. That gives up to 36 keys per two segments, 18 or so
on average over both ways, of 24 bits each, where plain blocks would need many
more tables for keys as long. Rows that meet under a key are verified bit by bit.

Empty and null texts have the fingerprint 0 and link like any other. Equal
fingerprints are one node, whatever the number of copies. Rows with a null
``doc_id`` take part; a component's id is the smallest id that is not null. Repeated
rows are copies. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from loadlens.llm.base import Forest, bucket_rows, close_pairs, components, key_groups
from loadlens.operators.joins import lookup_join
from loadlens.session import snapshot

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, width)
GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of degree 11


# --- fingerprints -------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of the word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    begins = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(line)]))
    size = min(shingle, len(begins))
    count = len(begins) - size + 1
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    # A long text is hashed a stretch at a time.
    for at in range(0, count, 65536):
        end = min(count, at + 65536)
        spans = zip(begins[at:end].tolist(), ends[at + size - 1:end + size - 1].tolist())
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)
        ones += _bit_counts(hashes)
    bits = ones * 2 > count
    return int(np.packbits(bits[::-1]).view(">u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the values have each bit set, lowest bit first."""
    # Bit k of all eight bytes is added up at once; a byte counts to 255.
    padded = np.zeros(-(-len(hashes) // 255) * 255, dtype=np.uint64)
    padded[:len(hashes)] = hashes
    ones = np.zeros((8, 8), dtype=np.int64)
    for k in range(8):
        lanes = (padded >> np.uint64(k) & np.uint64(0x0101010101010101)).reshape(-1, 255)
        ones[:, k] = lanes.sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return ones.reshape(64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(
                [fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id BIGINT, fp BIGINT")


# --- Golay keys ---------------------------------------------------------------


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes of 23-bit words: the remainder by the generator."""
    left = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - 11), 0)
    return left


@lru_cache(maxsize=1)
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of up to four bits, lightest first, and how many."""
    patterns = np.zeros((2048, 6), dtype=np.int64)
    counts = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        own = np.array(
            [sum(1 << b for b in places) for places in combinations(range(23), weight)],
            dtype=np.int64,
        )
        for pattern, syndrome in zip(own.tolist(), _remainder(own).tolist()):
            patterns[syndrome, counts[syndrome]] = pattern
            counts[syndrome] += 1
    return patterns, counts


def decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (12 bits) within four bits of each word, nearest first, and how many."""
    patterns, counts = _errors()
    syndromes = _remainder(words)
    return (words[:, None] ^ patterns[syndromes]) >> 11, counts[syndromes]


def keys_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of the unsigned fingerprints; no row has a key twice."""
    rows, keys = [], []
    all_rows = np.arange(len(values))
    parts = [
        (values >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        for shift, width in SEGMENTS
    ]
    for kind, part in enumerate(parts):
        rows.append(all_rows)
        keys.append(kind << 32 | part)
    near = [decode(part) for part in parts]
    for kind, (i, j) in enumerate(combinations(range(3), 2)):
        tag = (3 + kind) << 32
        (codes_i, count_i), (codes_j, count_j) = near[i], near[j]
        for n in range(6):
            here = count_j > n
            rows.append(all_rows[here])
            keys.append(tag | codes_i[here, 0] << 12 | codes_j[here, n])
            if n:  # both nearest is the same key either way
                here = count_i > n
                rows.append(all_rows[here])
                keys.append(tag | codes_i[here, n] << 12 | codes_j[here, 0])
    return np.concatenate(rows), np.concatenate(keys)


def golay_keys(values: DataFrame) -> DataFrame:
    """(key, fp) rows of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy()
            for at in range(0, len(all_fps), 4096):
                fps = all_fps[at:at + 4096]
                rows, keys = keys_of(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(fps[rows])], names=["key", "fp"]
                )

    return values.select("fp").mapInArrow(run, "key BIGINT, fp BIGINT")


# --- links and components -----------------------------------------------------


def _verified(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in key_groups(batches):
            fps = table.column("fp").to_numpy().view(np.uint64)

            def near(i, j):
                return np.bitwise_count(fps[i] ^ fps[j]) <= max_bits

            def block(first, end):
                own = fps[first:end]
                for i in range(len(own) - 1):
                    hit = np.flatnonzero(np.bitwise_count(own[i + 1:] ^ own[i]) <= max_bits)
                    if len(hit):
                        yield np.full(len(hit), first + i), hit + (first + i + 1)

            forest = Forest(table.num_rows)
            for i, j in close_pairs(begins, near, block):
                forest.add(i, j)
            if forest.links:
                i, j = np.array(forest.links).T
                signed = fps.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed[i]), pa.array(signed[j])], names=["a", "b"]
                )

    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all near ones.

    Of the verified pairs of a key only a spanning forest is returned, so a group of
    n near fingerprints gives n - 1 links and not n squared.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys find pairs of up to 4 differing bits")
    return bucket_rows(golay_keys(distinct), "fp").mapInArrow(_verified(max_bits), "a BIGINT, b BIGINT")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    marked = snapshot(fingerprints(docs, shingle), "fingerprints")
    return (
        with_components(marked, max_bits)
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def fp_components(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of a stored table (doc_id, fp)."""
    distinct = snapshot(
        marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints"
    )
    roots = components(links(distinct, max_bits))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # A component may hold a third of all fingerprints.
    return snapshot(
        lookup_join(snapshot(rooted, "rooted"), firsts, "root").select("fp", "root", "component_id"),
        "fp-components",
    )


def with_components(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of a stored table with ``doc_id`` and ``fp``, with ``component_id``."""
    found = fp_components(marked, max_bits).select("fp", "component_id")
    return lookup_join(marked, found, "fp", spread_by="row")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns.

    It is the row with the smallest id, a null id coming last; of several such rows in
    the group the first as they were stored. An id that repeats in other groups stays
    there, too. An empty table gives an empty one.
    """
    own = {"fp": "_fp", "row": "_row"}
    for name in own:
        while own[name] in docs.columns:
            own[name] += "_"
    text_at = docs.columns.index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column(text_at).to_pylist()]
            marks = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, marks], names=[*batch.schema.names, own["fp"]]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(own["fp"], T.LongType())])
    stored = snapshot(
        docs.mapInArrow(mark, schema).withColumn(own["row"], F.monotonically_increasing_id()),
        "marked-documents",
    )
    slim = stored.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(own["fp"]).alias("fp"),
        F.col(own["row"]).alias("row"),
    )
    groups = fp_components(slim, max_bits).select("fp", "root")
    # Copies are one line each before their group is looked up.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    copies = slim.groupBy("fp").agg(first)
    kept = lookup_join(copies, groups, "fp", even=True).groupBy("root").agg(
        F.min("first").alias("first")
    )
    rows = snapshot(kept.select(F.col("first.row").alias("_kept")), "kept-rows")
    return lookup_join(stored, rows, (own["row"], "_kept"), "left_semi", even=True).select(
        *docs.columns
    )
