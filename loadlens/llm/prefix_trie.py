"""The trie of all conversation prefixes, by vertical bitmaps.

Turns are reduced to (conversation, position, digest of role and text, code points).
Conversations are laid side by side in the order of their ids and cut into shards of
bounded size. A shard's index maps (position, turn) to the bitset of its conversations
that have that turn there. From the bitset of a node, the turn that its lowest
conversation has next names a posting; the intersection of both is a child, and what
is left of the bitset names the next one. A depth-first walk so yields every node of the
shard with its population count, smallest conversation and the list of those that end.

Nodes of different shards are one if their keys are equal: the XOR of 128 hash bits of
each (position, turn) on the path. Counts add up over shards. What must count once, a
node's text or a leaf, counts in the lowest shard that has the node; a shard adds these up
along its own trie, as a subtree's share in a shard lies below that shard's own node. End
lists are runs of ascending ids, one per shard, and read in the order of shards.

A conversation of any length is cut into bands of ``BAND`` positions, walked apart. A
band begins at the keys that its conversations have there; sums below the end of a band
are handed up by conversation. Turns are numbered after a sort by range, so that a
conversation with a large share of all turns is many tasks' work. Only an end list that
goes into a digest must pass through one task, as text in runs, never as a whole.

Rows with a null id take no part. A null turn comes first; turns that tie are ordered by
the digest of role and text, and repeated rows each count as a turn. Null role or text is
empty. An empty table gives no node, not even the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from loadlens.operators.joins import lookup_join
from loadlens.session import snapshot

BAND = 512
SHARD_CONVERSATIONS = 2048
SHARD_TURNS = 65_536


# --- turns ----------------------------------------------------------------------------


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn",
             role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, chars): the turns of each conversation numbered from 1."""
    said_by, said = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
        F.md5(F.concat(F.octet_length(said_by).cast("string"), F.lit(":"), said_by, said))
        .alias("digest"),
        F.char_length(said).cast("bigint").alias("chars"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv", "turn", "digest", "tie"]
    stored = snapshot(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).drop("tie"),
        "turns",
    )
    within = Window.partitionBy("conv", "part").orderBy("turn", "digest")
    local = stored.withColumn("_at", F.row_number().over(within))
    # A sorted partition continues at most one conversation of those before it, so
    # there are fewer such lines than partitions.
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        stored.groupBy("conv", "part").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(before)).where("_before IS NOT NULL")
        .select(F.col("conv").alias("_c"), F.col("part").alias("_p"), "_before")
    )
    met = local.join(
        F.broadcast(carried), (F.col("conv") == F.col("_c")) & (F.col("part") == F.col("_p")), "left"
    )
    pos = (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("bigint")
    return met.select("conv", pos.alias("pos"), "digest", "chars")


def reopened(turns: DataFrame, opener: Column, length: Column, longest: int) -> DataFrame:
    """Turns of conversations that begin with those of another.

    ``opener`` and ``length``, at most ``longest``, are made from ``conv``: the first
    ``length`` turns of ``opener``, as far as it has them, replace as many own ones. A
    conversation that is left without turns has no row here.
    """
    conversations = turns.select("conv").distinct().select(
        "conv", opener.alias("_opener"), length.alias("_length")
    )
    openers = conversations.select(F.col("_opener").alias("_o")).distinct()
    first = snapshot(
        lookup_join(turns.where(F.col("pos") <= longest), openers, ("conv", "_o"), "left_semi",
                    even=True).withColumnRenamed("conv", "_of"),
        "openers",
    )
    opening = lookup_join(conversations, first, ("_opener", "_of"), even=True)
    opening = opening.where("pos <= _length").select("conv", "pos", "digest", "chars")
    known = first.groupBy("_of").agg(F.max("pos").alias("_known"))
    own = turns.withColumn("_opener", opener).withColumn("_length", length).where("pos > _length")
    taken = F.least("_length", F.coalesce("_known", F.lit(0)))
    moved = lookup_join(own, known, ("_opener", "_of"), "left").select(
        "conv", (F.col("pos") - F.col("_length") + taken).alias("pos"), "digest", "chars"
    )
    return opening.unionByName(moved)


# --- one shard ------------------------------------------------------------------------

_ENTRY = ("band", "conv", "pos", "x1", "x2", "chars", "s1", "s2", "more")
_NODE = pa.schema([
    ("shard", pa.int64()), ("at", pa.int32()), ("up", pa.int32()), ("band", pa.int64()),
    ("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()),
    ("p2", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("chars", pa.int64()),
    ("ends", pa.string()), ("through", pa.list_(pa.int64())),
])
_NODE_SCHEMA = (
    "shard BIGINT, at INT, up INT, band BIGINT, depth BIGINT, k1 BIGINT, k2 BIGINT, p1 BIGINT, "
    "p2 BIGINT, n BIGINT, low BIGINT, chars BIGINT, ends STRING, through ARRAY<BIGINT>"
)


class VerticalIndex:
    """Bitsets of the conversations of one shard and band, by position and turn.

    ``turns[i]`` holds the (x1, x2, chars) of conversation i from the band's first position
    on; ``more[i]`` says that it goes on in the next band.
    """

    def __init__(self, base: int, convs: list[int], turns: list[list[tuple[int, int, int]]],
                 more: list[bool]):
        self.base, self.convs, self.turns = base, convs, turns
        self.postings: dict[tuple[int, int, int], int] = {}
        # By depth: conversations that have a turn after it here, and that end with it.
        self.longer: dict[int, int] = {}
        self.ending: dict[int, int] = {}
        self.going_on = sum(1 << i for i, on in enumerate(more) if on)
        for i, own in enumerate(turns):
            bit = 1 << i
            for step, (x1, x2, _) in enumerate(own):
                depth = base + step
                self.longer[depth] = self.longer.get(depth, 0) | bit
                posting = (depth + 1, x1, x2)
                self.postings[posting] = self.postings.get(posting, 0) | bit
            if not more[i]:
                end = base + len(own)
                self.ending[end] = self.ending.get(end, 0) | bit

    def members(self, bits: int) -> list[int]:
        found = []
        while bits:
            low = bits & -bits
            found.append(self.convs[low.bit_length() - 1])
            bits ^= low
        return found

    def children(self, bits: int, depth: int) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """Each child's bitset with its turn, by intersecting the parent's with postings."""
        rest = bits & self.longer.get(depth, 0)
        while rest:
            first = (rest & -rest).bit_length() - 1
            turn = self.turns[first][depth - self.base]
            child = bits & self.postings[(depth + 1, turn[0], turn[1])]
            yield child, turn
            rest &= ~child

    def walk(self, bits: int, key: tuple[int, int], root: bool) -> Iterator[tuple]:
        """(up, depth, key, parent's key, bits, chars) depth first; ``up`` is the parent's place.

        Without ``root`` the starting node belongs to the band before and is left out.
        """
        place = 0
        todo = [(-1, self.base, key, key, bits, 0)]
        while todo:
            node = todo.pop()
            _, depth, own, _, bits, _ = node
            at = -1
            if root or depth > self.base:
                yield node
                at, place = place, place + 1
            for child, (x1, x2, chars) in self.children(bits, depth):
                todo.append((at, depth + 1, (own[0] ^ x1, own[1] ^ x2), own, child, chars))


def _shard_rows(shard: int, rows: dict[str, np.ndarray], band_length: int) -> pa.RecordBatch:
    band = int(rows["band"][0])
    begins = np.flatnonzero(np.append(True, rows["conv"][1:] != rows["conv"][:-1]))
    ends = np.append(begins[1:], len(rows["conv"]))
    real = rows["pos"] > 0
    packed = list(zip(*(rows[c].tolist() for c in ("x1", "x2", "chars"))))
    turns = [[packed[i] for i in range(b, e) if real[i]] for b, e in zip(begins, ends)]
    index = VerticalIndex(
        band * band_length, rows["conv"][begins].tolist(), turns, rows["more"][begins].tolist()
    )
    starts: dict[tuple[int, int], int] = {}
    for i, b in enumerate(begins):
        start = (int(rows["s1"][b]), int(rows["s2"][b]))
        starts[start] = starts.get(start, 0) | (1 << i)
    out: list[list] = [[] for _ in _NODE]
    for start, bits in starts.items():
        offset = len(out[0])
        for up, depth, key, parent, own, chars in index.walk(bits, start, root=band == 0):
            ended = index.members(own & index.ending.get(depth, 0))
            through = []
            if depth == index.base + band_length:
                through = index.members(own & index.going_on)
            low = index.convs[(own & -own).bit_length() - 1]
            line = (shard, len(out[0]), up + offset if up >= 0 else -1, band, depth, *key, *parent,
                    own.bit_count(), low, chars, ",".join(map(str, ended)) if ended else None,
                    through or None)
            for column, value in zip(out, line):
                column.append(value)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(out, _NODE)], schema=_NODE
    )


def _shards(batches: Iterator[pa.RecordBatch], most: int, turns: int) -> Iterator[dict]:
    """Runs of whole conversations of one band from rows sorted by band, conversation, position."""
    waiting: dict[str, np.ndarray] | None = None

    def cut(rows: dict, whole: bool) -> tuple[list[dict], dict | None]:
        size = len(rows["conv"])
        fresh = np.append(True, (rows["conv"][1:] != rows["conv"][:-1])
                          | (rows["band"][1:] != rows["band"][:-1]))
        begins = np.append(np.flatnonzero(fresh), size).tolist()
        found, first, held = [], 0, 0
        # The last conversation may go on in the next batch.
        for g in range(len(begins) - (1 if whole else 2)):
            begin, end = begins[g], begins[g + 1]
            if held and (
                held >= most or end - first > turns or rows["band"][begin] != rows["band"][first]
            ):
                found.append({c: v[first:begin] for c, v in rows.items()})
                first, held = begin, 0
            held += 1
        if whole:
            found.append({c: v[first:] for c, v in rows.items()})
            return found, None
        return found, {c: v[first:] for c, v in rows.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
               for c in _ENTRY}
        rows = new if waiting is None else {c: np.concatenate([waiting[c], new[c]]) for c in _ENTRY}
        found, waiting = cut(rows, False)
        yield from found
    if waiting is not None:
        yield from cut(waiting, True)[0]


# --- all shards -----------------------------------------------------------------------


def _entries(turns: DataFrame, conversations: DataFrame, band_length: int) -> DataFrame:
    """Rows of ``_ENTRY``: turns with their hash bits and the key that their band starts at."""
    hashed = turns.select(
        F.floor((F.col("pos") - 1) / band_length).cast("bigint").alias("band"), "conv", "pos",
        F.xxhash64(F.lit(1), "pos", "digest").alias("x1"),
        F.xxhash64(F.lit(2), "pos", "digest").alias("x2"), "chars",
    )
    long = hashed.where("band > 0").select("conv").distinct()
    marked = snapshot(
        lookup_join(hashed, long.withColumn("_long", F.lit(True)), "conv", "left"), "trie-turns"
    )
    zero = F.lit(0).cast("bigint")
    short = marked.where("_long IS NULL").drop("_long").withColumns(
        {"s1": zero, "s2": zero, "more": F.lit(False)}
    )
    # One line per band of a long conversation.
    order = Window.partitionBy("_c").orderBy("_b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        marked.where("_long").groupBy(F.col("conv").alias("_c"), F.col("band").alias("_b"))
        .agg(F.bit_xor("x1").alias("_x1"), F.bit_xor("x2").alias("_x2"))
        .select(
            "_c", "_b",
            F.coalesce(F.bit_xor("_x1").over(before), zero).alias("s1"),
            F.coalesce(F.bit_xor("_x2").over(before), zero).alias("s2"),
            F.lead("_b").over(order).isNotNull().alias("more"),
        )
    )
    rest = marked.where("_long").drop("_long").join(
        starts, (F.col("conv") == F.col("_c")) & (F.col("band") == F.col("_b"))
    ).drop("_c", "_b")
    # A line for every conversation, so that those without turns are members of the root.
    roots = lookup_join(
        conversations.select("conv"), rest.where("band = 0 AND pos = 1").select("conv", "more"),
        "conv", "left", even=True,
    ).select(
        zero.alias("band"), "conv", *[zero.alias(c) for c in ("pos", "x1", "x2", "chars", "s1", "s2")],
        F.coalesce("more", F.lit(False)).alias("more"),
    )
    return short.unionByName(rest).unionByName(roots).select(*_ENTRY)


def shard_nodes(
    turns: DataFrame, conversations: DataFrame, band_length: int = BAND,
    most: int = SHARD_CONVERSATIONS, most_turns: int = SHARD_TURNS,
) -> DataFrame:
    """The nodes of every shard's trie, each with the place of its parent in the shard.

    ``turns`` are (conv, pos, digest, chars), ``conversations`` the distinct ids, those
    without turns too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, rows in enumerate(_shards(batches, most, most_turns)):
            yield _shard_rows((part << 32) | number, rows, band_length)

    entries = _entries(turns, conversations, band_length)
    return (
        entries.repartitionByRange("band", "conv").sortWithinPartitions("band", "conv", "pos")
        .mapInArrow(run, _NODE_SCHEMA)
    )


def _key(first: str, second: str) -> Column:
    return F.concat_ws(":", F.col(first).cast("string"), F.col(second).cast("string"))


def _end_digests(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256): the runs of a node's end list hashed one after another."""
    schema = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            keys, digests = [], []
            for key, ends in zip(batch.column(0).to_pylist(), batch.column(2)):
                if key == at:
                    state.update(b",")
                else:
                    if at is not None:
                        keys.append(at)
                        digests.append(state.hexdigest())
                    at, state = key, hashlib.sha256()
                state.update(ends.as_buffer())
            yield pa.RecordBatch.from_pydict({"key": keys, "ends_sha256": digests}, schema)
        if at is not None:
            yield pa.RecordBatch.from_pydict(
                {"key": [at], "ends_sha256": [state.hexdigest()]}, schema
            )

    runs = nodes.where("ends IS NOT NULL").select("key", "shard", "ends")
    return (
        runs.repartition("key").sortWithinPartitions("key", "shard")
        .mapInArrow(run, "key STRING, ends_sha256 STRING")
    )


def _handed_up(local: DataFrame) -> DataFrame:
    """(shard, at, _w, _leaves): what lies below the node at the end of a band, in later bands."""
    later = local.where("band > 0").groupBy(F.col("low").alias("c"), "band").agg(
        F.sum("_w").alias("_w"), F.sum("_leaf").alias("_leaves")
    )
    asked = local.where("through IS NOT NULL").select(
        F.explode("through").alias("c"), "band", "shard", "at"
    )
    none = F.lit(None).cast("bigint")
    both = asked.withColumns({"_w": none, "_leaves": none}).unionByName(
        later, allowMissingColumns=True
    )
    # Bands from the last on; a node's line comes before what its own band adds.
    run = (
        Window.partitionBy("c").orderBy(F.desc("band"), F.col("shard").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = both.select(
        "shard", "at", F.sum("_w").over(run).alias("_w"), F.sum("_leaves").over(run).alias("_leaves")
    ).where("shard IS NOT NULL")
    return summed.groupBy("shard", "at").agg(
        F.sum("_w").alias("_more_w"), F.sum("_leaves").alias("_more_leaves")
    )


def _subtree_sums(local: DataFrame) -> DataFrame:
    """(key, saved, leaves) of each shard's nodes, summed over their subtrees in it."""
    schema = pa.schema([("key", pa.string()), ("saved", pa.int64()), ("leaves", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy())
        up = table.column("up").to_numpy()[order].tolist()
        saved, leaves = (table.column(c).to_numpy()[order].tolist() for c in ("_w", "_leaf"))
        # A parent comes before its children, and every shard holds all of its own trie.
        for i in range(len(up) - 1, -1, -1):
            if up[i] >= 0:
                saved[up[i]] += saved[i]
                leaves[up[i]] += leaves[i]
        keys = table.column("key").take(pa.array(order))
        return pa.table([keys, pa.array(saved, pa.int64()), pa.array(leaves, pa.int64())], schema)

    return local.groupBy("shard").applyInArrow(run, "key STRING, saved BIGINT, leaves BIGINT")


def trie(turns: DataFrame, conversations: DataFrame, **limits: int) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and its ``key`` and ``parent`` key.

    ``turns`` and ``conversations`` are those of :func:`shard_nodes`, and so are the limits.
    """
    nodes = snapshot(
        shard_nodes(turns, conversations, **limits)
        .withColumn("key", _key("k1", "k2"))
        .withColumn("parent", F.when(F.col("depth") > 0, _key("p1", "p2")))
        .drop("k1", "k2", "p1", "p2"),
        "trie-nodes",
    )
    whole = nodes.groupBy("key").agg(
        F.min("low").alias("conv_id"), F.first("depth").alias("depth"),
        F.first("parent").alias("parent"), F.sum("n").alias("n_convs"),
        F.min("shard").alias("_owner"),
    )
    whole = snapshot(whole, "trie-whole")
    children = whole.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_p")).agg(
        F.count("*").alias("_children")
    )
    whole = snapshot(
        lookup_join(whole, children, ("key", "_p"), "left", even=True)
        .withColumn("n_children", F.coalesce("_children", F.lit(0)).cast("bigint"))
        .drop("_p", "_children"),
        "trie-whole",
    )
    once = (F.col("shard") == F.col("_owner")).cast("bigint")
    # In a shard a node has at most one row, so no key is hot.
    local = lookup_join(
        nodes.drop("ends", "parent", "depth"), whole.select("key", "_owner", "n_children"), "key",
        even=True,
    ).withColumns({
        "_w": (F.col("n") - once) * F.col("chars"),
        "_leaf": once * (F.col("n_children") == 0).cast("bigint"),
    }).select("shard", "at", "up", "band", "key", "low", "through", "_w", "_leaf")
    if not nodes.where("band > 0").isEmpty():
        local = snapshot(local, "trie-local")
        more = _handed_up(local).withColumnsRenamed({"shard": "_s", "at": "_a"})
        met = local.join(more, (F.col("shard") == F.col("_s")) & (F.col("at") == F.col("_a")), "left")
        local = met.withColumns({
            "_w": F.col("_w") + F.coalesce("_more_w", F.lit(0)),
            "_leaf": F.col("_leaf") + F.coalesce("_more_leaves", F.lit(0)),
        })
    sums = _subtree_sums(local.select("shard", "at", "up", "key", "_w", "_leaf"))
    totals = sums.groupBy("key").agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")
    )
    ends = _end_digests(nodes)
    named = whole.select(F.col("key").alias("_k"), F.col("conv_id").alias("parent_conv_id"))
    found = lookup_join(whole.drop("_owner"), snapshot(totals, "trie-sums"), "key", even=True)
    found = lookup_join(found, snapshot(ends, "trie-ends"), "key", "left", even=True)
    found = lookup_join(found, named, ("parent", "_k"), "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "key", "parent",
    )


TRIE_SQL = """
WITH RECURSIVE c AS (
    SELECT conv_id, conv_id - conv_id % 100 AS opener,
           xor(list_reduce(
               list_prepend(4294967295, flatten(list_transform(
                   string_split(CAST(conv_id AS VARCHAR), ''),
                   lambda x: list_prepend(CAST(ascii(x) AS BIGINT), list_resize([-1], 8, -1))))),
               lambda a, b: CASE WHEN b >= 0 THEN xor(a, b)
                                 WHEN a % 2 = 1 THEN xor(a // 2, 3988292384)
                                 ELSE a // 2 END), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
    FROM conversations
), r AS (
    SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.opener AND pos <= h
    UNION ALL
    SELECT c.conv_id, pos - h + least(h, coalesce(n, 0)), role, text
    FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
    LEFT JOIN (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id) o ON o.conv_id = c.opener
), path AS (
    SELECT conv_id, 0 AS depth, min(conv_id) OVER () AS node, CAST(NULL AS BIGINT) AS parent,
           0 AS chars
    FROM c
    UNION ALL
    SELECT p.conv_id, p.depth + 1, min(p.conv_id) OVER (PARTITION BY p.node, role, text), p.node,
           length(text)
    FROM path p JOIN r ON r.conv_id = p.conv_id AND r.pos = p.depth + 1
), node AS (
    SELECT depth, node, any_value(parent) AS parent, count(*) AS n_convs,
           any_value(chars) AS chars
    FROM path GROUP BY depth, node
), kids AS (
    SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL
), below AS (
    SELECT DISTINCT a.depth, a.node, b.depth AS depth2, b.node AS node2
    FROM path a JOIN path b ON b.conv_id = a.conv_id AND b.depth >= a.depth
), sums AS (
    SELECT b.depth, b.node, sum((n.n_convs - 1) * n.chars) AS saved,
           count(*) FILTER (kids.n IS NULL) AS leaves
    FROM below b JOIN node n ON n.depth = b.depth2 AND n.node = b.node2
    LEFT JOIN kids ON kids.depth = b.depth2 AND kids.node = b.node2
    GROUP BY b.depth, b.node
), ends AS (
    SELECT depth, node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
    FROM path SEMI JOIN (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id) l
        USING (conv_id, depth)
    GROUP BY depth, node
)
SELECT node.node AS conv_id, CAST(node.depth AS BIGINT) AS depth, parent AS parent_conv_id,
       n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN sums USING (depth, node) LEFT JOIN kids USING (depth, node)
LEFT JOIN ends USING (depth, node)
"""
