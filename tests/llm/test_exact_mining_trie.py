"""Exact duplicates, hard negatives and the prefix trie against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.llm import hard_negatives, prefix_trie, queries, radix
from tests.compare import differences, oracle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_prefix_trie", "op13_exact_dedup"])
def test_agrees_with_sql(spark, name):
    assert differences(spark, oracle(SMALL), SMALL, name) == []


# --- exact duplicates -------------------------------------------------------------


def documents(spark, rows):
    """Extra columns clash with internal names."""
    return spark.createDataFrame(
        [(i, t, "a", 1.5, True) for i, t in rows],
        "doc_id BIGINT, text STRING, _group STRING, _n DOUBLE, kept BOOLEAN",
    )


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(t.encode()).hexdigest()
        order = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, best, len(ids), n == 0, digest) for n, i in enumerate(order)]
    return sorted(map(repr, out))


def found(df):
    return sorted(
        repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in df.collect()
    )


LONG = "The same words, again and again. " * 9000
CASES = [
    (1, "Hello"), (2, "hELLO"), (3, "hello "), (4, None), (5, ""), (6, ""), (7, LONG),
    (8, LONG.upper()), (9, LONG[:-1] + "!"), (10, LONG + "x"), (11, "Ärger İ"), (12, "ärger İ"),
    (13, "ÄRGER İ"), (14, "ÄrgeR İ"), (7, LONG), (7, "other"), (None, "hello"), (None, "n"),
    (None, "N"), (20, "a" * 40 + "\U0001f600"), (21, "A" * 40 + "\U0001f600"), (22, "a" * 40 + "\U0001f601"),
    (23, "a\x00b"), (24, "A\x00B"), (25, "x" * 32), (26, "X" * 32), (27, "x" * 31 + "é"), (28, "5:hello"),
]


@pytest.mark.parametrize("broadcast_rows,head", [(200_000, 32), (0, 32), (0, 1), (200_000, 3)])
def test_exact_groups(spark, broadcast_rows, head):
    rows = CASES + [(100 + i, "One text that a third of all rows share, " * 30) for i in range(60)]
    got = radix.exact_groups(
        documents(spark, rows).repartition(5), carry={"text_sha256": lambda t: F.sha2(t, 256)},
        head=head, broadcast_rows=broadcast_rows,
    )
    assert found(got) == exact(rows)


def test_unique_keeps_whole_rows(spark):
    df = documents(spark, CASES)
    kept = radix.unique(df)
    assert kept.schema == df.schema
    assert sorted(lower(r.text) for r in kept.collect()) == sorted({lower(t) for _, t in CASES})
    assert {r.doc_id for r in kept.collect() if lower(r.text) == lower(LONG)} == {8}


def test_exact_groups_of_nothing(spark):
    assert radix.exact_groups(documents(spark, [])).count() == 0
    assert radix.exact_groups(documents(spark, [(1, None)])).collect()[0].kept


# --- hard negatives ---------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (33, 64, 129), (70, 100, 41), (0, 4, 3), (8, 0, 8)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a = rng.integers(-(1 << 23), 1 << 23, (m, k))
    b = rng.integers(-(1 << 23), 1 << 23, (k, n))
    assert (hard_negatives.strassen(a, b, leaf=2) == a @ b).all()


def test_strassen_wraps_like_a_ring():
    a = np.full((4, 4), 1 << 40, dtype=np.int64)
    b = np.array([[1 << 22] * 4, [-(1 << 22)] * 4] * 2, dtype=np.int64)
    assert (hard_negatives.strassen(a, b, leaf=1) == 0).all()


def test_heaps_merge_to_the_heap_of_all():
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 20, 400), rng.permutation(400)
    keys = np.zeros(400, dtype=np.int64)
    whole, left, right = (hard_negatives.Heap(10) for _ in range(3))
    whole.push(scores, ids, keys)
    left.push(scores[:150], ids[:150], keys[:150])
    right.push(scores[150:], ids[150:], keys[150:])
    left.merge(right)
    wanted = sorted(zip((-scores).tolist(), ids.tolist()))[:10]
    for heap in (whole, left):
        assert list(zip((-heap.scores).tolist(), heap.ids.tolist())) == wanted


def mined(rows, positives, negatives):
    sound = {}
    for i, label, v in rows:
        bad = v is None or any(x is None or not np.isfinite(x) for x in v)
        if i is not None and label is not None and not bad:
            sound[i] = (label, np.floor(np.array(v, dtype=np.float64) * 256).astype(np.int64))

    def score(a, b):
        short = min(len(a), len(b))
        return int(a[:short] @ b[:short])

    out = []
    for a, (label, v) in sound.items():
        if a % 10:
            continue
        scored = sorted((-score(v, w), i) for i, (_, w) in sound.items() if i != a)
        mine = [(i, -s) for s, i in scored if sound[i][0] == label][:positives]
        for p, ps in mine:
            other = [(i, -s) for s, i in scored
                     if sound[i][0] != label and 30 * ps <= -100 * s <= 90 * ps][:negatives]
            out += [(a, p, n + 1, i, ps, s) for n, (i, s) in enumerate(other)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1, 2.0) for r in rows],
        "vec_id BIGINT, label INT, embedding ARRAY<FLOAT>, key STRING, id INT, block DOUBLE",
    )


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 60, "anchor_rows": 7, "stretch": 16}])
def test_mining_matches_brute_force(spark, sizes):
    rng = np.random.default_rng(8)
    data = rng.normal(0.1, 0.3, (400, 12)).astype(np.float32)
    data[50:130] = data[10]  # ties
    rows = [(i, int(rng.integers(0, 3)), v.tolist()) for i, v in enumerate(data)]
    rows += [(500, 1, [0.0] * 12), (510, 2, []), (520, 0, [3.0]), (530, 9, [1.0] * 12)]
    odd = [(600, None, [1.0]), (610, 1, None), (620, 1, [1.0, None]), (630, 1, [float("nan")]),
           (640, 1, [float("inf")]), (None, 1, [1.0] * 12), rows[0], rows[10]]
    df = hard_negatives.labelled(vectors(spark, rows + odd))
    got = hard_negatives.mine(df, df.where(F.col("id") % 10 == 0), 3, 4, **sizes)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 3, 4)


def test_mining_with_repeated_ids_and_nothing(spark):
    rows = [(0, 1, [1.0]), (0, 1, [0.5]), (0, 2, [0.7]), (1, 1, [1.0]), (1, 2, [0.6]), (2, 2, [0.5])]
    df = hard_negatives.labelled(vectors(spark, rows))
    got = hard_negatives.mine(df, df.where("id = 0")).collect()
    # Row 1 is the only positive of both rows of label 1; rows of id 0 are no negatives.
    assert {(r.positive_id, r.negative_id) for r in got if r.positive_score == 65536} == {(1, 1), (1, 2)}
    assert all(r.negative_id != 0 and r.positive_id != 0 for r in got)
    none = hard_negatives.labelled(vectors(spark, []))
    assert hard_negatives.mine(none, none).count() == 0


# --- prefix trie --------------------------------------------------------------------


def conversations(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 3, 4) for r in rows],
        "conv_id BIGINT, turn BIGINT, role STRING, text STRING, key STRING, pos INT, band INT",
    )


def opening(c):
    return zlib.crc32(str(c).encode()) % 6


def brute_trie(rows, rebuild):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [t[2:] for t in sorted(own, key=lambda t: t[:2])] for c, own in said.items()}
    whole = plain
    if rebuild:
        whole = {
            c: plain.get(int(c / 100) * 100, [])[:opening(c)] + own[opening(c):]
            for c, own in plain.items()
        }
    members = defaultdict(set)
    for c, own in whole.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].add(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        own = members[path]
        saved = (len(own) - 1) * len(path[-1][1]) if path else 0
        below = [out[k] for k in kids[path]]
        ends = ",".join(str(c) for c in sorted(own) if len(whole[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out[path] = (min(own), len(path), parent, len(own), len(below),
                     sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below),
                     hashlib.sha256(ends.encode()).hexdigest())
    return sorted(map(repr, out.values()))


def trie_rows(df):
    return sorted(
        repr((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
              r.saved_tokens, r.ends_sha256)) for r in df.collect()
    )


def built(spark, rows, rebuild, **limits):
    turns = prefix_trie.numbered(conversations(spark, rows).repartition(6))
    ids = turns.select("conv").distinct()
    if rebuild:
        turns = prefix_trie.reopened(
            turns, F.col("conv") - F.col("conv") % 100, F.crc32(F.col("conv").cast("string")) % 6, 5
        )
    return trie_rows(prefix_trie.trie(turns, ids, **limits))


def chatter(seed=5, count=160):
    rng = np.random.default_rng(seed)
    rows = [(None, 0, "user", "no id")]
    for c in [*range(count), 205, 207, 333, 399, 9_000_000_000, -5, -250]:
        length = int(rng.integers(1, 9))
        rows += [(c, t if t else None, ("user", "bot", None)[int(rng.integers(0, 3))],
                  ("a", "b\U0001f600", None, "é")[int(rng.integers(0, 4))]) for t in range(length)]
    # Many equal conversations.
    return rows + [(10_000 + i, t, "user", f"same {t}") for i in range(90) for t in range(4)]


@pytest.mark.parametrize("limits", [{}, {"most": 7}, {"most_turns": 20, "band_length": 3},
                                    {"most": 1, "band_length": 1}])
@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_matches_brute_force(spark, rebuild, limits):
    rows = chatter()
    assert built(spark, rows, rebuild, **limits) == brute_trie(rows, rebuild)


def test_long_conversations_in_bands(spark):
    rows = [(c, t, "user", f"t{t}" if t < at else f"own {c} {t}")
            for c, length, at in ((1, 700, 700), (2, 1300, 600), (3, 1300, 1024), (4, 1024, 1024),
                                  (5, 1300, 1300), (6, 512, 512), (7, 1, 1))
            for t in range(length)]
    assert built(spark, rows, False, band_length=512) == brute_trie(rows, False)


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    # 107 has fewer turns than it gives up, and its opener does not exist.
    gone = next(c for c in range(101, 200) if opening(c) >= 2)
    rows = [(gone, 0, "user", "x"), (250, 0, "user", "y"), (250, 1, "user", "z")]
    assert built(spark, rows, True) == brute_trie(rows, True)
    root = [r for r in built(spark, rows, True) if ", 0, None," in r][0]
    assert hashlib.sha256(str(gone).encode()).hexdigest() in root or opening(250) >= 2


def test_repeated_turns_count_and_nothing_is_empty(spark):
    rows = [(1, 0, "u", "x"), (1, 0, "u", "x"), (2, 0, "u", "x")]
    assert len(built(spark, rows, False)) == 3
    assert built(spark, [], True) == []
