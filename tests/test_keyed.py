import random
import re
from collections import Counter

import pytest

from loadlens.operators import keyed
from loadlens.operators.sorted_table import sort_table
from loadlens.plans import mixes
from loadlens.sources import generated


def replay(table, log, upsert=False):
    state = dict(table)
    for seq, op, key, val in sorted(log):
        if op == "insert" or (op == "update" and (upsert or key in state)):
            state[key] = val
        elif op == "delete":
            state.pop(key, None)
    return state


def random_log(seed, size=600, keys=40):
    rng = random.Random(seed)
    ops = ["insert", "update", "delete", "read"]
    # One key takes a third of the operations.
    return [
        (i, rng.choice(ops), 7 if rng.random() < 0.33 else rng.randrange(keys), rng.random())
        for i in range(size)
    ]


@pytest.mark.parametrize("upsert", [False, True])
@pytest.mark.parametrize("rows", [0, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_applying_a_log_is_like_replaying_it(spark, upsert, rows, seed):
    table = [(k, float(k)) for k in range(0, 30)]
    log = random_log(seed)
    found = keyed.apply_writes(
        spark.createDataFrame(table, "key bigint, val double"),
        spark.createDataFrame(log, "seq bigint, op string, key bigint, val double"),
        upsert,
        rows,
    ).collect()
    assert len(found) == len({r.key for r in found})
    assert {r.key: r.val for r in found} == replay(table, log, upsert)


def test_other_columns_survive(spark):
    table = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "key bigint, val double, s string")
    log = spark.createDataFrame(
        [(1, "update", 1, 9.0), (2, "insert", 3, 5.0)], "seq bigint, op string, key bigint, val double"
    )
    for rows in (0, 10):
        found = sorted(tuple(r) for r in keyed.apply_writes(table, log, broadcast_rows=rows).collect())
        assert found == [(1, 9.0, "a"), (2, 2.0, "b"), (3, 5.0, None)]


@pytest.mark.parametrize("rows", [0, 1000])
@pytest.mark.parametrize("slices", [1, 5, None])
def test_range_scan(spark, rows, slices):
    rng = random.Random(3)
    keys = sorted(rng.sample(range(5000), 900))
    table = spark.createDataFrame([(k, k / 2) for k in keys], "key bigint, val double")
    requests = [(i, 700 if i % 3 == 0 else rng.randrange(-10, 5100), rng.randrange(1, 200))
                for i in range(150)]
    df = spark.createDataFrame(requests, "req_id bigint, start bigint, scan_len int")
    found = {}
    for r in keyed.range_scan(df, table, slices, rows).collect():
        assert r.val == r.key / 2
        found.setdefault(r.req_id, []).append((r.pos, r.key))
    for req, start, length in requests:
        wanted = [k for k in keys if k >= start][:length]
        assert sorted(found.get(req, [])) == list(enumerate(wanted))


def scanned(found):
    rows = {}
    for r in found.collect():
        rows.setdefault(r.req_id, []).append((r.pos, r.key))
    return {q: sorted(v) for q, v in rows.items()}


def test_a_sorted_table_is_read_where_it_is_asked(spark):
    keys = list(range(0, 60_000, 3))
    table = spark.createDataFrame([(k, k / 2) for k in keys], "key bigint, val double")
    stored = sort_table(table.repartition(5), parts=20)
    assert len(stored.parts) == 20 and stored.size() == len(keys)
    requests = spark.createDataFrame([(1, 30_001, 150)], "req_id bigint, start bigint, scan_len int")
    found = keyed.range_scan(requests, stored)
    assert scanned(found) == {1: list(enumerate(k for k in keys if k >= 30_001))[:150]}
    plan = found._jdf.queryExecution().toString()
    parts = re.search(r"PartitionFilters: \[_part#\d+ IN \(([\d,]+)\)", plan) or re.search(
        r"PartitionFilters: \[isnotnull\(_part#\d+\), \(_part#\d+ = (\d+)\)", plan)
    assert parts and len(parts[1].split(",")) <= 2
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    # Blocks that this read covers, of 160 in the table.
    low, high = (int(re.search(rf"{op}\(key,(\d+)\)", plan)[1]) for op in ("GreaterThanOrEqual", "LessThan"))
    assert (high - low) // 3 <= 4 * 128


def test_scans_at_the_edges_of_a_sorted_table(spark):
    keys = [k * 7 for k in range(1000)]
    stored = sort_table(spark.createDataFrame([(k, 0.0) for k in keys], "key bigint, val double"), 9)
    asked = [(1, -50, 3), (2, 0, 2), (3, 6993, 5), (4, 6994, 5), (5, 6900, 5000), (6, 5, 0), (7, None, 3)]
    df = spark.createDataFrame(asked, "req_id bigint, start bigint, scan_len int")
    for rows in (0, 1000):
        found = scanned(keyed.range_scan(df, stored, slices=4, broadcast_rows=rows))
        for req, start, length in asked:
            wanted = [k for k in keys if start is not None and k >= start][:length]
            assert found.get(req, []) == list(enumerate(wanted))
    assert keyed.range_scan(df.limit(0), stored).columns == ["req_id", "pos", "key", "val"]
    nothing = sort_table(spark.createDataFrame([], "key bigint, val double"))
    assert keyed.range_scan(df, nothing).count() == 0


def test_rmw_adds_up(spark):
    table = spark.createDataFrame([(1, 1.0), (2, 2.0)], "key bigint, val double")
    log = spark.createDataFrame(
        [(1, "rmw", 1, 5.0), (2, "rmw", 1, -2.0), (3, "rmw", 9, 1.0), (4, "update", 2, 8.0)],
        "seq bigint, op string, key bigint, val double",
    )
    for rows in (0, 10):
        found = {r.key: r.val for r in keyed.apply_rmw(table, log, rows).collect()}
        assert found == {1: 4.0, 2: 2.0}
        found = {r.key: r.val for r in keyed.apply_updates(table, log, rows).collect()}
        assert found == {1: 1.0, 2: 8.0}


def test_lookup_delete_insert_latest(spark):
    table = spark.createDataFrame([(k, float(k)) for k in range(10)], "key bigint, val double")
    asked = spark.createDataFrame([(1, 3), (2, 3), (3, 77)], "req_id bigint, key bigint")
    found = {r.req_id: (r.val, r.found) for r in keyed.point_lookup(asked, table).collect()}
    assert found == {1: (3.0, True), 2: (3.0, True), 3: (None, False)}
    left = keyed.delete_keys(table, asked.select("key"))
    assert sorted(r.key for r in left.collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    more = keyed.insert_rows(left, spark.createDataFrame([(3, 0.5)], "key bigint, val double"))
    assert more.count() == 10
    assert [r.key for r in keyed.read_latest(table, 3, "key").collect()] == [9, 8, 7]


def test_mixes_add_up_and_are_drawn_as_stated(spark):
    ids = generated.sequence_ids(spark, 20000)
    for name, mix in keyed.MIXES.items():
        assert sum(mix.values()) == 100
        rows = keyed.op_log(ids, mix, 1, 1000).collect()
        shares = Counter(r.op for r in rows)
        for op, share in mix.items():
            assert abs(shares[op] / 200 - share) < 2
        for r in rows:
            if r.op == "insert":
                assert r.key > 1000
            else:
                assert 1 <= r.key <= 1000
            assert (r.op == "scan") == (r.scan_len is not None)
            assert r.scan_len is None or 1 <= r.scan_len <= keyed.MAX_SCAN
    with pytest.raises(ValueError):
        keyed.op_log(ids, {"read": 50}, 1, 10)


def test_keys_beyond_32_bits_are_drawn(spark):
    log = keyed.op_log(spark.range(0, 20000), keyed.MIXES["a"], 1, 2**34)
    upper = log.where("key > 8589934592").count()
    assert abs(upper / 20000 - 0.5) < 0.02


def test_skewed_and_latest_keys_are_drawn_as_often_as_stated(spark):
    count, draws = 1000, 60_000
    weights = [(r + 1) ** -0.99 for r in range(count)]
    latest = Counter(r.key for r in keyed.op_log(
        spark.range(draws), {"read": 100}, 1, count, choice="latest", newest=5000).collect())
    assert max(latest) == 5000 and min(latest) > 4000
    for low, high in ((0, 1), (1, 3), (3, 15), (15, 127), (127, 511), (511, 1000)):
        share = sum(weights[low:high]) / sum(weights)
        assert abs(sum(latest[5000 - r] for r in range(low, high)) / draws - share) < 0.03
    skewed = Counter(r.key for r in keyed.op_log(
        spark.range(draws), {"read": 100}, 1, count, choice="skewed").collect())
    assert all(1 <= k <= count for k in skewed)
    (hot, most), (_, second) = skewed.most_common(2)
    assert hot != 1 and most / draws > 0.09 and second < most
    with pytest.raises(ValueError):
        keyed.op_log(spark.range(3), {"read": 100}, 1, 10, choice="newest")


def test_running_all_mixes(spark):
    table = spark.createDataFrame([(k, float(k)) for k in range(1, 101)], "key bigint, val double")
    report, last = mixes.run_mixes(table, generated.sequence_ids(spark, 1000))
    rows = report.collect()
    assert {r.mix for r in rows} == set(keyed.MIXES)
    per_mix = Counter()
    for r in rows:
        per_mix[r.mix] += r.ops
        assert r.hits + r.misses == r.ops
        if r.op == "insert":
            assert r.hits == 0
        if r.op == "scan":
            assert 0 < r.rows_read <= r.ops * keyed.MAX_SCAN
        else:
            assert r.rows_read == (r.hits if r.op in ("read", "rmw") else 0)
    assert set(per_mix.values()) == {1000}
    inserted = {r.mix: r.keys_touched for r in rows if r.op == "insert"}
    assert last.count() == 100 + sum(inserted.values())
    assert last.select("key").distinct().count() == last.count()
