import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.operators import checks
from loadlens.session import scratch_path, snapshot
from loadlens.sources import delimited, sinks, tables

MODE = "1|AAAA|EXPRESS||UPS||\n2|BBBB|REGULAR|SEA|DHL|x|\n"


def test_declared_columns_are_complete(spark):
    counts = {t: len(schemas.columns(d)) for t, d in schemas.TPCDS.items()}
    assert counts == {"catalog_sales": 34, "warehouse": 14, "ship_mode": 6, "call_center": 31,
                      "date_dim": 28, "web_sales": 34}
    assert {t: len(schemas.columns(d)) for t, d in schemas.TPCH.items()} == {
        "nation": 4, "region": 3, "part": 9, "supplier": 7, "partsupp": 5, "customer": 8,
        "orders": 9, "lineitem": 16}
    for table, key in schemas.TPCH_KEYS.items():
        assert set(key) <= set(schemas.columns(schemas.TPCH[table]))


def test_trailing_delimiter(spark, tmp_path):
    (tmp_path / "ship_mode.dat").write_text(MODE)
    rows = delimited.read_delimited(spark, str(tmp_path), schemas.TPCDS["ship_mode"]).collect()
    assert [tuple(r) for r in rows] == [
        (1, "AAAA", "EXPRESS", None, "UPS", None), (2, "BBBB", "REGULAR", "SEA", "DHL", "x")
    ]
    (tmp_path / "bad.dat").write_text("one|AAAA\n")
    with pytest.raises(Exception):
        delimited.read_delimited(spark, str(tmp_path), schemas.TPCDS["ship_mode"]).collect()
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.dat").write_text("1|x\n")
    rows = delimited.read_delimited(spark, str(plain), "a INT, b STRING", trailing=False)
    assert [tuple(r) for r in rows.collect()] == [(1, "x")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "a", Decimal("1.50"), dt.date(2000, 1, 2)), (2, None, None, None)],
        "a int, b string, c decimal(7,2), d date",
    )
    path = str(tmp_path / "t")
    delimited.write_delimited(df, path)
    back = delimited.read_delimited(spark, path, "a INT, b STRING, c DECIMAL(7,2), d DATE")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_external_tables_and_cleanup(spark, tmp_path):
    (tmp_path / "ship_mode.dat").write_text(MODE)
    names = ["ship_mode", "warehouse"]
    delimited.drop_tables(spark, names)
    assert checks.missing_tables(spark, names) == names
    delimited.declare_external(spark, "ship_mode", schemas.TPCDS["ship_mode"], str(tmp_path))
    assert "ship_mode" in tables.list_tables(spark)
    assert checks.missing_tables(spark, names) == ["warehouse"]
    assert spark.sql("SELECT sm_type FROM ship_mode ORDER BY 1").first()[0] == "EXPRESS"
    delimited.drop_tables(spark, names)
    delimited.drop_tables(spark, names)
    assert "ship_mode" not in tables.list_tables(spark)
    assert (tmp_path / "ship_mode.dat").exists()


def test_bulk_load(spark, tmp_path):
    (tmp_path / "region.tbl").write_text("0|AFRICA|x|\n1|ASIA|y|\n")
    (tmp_path / "nation.tbl").write_text("5|PERU|1|z|\n")
    done = delimited.load_tables(spark, str(tmp_path), str(tmp_path / "out"), schemas.TPCH)
    assert sorted(done) == ["nation", "region"]
    region = tables.read_table(spark, str(tmp_path / "out"), "region")
    assert region.dtypes[0] == ("r_regionkey", "int") and region.count() == 2
    tables.register({"r": region})
    assert spark.table("r").count() == 2
    counts = {r.table_name: r.row_count for r in checks.table_counts({"r": region, "s": region}).collect()}
    assert counts == {"r": 2, "s": 2}


def test_presence(spark):
    found = {r.table_name: r.present for r in tables.present(
        spark, "/root/testdata/sf0.001", ["lineitem", "partsupp"]).collect()}
    assert found == {"lineitem": True, "partsupp": False}
    nation = tables.read_table(spark, "/root/testdata/sf0.001", "nation")
    assert tables.count_check(nation, "nation").first().asDict() == {"nation_count": 25}


def test_key_check(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "c")], "k int, v string")
    row = checks.key_check(df, "t", ["k"], ["k", "v"]).first()
    assert (row.row_count, row.distinct_keys, row.duplicate_keys, row.null_values) == (3, 2, 1, 1)
    empty = checks.key_check(df.where("false"), "t", ["k"], ["k"]).first()
    assert (empty.row_count, empty.null_values) == (0, 0)


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    sinks.discard(df)
    for _ in range(2):
        sinks.write_csv(df, str(tmp_path / "csv"))
        sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.csv(str(tmp_path / "csv")).count() == 10
    assert spark.read.json(str(tmp_path / "json")).agg(F.sum("v")).first()[0] == 90
    assert sinks.as_json(df).orderBy("json").first()[0] == '{"id":0,"v":0}'
    assert len(sinks.preview(df, 3)) == 3
    spark.sql("DROP TABLE IF EXISTS sink_rows")
    spark.sql(f"CREATE TABLE sink_rows (id BIGINT, v BIGINT) USING parquet LOCATION '{tmp_path}/t'")
    sinks.insert_into(df, "sink_rows")
    sinks.insert_into(df, "sink_rows")
    assert spark.table("sink_rows").count() == 20
    spark.sql("DROP TABLE sink_rows")


def test_scratch_is_shared_and_fresh(spark):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = snapshot(spark.range(5).withColumn("r", F.rand()), "rand")
    assert kept.collect() == kept.collect()


def test_rejected_samples_are_reported(spark, tmp_path):
    from loadlens.sources import logs

    (tmp_path / "s.txt").write_text("1\n\nabc\n-5\n" + "9" * 23 + "\n7\n3.5\n")
    assert [int(r.v) for r in logs.read_samples(spark, str(tmp_path)).orderBy("pos").collect()] == [1, 7]
    found = logs.rejected_samples(spark, str(tmp_path)).orderBy("pos").collect()
    number = "not an unsigned 64-bit number"
    assert [r.reason for r in found] == ["not a number", number, number, number]


def test_bulk_load_is_all_or_none_and_keeps_broken_lines(spark, tmp_path):
    ddl, target = {"a": "k INT, v DOUBLE", "b": "k INT"}, str(tmp_path / "out")
    (tmp_path / "a.tbl").write_text("1|2.5|\n2|x|\n3|\n4|1|2|\n5||\n")
    with pytest.raises(FileNotFoundError, match="b"):
        delimited.bulk_load(spark, str(tmp_path), target, ddl)
    (tmp_path / "b.tbl").write_text("7|\n")
    with pytest.raises(ValueError, match="3 malformed lines of 5"):
        delimited.bulk_load(spark, str(tmp_path), target, ddl)
    with pytest.raises(FileNotFoundError):
        delimited.loaded_table(spark, target, "b", ddl["b"])
    found = delimited.bulk_load(spark, str(tmp_path), target, ddl, most_rejected=3).collect()
    assert {(r.name, r.loaded, r.rejected) for r in found} == {("a", 2, 3), ("b", 1, 0)}
    assert sorted(map(tuple, delimited.loaded_table(spark, target, "a", ddl["a"]).collect())) == [
        (1, 2.5), (5, None)]
    assert sorted(map(tuple, delimited.rejected_lines(spark, target, "a").collect())) == [
        ("a.tbl", "1 of 2 fields", "3|"), ("a.tbl", "3 of 2 fields", "4|1|2|"),
        ("a.tbl", "a value of another type", "2|x|")]
    # A later load that fails leaves the one before in place; one that is whole replaces it.
    (tmp_path / "b.tbl").write_text("8|\n9|y|z|\n")
    with pytest.raises(ValueError):
        delimited.bulk_load(spark, str(tmp_path), target, {"b": "k INT"})
    assert delimited.loaded_table(spark, target, "b", "k INT").collect()[0].k == 7
    (tmp_path / "b.tbl").write_text("8|\n9|\n")
    delimited.bulk_load(spark, str(tmp_path), target, {"b": "k INT", "c": "k INT"}, required=["b"])
    assert sorted(r.k for r in delimited.loaded_table(spark, target, "b", "k INT").collect()) == [8, 9]
    (tmp_path / "b.tbl").write_text("")
    delimited.bulk_load(spark, str(tmp_path), target, {"b": "k INT"})
    assert delimited.loaded_table(spark, target, "b", "k INT").count() == 0


def test_a_new_declaration_replaces_an_external_one(spark, tmp_path):
    for n, text in enumerate(("1|a|\n", "2|b|c|\n")):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "x.dat").write_text(text)
    delimited.declare_external(spark, "declared", "k INT, v STRING", str(tmp_path / "0"))
    delimited.declare_external(spark, "declared", "k INT, v STRING, w STRING", str(tmp_path / "1"))
    assert [tuple(r) for r in spark.sql("SELECT k, v, w FROM declared").collect()] == [(2, "b", "c")]
    delimited.drop_tables(spark, ["declared"])
    assert (tmp_path / "0" / "x.dat").exists()
    spark.range(3).createOrReplaceTempView("declared")
    with pytest.raises(ValueError, match="no external table"):
        delimited.declare_external(spark, "declared", "k INT", str(tmp_path / "0"))
    delimited.drop_tables(spark, ["declared"])
