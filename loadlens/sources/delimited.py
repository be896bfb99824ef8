"""Pipe-delimited text tables, with or without a delimiter at the line end."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from loadlens import schemas
from loadlens.sources.tables import has_files

_TAIL = "_line_end"


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    ddl: str,
    trailing: bool = True,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Scan text under a declared schema.

    Generated files end each line with a delimiter, which makes one more, empty
    field: it is declared and dropped, so a malformed row is still told apart.
    Empty fields are NULL.
    """
    declared = schemas.schema(ddl)
    if trailing:
        declared = T.StructType([*declared.fields, T.StructField(_TAIL, T.StringType())])
    rows = spark.read.schema(declared).option("sep", "|").option("mode", mode).csv(path)
    return rows.drop(_TAIL)


def write_delimited(df: DataFrame, path: str) -> None:
    """Write text the way :func:`read_delimited` expects it by default."""
    plain = df.withColumn(_TAIL, F.lit(None).cast("string"))
    plain.write.mode("overwrite").option("sep", "|").option("nullValue", "").option(
        "emptyValue", ""
    ).csv(path)


def declare_external(spark: SparkSession, name: str, ddl: str, location: str) -> None:
    """Declare a table over delimited text that stays where it is.

    A malformed row fails the query that reads it, as in :func:`read_delimited`. An
    earlier declaration of the name is replaced; the text of an external table stays. A
    view or a table that owns its rows is not replaced.
    """
    columns = f"{schemas.column_ddl(ddl)}, {_TAIL} STRING"
    if spark.catalog.tableExists(name):
        kind = spark.catalog.getTable(name).tableType
        if kind != "EXTERNAL":
            raise ValueError(f"{name} is there and is no external table: {kind}")
        spark.sql(f"DROP TABLE `{name}`")
    spark.sql(
        f"CREATE TABLE `{name}` ({columns}) USING csv "
        f"OPTIONS (sep '|', mode 'FAILFAST') LOCATION '{location}'"
    )


def drop_tables(spark: SparkSession, names: Iterable[str]) -> None:
    """Drop tables and views if present, so that a rerun starts clean."""
    for name in names:
        spark.catalog.dropTempView(name)
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def bulk_load(
    spark: SparkSession,
    folder: str,
    target: str,
    tables: dict[str, str],
    suffix: str = ".tbl",
    required: Iterable[str] | None = None,
    most_rejected: int | None = 0,
) -> DataFrame:
    """Load text tables as typed Parquet, all of them or none; returns the new manifest.

    All ``required`` files (by default every table's) must be there before a line is
    read; a table that need not be there may be missing. Lines are parsed once. Malformed
    ones are kept apart with their file and the reason. Only when every table has at most
    ``most_rejected`` of them (None: any number) is the load published, by one committed
    file: until then :func:`loaded_table` reads what was loaded before.
    """
    paths = {name: f"{folder.rstrip('/')}/{name}{suffix}" for name in tables}
    present = {name for name, path in paths.items() if has_files(spark, path)}
    missing = sorted(set(tables if required is None else required) - present)
    if missing:
        raise FileNotFoundError(f"missing tables: {', '.join(missing)}")
    number = 1 + (_manifests(spark, target).agg(F.max("load")).first()[0] or 0)
    lines = []
    for name in sorted(present):
        staged = f"{target.rstrip('/')}/loads/{number}-{uuid.uuid4().hex}/{name}"
        _parsed(spark, paths[name], tables[name]).write.partitionBy("_ok").parquet(staged)
        known = spark.read.schema("_ok BOOLEAN").parquet(staged)
        counts = dict(known.groupBy("_ok").agg(F.count("*")).collect())
        good, bad = counts.get(True, 0), counts.get(False, 0)
        if most_rejected is not None and bad > most_rejected:
            raise ValueError(f"{name}: {bad} malformed lines of {good + bad}, kept in {staged}")
        lines.append((number, name, staged, good, bad))
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("append").parquet(
        f"{target.rstrip('/')}/manifest"
    )
    return _manifests(spark, target).where(F.col("load") == number)


_MANIFEST = "load BIGINT, name STRING, path STRING, loaded BIGINT, rejected BIGINT"
_BAD = "_malformed"


def _manifests(spark: SparkSession, target: str) -> DataFrame:
    path = f"{target.rstrip('/')}/manifest"
    if not has_files(spark, path):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(path)


def _parsed(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Every line: its values, or the line itself with file and reason; ``_ok`` tells which."""
    fields = schemas.schema(ddl).fields
    declared = T.StructType(
        [*fields, T.StructField(_TAIL, T.StringType()), T.StructField(_BAD, T.StringType())]
    )
    rows = (
        spark.read.schema(declared).option("sep", "|").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        # Without the line's end too few or too many fields would pass.
        .option("columnPruning", "false").csv(path)
    )
    found = F.size(F.split(_BAD, r"\|")) - 1
    reason = F.when(
        found != len(fields),
        F.concat(found.cast("string"), F.lit(f" of {len(fields)} fields")),
    ).otherwise("a value of another type")
    bad = F.col(_BAD).isNotNull()
    return rows.select(
        *[f.name for f in fields], _BAD,
        F.when(bad, F.col("_metadata.file_name")).alias("_file"),
        F.when(bad, reason).alias("_reason"), (~bad).alias("_ok"),
    )


def _newest(spark: SparkSession, target: str, name: str) -> str:
    row = _manifests(spark, target).where(F.col("name") == name).orderBy(F.desc("load")).first()
    if row is None:
        raise FileNotFoundError(f"{name} was never loaded to {target}")
    return row["path"]


def loaded_table(spark: SparkSession, target: str, name: str, ddl: str) -> DataFrame:
    """The rows of a table as of the newest load that was published."""
    declared = T.StructType([*schemas.schema(ddl).fields, T.StructField("_ok", T.BooleanType())])
    return spark.read.schema(declared).parquet(_newest(spark, target, name)).where("_ok").drop("_ok")


def rejected_lines(spark: SparkSession, target: str, name: str) -> DataFrame:
    """(file, reason, line) of the malformed lines of that load."""
    declared = f"{_BAD} STRING, _file STRING, _reason STRING, _ok BOOLEAN"
    rows = spark.read.schema(declared).parquet(_newest(spark, target, name)).where("NOT _ok")
    return rows.select(
        F.col("_file").alias("file"), F.col("_reason").alias("reason"), F.col(_BAD).alias("line")
    )


def load_tables(
    spark: SparkSession, folder: str, target: str, tables: dict[str, str], suffix: str = ".tbl"
) -> list[str]:
    """Turn the text files at hand into typed Parquet tables; names what it loaded."""
    loaded = []
    for name, ddl in tables.items():
        if not has_files(spark, f"{folder}/{name}{suffix}"):
            continue
        rows = read_delimited(spark, f"{folder}/{name}{suffix}", ddl)
        rows.write.mode("overwrite").parquet(f"{target}/{name}.parquet")
        loaded.append(name)
    return loaded
