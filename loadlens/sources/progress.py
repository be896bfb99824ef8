"""Progress results: one JSON document per entity and run, plus host brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlens import schemas
from loadlens.functions.text import run_phase, run_started

_BRACKET = "*.host_bracket.json"


def _run(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _chunks(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path, chunk``: the documents' text, cut behind every closing brace.

    Spark cuts the files into splits at the same places, so a long document is the work
    of many tasks and none of them holds more than a sample at a time.
    """
    path = F.col("_metadata.file_path")
    return (
        spark.read.option("lineSep", "}")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .text(folder)
        .where(~path.endswith(".host_bracket.json"))
        .select(path.alias("path"), F.col("value").alias("chunk"))
    )


def _named(path) -> list[F.Column]:
    return [
        _run(path).alias("run"),
        run_phase(path).alias("phase"),
        run_started(path).alias("started"),
        F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("entity"),
    ]


def read_samples(spark: SparkSession, folder: str, pattern: str = "cpu_*.json") -> DataFrame:
    """``run, phase, started, entity, t, ticks``, one row per sample.

    A sample is a flat object with ``mono_ns``; a document needs no line breaks. Objects
    without that key are no samples. An object nested in a sample fails the read rather
    than hide it. Of a document that breaks off the samples before the break count;
    :func:`read_documents` tells which ones do.
    """
    last = F.regexp_extract("chunk", r"\{([^{}]*)$", 1)
    # A key, not a text that quotes one.
    key = r"""(^|[^\\])"mono_ns"\s*:"""
    chunks = _chunks(spark, folder, pattern).where(F.col("chunk").contains('"mono_ns"'))
    parsed = chunks.select(
        "path", "chunk", F.col("chunk").rlike(key).alias("_any"), last.alias("_body"),
        last.rlike(key).alias("_own"),
    ).where("_any")
    sample = F.when(
        F.col("_own"),
        F.from_json(F.concat(F.lit("{"), "_body", F.lit("}")), "mono_ns BIGINT, ticks BIGINT"),
    ).otherwise(
        F.raise_error(F.concat(F.lit("nested object in a sample of "), "path"))
        .cast("struct<mono_ns: bigint, ticks: bigint>")
    )
    return parsed.select("path", sample.alias("_s")).select(
        *_named(F.col("path")), F.col("_s.mono_ns").alias("t"), F.col("_s.ticks").alias("ticks")
    )


def read_documents(spark: SparkSession, folder: str, pattern: str = "cpu_*.json") -> DataFrame:
    """``run, phase, started, entity, mono_start, mono_end, samples, closed`` per document.

    ``closed`` is false where the text ends within the samples. One row per file leaves
    each task, so that a long document is counted up where it is read.
    """
    value = r"""(?:^|[^\\])"%s"\s*:\s*(-?\d+)"""
    found = [
        F.max(F.regexp_extract("chunk", value % name, 1).try_cast("bigint")).alias(name)
        for name in ("mono_start", "mono_end")
    ]
    ends = F.col("chunk").rlike(r"^\s*\]") | F.col("chunk").rlike(r""""samples"\s*:\s*\[\s*\]""")
    return (
        _chunks(spark, folder, pattern).groupBy("path")
        .agg(
            *found,
            F.count_if(F.col("chunk").rlike(r"""(^|[^\\])"mono_ns"\s*:""")).alias("samples"),
            F.bool_or(ends).alias("closed"),
        )
        .select(*_named(F.col("path")), "mono_start", "mono_end", "samples", "closed")
    )


def read_brackets(spark: SparkSession, folder: str) -> DataFrame:
    """``run, host_start, host_end`` from the sidecar files."""
    path = F.col("_metadata.file_path")
    docs = (
        spark.read.schema(schemas.BRACKET)
        .option("multiLine", "true")
        .option("pathGlobFilter", _BRACKET)
        .option("recursiveFileLookup", "true")
        .json(folder)
    )
    return docs.select(
        _run(path).alias("run"),
        F.col("host_start_ns").alias("host_start"),
        F.col("host_end_ns").alias("host_end"),
    )
