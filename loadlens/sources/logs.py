"""Log files as lines, with line numbers that hold for files of any size.

A scan is strict: a file that cannot be read to its end fails it, so no line is ever lost
in silence. :func:`store_sound` runs work over such a scan, finds the files whose content
is damaged, and does the work again without them; any other fault ends the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from py4j.protocol import Py4JJavaError

from loadlens.operators.joins import lookup_join
from loadlens.session import snapshot

# Files of these kinds are longer once read, so their length says nothing about lines.
_INFLATED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"
# Kinds that consist of blocks with their length in front and have no mark at their end.
_BLOCKS = r"\.(lz4|snappy)$"
# How much of a longer block Hadoop's writers of these kinds compress at
# once, as its 256 KB buffer leaves room for what might not compress.
_PIECES = {"lz4": 261_100, "snappy": 218_422}
# Failures of the installation or the machine, also if a codec's frame reports them.
_NO_DAMAGE = (
    "java.lang.RuntimeException", "java.lang.UnsupportedOperationException",
    "java.lang.OutOfMemoryError", "java.lang.UnsatisfiedLinkError", "java.lang.NoClassDefFoundError",
    "java.lang.InterruptedException", "java.io.InterruptedIOException",
)
# What the frames of decompressors begin with: what they throw is about the content.
_CODECS = (
    "org.apache.hadoop.io.compress.", "java.util.zip.", "com.github.luben.zstd.",
    "net.jpountz.", "org.xerial.snappy.", "io.airlift.compress.",
)


def scan_lines(spark: SparkSession, path: str | list[str], pattern: str = "*.log") -> DataFrame:
    """Lines of all matching files, read in splits, which ``_start`` and ``_length`` name."""
    lines = (
        spark.read.option("pathGlobFilter", pattern)
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "false")
        .text(path)
    )
    return lines.select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_path").alias("path"),
        "value",
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_block_length").alias("_length"),
    )


def with_ids(lines: DataFrame) -> DataFrame:
    """Add ``_id``, which grows along each split; filter files before, as none passes it."""
    return lines.withColumn("_id", F.monotonically_increasing_id())


def read_lines(spark: SparkSession, path: str | list[str], pattern: str = "*.log") -> DataFrame:
    """The lines with what :func:`with_line_numbers` needs."""
    return with_ids(scan_lines(spark, path, pattern))


def with_line_numbers(chosen: DataFrame, lines: DataFrame) -> DataFrame:
    """Number the chosen lines as in their whole file.

    Splits are counted, one small row each, and added up per file; only the
    chosen lines are then looked up by split. The counted and the chosen pass
    must have been cut alike: a line outside its split's id range fails the job
    rather than get a wrong number.
    """
    splits = lines.groupBy("path", "_start", "_length").agg(
        F.count("*").alias("_lines"), F.min("_id").alias("_low"), F.max("_id").alias("_high")
    )
    run = (
        Window.partitionBy("path")
        .orderBy("_start")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = snapshot(splits.select(
        F.concat_ws("|", "path", F.col("_start").cast("string"), F.col("_length").cast("string"))
        .alias("_split"),
        "_low",
        "_high",
        (F.sum("_lines").over(run) - F.col("_lines")).alias("_before"),
    ), "splits")
    keyed = chosen.withColumn(
        "_split",
        F.concat_ws("|", "path", F.col("_start").cast("string"), F.col("_length").cast("string")),
    )
    # A key here is one split, which is never more than a task's worth of lines.
    found = lookup_join(keyed, placed, "_split", "left", even=True)
    number = F.when(
        F.col("_id").between(F.col("_low"), F.col("_high")),
        F.col("_before") + F.col("_id") - F.col("_low") + 1,
    ).otherwise(F.raise_error(F.lit("log files were split differently between two passes")))
    return found.withColumn("line", number.cast("bigint")).drop(
        "_split", "_low", "_high", "_before", "_start", "_length", "_id"
    )


def list_files(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """Names and sizes of the matching files, empty ones too; nothing is read.

    The names are the listing every scan of the folder makes on the driver.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    names = spark.createDataFrame(
        [(re.sub("^file:/+", "file:/", f),) for f in found.inputFiles()], "path STRING"
    )
    # A scan leaves empty files out, so sizes come from it and default to 0.
    sizes = found.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length")
    )
    return names.join(sizes, "path", "left").select(
        F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)).alias("file"),
        "path",
        F.coalesce("length", F.lit(0).cast("bigint")).alias("length"),
    )


def _plain(path: str) -> str:
    """A path as Spark's messages and its metadata both spell it."""
    return unquote(re.sub("^file:/+", "file:/", path))


def broken_file(error: Exception) -> str | None:
    """The path of the file whose content a decompressor refused, if that ended a scan.

    The innermost cause decides by who threw it: only a codec's own frame means that
    the content is damaged. A lost connection or a refused access is no such thing.
    """
    text = str(error)
    named = re.search(r"Encountered error while reading file (.+?)\.\s+SQLSTATE", text)
    # Each cause with the frame that threw it.
    causes = re.findall(
        r"Caused by: ([\w.$]+)[^\n]*\n(?:(?!Caused by)[^\n]*\n)*?\s+at (?:[\w.]+/)?([\w.$]+)\(", text
    )
    damage = any(
        frame.startswith(_CODECS) and kind not in _NO_DAMAGE for kind, frame in causes
    )
    # Compiled code throws these without a trace once they are frequent; while a file is
    # read only a decoder walks arrays by what it finds there.
    bare = re.search(r"Caused by: java\.lang\.ArrayIndexOutOfBoundsException[^\n]*(?:\n(?!\s*at )|$)", text)
    return _plain(named[1]) if named and (damage or bare) else None


def _without(lines: DataFrame, paths: list[str]) -> DataFrame:
    # On the file's metadata and before any row number, so that these files are not opened.
    return lines.where(~_same(F.col("path")).isin(paths)) if paths else lines


def _same(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def damaged_paths(lines: DataFrame, found: list[str] | None = None) -> list[str]:
    """Paths of all files of a strict scan that a decompressor refuses.

    A scan names one such file when it fails. The files are then halved by a hash of
    their path and each half is scanned without those already known, until all halves
    succeed: about log2(damaged) + 2 times the folder is read, once if nothing is wrong.
    """
    known = list(found or [])
    halves = [(1, 0)] if not known else [(2, 0), (2, 1)]
    while halves:
        parts, part = halves.pop()
        share = F.pmod(F.xxhash64("path"), F.lit(parts)) == part
        while True:
            try:
                _without(lines.where(share), known).agg(F.count("value")).first()
            except (Py4JJavaError, PySparkException) as error:
                path = broken_file(error)
                if path is None or path in known:
                    raise
                known.append(path)
                if parts < 1 << 20:
                    halves += [(2 * parts, part), (2 * parts, part + parts)]
                    break
            else:
                break
    return known


def store_sound(
    lines: DataFrame, work: Callable[[DataFrame], DataFrame], name: str
) -> tuple[DataFrame, list[str]]:
    """Store ``work`` over the lines of all files that can be read to their end.

    Returns the stored result and the paths of the damaged files, of which no line is
    in it. Without damage this is one scan.
    """
    try:
        return snapshot(work(lines), name), []
    except (Py4JJavaError, PySparkException) as error:
        first = broken_file(error)
        if first is None:
            raise
    damaged = damaged_paths(lines, [first])
    return snapshot(work(_without(lines, damaged)), name), damaged


def _int_at(content: Column, place: Column) -> Column:
    """The four bytes at a 0-based place as an unsigned number."""
    return F.conv(F.hex(F.substring(content, place + 1, F.lit(4))), 16, 10).cast("bigint")


def cut_block_files(files: DataFrame) -> DataFrame:
    """(path) of files of block kinds that end within a block.

    Reading such a file to its end raises nothing, it just ends with the last whole block.
    Here the lengths in front of blocks and their pieces are followed to the end: a sound
    file's last piece ends where the file does. As Spark hands a whole file over for this, a
    file above its limit for one (2 GB) fails the job.
    """
    spark = files.sparkSession
    listed = [r[0] for r in files.where(F.col("path").rlike(_BLOCKS)).select("path").collect()]
    if not listed:
        return files.select("path").limit(0)
    content, length = F.col("content"), F.octet_length("content").cast("bigint")
    piece = F.when(F.col("path").endswith(".lz4"), _PIECES["lz4"]).otherwise(_PIECES["snappy"])

    def step(at: Column, _: Column) -> Column:
        # ``due`` pieces are still to come in the block at hand.
        head = at["due"] == 0
        value = _int_at(content, at["place"])
        moved = F.struct(
            (at["place"] + 4 + F.when(head, 0).otherwise(value)).alias("place"),
            F.when(head, F.ceil(value / piece)).otherwise(at["due"] - 1).cast("bigint").alias("due"),
        )
        return F.when(at["place"] + 4 <= length, moved).otherwise(at)

    # Every step is four bytes or more, in two loops so that neither is long.
    side = F.ceil(F.sqrt(length / 4 + 1)).cast("int")
    zero = F.lit(0).cast("bigint")
    end = F.aggregate(
        F.sequence(F.lit(1), side), F.struct(zero.alias("place"), zero.alias("due")),
        lambda at, _: F.when(at["place"] + 4 > length, at).otherwise(
            F.aggregate(F.sequence(F.lit(1), side), at, step)
        ),
    )
    read = spark.read.format("binaryFile").load([unquote(p) for p in listed])
    ended = read.select(
        F.col("_metadata.file_path").alias("path"), length.alias("_len"), end.alias("_end")
    )
    return ended.where("_end.place <> _len OR _end.due > 0").select("path")


def completeness(
    files: DataFrame, seen: DataFrame, damaged: list[str], truncated: DataFrame | None = None
) -> DataFrame:
    """(file, path, length, lines, bytes, verdict): one row per listed file.

    ``seen`` is (path, lines, bytes) of what a scan read, without the damaged files. The
    verdict is ``whole``; ``empty``; ``unreadable`` if not one line could be read; or
    ``breaks off`` if the content is damaged, ends within a block, or if a plain file's
    lines, each with two bytes of line end, do not make up its length.
    """
    spark = files.sparkSession
    if truncated is None:
        truncated = cut_block_files(files)
    begun: set[str] = set()
    if damaged:
        # What of a damaged file lies before the fault tells the two verdicts apart.
        lenient = spark.read.option("ignoreCorruptFiles", "true").text(damaged)
        begun = {_plain(r[0]) for r in
                 lenient.select(F.col("_metadata.file_path")).distinct().collect()}
    marks = spark.createDataFrame(
        [(p, "breaks off" if p in begun else "unreadable") for p in damaged],
        "_damaged STRING, _mark STRING",
    ).unionByName(truncated.select(
        _same(F.col("path")).alias("_damaged"), F.lit("breaks off").alias("_mark")))
    own = files.withColumn("_plain", _same(F.col("path")))
    counted = lookup_join(
        own, seen.select(_same(F.col("path")).alias("_seen"), "lines", "bytes"),
        ("_plain", "_seen"), "left", even=True,
    )
    marked = lookup_join(counted, marks, ("_plain", "_damaged"), "left", even=True)
    # The three bytes are those of a byte order mark.
    short = ~F.col("path").rlike(_INFLATED) & (F.col("bytes") + 2 * F.col("lines") + 3 < F.col("length"))
    verdict = (
        F.when(F.col("_mark").isNotNull(), F.col("_mark"))
        .when(F.col("length") == 0, "empty")
        .when(F.col("lines").isNull(), "unreadable")
        .when(short, "breaks off")
        .otherwise("whole")
    )
    none = F.lit(0).cast("bigint")
    return marked.select(
        "file", "path", "length", F.coalesce("lines", none).alias("lines"),
        F.coalesce("bytes", none).alias("bytes"), verdict.alias("verdict"),
    )


def seen_per_file(lines: DataFrame, size: Column | None = None) -> DataFrame:
    """(path, lines, bytes) of a scan; ``size`` is a line's bytes if its text is gone."""
    size = F.octet_length("value") if size is None else size
    return lines.groupBy("path").agg(F.count("*").alias("lines"), F.sum(size).alias("bytes"))


def file_errors(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, reason) of listed files that are not whole, from a strict scan of them."""
    seen, damaged = store_sound(lines, seen_per_file, "seen")
    return bad_files(completeness(files, seen, damaged))


def bad_files(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("verdict IN ('breaks off', 'unreadable')").select(
        "file", F.col("verdict").alias("reason")
    )


def _sample_lines(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    lines = read_lines(spark, path, pattern)
    number = F.try_to_number(F.trim("value"), F.lit("9" * 20)).cast("decimal(20,0)")
    return lines.select("file", F.col("_id").alias("pos"), "value", number.alias("v"))


def read_samples(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """Raw samples, one unsigned number per line; ``pos`` keeps their order.

    ``pos`` is increasing within a file, not gapless. Lines that are no such number
    are those of ``rejected_samples``.
    """
    return _sample_lines(spark, path, pattern).where("v IS NOT NULL").drop("value")


def rejected_samples(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(file, pos, value, reason) of each line that ``read_samples`` leaves out; blank ones are not reported."""
    rest = _sample_lines(spark, path, pattern).where("v IS NULL AND trim(value) <> ''")
    reason = F.when(
        F.col("value").rlike(r"^\s*[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?\s*$"), "not an unsigned 64-bit number"
    ).otherwise("not a number")
    return rest.select("file", "pos", "value", reason.alias("reason"))
