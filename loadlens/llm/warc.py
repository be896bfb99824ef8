"""WARC archives: written as whole-file gzip, normalised to one member per record.

``write_archives`` writes each record of a table into ``.warc.gz`` files that are one
gzip stream from end to end, as many tools do. ``normalise`` inflates each such
stream once, from its first byte to its last, rewrites every record as a gzip member
of its own and writes the sidecar index: file, record number, offset and length of
each member. The index lies beside the members, in the folder's ``index``, so the
folder alone can be read: ``archive_index`` opens it and ``read_records`` fetches
members by it. A folder that has an index is not written to again.

Spark's own reader inflates the streams, line by line, so a task holds one record and
not a file, whatever the size of the archive. A record ends where its content length
says; a stream that breaks off or does not parse fails the job with the file's name.
Normalised files go to the folder that is given, which all executors must reach, by
way of pyarrow's file systems; Hadoop's names of S3 (``s3a``, ``s3n``) are translated,
and a scheme that pyarrow cannot open fails on the driver before any task starts. Only
``.gz`` files are read as archives. A task writes to names of its own, so one that is run
again never meets half a file; files that the index does not name can be deleted.

Null html is an empty payload. A null url is written as an empty target. Of equal
payloads of at least ``MIN_REVISIT`` bytes the record with the smallest page id is
the response and others revisit it. Copies with that same id, or a null one where all
are null, are responses too. Null ids revisit those with one. Extra columns are
ignored. No rows give no archives and an empty index.
"""

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlens.operators.joins import lookup_join
from loadlens.session import scratch_path, snapshot

MIN_REVISIT = 100
# Records per archive; a file is one task's work when it is normalised.
FILE_RECORDS = 20_000
DATE = "2024-01-01T00:00:00Z"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
READ_BYTES = 1 << 20


# --- what is a revisit ------------------------------------------------------------


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    facts = snapshot(
        pages.select(
            "page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")
        ).where(F.col("size") >= min_revisit)
        .groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("digest").alias("payload_digest"), "first_id"),
        "repeated-payloads",
    )
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    met = lookup_join(rows, facts, "payload_digest", "left", spread_by="row")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return met.withColumn("refers_to", refers).withColumn(
        "record_type", F.when(refers.isNotNull(), REVISIT).otherwise(RESPONSE)
    ).drop("first_id")


# --- writing ------------------------------------------------------------------------


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def _record_text(row_type: Column) -> Column:
    """A whole record but for its last line end."""
    full = row_type == RESPONSE
    body = F.when(full, F.col("html")).otherwise("")
    page = F.col("page_id").cast("string")
    # Line ends in a url would end its header.
    target = F.regexp_replace("url", r"[\r\n]", "")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", row_type),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", target),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        _header("WARC-Profile", F.when(~full, F.lit(PROFILE))),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n"),
    )


def write_archives(rows: DataFrame, folder: str, file_records: int = FILE_RECORDS) -> None:
    """Write ``records`` rows as archives, each one gzip stream."""
    (
        rows.select(_record_text(F.col("record_type")).alias("value"))
        .write.option("lineSep", "\r\n").option("compression", "gzip")
        .option("maxRecordsPerFile", file_records).text(folder)
    )


# --- normalising ---------------------------------------------------------------------


class RecordCutter:
    """Cuts a stream of lines, without their line feeds, into records."""

    def __init__(self):
        self.lines: list[bytes] = []
        self.missing = -1  # bytes of the content and its two line ends; -1 within a header

    def add(self, line: bytes) -> bytes | None:
        """The record that this line ends, if it does."""
        if not self.lines and line in (b"", b"\r"):
            return None  # more line ends than needed between records
        self.lines.append(line)
        if self.missing < 0:
            if line in (b"", b"\r"):
                self.missing = self._content_length() + 4
            return None
        self.missing -= len(line) + 1
        if self.missing > 0:
            return None
        if self.missing < 0:
            raise ValueError("a record is longer than its content length says")
        whole = b"\n".join(self.lines) + b"\n"
        self.lines, self.missing = [], -1
        return whole

    def _content_length(self) -> int:
        for line in self.lines[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                return int(value)
        raise ValueError("a record has no content length")


def parse_record(whole: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the content."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[:int(fields["content-length"])]


INDEX_FOLDER = "index"


def member_uri(folder: str) -> str:
    """The folder as pyarrow names it; fails if pyarrow cannot open it."""
    from pyarrow import fs

    scheme, mark, rest = folder.partition("://")
    if mark and scheme in ("s3a", "s3n"):
        folder = f"s3://{rest}"
    elif not mark and not folder.startswith("file:"):
        folder = f"file://{folder}"
    fs.FileSystem.from_uri(folder)
    return folder


class MemberWriter:
    """A normalised archive in the making: each record is a gzip member."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.system, path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.path = f"{path.rstrip('/')}/{self.name}"
        self.stream = self.system.open_output_stream(self.path, compression=None)
        self.offset = 0

    def add(self, record: bytes) -> tuple[int, int]:
        member = gzip.compress(record, compresslevel=6, mtime=0)
        self.stream.write(member)
        at, self.offset = self.offset, self.offset + len(member)
        return at, len(member)


INDEX = (
    "source STRING, file STRING, number BIGINT, offset BIGINT, length BIGINT, "
    "record_id STRING, target STRING"
)


def normalise(spark: SparkSession, archives: str, folder: str) -> DataFrame:
    """Rewrite all archives of a folder; the index of what was written, stored beside it."""
    uri = member_uri(folder)
    streams = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(archives)
    lines = streams.select(
        F.col("_metadata.file_path").alias("source"), F.col("value").cast("binary").alias("line")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, cutter, writer, number = None, None, None, 0

        def close():
            if cutter is not None and cutter.lines:
                raise ValueError(f"{source} breaks off within a record")
            if writer is not None:
                writer.stream.close()

        for batch in batches:
            rows = []
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != source:
                    close()
                    source, cutter, writer, number = name, RecordCutter(), None, 0
                try:
                    record = cutter.add(line)
                except ValueError as error:
                    raise ValueError(f"{source}: {error}") from None
                if record is None:
                    continue
                if writer is None:
                    writer = MemberWriter(uri)
                fields = parse_record(record)[0]
                rows.append((source, writer.name, number, *writer.add(record),
                             fields.get("warc-record-id"), fields.get("warc-target-uri")))
                number += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
                        pa.string(), pa.string(),
                    ))],
                    names=["source", "file", "number", "offset", "length", "record_id", "target"],
                )
        close()

    lines.mapInArrow(run, INDEX).write.parquet(f"{folder.rstrip('/')}/{INDEX_FOLDER}")
    return archive_index(spark, folder)


# --- reading back ---------------------------------------------------------------------


RECORD = (
    "file STRING, number BIGINT, page_id BIGINT, record_type STRING, refers_to BIGINT, "
    "payload_bytes BIGINT, payload_digest STRING"
)


def _page(value: str | None) -> int | None:
    return int(value.rpartition(":")[2].rstrip(">")) if value else None


def archive_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar index of a folder of normalised archives."""
    return spark.read.schema(INDEX).parquet(f"{folder.rstrip('/')}/{INDEX_FOLDER}")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """One row per index row, from its member alone; a response's payload is hashed anew.

    A revisit holds no payload; its size and digest are those of its header.
    """
    uri = member_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        name, file = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    if file is not None:
                        file.close()
                    name = row["file"]
                    file = system.open_input_file(f"{path.rstrip('/')}/{name}")
                member = file.read_at(row["length"], row["offset"])
                fields, payload = parse_record(zlib.decompress(member, wbits=31))
                kind = fields["warc-type"]
                digest = fields["warc-payload-digest"].rpartition(":")[2]
                size = int(fields["warc-payload-length"])
                if kind == RESPONSE:
                    found = hashlib.sha256(payload).hexdigest()
                    if (found, len(payload)) != (digest, size):
                        raise ValueError(f"{name}, record {row['number']}: the payload is damaged")
                rows.append((name, row["number"], _page(fields.get("warc-record-id")), kind,
                             _page(fields.get("warc-refers-to")), size, digest))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(),
                        pa.string(),
                    ))],
                    names=["file", "number", "page_id", "record_type", "refers_to",
                           "payload_bytes", "payload_digest"],
                )
        if file is not None:
            file.close()

    return index.select("file", "number", "offset", "length").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back every page of (page_id, url, html)."""
    spark = pages.sparkSession
    archives = scratch_path(spark, "warc-streams")
    members = scratch_path(spark, "warc-members")
    write_archives(records(pages), archives)
    return read_records(normalise(spark, archives, members), members).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
