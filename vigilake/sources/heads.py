"""Files that tasks open by themselves: first lines, read by range, tell what a file is; and folders of
many small files, read whole, many per task."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake import fixed
from vigilake.sources.lines import as_paths, scan_text

#: Stores that tasks open by themselves, comma-separated; files elsewhere are read by Spark's text reader.
DIRECT_SETTING, DIRECT = "vigilake.heads.direct", "file"
BLOCK = 64 * 1024
#: A file whose first lines are longer is known by what stands before.
MOST = 128 * 1024 * 1024
_BREAK = re.compile(rb"\r\n|\r|\n")
#: Where a folder has more than ``MANY`` files of at most ``SMALL`` bytes, these are read whole. Spark's text reader
#: copies its whole configuration per file, one at a time in an executor, which takes longer than the file.
MANY, SMALL = 1000, 1024 * 1024
#: Files and bytes for a task, and rows and bytes for a batch of it.
TASK_FILES, TASK_BYTES, BATCH_ROWS, BATCH_BYTES = 5000, 32 * 1024 * 1024, 10_000, 8 * 1024 * 1024
COMPRESSED = r"(?i)\.(gz|bz2|zst|zstd|lz4|lzo|snappy|deflate)$"
LINES = "source_file string, seq long, value string"


def manifest(spark: SparkSession, paths) -> DataFrame:
    """``(source_file, length)`` of all files, from the listing alone: no content is read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_size").alias("length"))


def _located(uri: str):
    """File system and path of a file name as ``_metadata.file_path`` gives it."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def first_lines(uri: str, count: int) -> list[bytes]:
    """At least ``count`` lines of a file, two of them filled, or all that it has; reads blocks until then."""
    system, path = _located(uri)
    data = b""
    with system.open_input_stream(path, compression="detect", buffer_size=BLOCK) as stream:
        while len(data) < MOST:
            block = stream.read(BLOCK)
            data += block
            if not block:
                break
            lines = _BREAK.split(data)[:-2]  # the last may go on, and a return may be half of a break
            if len(lines) >= count and sum(bool(x.strip()) for x in lines) > 1:
                return lines
    lines = _BREAK.split(data)
    return lines if lines[-1] else lines[:-1]


def pieces(data: bytes, line_sep: bytes | None) -> list[bytes]:
    """Contents of a file cut as Spark's text reader cuts them: at any line break, or at ``line_sep``."""
    data = data.removeprefix(b"\xef\xbb\xbf")
    parts = data.split(line_sep) if line_sep else _BREAK.split(data) if b"\r" in data else data.split(b"\n")
    return parts if parts[-1] else parts[:-1]


def _direct(spark: SparkSession) -> Column:
    """Whether tasks may open a file."""
    scheme = F.regexp_extract("source_file", "^([A-Za-z0-9+.-]+):", 1)
    return scheme.isin(spark.conf.get(DIRECT_SETTING, DIRECT).split(","))


def _rows_of(spark: SparkSession, files: DataFrame, count: int, size: int, cut: Callable[[str], list[bytes]]) -> DataFrame:
    """``(source_file, seq, value)``: what ``cut`` makes of each file, numbered from 0. Only names are shuffled."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_FILES), -(-size // TASK_BYTES))
    schema = pa.schema([("source_file", pa.string()), ("seq", pa.int64()), ("value", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places, values, filled = [], [], [], 0
        for batch in batches:
            for uri in batch.column("source_file").to_pylist():
                found = cut(uri)
                names += [uri] * len(found)
                places += range(len(found))
                values += found
                filled += sum(map(len, found))
                if filled >= BATCH_BYTES or len(values) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((names, places, values), schema)], schema=schema)
                    names, places, values, filled = [], [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((names, places, values), schema)], schema=schema)

    rows = files.select("source_file").repartition(tasks, "source_file").mapInArrow(read, "source_file string, seq long, value binary")
    return rows.withColumn("value", F.col("value").cast("string"))


def scan_files(spark: SparkSession, paths, line_sep: str | None = None, only: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """``(source_file, seq, value)`` lines, as ``scan_text`` has them, of a folder that may hold many small files;
    with ``whole`` a row per file.

    ``only`` is a table of the names to read, written beforehand. Names of small files do not pass the
    driver as arguments; the other files are read by Spark's text reader.
    """
    files = manifest(spark, paths)
    chosen = files if only is None else files.join(only, "source_file", "left_semi")
    small = _direct(spark) & (F.col("length") <= SMALL) & ~F.col("source_file").rlike(COMPRESSED)
    count, size = chosen.where(small).agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    many = count > MANY
    if only is None and not many:
        return _whole_texts(spark, paths) if whole else scan_text(spark, paths, line_sep)
    others = as_paths(sorted(r["source_file"] for r in (chosen.where(~small) if many else chosen).select("source_file").collect()))
    parts = []
    if others:
        parts.append(_whole_texts(spark, others) if whole else scan_text(spark, others, line_sep))
    if many:
        sep = line_sep.encode() if line_sep else None

        def cut(uri: str) -> list[bytes]:
            system, path = _located(uri)
            with system.open_input_file(path) as file:
                data = file.read()
            return [data] if whole else pieces(data, sep)

        parts.append(_rows_of(spark, chosen.where(small), count, size, cut))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LINES)


def _whole_texts(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), F.lit(0).cast("bigint").alias("seq"), "value")


def head_scan(spark: SparkSession, paths, count: int = fixed.SAMPLE_LINES) -> DataFrame:
    """``(source_file, seq, value)``: the first ``count`` lines or more of every file, numbered from 0.

    Lines of an empty file: none. For probes that look at the start of files; record numbers of
    whole scans are other numbers.
    """
    files = manifest(spark, paths)
    number, others = files.agg(F.count(F.lit(1)), F.count_if(~_direct(spark))).first()
    if others:
        return scan_text(spark, paths, head=True)

    def cut(uri: str) -> list[bytes]:
        return [x.decode("utf-8", "replace").encode() for x in first_lines(uri, count)]

    return _rows_of(spark, files.where("length > 0"), number, 0, cut)
