"""Line-oriented scans: text files -> (source_file, seq, value)."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.text import strip

_ROW_BITS = (1 << 33) - 1


def sequence() -> Column:
    """Record order inside a file as one BIGINT.

    Start of the file split in bytes plus row number inside the scan partition. A split
    that has a successor fills a partition of its own and every record takes at least
    one byte, so numbers of one split stay below the start of the next. One fixed-width
    number keeps first-record lookups cheap.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    return F.col("_metadata.file_block_start") + row


def spaced(lines: DataFrame) -> DataFrame:
    """Lines with room between their numbers for the parts of each. Numbers of lines are
    byte positions at most, so 20 bits for the place in a line leave room for 8 TB files."""
    return lines.withColumn("seq", F.col("seq") * (1 << 20))


def as_paths(names) -> list[str]:
    """File names from ``_metadata.file_path``, which are URL-encoded, as paths for a reader,
    which reads some characters as patterns."""
    return [re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(n)) for n in names]


def scan_text(spark: SparkSession, paths, line_sep: str | None = None, head: bool = False) -> DataFrame:
    """Lines as they are, with file and order; splittable for uncompressed files.

    ``head=True`` keeps the lines of each file's first split only. It serves probes that
    look at the start of a file (headers, formats, layouts).
    """
    reader = spark.read
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    lines = reader.text(paths)
    if head:
        lines = lines.filter(F.col("_metadata.file_block_start") == 0)
    return lines.select(
        F.col("_metadata.file_path").alias("source_file"),
        sequence().alias("seq"),
        F.col("value"),
    )


def clean_lines(lines: DataFrame, skip_comments: bool = False) -> DataFrame:
    """Strip every line, drop empty ones and, where asked, those starting with ``#``."""
    stripped = lines.withColumn("value", strip(F.col("value"))).filter("value <> ''")
    return stripped.filter(~F.col("value").startswith("#")) if skip_comments else stripped


def read_lines(spark: SparkSession, paths, skip_comments: bool = False) -> DataFrame:
    return clean_lines(scan_text(spark, paths), skip_comments)
