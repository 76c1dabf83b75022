"""Delimited files (comma, semicolon, tab, bar) -> events.

Every file may have its own header and delimiter. Headers are found once per file from
the head split and joined to the rows; rows are split by Spark's CSV parser, one
expression per delimiter, so any number of layouts is read in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake import fixed
from vigilake.functions import text
from vigilake.functions.normalize import alias_places, normalize_cells
from vigilake.operators.detect import hashed
from vigilake.session import written
from vigilake.sources.lines import scan_text, sequence

BOM = "﻿"
#: A row without a filled cell that is longer than this was too wide to split.
UNSPLIT = 20_000


def _split(rows: DataFrame, source: str, target: str, width: int) -> DataFrame:
    """Record text -> array of ``width`` cells, split at the row's own delimiter; short
    records are padded with empty cells. Each record is parsed once; one with more delimiters than
    the parser takes is left unsplit, all its cells empty."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    most = max(width * 4, 20480)
    options = {
        "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1",
        "maxColumns": str(most),
    }
    parsed = F.coalesce(*[
        F.when((F.col("delimiter") == d) & (text.occurrences(F.col(source), d) < most), F.from_csv(F.col(source), F.lit(schema), {"sep": d, **options}))
        for d in fixed.DELIMITERS
    ])
    cells = F.array(*[F.coalesce(F.col("_row")[f"c{i}"], F.lit("")) for i in range(width)])
    return rows.withColumn("_row", text.once(parsed)).withColumn(target, cells).drop("_row")


def csv_headers(lines: DataFrame) -> DataFrame:
    """First non-blank line per file with its delimiter and column count.

    ``(source_file, header_seq, header, delimiter, width)``; width counts delimiters, so
    it is at least the number of columns.
    """
    first = hashed(
        lines.filter(text.strip(F.col("value")) != "").groupBy("source_file"),
        [F.min("seq").alias("header_seq"), F.min_by("value", "seq").alias("value")],
    )
    header = F.ltrim(F.col("value"), F.lit(BOM))
    return first.select(
        "source_file", "header_seq", header.alias("header"),
        text.sniff_delimiter(header).alias("delimiter"),
    ).withColumn("width", reduce(
        F.greatest, [text.occurrences(F.col("header"), d) for d in fixed.DELIMITERS]
    ) + 1)


def _columns(headers: DataFrame) -> DataFrame:
    """Header cells -> column ``keys``, their cleaned ``names`` and the ``places`` of the canonical
    fields among them, once per file. Cells past the last filled one are padding, not columns."""
    last = F.array_max(F.transform(
        F.col("names"), lambda n, i: F.when(text.strip(n) != "", i + 1).otherwise(0)
    ))
    keys = F.transform(F.slice(F.col("names"), F.lit(1), last), text.strip)
    cleaned = headers.withColumn("keys", keys).withColumn("names", F.transform("keys", text.clean_key))
    return cleaned.withColumn("places", alias_places(F.col("names")))


def _written_headers(lines: DataFrame) -> tuple[DataFrame, int]:
    """Columns per file as a small written table, and the largest column count."""
    headers = written(csv_headers(lines), "csv-headers")
    width = headers.agg(F.max("width")).first()[0] or 1
    return _columns(_split(headers, "header", "names", width)), width


def csv_events(lines: DataFrame, log_type: str = "csv", heads: DataFrame | None = None) -> DataFrame:
    """Events of ``(source_file, seq, value)`` lines, one record per line.

    ``heads`` are lines that hold at least the first of each file, if a cheaper source than
    all lines is at hand. Records with quoted line breaks need :func:`read_csv_events` with ``multiline=True``.
    """
    headers, width = _written_headers(lines if heads is None else heads)
    rows = lines.join(headers, "source_file").filter("seq <> header_seq")
    return _named(_split(rows, "value", "cells", width), log_type)


def _named(rows: DataFrame, log_type: str) -> DataFrame:
    """Rows with cells and their file's columns -> events; rows of blanks and delimiters alone are
    dropped and cells beyond the header are cut. An unsplit row keeps its text."""
    unsplit = F.length("value") > UNSPLIT
    filled = rows.filter(F.exists("cells", lambda c: text.strip(c) != "") | (unsplit & F.col("value").rlike(r"[^\s,;|\"]")))
    return normalize_cells(filled.select("source_file", "seq", F.col("value").alias("raw"), "keys", "cells", "places"), log_type)


def quoted_records(lines: DataFrame, longest: int = 10_000) -> DataFrame:
    """Lines ``(source_file, split, seq, value)`` -> records whose quoted cells may hold line breaks.

    A line with an odd number of quotes opens or closes a quoted break. Every file split counts its
    own quotes; a prefix sum over the few splits of a file tells with which state each begins, and
    where the record that reaches into it started. So files are split as usual, and only lines of
    records that span several are brought together. Breaks become line feeds. A record of more than
    ``longest`` lines, as a stray quote makes one of the rest of a file, is read as single lines.
    """
    inside = Window.partitionBy("source_file", "split").orderBy("seq")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    rows = lines.withColumn("_odd", quotes % 2).withColumn("_before", F.coalesce(F.sum("_odd").over(so_far), F.lit(0)) % 2)
    splits = rows.groupBy("source_file", "split").agg(
        F.sum("_odd").alias("odd"), *[F.max(F.when(F.col("_before") == k, F.col("seq"))).alias(f"last{k}") for k in (0, 1)])
    earlier = Window.partitionBy("source_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    splits = splits.withColumn("_start", start).withColumn("last", F.when(F.col("_start") == 0, F.col("last0")).otherwise(F.col("last1")))
    splits = written(splits.select("source_file", "split", "_start", ((F.col("_start") + F.col("odd")) % 2 == 1).alias("_over"),
                                   F.max("last").over(earlier).alias("_carried")), "csv-splits")
    rows = rows.join(splits, ["source_file", "split"]).withColumn("_open", (F.col("_start") + F.col("_before")) % 2 == 1)
    begun = F.max(F.when(~F.col("_open"), F.col("seq"))).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"_record": F.coalesce(begun, "_carried"), "_on": F.coalesce(F.lead("_open").over(inside), "_over")})
    several = F.col("_open") | F.col("_on")
    single = rows.where(~several).select("source_file", "seq", "value")
    parts = rows.where(several).select("source_file", "_record", "seq", "value")
    sizes = parts.groupBy("source_file", "_record").count()
    parts = parts.join(sizes, ["source_file", "_record"])
    ordered = F.array_sort(F.collect_list(F.struct("seq", "value")))
    joined = parts.where(F.col("count") <= longest).groupBy("source_file", "_record").agg(ordered.alias("_lines")).select(
        "source_file", F.col("_record").alias("seq"), F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("value"))
    alone = parts.where(F.col("count") > longest).select("source_file", "seq", "value")
    return single.unionByName(joined).unionByName(alone)


def _split_lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split"), sequence().alias("seq"), "value")


def read_csv_events(spark: SparkSession, paths, multiline: bool = False, log_type: str = "csv") -> DataFrame:
    """Events of CSV files. ``multiline=True`` also reads quoted line breaks (``quoted_records``), at
    the price of a shuffle of the lines."""
    if not multiline:
        return csv_events(scan_text(spark, paths), log_type, scan_text(spark, paths, head=True))
    lines = _split_lines(spark, paths)
    return csv_events(quoted_records(lines), log_type, quoted_records(lines.filter("split = 0")))
