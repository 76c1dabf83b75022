"""JSON logs -> events: JSON Lines, arrays, wrapper objects and single objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake import fixed
from vigilake.functions import text
from vigilake.functions.flatten import json_entries
from vigilake.functions.normalize import normalize
from vigilake.sources.heads import head_scan, scan_files
from vigilake.sources.lines import as_paths, scan_text, spaced

BOM = "﻿"
_TEXTS = "array<string>"


def _is_object(value: Column) -> Column:
    return F.json_object_keys(value).isNotNull()


def _list_members(value: Column) -> Column:
    """Texts of the members of a JSON array, NULL for anything else."""
    return F.when(value.startswith("["), F.from_json(value, _TEXTS))


def parses(value: Column) -> Column:
    """Whether a text is a JSON object or list, of any size and with any keys."""
    return F.coalesce(_is_object(value), F.lit(False)) | F.coalesce(_list_members(value).isNotNull(), F.lit(False))


def document_members(value: Column) -> Column:
    """Record texts of a whole document: members of the list, of the first wrapper key
    that holds a list, or the object itself."""
    # a key that holds no list reads as NULL; of a key given twice the later one counts
    # keys that differ in case only cannot be fields of one schema
    rest, tops = list(fixed.JSON_WRAPPER_KEYS), {}
    while rest:
        group = {key.lower(): key for key in reversed(rest)}.values()
        parsed = F.from_json(value, ", ".join(f"`{key}` {_TEXTS}" for key in group))
        tops |= {key: parsed[key] for key in group}
        rest = [key for key in rest if key not in tops]
    wrapped = [tops[key] for key in fixed.JSON_WRAPPER_KEYS]
    return F.when(
        _is_object(value), F.coalesce(*wrapped, F.array(value))
    ).otherwise(_list_members(value))


def line_members(value: Column) -> Column:
    """Record texts of one line: the object, or the members of an array."""
    return F.when(_is_object(value), F.array(value)).otherwise(_list_members(value))


def _events(rows: DataFrame, members: Column, log_type: str) -> DataFrame:
    """Rows of texts -> events. Members keep their order: the position inside a row
    follows the row's own number, which leaves room for it."""
    records = (
        rows.select("source_file", "seq", F.posexplode(members).alias("_at", "raw"))
        .withColumn("_p", json_entries("raw"))
        .filter("_p is not null")
    )
    placed = records.select("source_file", (F.col("seq") + F.col("_at")).alias("seq"), "raw", "_p.entries", "_p.at")
    return normalize(placed, log_type)


def _cut_line(value: Column) -> Column:
    """A line without blanks around it, byte order mark and trailing commas."""
    return text.strip(F.rtrim(text.strip(F.ltrim(value, F.lit(BOM))), F.lit(",")))


def json_line_events(lines: DataFrame, log_type: str = "json") -> DataFrame:
    """Events of JSON Lines; trailing commas are cut, lines that do not parse skipped."""
    cut = lines.withColumn("value", _cut_line(F.col("value"))).filter("value <> ''")
    return _events(cut, line_members(F.col("value")), log_type)


def json_document_events(documents: DataFrame, log_type: str = "json") -> DataFrame:
    """Events of whole documents, one per row. A document is one row while it is split."""
    value = text.strip(F.ltrim(text.strip(F.col("value")), F.lit(BOM)))
    return _events(documents.withColumn("value", value), document_members(F.col("value")), log_type)


def json_whole_events(documents: DataFrame, log_type: str = "json") -> DataFrame:
    """Events of whole files, one per row, each read and parsed once: members of the document, or
    those of its lines where it does not parse as a whole."""
    value = text.strip(F.ltrim(text.strip(F.col("value")), F.lit(BOM)))
    rows = documents.withColumn("_whole", text.once(document_members(value)))
    lines = F.when(F.col("_whole").isNull(), F.split("value", "\r\n|\r|\n")).otherwise(F.array(F.lit("")))
    pieces = rows.select("source_file", "_whole", F.posexplode(lines).alias("_line", "_said"))
    members = F.coalesce("_whole", line_members(_cut_line(F.col("_said"))))
    placed = pieces.withColumn("seq", F.col("_line").cast("bigint") * (1 << 20))
    return _events(placed, members, log_type)


def json_layout(lines: DataFrame) -> DataFrame:
    """``(source_file, layout)``: ``lines`` by name (``.jsonl``, ``.ndjson``) or if the first
    non-blank line parses by itself and more follow (such a file cannot be one document),
    else ``document``."""
    filled = lines.withColumn("value", text.strip(F.ltrim("value", F.lit(BOM)))).filter("value <> ''")
    first = filled.groupBy("source_file").agg(
        F.min_by("value", "seq").alias("first"), F.count(F.lit(1)).alias("n")
    )
    whole = parses(text.strip(F.rtrim("first", F.lit(","))))
    by_name = F.lower("source_file").rlike(r"\.(jsonl|ndjson)$")
    return first.select(
        "source_file", F.when(by_name | (whole & (F.col("n") > 1)), "lines").otherwise("document").alias("layout")
    )


def read_json_events(spark: SparkSession, paths, layout: str | None = None, log_type: str = "json") -> DataFrame:
    """Events of JSON files. With ``layout`` (``lines`` or ``document``) given nothing is
    probed. Otherwise one job finds the layout per file; only file names, which the
    driver lists anyway, come back from it. A document that does not parse as a whole is
    read line by line."""
    if layout == "lines":
        return json_line_events(spaced(scan_text(spark, paths)), log_type)
    if layout == "document":
        return json_document_events(scan_files(spark, paths, whole=True), log_type)
    files: dict[str, list[str]] = {}
    for r in json_layout(head_scan(spark, paths)).collect():
        files.setdefault(r["layout"], []).append(r["source_file"])
    parts = []
    if "lines" in files:
        parts.append(json_line_events(spaced(scan_text(spark, as_paths(sorted(files["lines"])))), log_type))
    if "document" in files:
        parts.append(json_whole_events(scan_files(spark, as_paths(sorted(files["document"])), whole=True), log_type))
    return reduce(DataFrame.unionByName, parts) if parts else json_line_events(scan_text(spark, paths), log_type)
