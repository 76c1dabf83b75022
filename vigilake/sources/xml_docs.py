"""XML logs -> events: Windows event exports and generic record files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import text
from vigilake.functions.flatten import xml_children, xml_entries
from vigilake.functions.normalize import normalize
from vigilake.session import written
from vigilake.sources.formats import head_lines
from vigilake.sources.heads import head_scan, scan_files

EVENT_END = "</Event>"


def xml_record_events(records: DataFrame, log_type: str = "xml") -> DataFrame:
    """Events of record texts, one XML element per row; others are dropped."""
    flat = records.withColumn("_p", xml_entries("value")).filter("_p is not null")
    return normalize(flat.select("source_file", "seq", F.col("value").alias("raw"), "_p.entries", "_p.at"), log_type)


def event_records(pieces: DataFrame, end: str = EVENT_END) -> DataFrame:
    """Pieces cut at the end tag of ``Event`` -> one event element per row.

    Works for rooted files and for bare sibling events alike: what stands before the
    start tag (declaration, root tag, blanks) is cut off, a piece without one is the tail
    of the file.
    """
    element = F.regexp_extract("value", r"(?s)<(?:\w+:)?Event(?:\s[^>]*)?>.*", 0)
    return pieces.withColumn("value", element).filter("value <> ''").withColumn(
        "value", F.concat("value", F.lit(end))
    )


def xml_document_events(documents: DataFrame, log_type: str = "xml") -> DataFrame:
    """Events of whole generic documents, one per row: the root itself if it is an event,
    else its children of the most frequent tag."""
    records = documents.select(
        "source_file", "seq", F.posexplode(xml_children("value")).alias("at", "value")
    )
    return xml_record_events(records.withColumn("seq", F.col("seq") + F.col("at")), log_type)


def xml_kinds(lines: DataFrame) -> DataFrame:
    """``(source_file, kind, tag)``: ``event`` where the file's first element other than a
    root ``Events`` is an event, else ``document``; and that element's name with its prefix."""
    tag = F.regexp_extract(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"])),
        r"(?s)^\W*(?:<[?!][^>]*>\s*)*(?:<(?:\w+:)?Events\b[^>]*>\s*)?<((?:\w+:)?\w+)", 1,
    )
    first = lines.filter(text.strip(F.col("value")) != "")
    return first.groupBy("source_file").agg(tag.alias("tag")).select(
        "source_file", F.when(F.col("tag").rlike(r"^(\w+:)?Event$"), "event").otherwise("document").alias("kind"), "tag"
    )


def read_xml_events(spark: SparkSession, paths, kind: str | None = None, log_type: str = "xml",
                    tag: str = "Event", only: DataFrame | None = None) -> DataFrame:
    """Events of XML files. ``kind='event'`` cuts the files at event end tags, which splits
    large files over tasks; ``kind='document'`` reads a file as one row. Without it one
    small job over the head of each file decides. ``only`` is a table of the names to read."""
    if kind == "event":
        end = f"</{tag}>"
        return xml_record_events(event_records(scan_files(spark, paths, end, only), end), log_type)
    if kind == "document":
        return xml_document_events(scan_files(spark, paths, only=only, whole=True), log_type)
    # one reader per end tag; documents are read alike whatever their tags
    tag = F.when(F.col("kind") == "event", F.col("tag")).otherwise("")
    kinds = written(xml_kinds(head_lines(head_scan(spark, paths))).select("kind", tag.alias("tag"), "source_file"), "xml-kinds")
    groups = sorted((r["kind"], r["tag"]) for r in kinds.select("kind", "tag").distinct().collect())
    parts = [read_xml_events(spark, paths, kind, log_type, tag, kinds.where((F.col("kind") == kind) & (F.col("tag") == tag)).select("source_file"))
             for kind, tag in groups]
    return reduce(DataFrame.unionByName, parts) if parts else read_xml_events(spark, paths, "event", log_type)
