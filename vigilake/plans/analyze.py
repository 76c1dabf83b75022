"""Whole runs: files -> events -> findings -> rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.detect import detect_all
from vigilake.operators.ranking import filter_severity
from vigilake.plans import catalog
from vigilake.session import configure, shared_path, written
from vigilake.sources.auth import auth_events
from vigilake.sources.delimited import read_csv_events
from vigilake.sources.formats import route_files
from vigilake.sources.heads import head_scan, scan_files
from vigilake.sources.json_docs import read_json_events
from vigilake.sources.lines import as_paths, scan_text
from vigilake.sources.web import web_events
from vigilake.sources.windows import cut_blocks, win_block_events, win_files, win_tabular_events
from vigilake.sources.xml_docs import read_xml_events


def events_for(spark: SparkSession, log_type: str, paths, default_year: int | None = None) -> DataFrame:
    """Events of files of one known type; an unknown type is read as system-login lines
    and later judged by the generic rules."""
    if log_type == "csv":
        return read_csv_events(spark, paths)
    if log_type == "json":
        return read_json_events(spark, paths)
    if log_type == "xml":
        return read_xml_events(spark, paths)
    lines = scan_text(spark, paths)
    if log_type == "apache":
        return web_events(lines)
    if log_type == "windows":
        return read_windows_events(spark, paths)
    return auth_events(lines, default_year, "auth" if log_type == "auth" else "generic")


def read_windows_events(spark: SparkSession, paths) -> DataFrame:
    """Windows text files of both layouts. One job finds layout and usual line ends per file."""
    # cut at line feeds only, so that a carriage return stays visible
    layouts = written(win_files(scan_files(spark, paths, "\n")), "win-layouts")
    parts = []
    for layout, crlf in sorted(layouts.select("layout", "crlf").distinct().collect()):
        mine = layouts.where((F.col("layout") == layout) & (F.col("crlf") == crlf)).select("source_file")
        if layout == "tabular":
            parts.append(win_tabular_events(scan_files(spark, paths, only=mine)))
        else:
            blocks = scan_files(spark, paths, "\r\n\r\n" if crlf else "\n\n", mine)
            parts.append(win_block_events(cut_blocks(blocks)))
    return reduce(DataFrame.unionByName, parts) if parts else win_tabular_events(scan_text(spark, paths))


def _files_by(files: DataFrame, *keys: str) -> dict[tuple, list[str]]:
    """File names per group: names only, which the driver lists for every scan anyway."""
    names: dict[tuple, list[str]] = {}
    for r in files.select(*keys, "source_file").collect():
        names.setdefault(tuple(r[k] for k in keys), []).append(r["source_file"])
    return {k: as_paths(sorted(v)) for k, v in names.items()}


def load_events(spark: SparkSession, paths, default_year: int | None = None) -> DataFrame:
    """Events of a whole directory of mixed formats: one routing job, then one reader per
    format over that format's files."""
    configure(spark)
    groups = _files_by(route_files(head_scan(spark, paths)), "log_type")
    parts = [events_for(spark, t, names, default_year) for (t,), names in sorted(groups.items())]
    # a directory without a line has no events
    return reduce(DataFrame.unionByName, parts) if parts else events_for(spark, "auth", paths, default_year)


def analyze(spark: SparkSession, paths, output: str | None = None, formats: str = "sigma",
            severity: str = "all", thresholds: dict[str, int] | None = None,
            default_year: int | None = None, scoped: bool = False) -> DataFrame:
    """Findings of a directory of logs at or above a severity.

    Events are written once (to ``output``, or to the shared folder), so that the text is
    parsed a single time and each rule family reads only its own type and columns. With
    ``output`` the findings and rules are written next to them: in place of all that is there, or,
    with ``scoped``, of what is there for the files of this run (``catalog.replace_scopes``).
    """
    base = output.rstrip("/") if output and not scoped else shared_path(spark, "analyze")
    events = load_events(spark, paths, default_year)
    catalog.write_events(events, f"{base}/events")
    stored = spark.read.schema(events.schema).parquet(f"{base}/events")
    findings = written(filter_severity(detect_all(stored, thresholds), severity), "findings")
    if output and scoped:
        scopes, base = stored.select("scope").distinct(), output.rstrip("/")
        catalog.replace_scopes(stored, f"{base}/events", scopes)
        catalog.replace_scopes(findings, f"{base}/findings", scopes)
        catalog.replace_scopes(catalog.rules_table(findings, formats), f"{base}/rules", scopes, ("format", "rule_name"))
        return findings
    if output:
        catalog.write_findings(findings, f"{base}/findings")
        rules = catalog.rules_table(findings, formats)
        catalog.write_rules(rules, f"{base}/rules")
        catalog.write_rule_texts(rules, f"{base}/rule_texts")
    return findings
