"""Folders of many small files: written and read by tasks as Spark's own writer and reader do it."""

import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from vigilake.plans.analyze import read_windows_events
from vigilake.session import shared_path
from vigilake.sources import heads
from vigilake.sources.heads import scan_files
from vigilake.sources.lines import scan_text
from vigilake.sources.xml_docs import read_xml_events
from workloads import files, views
from workloads.files import FileLogs


@pytest.fixture
def folder(tmp_path):
    texts = {"plain.log": "a\nb\n", "open end.log": "a\r\nb\rc", "100%[x].log": "x\n\n" * 40, "empty.log": "", "blank.log": "\n\n\n\n\n",
             "mark.log": "﻿é\n\nü\n", "long.log": "z" * 900 + "\n\ny\r\n\r\nx\n" + "w" * 900, "broken.log": "a\n\nb\n \n\r\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bytes.log").write_bytes(b"\xff\xfe\n\xe9\n")
    (tmp_path / "packed.log.gz").write_bytes(gzip.compress(b"g1\ng2\n"))
    return str(tmp_path)


@pytest.fixture
def many(monkeypatch):
    """Few files and a short one count as many and a small one; returns how many files tasks were given to read."""
    monkeypatch.setattr(heads, "MANY", 0)
    monkeypatch.setattr(heads, "SMALL", 1000)
    given = []
    rows_of = heads._rows_of
    monkeypatch.setattr(heads, "_rows_of", lambda spark, files, count, *more: given.append(count) or rows_of(spark, files, count, *more))
    return given


def said(lines):
    rows = lines.orderBy("source_file", "seq").select("source_file", F.hex(F.col("value").cast("binary")).alias("value")).collect()
    return [(r.source_file, r.value) for r in rows]


@pytest.mark.parametrize("line_sep", [None, "\n", "\n\n", "\r\n\r\n"])
def test_same_lines_as_a_scan(spark, folder, many, line_sep):
    assert said(scan_files(spark, folder, line_sep)) == said(scan_text(spark, folder, line_sep)) != []
    assert many == [7]  # neither the packed file nor the long one nor the empty one


def test_whole_files_and_some_of_them(spark, folder, many):
    assert said(scan_files(spark, folder, whole=True)) == said(heads._whole_texts(spark, folder)) != []
    some = heads.manifest(spark, folder).where(~F.col("source_file").contains("blank") & ~F.col("source_file").contains("plain")).select("source_file")
    left = [r for r in said(scan_text(spark, folder)) if "blank" not in r[0] and "plain" not in r[0]]
    assert said(scan_files(spark, folder, only=some)) == left != []
    heads.MANY = 1000  # the same by the text reader
    assert said(scan_files(spark, folder, only=some)) == left and many == [7, 5]


def test_empty_files_and_other_stores(spark, folder, many):
    spark.conf.set(heads.DIRECT_SETTING, "nothing")
    try:
        assert said(scan_files(spark, folder)) == said(scan_text(spark, folder)) and not many
    finally:
        spark.conf.unset(heads.DIRECT_SETTING)
    assert said(scan_files(spark, f"{folder}/empty.log")) == []


def test_readers_of_many_small_files(spark, tmp_path, many):
    (tmp_path / "t.log").write_text("01/02/2024 03:04:05 AM Microsoft-Windows-Security-Auditing 4625 Category 1 \t event for a\n")
    (tmp_path / "b.log").write_bytes(b"EventID: 4624\r\nAccount Name: a\r\n\r\nEventID: 4625\r\nAccount Name: b\r\n")
    (tmp_path / "e.log").write_text("EventID: 4624\nAccount Name: a\n\n\nEventID: 4720\n")
    (tmp_path / "x").mkdir()
    for n in range(3):
        (tmp_path / "x" / f"{n}.xml").write_text("<?xml version='1.0'?><Events>" + f"<Event><System><EventID>{n}</EventID></System></Event>" * (n + 1) + "</Events>")
    (tmp_path / "x" / "d.xml").write_text("<all><e a='1'/><e a='2'/></all>")

    def rows(events):
        return sorted((r.source_file, str(r.event_id), r.username, r.raw) for r in events.collect())

    found = rows(read_windows_events(spark, str(tmp_path / "*.log"))), rows(read_xml_events(spark, str(tmp_path / "x")))
    assert [len(f) for f in found] == [5, 8] and many
    heads.MANY = 1000
    assert found == (rows(read_windows_events(spark, str(tmp_path / "*.log"))), rows(read_xml_events(spark, str(tmp_path / "x"))))


def test_files_are_written_as_spark_writes_them(spark, monkeypatch):
    names = ["a.log", "b c=%/x.log", "".join(map(chr, [1, 7, 9, 31, *range(33, 127), 127])), "ä.log", "", None]
    rows = [(name, at, None if at == 1 else f"{name} {at} é") for name in names for at in (2, 0, 1)]
    lines = spark.createDataFrame(rows, "source_file string, seq bigint, value string")
    logs, wrote = FileLogs(spark, "none"), []
    for own in (True, False):
        if not own:
            monkeypatch.setattr(files, "opened", lambda *_: None)
        path = logs.filed(lines, shared_path(spark, "written"), "\n\n")
        found = {d: [open(f, "rb").read() for f in glob.glob(f"{path}/{d}/part-*.txt")] for d in os.listdir(path) if d.startswith("source_file=")}
        wrote.append(found)
        assert bool(glob.glob(f"{path}/*/.*.crc")) != own  # two files and three processes for each before
    assert wrote[0].keys() == wrote[1].keys() and len(wrote[0]) == 5
    for one in wrote:  # two names meet here, which may lie in one file or in two
        one["source_file=__HIVE_DEFAULT_PARTITION__"] = sorted(b"".join(one["source_file=__HIVE_DEFAULT_PARTITION__"]).split(b"\n\n"))
    assert wrote[0] == wrote[1]


def test_folders_of_files_are_no_columns(spark, monkeypatch):
    monkeypatch.setattr(views, "web_lines", lambda *_: spark.createDataFrame([("7", 0, "x"), ("8", 0, "y")], "source_file string, seq bigint, value string"))
    logs = FileLogs(spark, "none")
    assert spark.read.text(logs.each(logs.folder("web_lines"))).columns == ["value"]
    assert sorted((r.source_file, r.value) for r in logs.raw("web_lines").collect()) == [("7", "x"), ("8", "y")]
    monkeypatch.setattr(views, "web_lines", lambda *_: spark.createDataFrame([], "source_file string, seq bigint, value string"))
    assert logs.raw("web_lines").collect() == []
