"""Small files, slices of streams and batches of files at sizes that one task or one batch each would not serve."""

import datetime
import glob
import re
from xml.etree.ElementTree import Element

import pytest

from vigilake.functions import flatten as fl
from vigilake.session import shared_path
from vigilake.streaming import running
from workloads import streams, views
from workloads.files import FileLogs


def made(spark, names, each):
    rows = [(f"{name}.csv", i - 1, "Src-IP,action" if i == 0 else f"10.0.0.{i},deny") for name in names for i in range(each)]
    return spark.createDataFrame(rows, "source_file string, seq bigint, value string").repartition(3)


def test_small_files_are_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(views, "firewall_lines", lambda *_: made(spark, [f"f{n}" for n in range(40)], 3), raising=True)
    path = FileLogs(spark, "none").folder("firewall_lines")
    found = glob.glob(f"{path}/source_file=*/part-*.txt")
    assert len(found) == 40 and len({re.search(r"part-(\d+)", f)[1] for f in found}) > 1
    assert all(open(f).read() == "Src-IP,action\n10.0.0.1,deny\n10.0.0.2,deny\n" for f in found)


def test_names_are_taken_in_in_a_bounded_number_of_batches(spark, monkeypatch):
    monkeypatch.setattr(views, "firewall_lines", lambda *_: made(spark, [f"f{n}" for n in range(12)], 2), raising=True)
    monkeypatch.setattr(streams, "BATCHES", 2, raising=False)
    events = streams.IngestedLogs(spark, "none").csv
    assert events.select("batch").distinct().count() == 2
    assert sorted(r.source_file for r in events.collect()) == sorted(f"f{n}.csv" for n in range(12))


@pytest.mark.parametrize("rows_per_file", [1_000_000, 7])
def test_slices_of_several_files_are_one_batch_each(spark, monkeypatch, rows_per_file):
    monkeypatch.setattr(streams, "SLICE_FILE", rows_per_file, raising=False)
    start = datetime.datetime(2024, 2, 3, 4)
    # all rows lie in the first and the last slice, so the others have none
    rows = [("f", n, "x", "auth", f"10.0.0.{n % 4}", start + datetime.timedelta(minutes=n, days=30 * (n % 2)), True, False, False, False, False) for n in range(60)]
    kinds = "source_file string, seq bigint, raw string, log_type string, src_ip string, event_ts timestamp, " + ", ".join(f"{f} boolean" for f in streams.FLAGS)
    logs = FileLogs(spark, "none")
    stream = streams.arriving(logs, spark.createDataFrame(rows, kinds), "scale")
    found = running.crossings(stream, thresholds={"d1": 6}, delay="1 hour", forget="4000 days")
    out = streams.drained(logs, found, "scale").collect()
    assert sorted((r.src_ip, r.hits) for r in out) == [(f"10.0.0.{n}", 15) for n in range(4)]
    streams.put(spark.range(3), path := shared_path(spark, "put"), 5, 2)
    assert len(spark.read.parquet(path).inputFiles()) == 5 and spark.read.parquet(path).count() == 3


def test_xml_records_become_trees_without_python_in_between():
    tree = fl.element('<a x="1">t<!-- c -->u<b/>tail</a>')
    assert isinstance(tree, Element) and (tree.text, tree.attrib, len(tree)) == ("tu", {"x": "1"}, 1)
    assert fl.element("<a>") is None and fl.element("") is None
