"""Canonical fields are found by place: per file for tables, per record for documents."""

import json
import re

from vigilake.functions import flatten as fl
from vigilake.operators import detect, hunts
from vigilake.operators.rules import rules
from vigilake.sources.delimited import csv_events, csv_headers
from vigilake.sources.json_docs import json_line_events
from workloads import queries
from workloads.logs import Logs


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_aliases_of_a_table(spark, lines):
    """Earlier aliases first; of columns with one name the last filled; empty cells fill nothing."""
    two = lines("ip,Src-IP,a.user,USER,user,msg", "1,2,x,y,z,m", "1,,x,y,,", ",,x,,,", ",3,,,,é").unionByName(
        lines("message;code;ip", "said;HTTP 503;9", source_file="g.log"))
    events = csv_events(two)
    found = {(r.source_file, r.seq): tuple(r)[2:] for r in events.select("source_file", "seq", "src_ip", "username", "message", "status_code").collect()}
    assert found == {
        ("f.log", 1): ("2", "z", "m", None), ("f.log", 2): ("1", "y", None, None), ("f.log", 3): (None, "x", None, None),
        ("f.log", 4): ("3", None, "é", None), ("g.log", 1): ("9", None, "said", 503)}
    assert "map_from_arrays" not in plan(events.select("src_ip"))


def test_texts_are_not_sorted(lines):
    """Neither the header of a file nor the first record of a rule."""
    assert "SortAggregate" not in plan(csv_headers(lines("a,b", "1,2")))
    profile = detect.key_profile(detect._scoped(csv_events(lines("ip,action", "1,login failed")), "source_file", "seq", ["csv"]), rules(ids=["d18"]))
    assert "SortAggregate" not in plan(profile) and [(r.key, r.n_d18, r.first_d18) for r in profile.collect()] == [("1", 1, 1)]


def test_aliases_of_a_record(spark, lines):
    """The same rule for records, whose names differ from one to the next."""
    records = [{"ip": "1", "x": {"src_ip": "2"}}, {"ip": "1", "src_ip": ""}, {"a": {"user": "u"}, "user": "v", "b": {"user": ""}},
               {"code": 0, "result": False, "id": None, "msg": "\ud800"}, {}]
    events = json_line_events(lines(*[json.dumps(r) for r in records]))
    rows = events.orderBy("seq").select("src_ip", "username", "status_code", "status", "event_id_raw", "message").collect()
    assert [tuple(r) for r in rows] == [
        ("2", None, None, None, None, None), ("1", None, None, None, None, None), (None, "v", None, None, None, None),
        (None, None, 0, "False", None, "?"), (None,) * 6]
    assert "map_from_arrays" not in plan(events.select("src_ip"))


def test_leaves_are_those_of_unfolding():
    for record in ({}, {"": {"": 1, "a": [[], {}, [2, {"b": None}]]}}, {"a": {"": [1, [2, {"": 3}]]}, "": [4, {"x": 5}], "z": {"y": {"x": True}}, "w": 1.5}):
        assert fl.json_leaves(record) == fl.unfold("", record, fl.json_members)


def test_sorted_tables_read_their_logs_once(lines):
    found = plan(hunts.hunt_table(json_line_events(lines('{"user": "u"}'))))
    below = found[found.index("rangepartitioning"):]
    assert re.search(r"Exchange RoundRobinPartitioning", below) and below.index("RoundRobin") < below.index("json_entries")


def test_rules_are_made_from_stored_events(spark, monkeypatch):
    """Both runs of the sink read events that were parsed once."""
    read = []
    known = queries.detect.detect
    monkeypatch.setattr(queries.detect, "detect", lambda events, chosen: read.append(events) or known(events, chosen))
    queries.QUERIES["r7_rules_sink"](Logs(spark, "/root/testdata/sf0.001"))
    assert len(read) == 2 and all("auth-events" in f for e in read for f in e.inputFiles())
