"""Readers: layouts, delimiters, broken input, order and format recognition."""

import json

from tests import samples
from vigilake.plans.analyze import events_for, load_events, read_windows_events
from vigilake.sources.auth import auth_events
from vigilake.sources.delimited import read_csv_events
from vigilake.sources.formats import detect_formats, route_files
from vigilake.sources.json_docs import read_json_events
from vigilake.sources.lines import read_lines, scan_text
from vigilake.sources.web import web_events
from vigilake.sources.windows import win_block_events, win_tabular_events
from vigilake.sources.xml_docs import read_xml_events


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("seq").select(*columns).collect()]


def test_order_over_file_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {n}\n" for n in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = scan_text(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        got = [r.value for r in lines.orderBy("seq").collect()]
        assert lines.select("seq").distinct().count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"line {n}" for n in range(5000)]


def test_lines_are_stripped_and_comments_skipped(spark, tmp_path):
    (tmp_path / "a.log").write_text("\t one \n\n   \n# note\n two\n")
    assert rows(read_lines(spark, str(tmp_path), skip_comments=True), "value") == [("one",), ("two",)]
    assert rows(read_lines(spark, str(tmp_path)), "value") == [("one",), ("# note",), ("two",)]


def test_unmatched_lines(lines):
    got = auth_events(lines("free text for nobody"), 2024).first()
    assert (got.message, got.process, got.username, got.is_failed_auth) == ("free text for nobody", "", None, None)
    assert web_events(lines("free text")).first().message == "free text"
    assert win_tabular_events(lines("free text")).count() == 0


def test_mark_inside_a_line(lines):
    got = auth_events(lines("Feb  3 04:00:00 h\x01x sshd[1]: Invalid user a from 1.2.3.4"), 2024).first()
    assert (got.host, got.username, got.src_ip) == ("h\x01x", "a", "1.2.3.4")


def test_username_takes_the_first_word(lines):
    text = "Feb  3 04:00:00 h sshd[1]: Failed password for invalid user admin from 1.2.3.4 port 1"
    assert auth_events(lines(text), 2024).first().username == "invalid"


def test_paths_keep_plus_and_broken_escapes(lines):
    got = web_events(lines('1.2.3.4 - - [03/Feb/2024:04:00:00 +0000] "GET /a+b%zz%20c% HTTP/1.1" 200 1')).first()
    assert (got.path, got.referer, got.useragent) == ("/a+b%zz c%", "", "")


def test_windows_blocks_and_layout(spark, tmp_path):
    block = "EventID: 4624\nAccount Name: ann\nLogon Type: 3\nSource Network Address: 1.2.3.4"
    (tmp_path / "a.txt").write_text(f"{block}\n\n\n{block.replace('3\n', '2\n')}\n\nAccount Name: bob\n")
    (tmp_path / "b.txt").write_bytes(f"{block}\n\n{block}".replace("\n", "\r\n").encode())
    (tmp_path / "c.txt").write_text("02/03/2024 04:00:00 AM P 4625 Logon\tfailed\n")
    events = read_windows_events(spark, str(tmp_path))
    got = sorted((r.source_file[-5:], r.event_id or 0, r.is_pass_the_hash) for r in events.collect())
    assert got == [("a.txt", 0, False), ("a.txt", 4624, False), ("a.txt", 4624, True),
                   ("b.txt", 4624, True), ("b.txt", 4624, True), ("c.txt", 4625, False)]


def test_block_message_is_cut(lines):
    got = win_block_events(lines("EventID: 1102\n" + "x" * 300)).first()
    assert len(got.message) == 200 and len(got.raw) == 314


def test_csv_layouts(spark, tmp_path):
    (tmp_path / "comma.csv").write_text('﻿ Src IP ,user,user\n1.1.1.1,a,b\n\n1.1.1.2,"x, ""y"""\n1.1.1.3,c,d,e\n')
    (tmp_path / "semi.csv").write_text("sip;action\n2.2.2.2;drop\n")
    (tmp_path / "tab.tsv").write_text("sip\taction\n3.3.3.3\tallow\n")
    (tmp_path / "bar.csv").write_text("sip|action\n4.4.4.4|a,b\n")
    got = sorted((r.src_ip, r.username, r.action) for r in read_csv_events(spark, str(tmp_path)).collect())
    assert got == [("1.1.1.1", "b", None), ("1.1.1.2", 'x, "y"', None), ("1.1.1.3", "d", None),
                   ("2.2.2.2", None, "drop"), ("3.3.3.3", None, "allow"), ("4.4.4.4", None, "a,b")]


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('ip,msg\n1.1.1.1,"two\nlines"\n1.1.1.2,one\n')
    got = rows(read_csv_events(spark, str(tmp_path), multiline=True), "src_ip", "message")
    assert got == [("1.1.1.1", "two\nlines"), ("1.1.1.2", "one")]


def test_csv_rows_too_wide_to_split_keep_their_text(spark, tmp_path):
    wide = "9.9.9.9" + "," * 30_000 + "x"
    (tmp_path / "w.csv").write_text(f"ip,msg\n1.1.1.1,a\n{wide}\n{',' * 30_000}\n1.1.1.2,b\n")
    got = [(r.src_ip, r.message, r.raw) for r in read_csv_events(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [("1.1.1.1", "a", "1.1.1.1,a"), (None, None, wide), ("1.1.1.2", "b", "1.1.1.2,b")]


def test_quoted_line_breaks_over_many_splits(spark, tmp_path):
    import csv
    import random

    rng = random.Random(8)
    files = {}
    for name in ("a.csv", "b.csv"):
        files[name] = [["ip", "msg"]] + [[f"10.0.{n // 250}.{n % 250}", "".join(rng.choice(["x", 'say "', "\n", "\n\n", ",", "long word "]) for _ in range(rng.choice([0, 1, 3, 60])))]
                                         for n in range(700)]
        with open(tmp_path / name, "w", newline="") as out:
            csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL if name == "a.csv" else csv.QUOTE_MINIMAL).writerows(files[name])
    settings = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "4000"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        frame = read_csv_events(spark, str(tmp_path), multiline=True)
        got = {}
        for r in frame.select("source_file", "seq", "src_ip", "message").collect():
            got.setdefault(r.source_file[-5:], []).append((r.seq, r.src_ip, r.message))
        parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert parts > 10
    for name, rows_ in files.items():
        assert [(ip, (msg or "").strip()) for _, ip, msg in sorted(got[name])] == [(ip, msg.strip()) for ip, msg in rows_[1:]]


def test_stray_quotes_end_with_the_longest_record(spark):
    from vigilake.sources.delimited import quoted_records

    rows_ = [("f", 0, n, v) for n, v in enumerate(['a,"b', "c", 'd"', 'e"'] + ["x"] * 9)] + [("f", 50, 60 + n, v) for n, v in enumerate(["y", 'z"', "end"])]
    lines = spark.createDataFrame(rows_, "source_file string, split long, seq long, value string")
    whole = sorted((r.seq, r.value) for r in quoted_records(lines).collect())
    assert whole == [(0, 'a,"b\nc\nd"'), (3, "\n".join(['e"'] + ["x"] * 9 + ["y", 'z"'])), (62, "end")]
    short = sorted((r.seq, r.value) for r in quoted_records(lines, longest=5).collect())
    assert short == [(0, 'a,"b\nc\nd"'), (3, 'e"')] + [(n, "x") for n in range(4, 13)] + [(60, "y"), (61, 'z"'), (62, "end")]


def test_json_layouts(spark, tmp_path):
    one, two = {"ip": "1.1.1.1", "n": {"user": "a"}}, {"ip": "1.1.1.2", "n": [{"user": "b"}]}
    (tmp_path / "lines.jsonl").write_text(f"{json.dumps(one)},\nnot json\n3\n[{json.dumps(two)}, 4]\n")
    (tmp_path / "array.json").write_text(json.dumps([one, 3, two], indent=1))
    (tmp_path / "wrapped.json").write_text(json.dumps({"data": "text", "events": [one], "logs": [two]}))
    (tmp_path / "single.json").write_text(json.dumps(two))
    (tmp_path / "broken.json").write_text("{\n" + json.dumps(one) + "\n" + json.dumps(two) + "\n")
    got = sorted((r.source_file.rsplit("/", 1)[1], r.src_ip, r.username) for r in read_json_events(spark, str(tmp_path)).collect())
    both = [("1.1.1.1", "a"), ("1.1.1.2", "b")]
    assert got == sorted(
        [(n, *x) for n in ("lines.jsonl", "array.json", "broken.json") for x in both]
        + [("wrapped.json", *both[0]), ("single.json", *both[1])])


def test_json_values_as_text(lines):
    from vigilake.sources.json_docs import json_line_events
    got = json_line_events(lines('{"id": "x", "code": 404.0, "ok": true, "none": null, "user": "", "deep": {"a": {"b": {"c": {"d": {"e": {"user": "low"}}}}}}}')).first()
    assert (got.event_id, got.event_id_raw, got.status_code, got.is_failed_logon, got.event_type) == (None, "x", 404, False, "generic")
    assert got.fields["ok"] == "True" and got.fields["none"] is None and got.username == "low"


def test_xml_layouts(spark, tmp_path):
    bare = samples.event(4625, IpAddress="1.1.1.1") + "\n" + samples.event(1102, SubjectUserName="s", TargetUserName="t")
    (tmp_path / "bare.xml").write_text(bare)
    (tmp_path / "rooted.xml").write_text(f'<?xml version="1.0"?>\n<Events>{bare}</Events>')
    (tmp_path / "mixed.xml").write_text('<log><meta/><row user="a"><ip>2.2.2.2</ip></row><row><ip>2.2.2.3</ip><tag>x</tag><tag>y</tag></row></log>')
    (tmp_path / "bad.xml").write_text("<log><row></log>")
    got = sorted((r.source_file.rsplit("/", 1)[1], r.event_id or 0, r.src_ip or "", r.username or "") for r in read_xml_events(spark, str(tmp_path)).collect())
    assert got == [("bare.xml", 1102, "", "s"), ("bare.xml", 4625, "1.1.1.1", ""), ("mixed.xml", 0, "2.2.2.2", ""),
                   ("mixed.xml", 0, "2.2.2.3", ""), ("rooted.xml", 1102, "", "s"), ("rooted.xml", 4625, "1.1.1.1", "")]


def test_formats_by_content(spark, tmp_path):
    contents = {
        "auth": "\n".join(samples.auth()), "apache": "\n".join(samples.web()), "windows": "\n".join(samples.windows()),
        "csv": "\n".join(samples.firewall()), "json": samples.cloud().replace("\n", ""), "xml": samples.winevents(), "generic": "hello\nworld",
        "generic_long_json": json.dumps([{"ip": "1.1.1.1"}] * 40, indent=1),
    }
    for name, content in contents.items():
        (tmp_path / name).write_text(content + "\n")
    (tmp_path / "named.JSONL").write_text("<not xml>\n")
    got = {r.source_file.rsplit("/", 1)[1]: r.log_type for r in route_files(scan_text(spark, str(tmp_path))).collect()}
    # a pretty-printed document of more than 50 lines does not parse from its head
    assert got == {**{n: n for n in contents if n != "generic_long_json"}, "generic_long_json": "generic", "named.JSONL": "json"}
    # sshd[, sudo:, Failed password for, Accepted publickey
    assert detect_formats(scan_text(spark, str(tmp_path / "auth"))).first().auth_score == 4


def test_unknown_files_are_judged_by_generic_rules(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello\n")
    assert load_events(spark, str(tmp_path)).first().log_type == "generic"
    assert events_for(spark, "auth", str(tmp_path)).first().log_type == "auth"


def test_names_with_blanks_and_pattern_signs(spark, tmp_path):
    line = "Jan 10 03:0{}:00 web1 sshd[1]: Failed password for root from 10.0.0.{} port 22 ssh2\n"
    for n, name in enumerate(["a b.log", "a[1].log", "50%.log", "x{y}.log"]):
        (tmp_path / name).write_text(line.format(n, n))
    assert sorted(r.src_ip for r in load_events(spark, str(tmp_path)).collect()) == [f"10.0.0.{n}" for n in range(4)]


def test_directories_without_a_line(spark, tmp_path):
    (tmp_path / "empty.log").write_text("")
    assert load_events(spark, str(tmp_path)).collect() == []


def test_blocks_with_mixed_line_ends(spark, tmp_path):
    block = "Event ID: 4625{0}Account Name: u{1}{0}Source Network Address: 10.0.0.{1}{0}"
    text = block.format("\n", 1) + "\n" + block.format("\r\n", 2) + "\r\n" + block.format("\n", 3) + "\n\n" + block.format("\n", 4)
    (tmp_path / "w.txt").write_bytes(text.encode())
    assert [i for i, in rows(read_windows_events(spark, str(tmp_path)), "event_id")] == [4625] * 4


def test_prefixed_event_xml(spark, tmp_path):
    event = '<e:Event xmlns:e="u"><e:System><e:EventID>{}</e:EventID></e:System></e:Event>'
    (tmp_path / "e.xml").write_text('<e:Events xmlns:e="u">' + event.format(4625) + event.format(1102) + "</e:Events>")
    assert [i for i, in rows(read_xml_events(spark, str(tmp_path)), "event_id")] == [4625, 1102]


def test_json_with_repeated_keys_and_lists_on_lines(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{\n"Records": [\n{"eventName": "A"},\n{"ip": "1.1.1.1", "ip": "2.2.2.2"}\n]}')
    (tmp_path / "lists.jsonl").write_text('{broken\n[{"n": 1}, {"n": 2}]\n{"n": 3, "n": 4}\n[{"n": 5}]\n')
    found = read_json_events(spark, str(tmp_path)).orderBy("source_file", "seq").collect()
    assert [r.fields.get("n") or r.fields.get("ip") or r.fields.get("eventName") for r in found] == ["A", "2.2.2.2", "1", "2", "4", "5"]
    lists = [r.seq for r in found if "lists" in r.source_file]
    assert len(set(lists)) == len(lists)
