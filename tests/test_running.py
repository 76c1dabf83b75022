"""Streams over several micro-batches: the same as batches, with state that ends."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tests import samples
from vigilake.session import shared_path
from vigilake.streaming import alerts, raw, running, sinks

START = datetime.datetime(2024, 2, 3, 4)
SCHEMA = ("source_file string, seq bigint, raw string, log_type string, src_ip string, event_ts timestamp, is_failed_auth boolean,"
          " is_accepted_auth boolean, is_4xx boolean, is_denied boolean, is_error_status boolean")


def event(seq, seconds, ip, failed=False, accepted=False, kind="auth", **flags):
    at = None if seconds is None else START + datetime.timedelta(seconds=seconds)
    return ("f", seq, f"line {seq}", kind, ip, at, failed, accepted, flags.get("web"), flags.get("denied"), flags.get("error"))


def fed(spark, name, *batches, schema=SCHEMA):
    """A stream of one file per batch, in order."""
    path = shared_path(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, stream, name):
    """Rows by micro-batch, and rows in state after each batch."""
    seen, state = [], shared_path(spark, f"{name}-state")
    query = stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(
        lambda batch, n: seen.append(sorted(map(tuple, batch.collect()), key=str))).start()
    query.awaitTermination()
    return seen, [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]


def flat(seen):
    return sorted((r for rows in seen for r in rows), key=str)


CLOSING = [event(9001, 400_000, "9.9.9.9", failed=True), event(9002, 400_000, "9.9.9.9", accepted=True)]


def test_success_after_failures(spark):
    rng = random.Random(4)
    rows = [event(n, int(n * 45 + rng.random() * 30), f"10.0.0.{rng.randrange(5)}", failed := rng.random() < 0.6, not failed) for n in range(240)]
    rows += [event(500, 10, "1.1.1.1", True), event(501, 3609, "1.1.1.1", accepted=True), event(502, 3611, "1.1.1.1", accepted=True),
             event(503, 50, "2.2.2.2", accepted=True), event(504, 51, "2.2.2.2", True), event(505, 60, None, True), event(506, None, "3.3.3.3", True),
             event(507, 70, "4.4.4.4", True), event(508, 70, "4.4.4.4", accepted=True)]
    rows.sort(key=lambda r: (r[5] is None, r[5]))
    frame = spark.createDataFrame(rows, SCHEMA)
    batch = sorted(map(tuple, running.success_after_failures(frame).collect()), key=str)
    plain = []
    for ip, at in sorted({(r[4], r[5]) for r in rows if r[7] and r[5] and r[4]}):
        before = [r for r in rows if r[4] == ip and r[6] and r[5] and at - datetime.timedelta(hours=1) <= r[5] <= at]
        if before:
            sample = min((r for r in rows if r[4] == ip and r[5] == at and r[7]), key=lambda r: r[1])
            plain.append(("f", ip, at, len(before), min(r[5] for r in before), sample[2]))
    assert batch == sorted(plain, key=str) != []
    assert {r[1:4] for r in batch if r[1] in ("1.1.1.1", "2.2.2.2", "4.4.4.4")} == {
        ("1.1.1.1", START + datetime.timedelta(seconds=3609), 1), ("4.4.4.4", START + datetime.timedelta(seconds=70), 1)}
    parts = [rows[n:n + 60] for n in range(0, len(rows), 60)]
    seen, state = drained(spark, running.success_after_failures(fed(spark, "d4", *parts, CLOSING)), "d4")
    assert flat(seen) == batch
    assert max(state) > 60 and state[-1] <= 8  # only the closing rows are left


def test_crossings_tell_once(spark):
    def hits(seq, count, seconds, ip, **kind):
        return [event(seq + n, seconds + n, ip, **kind) for n in range(count)]

    one = hits(0, 3, 0, "1.1.1.1", failed=True) + hits(10, 4, 0, "2.2.2.2", failed=True) + hits(30, 21, 0, "1.1.1.1", kind="apache", web=True)
    two = hits(100, 3, 600, "1.1.1.1", failed=True) + hits(110, 9, 600, "3.3.3.3", kind="csv", denied=True) + hits(130, 5, 600, "", failed=True)
    three = hits(200, 9, 1200, "1.1.1.1", failed=True) + hits(210, 1, 1200, "3.3.3.3", kind="json", denied=True) + hits(220, 19, 1200, "4.4.4.4", kind="csv", error=True)
    batch = running.crossings(spark.createDataFrame(one + two + three, SCHEMA))
    assert sorted((r.rule_name, r.src_ip, r.hits, r.threshold) for r in batch.collect()) == [
        ("generic_block_deny_surge", "3.3.3.3", 10, 10), ("ssh_brute_force_by_ip", "1.1.1.1", 15, 5), ("web_directory_scanning", "1.1.1.1", 21, 20)]
    seen, _ = drained(spark, running.crossings(fed(spark, "cross", one, two, three)), "cross")
    found = [[(r[0], r[4], r[5]) for r in rows] for rows in seen if rows]
    assert found == [[("web_directory_scanning", "1.1.1.1", 21)], [("ssh_brute_force_by_ip", "1.1.1.1", 6)], [("generic_block_deny_surge", "3.3.3.3", 10)]]
    with pytest.raises(ValueError):
        running.crossings(spark.createDataFrame(one, SCHEMA), ids=("d2",))


def test_crossings_forget(spark):
    day = 86_400
    parts = [[event(n, 60 * n, "1.1.1.1", True) for n in range(5)], [event(20, 10 * day, "2.2.2.2", True)],
             [event(30 + n, 10 * day + n, "1.1.1.1", True) for n in range(5)], [event(50, 20 * day, "3.3.3.3", True)], [event(60, 30 * day, "4.4.4.4", True)]]
    seen, state = drained(spark, running.crossings(fed(spark, "forget", *parts)), "forget")
    assert [r[4] for r in flat(seen)] == ["1.1.1.1", "1.1.1.1"]
    assert state[-1] <= 1


def test_earliest_alert_of_the_hour(spark):
    def alert(minutes, ip, hits):
        return ("r", ip, START + datetime.timedelta(minutes=minutes), hits)

    schema = "rule_name string, src_ip string, window_start timestamp, hits int"
    parts = [[alert(20, "1.1.1.1", 1), alert(65, "2.2.2.2", 2)], [alert(5, "1.1.1.1", 3), alert(61, "2.2.2.2", 4), alert(5, "1.1.1.1", 2)],
             [alert(70, "1.1.1.1", 5)], [alert(600, "9.9.9.9", 9)]]
    rows = [r for part in parts[:-1] for r in part]
    batch = sorted(map(tuple, alerts.earliest_per_period(spark.createDataFrame(rows, schema)).collect()))
    assert [(r[1], r[3]) for r in batch] == [("1.1.1.1", 2), ("1.1.1.1", 5), ("2.2.2.2", 4)]
    found = alerts.earliest_per_period(fed(spark, "first", *parts, schema=schema), watermark="2 hours")
    seen, state = drained(spark, found, "first")
    assert flat(seen) == sorted(batch, key=str)
    assert state[-1] == 1


def test_windows_then_earliest(spark):
    rows = [event(n, 300 * n, "1.1.1.1", True) for n in range(40)] + [event(100 + n, 300 * n + 1, "1.1.1.1", True) for n in range(5, 40)]
    rows.sort(key=lambda r: r[5])

    def chain(df):
        found = alerts.windowed_alerts(df, F.col("is_failed_auth"), "repeated_auth_failures", threshold=2, watermark="5 minutes" if df.isStreaming else None, timed=True)
        return alerts.earliest_per_period(found, time="alert_time").drop("alert_time")

    batch = sorted(map(tuple, chain(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    seen, _ = drained(spark, chain(fed(spark, "chain", rows[:20], rows[20:50], rows[50:], CLOSING)), "chain")
    assert flat(seen) == batch and len(batch) == 4


def test_late_rows_have_a_table(spark):
    parts = [[event(n, n, "1.1.1.1", True) for n in range(6)], [event(10, 7200, "2.2.2.2", True)], [event(11, 7201, "2.2.2.2", True)],
             [event(20 + n, n, "1.1.1.1", True) for n in range(4)] + [event(30, 7000, "2.2.2.2", True)], CLOSING[:1]]
    out = shared_path(spark, "kept")
    for _ in range(2):  # the second query runs every batch again
        stream = fed(spark, "late", *parts)
        sinks.keep_with_late(stream, out, shared_path(spark, "kept-state"), "5 minutes", once=True).awaitTermination()
        events, late = (sorted(r.seq for r in sinks.read_kept(spark, out, SCHEMA, t).collect()) for t in ("events", "late"))
        assert events == sorted(r[1] for p in parts for r in p)
        assert late == [20, 21, 22, 23]
    found = alerts.windowed_alerts(fed(spark, "late", *parts), F.col("is_failed_auth"), "repeated_auth_failures", threshold=0, watermark="5 minutes")
    seen, _ = drained(spark, found, "late-windows")
    assert sorted((r[1], r[4]) for r in flat(seen)) == [("1.1.1.1", 6), ("2.2.2.2", 1), ("2.2.2.2", 2)]
    frame = spark.createDataFrame(parts[3], SCHEMA)
    sinks.store_batch(frame, 3, out, "5 minutes", "10 minutes")
    assert sorted(r.seq for r in sinks.read_kept(spark, out, SCHEMA, "late").collect()) == [20, 21, 22, 23]


def test_raw_lines_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for n, part in enumerate((samples.auth()[:9], samples.auth()[9:])):
        (folder / f"a{n}.log").write_text("\n".join(part) + "\n")
    found = raw.stream_events(spark, str(folder), "auth", max_files=1, default_year=2024).select("raw", "src_ip", "is_failed_auth")
    seen, _ = drained(spark, found, "raw")
    whole = raw.events_for(spark, "auth", str(folder), 2024).select("raw", "src_ip", "is_failed_auth")
    assert len(seen) == 2 and flat(seen) == sorted(map(tuple, whole.collect()), key=str) != []
    with pytest.raises(ValueError):
        raw.stream_events(spark, str(folder), "csv")


def test_ingest_of_whole_files(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.csv").write_text("src_ip,action\n1.1.1.1,deny\n2.2.2.2,pass\n")
    (folder / "b.csv").write_text("user;source ip\nann;3.3.3.3\n")
    (folder / "c d.log").write_text("\n".join(samples.auth()) + "\n")
    raw.ingest(spark, str(folder), out, state, max_files=2, default_year=2024, once=True).awaitTermination()
    (folder / "d.json").write_text('{"sourceIPAddress": "4.4.4.4"}\n{"sourceIPAddress": "5.5.5.5"}\n')
    raw.ingest(spark, str(folder), out, state, max_files=2, default_year=2024, once=True).awaitTermination()
    events = raw.read_ingested(spark, out)
    assert sorted(r.src_ip for r in events.filter("log_type in ('csv', 'json')").collect()) == [f"{n}.{n}.{n}.{n}" for n in range(1, 6)]
    assert events.count() == raw.load_events(spark, str(folder), 2024).count()
    assert events.select("batch").distinct().count() == 3
    # run again without its checkpoint: whole batches stay as they are
    raw.ingest(spark, str(folder), out, str(tmp_path / "state2"), max_files=2, default_year=2024, once=True).awaitTermination()
    assert events.count() == raw.read_ingested(spark, out).count()
    stream = raw.read_ingested(spark, out, streaming=True)
    seen, _ = drained(spark, stream.select("src_ip"), "again")
    assert len(flat(seen)) == events.count()
