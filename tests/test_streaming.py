"""Windows and running detections: streams give what batches give."""

import datetime

from pyspark.sql import functions as F

from tests import samples
from vigilake.session import shared_path
from vigilake.sources.auth import auth_events
from vigilake.streaming import alerts

START = datetime.datetime(2024, 2, 3, 4)


def events(spark, *rows):
    """(seconds, address, flag) -> minimal events."""
    data = [(n, START + datetime.timedelta(seconds=s), ip, hit) for n, (s, ip, hit) in enumerate(rows)]
    return spark.createDataFrame(data, "seq bigint, event_ts timestamp, src_ip string, is_failed_logon boolean")


def streamed(spark, df, name):
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(spark, df, name):
    out = shared_path(spark, name)
    alerts.every_quarter_hour(df, out, shared_path(spark, name + "-state"), once=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def test_threshold_is_strict(spark):
    five = events(spark, *[(n, "1.1.1.1", True) for n in range(5)])
    six = events(spark, *[(n, "1.1.1.1", True) for n in range(6)])
    chosen = alerts.selection("event_id_brute_force")
    assert alerts.windowed_alerts(five, chosen, "event_id_brute_force").count() == 0
    assert alerts.windowed_alerts(six, chosen, "event_id_brute_force").first().hits == 6


def test_windows_tumble_or_slide(spark):
    rows = events(spark, *[(270 + n * 10, "1.1.1.1", True) for n in range(7)])
    chosen = alerts.selection("event_id_brute_force")
    assert alerts.windowed_alerts(rows, chosen, "event_id_brute_force").count() == 0
    sliding = alerts.windowed_alerts(rows, chosen, "event_id_brute_force", slide="1 minute")
    assert sliding.count() > 0


def test_stream_equals_batch(spark):
    rows = [(n * 7, f"1.1.1.{n % 3}", n % 4 != 0) for n in range(400)]
    closing = [(100_000, "9.9.9.9", True)]
    df = events(spark, *rows, *closing)
    chosen = alerts.selection("event_id_brute_force")
    batch = alerts.windowed_alerts(df, chosen, "event_id_brute_force")
    stream = alerts.windowed_alerts(streamed(spark, df, "in"), chosen, "event_id_brute_force", watermark="1 minute")
    assert sorted(map(tuple, drained(spark, stream, "out").collect())) == sorted(map(tuple, batch.collect())) != []


def test_late_rows_stay_out_of_windows(spark):
    folder = shared_path(spark, "late")
    early = events(spark, *[(n, "1.1.1.1", True) for n in range(6)], (7200, "2.2.2.2", True))
    late = events(spark, *[(n, "1.1.1.1", True) for n in range(6)], (14400, "2.2.2.2", True))
    out, state = shared_path(spark, "late-out"), shared_path(spark, "late-state")
    for batch in (early, late):
        batch.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(batch.schema).parquet(folder)
        found = alerts.windowed_alerts(stream, alerts.selection("event_id_brute_force"), "event_id_brute_force", watermark="1 minute")
        alerts.every_quarter_hour(found, out, state, once=True).awaitTermination()
    assert [r.hits for r in spark.read.parquet(out).collect()] == [6]


def test_throttle(spark):
    df = spark.createDataFrame(
        [("r", "1.1.1.1", START + datetime.timedelta(minutes=m)) for m in (5, 10, 59, 61)] + [("r", "2.2.2.2", START)],
        "rule_name string, src_ip string, window_start timestamp")
    kept = sorted((r.src_ip, r.window_start.minute) for r in alerts.throttle(df).collect())
    assert kept == [("1.1.1.1", 1), ("1.1.1.1", 5), ("2.2.2.2", 0)]
    stream = alerts.throttle(streamed(spark, df.filter("minute(window_start) < 60 and hour(window_start) = 4"), "t-in"))
    assert sorted(r.src_ip for r in drained(spark, stream, "t-out").collect()) == ["1.1.1.1", "2.2.2.2"]


def test_running_detections(spark, lines):
    df = auth_events(lines(*samples.auth()), 2024).select("source_file", "seq", "raw", "src_ip", "is_failed_auth", "is_accepted_auth")
    for make in (lambda d: alerts.running_counts(d, "ssh_brute_force_by_ip", "is_failed_auth", 5), alerts.running_success_after_failures):
        seen = []
        query = make(streamed(spark, df, "run")).writeStream.outputMode("update").option(
            "checkpointLocation", shared_path(spark, "run-state")
        ).foreachBatch(lambda batch, n: seen.extend(map(tuple, batch.collect()))).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(seen) == sorted(map(tuple, make(df).collect())) != []


def test_keyword_selection(spark):
    df = spark.createDataFrame([({"a": "Denied by rule"}, START, "1.1.1.1")], "fields map<string,string>, event_ts timestamp, src_ip string")
    chosen = alerts.selection("block_deny_surge", ["deny", "denied"])
    assert alerts.windowed_alerts(df, chosen, "block_deny_surge", threshold=0).count() == 1
    assert df.filter(~F.coalesce(chosen, F.lit(False))).count() == 0
