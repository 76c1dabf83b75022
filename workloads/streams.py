"""Registered queries of the streaming operators: several micro-batches each, and their SQL."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.schema import flag
from vigilake.session import shared_path, written
from vigilake.sources.heads import manifest
from vigilake.streaming import alerts, raw, running, sinks
from workloads.files import FileLogs
from workloads.logs import YEAR, Logs
from workloads.oracle import sql

SLICES = 5
#: Rows of a stream per file and slice: one task writes a slice only while it is small.
SLICE_FILE = 1_000_000
#: A stream of file names is taken in in so many batches at most, each of ``LEAST`` files or more.
BATCHES, LEAST = 25, 4
FLAGS = ["is_failed_auth", "is_accepted_auth", "is_4xx", "is_denied", "is_error_status"]
COLUMNS = ["source_file", "seq", "raw", "log_type", "src_ip", "event_ts", *FLAGS]
SQL_STAMP = "%Y-%m-%d %H:%M:%S"
CLOSING_IP = "192.0.2.1"


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def arriving(logs: Logs, events: DataFrame, name: str, late=None) -> DataFrame:
    """Events as a stream that brings them in ``SLICES`` slices by time, one per micro-batch; rows for
    which ``late`` holds come after all others, and a last slice is a year on. Every slice has the
    same number of files, empty ones included, so that a number of files is a slice."""
    staged = written(events.select(*COLUMNS), f"{name}-staged")
    seconds = F.unix_timestamp("event_ts")
    low, high, rows = staged.agg(F.min(seconds), F.max(seconds), F.count(F.lit(1))).first()
    files = 1 + rows // SLICE_FILE
    part = F.coalesce(F.least(((seconds - low) * SLICES / (high - low + 1)).cast("int"), F.lit(SLICES - 1)), F.lit(0))
    if late is not None:
        part = F.when(late, SLICES).otherwise(part)
    path = shared_path(logs.spark, f"{name}-in")
    sliced = staged.withColumn("_part", part)
    for n in range(SLICES + (late is not None)):  # files are taken in the order in which they were written
        put(sliced.filter(F.col("_part") == n).drop("_part"), path, (n + 1) * files, files)
    closing = staged.limit(1).select(F.lit("closing").alias("source_file"), F.lit(-1).cast("long").alias("seq"), F.lit("").alias("raw"), F.lit("none").alias("log_type"),
                                     F.lit(CLOSING_IP).alias("src_ip"), F.timestamp_seconds(F.lit(high + 366 * 86_400)).alias("event_ts"),
                                     *[F.lit(True).alias(f) for f in FLAGS])
    put(closing, path, (SLICES + (late is not None) + 1) * files, 1)
    return logs.spark.readStream.schema(staged.schema).option("maxFilesPerTrigger", files).parquet(path)


def put(rows: DataFrame, path: str, until: int, tasks: int) -> None:
    """Rows as files of a folder, written by so many tasks; empty files until it has ``until``."""
    (rows.coalesce(1) if tasks == 1 else rows.repartition(tasks)).write.mode("append").parquet(path)
    for _ in range(until - len(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())):
        rows.limit(0).coalesce(1).write.mode("append").parquet(path)


def drained(logs: Logs, stream: DataFrame, name: str) -> DataFrame:
    """All that an append stream gives once the last file is through."""
    out, state = shared_path(logs.spark, f"{name}-out"), shared_path(logs.spark, f"{name}-state")
    alerts.every_quarter_hour(stream, out, state, once=True).awaitTermination()
    return logs.spark.read.schema(stream.schema).parquet(out).filter(F.col("src_ip") != CLOSING_IP)


def success_within(logs: Logs) -> DataFrame:
    """Accepted logins within six hours of a failure, from two streams joined."""
    found = running.success_after_failures(arriving(logs, logs.auth, "w5-success"), "6 hours", "1 hour")
    return drained(logs, found, "w5-success").select(
        "scope", "src_ip", stamp("accepted_at"), "failures", stamp("first_failure"), "sample_entry")


CROSSED = {"d10": 8}


def crossed(logs: Logs) -> DataFrame:
    """Alerts of all keyed rules over four kinds of logs; addresses are remembered for the whole time."""
    events = reduce(DataFrame.unionByName, [df.select(*COLUMNS) for df in (logs.auth, logs.web, logs.csv, logs.cloud)])
    found = running.crossings(arriving(logs, events, "w5-cross"), thresholds=CROSSED, delay="1 hour", forget="4000 days")
    return drained(logs, found, "w5-cross").select("rule_name", "scope", "src_ip", "threshold")


def _crossed_sql() -> str:
    parts = [("auth", "ssh_brute_force_by_ip", "is_failed_auth", 5), ("web", "web_directory_scanning", "is_4xx", CROSSED["d10"])]
    for view in ("csv", "cloud"):
        parts += [(view, "generic_repeated_auth_failures", "is_failed_auth", 5), (view, "generic_block_deny_surge", "is_denied", 10),
                  (view, "generic_error_status_spike", "is_error_status", 20)]
    return "\nUNION ALL ".join("SELECT * FROM (" + sql(view, f"""SELECT '{rule}' AS rule_name, scope, src_ip, {n} AS threshold FROM {view}
 WHERE {flag_name} AND src_ip IS NOT NULL GROUP BY scope, src_ip HAVING count(*) >= {n}""") + ")" for view, rule, flag_name, n in parts)


def dense(events: DataFrame) -> DataFrame:
    """Events with time pressed together a hundred times, so that windows fill up."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    seconds = F.unix_timestamp("event_ts") - F.unix_timestamp(start)
    return events.withColumn("event_ts", F.timestamp_seconds(F.unix_timestamp(start) + (seconds / 100).cast("bigint")))


PRESSED = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(epoch(date_trunc('second', ts) - TIMESTAMP '2024-01-01 00:00:00') // 100)"


def earliest(logs: Logs) -> DataFrame:
    """Windows, then the earliest alert of each address and hour, in one stream."""
    stream = arriving(logs, dense(logs.auth), "w4-first")
    found = alerts.windowed_alerts(stream, flag("is_failed_auth"), "repeated_auth_failures", threshold=0, watermark="10 minutes", timed=True)
    first = alerts.earliest_per_period(found, time="alert_time").drop("alert_time")
    return drained(logs, first, "w4-first").select("rule_name", "src_ip", stamp("window_start"), stamp("window_end"), "hits")


EARLIEST = sql("auth", f""", w AS (SELECT src_ip, time_bucket(INTERVAL 10 MINUTE, {PRESSED}) AS start, count(*) AS hits FROM auth WHERE is_failed_auth GROUP BY ALL)
SELECT 'repeated_auth_failures' AS rule_name, src_ip, strftime(min(start), '{SQL_STAMP}') AS window_start,
 strftime(min(start) + INTERVAL 10 MINUTE, '{SQL_STAMP}') AS window_end, arg_min(hits, start) AS hits FROM w GROUP BY src_ip, date_trunc('hour', start)""")


def kept_with_late(logs: Logs) -> DataFrame:
    """All events of a stream and which of them came too late for their window; every batch runs twice."""
    out = shared_path(logs.spark, "w6-kept")
    stream = arriving(logs, dense(logs.auth), "w6", late=(F.col("seq") % 20 == 0) & F.col("event_ts").isNotNull())
    for run in ("first", "again"):
        sinks.keep_with_late(stream, out, shared_path(logs.spark, f"w6-{run}"), "5 minutes", once=True).awaitTermination()
    events, late = (sinks.read_kept(logs.spark, out, stream.schema, t).filter(F.col("source_file") != "closing").select("source_file", "seq") for t in ("events", "late"))
    return events.join(late.withColumn("late", F.lit(True)), ["source_file", "seq"], "left").fillna(False, ["late"])


KEPT = sql("auth", f""", e AS (SELECT scope AS source_file, seq, seq % 20 = 0 AND matched AS held, CASE WHEN matched THEN {PRESSED} END AS tm FROM auth)
SELECT source_file, seq, coalesce(held AND time_bucket(INTERVAL 10 MINUTE, tm) + INTERVAL 10 MINUTE <=
 (SELECT max(tm) - INTERVAL 5 MINUTE FROM e WHERE NOT held), false) AS late FROM e""")


def raw_windows(logs: Logs) -> DataFrame:
    """Raw login lines as a stream of text files, parsed and counted in windows."""
    folder = FileLogs(logs.spark, logs.sf_dir).folder("auth_lines")
    closing = logs.spark.range(1).select(F.lit("zz.log").alias("source_file"), F.lit(
        f"Dec 31 23:59:58 web01 sshd[1]: Failed password for closing from {CLOSING_IP} port 1 ssh2").alias("value"))
    closing.write.mode("append").partitionBy("source_file").text(folder)
    # files of one job have no order in time: the watermark waits longer than the log is long
    events = raw.stream_events(logs.spark, folder, "auth", max_files=10, default_year=YEAR)
    found = alerts.windowed_alerts(events, flag("is_failed_auth"), "repeated_auth_failures", threshold=0, watermark="60 days")
    return drained(logs, found, "w3-raw").select("rule_name", "src_ip", stamp("window_start"), stamp("window_end"), "hits")


RAW_WINDOWS = sql("auth", f"""SELECT 'repeated_auth_failures' AS rule_name, src_ip, strftime(start, '{SQL_STAMP}') AS window_start,
 strftime(start + INTERVAL 10 MINUTE, '{SQL_STAMP}') AS window_end, count(*) AS hits
FROM (SELECT src_ip, time_bucket(INTERVAL 10 MINUTE, date_trunc('second', ts)) AS start FROM auth WHERE is_failed_auth) GROUP BY src_ip, start""")


class IngestedLogs(FileLogs):
    """Firewall files with a header each, taken in by a stream of file names."""

    @cached_property
    def csv(self) -> DataFrame:
        out, state = shared_path(self.spark, "w3-ingest"), shared_path(self.spark, "w3-ingest-state")
        folder = self.folder("firewall_lines")
        # a batch costs the same for few files as for many, so their number must not grow with the files
        files = max(LEAST, -(-manifest(self.spark, folder).count() // BATCHES))
        raw.ingest(self.spark, folder, out, state, "csv", max_files=files, once=True).awaitTermination()
        return self.named(raw.read_ingested(self.spark, out))


def registered(queries: dict, statements: dict) -> tuple[dict, dict]:
    """Queries and SQL of this module; readers are compared by the statements that exist."""
    found = {
        "w5_stream_success_within": (success_within, sql("auth", f""", a AS (SELECT scope, src_ip, date_trunc('second', ts) AS tm, is_failed_auth AS f, is_accepted_auth AS s, seq, raw FROM auth WHERE src_ip IS NOT NULL)
SELECT s.scope, s.src_ip, strftime(s.tm, '{SQL_STAMP}') AS accepted_at, sum(f.n)::BIGINT AS failures, strftime(min(f.tm), '{SQL_STAMP}') AS first_failure, any_value(s.raw) AS sample_entry
FROM (SELECT scope, src_ip, tm, arg_min(raw, seq) AS raw FROM a WHERE s GROUP BY ALL) s JOIN (SELECT scope, src_ip, tm, count(*) AS n FROM a WHERE f GROUP BY ALL) f
 ON s.scope = f.scope AND s.src_ip = f.src_ip AND f.tm BETWEEN s.tm - INTERVAL 6 HOUR AND s.tm GROUP BY s.scope, s.src_ip, s.tm""")),
        "w5_stream_crossings": (crossed, _crossed_sql()),
        "w4_stream_earliest": (earliest, EARLIEST),
        "w6_stream_late_rows": (kept_with_late, KEPT),
        "w3_stream_raw_windows": (raw_windows, RAW_WINDOWS),
        "w3_stream_raw_csv": (lambda logs: queries["src7_csv_events"](IngestedLogs(logs.spark, logs.sf_dir)).drop("seq"),
                              f"SELECT * EXCLUDE (seq) FROM ({statements['src7_csv_events']}) AS t"),
    }
    return {k: run for k, (run, _) in found.items()}, {k: s for k, (_, s) in found.items()}
