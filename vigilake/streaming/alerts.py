"""Windowed alerts, throttling and running detections, for batch and streaming events.

The same functions take either kind of DataFrame. A watermark delay is a setting: rows
later than it are left out of windows, while the event sink still keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilake.operators.selections import field_match
from vigilake.schema import flag

# what the windowed rules look for: selection, window length, count that must be passed
WINDOWED = {
    "event_id_brute_force": ("5 minutes", 5),
    "repeated_auth_failures": ("10 minutes", 5),
    "block_deny_surge": ("10 minutes", 10),
    "error_status_spike": ("10 minutes", 20),
}
_FLAGS = {
    "event_id_brute_force": "is_failed_logon", "repeated_auth_failures": "is_failed_auth",
    "block_deny_surge": "is_denied", "error_status_spike": "is_error_status",
}


def selection(rule: str, keywords: list[str] | None = None) -> Column:
    """Flag-based selection of a windowed rule, or any-field keywords where given."""
    return field_match(keywords) if keywords else F.col(_FLAGS[rule])


def windowed_alerts(events: DataFrame, chosen: Column, rule: str, key: str = "src_ip",
                    length: str | None = None, threshold: int | None = None,
                    slide: str | None = None, watermark: str | None = None, timed: bool = False) -> DataFrame:
    """Windows with strictly more than ``threshold`` chosen records per key.

    Tumbling unless ``slide`` is given. Records without a time or key are left out.
    Counts are combined before the shuffle, so one hot key stays one row per task.
    ``timed`` adds ``alert_time``, the last instant of the window: on a stream it carries the
    watermark on, so that another stateful step may follow (``earliest_per_period``).
    """
    length, threshold = length or WINDOWED[rule][0], WINDOWED[rule][1] if threshold is None else threshold
    rows = events.filter(chosen & F.col("event_ts").isNotNull() & F.col(key).isNotNull())
    if watermark:
        rows = rows.withWatermark("event_ts", watermark)
    window = F.window("event_ts", length, slide) if slide else F.window("event_ts", length)
    counted = rows.groupBy(window.alias("window"), key).agg(F.count(F.lit(1)).alias("hits"))
    return counted.filter(F.col("hits") > threshold).select(
        F.lit(rule).alias("rule_name"), key, F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"), "hits",
        *([F.window_time("window").alias("alert_time")] if timed else []),
    )


def throttle(alerts: DataFrame, per: str = "1 hour", time: str = "window_start", key: str = "src_ip") -> DataFrame:
    """One alert per rule and source per period.

    Batch: the earliest alert of each period. Stream: the first to arrive, later ones of
    the same rule and source are dropped while inside the period.
    """
    if alerts.isStreaming:
        return alerts.withWatermark(time, per).dropDuplicatesWithinWatermark(["rule_name", key])
    whole = F.struct(*[F.col(c) for c in alerts.columns])
    return alerts.groupBy("rule_name", key, F.window(time, per).alias("_period")).agg(
        F.min_by(whole, time).alias("_first")
    ).select("_first.*")


def earliest_per_period(alerts: DataFrame, per: str = "1 hour", time: str = "window_start", key: str = "src_ip",
                        watermark: str | None = None) -> DataFrame:
    """The earliest alert per rule and source in each period of the clock, batch and stream alike.

    A stream holds a source's first alert until the watermark has passed the end of the period,
    so that one that arrives late but within ``watermark`` still wins; then it comes out and its state
    goes. ``watermark`` is needed where ``time`` carries none yet. Of equal times the smallest row in
    the order of the columns stays. State is one row per rule, source and open period.
    """
    rows = alerts.withWatermark(time, watermark) if watermark and alerts.isStreaming else alerts
    columns = [time, *[c for c in alerts.columns if c != time]]
    first = F.min(F.struct(*[F.col(c) for c in columns])).alias("_first")
    return rows.groupBy("rule_name", key, F.window(time, per).alias("_period")).agg(first).select(
        *[F.col(f"_first.{c}").alias(c) for c in alerts.columns])


def running_counts(events: DataFrame, rule: str, name: str, threshold: int, scope: str = "source_file") -> DataFrame:
    """Per (scope, address) hits of a flag once they reach the threshold; as a stream, in
    update mode, each change of a count is emitted."""
    rows = events.filter(F.col(name) & F.col("src_ip").isNotNull())
    return rows.groupBy(scope, "src_ip").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= threshold).select(
        F.lit(rule).alias("rule_name"), scope, "src_ip", "hits"
    )


def running_success_after_failures(events: DataFrame, scope: str = "source_file") -> DataFrame:
    """Addresses whose latest accepted login lies at or after their first failure.

    State per (scope, address) is four numbers and the latest success, kept by Spark's own
    streaming aggregation; no Python state and no order of arrival is needed.
    """
    failed, accepted = flag("is_failed_auth"), flag("is_accepted_auth")
    rows = events.filter("(is_failed_auth or is_accepted_auth) and src_ip is not null")
    state = rows.groupBy(scope, "src_ip").agg(
        F.count_if(failed).alias("failures"),
        F.min(F.when(failed, F.col("seq"))).alias("first_failure"),
        F.max(F.when(accepted, F.col("seq"))).alias("last_accept"),
        F.max_by("raw", F.when(accepted, F.col("seq"))).alias("sample_entry"),
    )
    return state.filter("last_accept >= first_failure").select(scope, "src_ip", "failures", "sample_entry")


def every_quarter_hour(alerts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append alerts to a table every 15 minutes, or once over what is there."""
    writer = alerts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": "15 minutes"}
    return writer.trigger(**trigger).start(path)
