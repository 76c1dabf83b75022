"""Running detections whose state ends: success after failures as a join of two streams, and
one stateful operator for all keyed rules that raises each alert once.

Both take batches too, where they give what a stream gives once its watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigilake.operators.rules import Rule, rule_dimension, rules
from vigilake.schema import flag

#: Keyed rules that run on streams: a count per address.
KEYED = ("d1", "d10", "d18", "d19", "d20")


def success_after_failures(events: DataFrame, bound: str = "1 hour", delay: str = "10 minutes",
                           scope: str = "source_file") -> DataFrame:
    """Accepted logins of an address that failed at most ``bound`` before.

    ``scope, src_ip, accepted_at, failures, first_failure, sample_entry``: one row per address and
    second with an accepted login; ``failures`` counts those within the bound, the same second
    included. Both sides are summed by second before they meet, so an address with a million
    failures brings at most one row per second of the bound, not a million. On a stream both sides
    have a watermark of ``delay`` and the join a time bound: state of an address goes once the
    watermark is past its last second plus the bound, and a row comes out when no earlier failure
    can arrive any more. Rows later than ``delay`` are left out. Rows without address or time are
    left out; ties in time keep the smallest record number as sample.
    """
    rows = events.filter("src_ip is not null and event_ts is not null and (is_failed_auth or is_accepted_auth)")
    rows = rows.select(F.col(scope).alias("scope"), "src_ip", "event_ts", "seq", "raw", *[flag(f).alias(f) for f in ("is_failed_auth", "is_accepted_auth")])
    streaming = rows.isStreaming

    def side(chosen: str, at: str, *measures: Column) -> DataFrame:
        found = rows.filter(chosen).withColumn(at, F.date_trunc("second", "event_ts"))
        found = found.withWatermark(at, delay) if streaming else found
        return found.groupBy("scope", "src_ip", at).agg(*measures)

    failed = side("is_failed_auth", "failed_at", F.count(F.lit(1)).alias("n")).withColumnsRenamed({"scope": "f_scope", "src_ip": "f_ip"})
    accepted = side("is_accepted_auth", "accepted_at", F.min(F.struct("seq", "raw")).alias("first"))
    near = (F.col("scope").eqNullSafe(F.col("f_scope"))) & (F.col("src_ip") == F.col("f_ip")) & F.expr(
        f"failed_at <= accepted_at and failed_at >= accepted_at - interval {bound}")
    return accepted.join(failed, near).groupBy("scope", "src_ip", "accepted_at").agg(
        F.sum("n").alias("failures"), F.min("failed_at").alias("first_failure"), F.min("first.raw").alias("sample_entry"))


def _hits(events: DataFrame, chosen: list[Rule], scope: str) -> DataFrame:
    """(rule_id, scope, src_ip, minute) per record and keyed rule that it counts for."""
    counted = [F.when(F.col("log_type").isin(list(r.log_types)) & flag(r.flag), F.lit(r.id)) for r in chosen]
    rows = events.filter("src_ip <> '' and event_ts is not null")
    return rows.select(F.explode(F.array_compact(F.array(*counted))).alias("rule_id"), F.col(scope).alias("scope"), "src_ip",
                       F.date_trunc("minute", "event_ts").alias("minute"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of a task by key and minute: what a hot address sends through the shuffle."""
    for batch in batches:
        keys = ["rule_id", "scope", "src_ip", "minute"]
        found = pa.Table.from_batches([batch]).group_by(keys).aggregate([([], "count_all")])
        yield from found.rename_columns([*keys, "n"]).to_batches()


def crossings(events: DataFrame, ids=KEYED, thresholds: dict[str, int] | None = None, delay: str = "1 hour",
              forget: str = "1 day", scope: str = "source_file") -> DataFrame:
    """One alert per keyed rule, scope and address: when its count reaches the threshold.

    ``rule_name, severity, mitre_technique, scope, src_ip, hits, threshold``. All rules share one
    stateful operator. On a stream ``hits`` is the count at the end of the micro-batch that
    passed the threshold, later hits raise nothing, and the state of an address (a count, whether
    it was told, its last minute) goes when the watermark is ``forget`` past its last hit; it
    may then be told of anew. Minutes older than the watermark (``delay``) are left out. Records
    without address or time do not count.
    """
    chosen = [r for r in rules(ids=set(ids), thresholds=thresholds) if r.shape == "keyed"]
    if len(chosen) < len(set(ids)):
        raise ValueError(f"only keyed rules run here, not {sorted(set(ids) - {r.id for r in chosen})}")
    limit = {r.id: r.threshold for r in chosen}
    hits = _hits(events, chosen, scope)
    if not hits.isStreaming:
        limits = F.element_at(F.create_map(*[F.lit(x) for pair in limit.items() for x in pair]), F.col("rule_id"))
        counted = hits.groupBy("rule_id", "scope", "src_ip").agg(F.count(F.lit(1)).alias("hits"))
        return _told(counted.filter(F.col("hits") >= limits), chosen)
    kept = int(pd.Timedelta(forget).total_seconds() * 1000)

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, told, last = state.get if state.exists else (0, False, 0)
        if last + kept <= state.getCurrentWatermarkMs():  # its time is over, though no batch came to say so
            count, told, last = 0, False, 0
        for frame in frames:
            count += int(frame["n"].sum())
            last = max(last, int(frame["minute"].max().timestamp() * 1000))
        if not told and count >= limit[key[0]]:
            told = True
            yield pd.DataFrame({"rule_id": [key[0]], "scope": [key[1]], "src_ip": [key[2]], "hits": [count]})
        state.update((count, told, last))
        state.setTimeoutTimestamp(max(last + kept, state.getCurrentWatermarkMs() + 1))

    kind = hits.schema.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", ")
    partial = hits.mapInArrow(_summed, f"{kind}, n long").withWatermark("minute", delay)
    found = partial.groupBy("rule_id", "scope", "src_ip").applyInPandasWithState(
        settle, "rule_id string, scope string, src_ip string, hits long", "count long, told boolean, last long",
        "append", GroupStateTimeout.EventTimeTimeout)
    return _told(found, chosen)


def _told(found: DataFrame, chosen: list[Rule]) -> DataFrame:
    texts = rule_dimension(found.sparkSession, chosen).select(
        "rule_id", F.col("_name").alias("rule_name"), "severity", "mitre_technique", F.col("_threshold").alias("threshold"))
    return found.join(F.broadcast(texts), "rule_id").select("rule_name", "severity", "mitre_technique", "scope", "src_ip", "hits", "threshold")
