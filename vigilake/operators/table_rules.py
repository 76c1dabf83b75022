"""Detection rules read from a table: validated, then compiled to one aggregate.

A rule is a row: what it counts (a condition over event columns), by which key, in which
window, and from how many on. Hundreds of rules cost one scan and one shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ("low", "medium", "high", "critical")
#: Rules are expressions of one plan; more than this many belong into several calls.
MOST = 2000
COLUMNS = {"rule_id": "string", "rule_name": "string", "log_types": "array<string>", "predicate": "string", "key": "string",
           "window": "string", "threshold": "int", "severity": "string", "mitre_technique": "string"}


@dataclass(frozen=True)
class TableRule:
    rule_id: str
    rule_name: str
    log_types: tuple[str, ...] | None
    predicate: str
    key: str | None
    window: str | None
    threshold: int
    severity: str
    mitre_technique: str | None


def _faults(row, events: DataFrame, seen: set[str]) -> list[str]:
    """What is wrong with a rule; conditions are analysed against the events, never run here."""
    found = []
    if not row["rule_id"] or row["rule_id"] in seen:
        found.append("rule_id is empty or used twice")
    if not row["rule_name"]:
        found.append("rule_name is empty")
    if row["threshold"] is None or row["threshold"] < 1:
        found.append("threshold is not 1 or more")
    if row["severity"] not in SEVERITIES:
        found.append(f"severity is none of {', '.join(SEVERITIES)}")
    kinds = {f.name: f.dataType for f in events.schema.fields}
    if row["key"] is not None and not isinstance(kinds.get(row["key"]), (T.StringType, T.NumericType, T.BooleanType)):
        found.append(f"key {row['key']!r} is no plain event column")
    condition = row["predicate"] or ""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", "''", condition)
    if re.search(r"(?i)\bselect\b|;|--|/\*", bare):
        found.append("predicate is more than an expression")
    else:
        try:
            whole = F.expr(f"({condition})")  # in brackets, so that no name can follow
            if events.select(whole.alias("c")).schema["c"].dataType != T.BooleanType():
                found.append("predicate is not a condition")
            elif not events.filter(whole)._jdf.queryExecution().analyzed().deterministic():
                found.append("predicate gives other results from run to run")
        except (AnalysisException, ParseException) as error:
            found.append(f"predicate: {str(error).splitlines()[0]}")
    if row["window"] is not None:
        if not re.fullmatch(r"[1-9]\d{0,5} (second|minute|hour|day)s?", row["window"]):
            found.append("window is not a number of seconds, minutes, hours or days")
    return found


def load_rules(table: DataFrame, events: DataFrame) -> list[TableRule]:
    """Rules of a table (``COLUMNS``) that all hold against the columns of ``events``; ValueError with
    every fault otherwise. ``log_types`` NULL stands for all, ``key`` NULL for the whole scope,
    ``window`` NULL for all time. The order is that of the ids."""
    missing = [c for c in COLUMNS if c not in table.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    rows = table.select(*[F.col(c).cast(k).alias(c) for c, k in COLUMNS.items()]).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    empty, seen, wrong, out = events.limit(0), set(), [], []
    for row in sorted(rows, key=lambda r: (r["rule_id"] or "", r["rule_name"] or "")):
        wrong += [f"{row['rule_id']}: {f}" for f in _faults(row, empty, seen)]
        seen.add(row["rule_id"])
        out.append(TableRule(*[tuple(row[c]) if c == "log_types" and row[c] is not None else row[c] for c in COLUMNS]))
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def detect_table(events: DataFrame, rules: list[TableRule], scope: str = "source_file", order: str = "seq") -> DataFrame:
    """Keys that reach a rule's threshold in a scope and window.

    ``rule_id, rule_name, severity, mitre_technique, scope, key, window_start, window_end, hits,
    threshold, first_seq``. Every event becomes a row per rule that it counts for, and all rules
    share one aggregate with map-side combine. Events whose key is NULL or empty do not count, nor,
    for rules with a window, those without a time. A condition that is NULL counts as not met.
    """
    if not rules:
        raise ValueError("no rules")
    # one window column per length, tumbling from the epoch
    lengths = sorted({r.window for r in rules if r.window})
    rows = events
    for n, length in enumerate(lengths):
        step = F.lit(_seconds(length))
        rows = rows.withColumn(f"_w{n}", F.timestamp_seconds(F.floor(F.unix_timestamp("event_ts") / step) * step))
    structs = []
    for r in rules:
        when = F.expr(f"({r.predicate})")
        if r.log_types is not None:
            when = when & F.col("log_type").isin(list(r.log_types))
        key = F.lit(None).cast("string") if r.key is None else F.nullif(F.col(r.key).cast("string"), F.lit(""))
        start = F.col(f"_w{lengths.index(r.window)}") if r.window else F.lit(None).cast("timestamp")
        for needed, value in ((r.key is not None, key), (r.window is not None, start)):
            when = when & value.isNotNull() if needed else when
        structs.append(F.when(when, F.struct(F.lit(r.rule_id).alias("rule_id"), key.alias("key"), start.alias("window_start"))))
    hits = rows.select(F.col(scope).alias("scope"), F.col(order).alias("seq"), F.explode(F.array_compact(F.array(*structs))).alias("h"))
    counted = hits.groupBy("scope", "h.rule_id", "h.key", "h.window_start").agg(F.count(F.lit(1)).alias("hits"), F.min("seq").alias("first_seq"))
    texts = F.inline(F.array(*[F.struct(
        F.lit(r.rule_id).alias("rule_id"), F.lit(r.rule_name).alias("rule_name"), F.lit(r.severity).alias("severity"),
        F.lit(r.mitre_technique).cast("string").alias("mitre_technique"), F.lit(r.threshold).alias("threshold"),
        F.lit(_seconds(r.window)).cast("bigint").alias("length")) for r in rules]))
    told = counted.join(F.broadcast(events.sparkSession.range(1).select(texts)), "rule_id").filter("hits >= threshold")
    end = F.timestamp_seconds(F.unix_timestamp("window_start") + F.col("length"))
    return told.select("rule_id", "rule_name", "severity", "mitre_technique", "scope", "key", "window_start", end.alias("window_end"),
                       "hits", "threshold", "first_seq")


def _seconds(window: str | None) -> int | None:
    if window is None:
        return None
    n, unit = window.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]
