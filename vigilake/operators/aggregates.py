"""Counts that are collected for analysts but raise no finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake import fixed
from vigilake.schema import flag


def failures_per_user(events: DataFrame, scope: str = "source_file") -> DataFrame:
    return events.filter("is_failed_auth and username is not null").groupBy(scope, "username").agg(
        F.count(F.lit(1)).alias("failures")
    )


def sudo_commands(events: DataFrame) -> DataFrame:
    return events.filter("is_sudo").select("source_file", "seq", "raw")


def web_exposure(events: DataFrame, scope: str = "source_file") -> DataFrame:
    """Remote-include, admin-path and backup-file hits."""
    return events.groupBy(scope).agg(
        F.count_if(flag("is_rfi")).alias("rfi_hits"),
        F.count_if(flag("is_admin_access")).alias("admin_hits"),
        F.count_if(flag("is_backup_file")).alias("backup_hits"),
    )


def privileged_logons(events: DataFrame, scope: str = "source_file") -> DataFrame:
    return events.groupBy(scope).agg(F.count_if(flag("is_privileged_logon")).alias("privileged_logons"))


def admin_actions(events: DataFrame) -> DataFrame:
    """Sensitive actions and failed logins of administrator accounts."""
    return events.filter("is_admin_user and (is_sensitive_action or is_failed_auth)")


def unruled_event_types(events: DataFrame, scope: str = "source_file") -> DataFrame:
    """Known event types that no rule looks at."""
    ruled = {i for ids in fixed.EVENT_ID_FLAGS.values() for i in ids}
    return events.filter(F.col("event_id").isin([i for i in fixed.EVENT_TYPES if i not in ruled])).groupBy(
        scope, "event_type"
    ).agg(F.count(F.lit(1)).alias("n"))


def run_summary(events: DataFrame, findings: DataFrame, formats: int = 1, scope: str = "source_file") -> DataFrame:
    """Entries, findings and rules per scope; a scope without findings counts zero."""
    entries = events.groupBy(F.col(scope).alias("scope"), "log_type").agg(F.count(F.lit(1)).alias("entries"))
    fired = findings.groupBy("scope").agg(F.count(F.lit(1)).alias("findings"))
    return entries.join(fired, "scope", "left").select(
        "scope", "log_type", "entries", F.coalesce("findings", F.lit(0)).alias("findings"),
        (F.coalesce("findings", F.lit(0)) * formats).alias("rules"),
    )
