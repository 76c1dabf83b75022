"""The canonical ``events`` table: column names, types and the projection onto them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = {
    "scope": "string", "source_file": "string", "seq": "bigint",
    "log_type": "string", "raw": "string",
}
CANONICAL = {
    "src_ip": "string", "dst_ip": "string", "dst_port": "string", "username": "string",
    "action": "string", "status": "string", "message": "string", "timestamp": "string",
    "host": "string", "user_agent": "string", "protocol": "string",
    "event_id": "int", "status_code": "int",
}
NATIVE = {
    "event_id_raw": "string", "fields": "map<string,string>",
    "month": "string", "day": "string", "time": "string", "process": "string",
    "pid": "string", "port": "string",
    "method": "string", "target": "string", "path": "string", "http_status": "int",
    "size": "string", "referer": "string", "useragent": "string",
    "date": "string", "source": "string", "category": "string", "logon_type": "string",
    "workstation": "string", "process_name": "string",
    "event_type": "string", "event_ts": "timestamp",
}
FLAGS = [
    "is_failed_auth", "is_accepted_auth", "is_invalid_user", "is_sudo", "is_root_login",
    "is_disconnected", "is_session_opened", "is_session_closed",
    "is_sqli", "is_xss", "is_path_traversal", "is_rfi", "is_webshell", "is_scanner",
    "is_4xx", "is_5xx", "is_admin_access", "is_backup_file",
    "is_failed_logon", "is_privileged_logon", "is_service_install", "is_scheduled_task",
    "is_account_created", "is_group_modified", "is_log_cleared", "is_kerberoast",
    "is_pass_the_hash",
    "is_denied", "is_success_auth", "is_sensitive_action", "is_admin_user",
    "is_error_status", "is_auth_context",
]
EVENT_COLUMNS = {**IDENTITY, **CANONICAL, **NATIVE, **{f: "boolean" for f in FLAGS}}


def to_events(df: DataFrame, **derived: Column) -> DataFrame:
    """Project onto the events schema; a column the source lacks is NULL.

    Flags of the source are kept as they are (NULL = the record carries none); readers
    of a flag use :func:`flag`. ``scope`` defaults to the source file.
    """
    have = set(df.columns)

    def column(name: str, kind: str) -> Column:
        if name in derived:
            return derived[name].cast(kind).alias(name)
        if name in have:
            return F.col(name).cast(kind).alias(name)
        if name == "scope":
            return F.col("source_file").alias(name)
        return F.lit(None).cast(kind).alias(name)

    return df.select(*[column(n, k) for n, k in EVENT_COLUMNS.items()])


def flag(name: str) -> Column:
    """A flag read as false where the record does not carry it, for use as a value. Filters
    take the bare column instead: they drop NULL anyway, and the scan can apply them."""
    return F.coalesce(F.col(name), F.lit(False))
