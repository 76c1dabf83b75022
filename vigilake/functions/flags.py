"""Boolean columns per record. Each family is one projection, no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake import fixed
from vigilake.functions import text


def auth_flags(message: Column, process: Column) -> dict[str, Column]:
    flags = {name: message.rlike(pattern) for name, pattern in fixed.AUTH_FLAGS.items()}
    flags["is_sudo"] = F.lower(process).contains("sudo")
    flags["is_root_login"] = F.lower(message).contains("root") & flags["is_failed_auth"]
    return flags


def with_auth_flags(events: DataFrame) -> DataFrame:
    """Flags of system-login lines; lines that did not match the layout carry none."""
    parsed = F.col("time").isNotNull()
    flags = auth_flags(F.col("message"), F.col("process"))
    return events.withColumns({n: F.when(parsed, c) for n, c in flags.items()})


def with_web_flags(events: DataFrame) -> DataFrame:
    path, agent = F.lower("path"), F.lower("useragent")
    status = F.col("http_status")
    flags = {n: path.rlike(p) for n, p in fixed.WEB_PATH_FLAGS.items()}
    flags |= {n: agent.rlike(p) for n, p in fixed.WEB_AGENT_FLAGS.items()}
    flags["is_4xx"] = (status >= 400) & (status < 500)
    flags["is_5xx"] = (status >= 500) & (status < 600)
    return events.withColumns(flags)


def event_id_flags(event_id: Column) -> dict[str, Column]:
    return {n: event_id.isin(ids) for n, ids in fixed.EVENT_ID_FLAGS.items()}


def with_event_id_flags(events: DataFrame) -> DataFrame:
    """Flags of Windows text records. A record without an id counts as id 0."""
    event_id = F.coalesce(F.col("event_id"), F.lit(0))
    remote = F.coalesce(F.col("logon_type") == "3", F.lit(False)) if "logon_type" in events.columns else F.lit(False)
    return events.withColumns({
        **event_id_flags(event_id),
        "is_pass_the_hash": (event_id == 4624) & remote,
        "event_type": text.event_type(event_id),
    })


def with_generic_flags(events: DataFrame) -> DataFrame:
    """Flags of structured records. All word tests look for parts of words."""
    def part(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    action = F.lower(part("action"))
    blobs = events.withColumns({
        "_status_blob": F.lower(F.concat_ws(" ", part("status"), part("action"), part("message"))),
        "_action_blob": action,
    })
    status_blob, action_blob = F.col("_status_blob"), F.col("_action_blob")
    # the action is part of the status blob, so hints in either show up in the latter
    with_context = blobs.withColumn(
        "is_auth_context", text.any_word(status_blob, fixed.AUTH_HINT_WORDS)
    )
    has_id = F.col("event_id_raw").isNotNull()
    event_id = F.coalesce(F.col("event_id"), F.lit(0))
    return with_context.withColumns({
        "is_denied": text.any_word(status_blob, fixed.DENY_WORDS),
        "is_failed_auth": F.col("is_auth_context") & text.any_word(status_blob, fixed.FAIL_WORDS),
        "is_success_auth": F.col("is_auth_context") & text.any_word(status_blob, fixed.SUCCESS_WORDS),
        "is_sensitive_action": text.any_word(
            F.replace(action_blob, F.lit(" "), F.lit("")), fixed.SENSITIVE_ACTIONS
        ),
        "is_admin_user": F.lower(part("username")).rlike(fixed.ADMIN_USER),
        "is_error_status": F.coalesce(F.col("status_code") >= 400, F.lit(False)),
        "event_type": F.when(has_id, text.event_type(event_id)),
        **{n: F.when(has_id, c) for n, c in event_id_flags(event_id).items()},
    }).drop("_status_blob", "_action_blob")
