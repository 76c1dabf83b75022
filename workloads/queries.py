"""Registered queries: name -> (Spark function over Logs, SQL over the same tables).

Names start with the operator's id. Each query works on the whole log view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.functions import text
from vigilake.operators import aggregates, detect, hunts, ranking, selections
from vigilake.operators.rules import rules
from vigilake.plans import catalog
from vigilake.schema import flag
from vigilake.session import shared_path, written
from vigilake.sources import formats
from vigilake.sources.lines import clean_lines
from vigilake.sources.windows import win_layout
from vigilake.streaming import alerts
from workloads import oracle, streams, tables
from workloads.files import FileLogs, QuotedLogs, directory_counts, directory_of_all
from workloads.logs import Logs
from workloads.oracle import keyed, sql, total

QUERIES: dict[str, Callable[[Logs], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = "2024-02-01"
STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "%Y-%m-%d %H:%M:%S"


def register(name: str, run: Callable[[Logs], DataFrame], statement: str | None = None) -> None:
    QUERIES[name] = run
    if statement is not None:
        SQL[name] = statement


def _stamp(column: str = "event_ts"):
    return F.date_format(column, STAMP)


# --------------------------------------------------------------------- sources
register(
    "src1_text_lines",
    lambda logs: clean_lines(logs.raw("auth_lines"), skip_comments=True).select("source_file", "seq", "value"),
    sql("auth", "SELECT scope AS source_file, seq, raw AS value FROM auth"),
)
register(
    "src2_auth_events",
    lambda logs: logs.auth.select(
        "source_file", "seq", "raw", "month", "day", "time", "host", "process", "pid", "message", "src_ip", "username", "port",
        _stamp().alias("stamp"),
    ),
    sql("auth", f"""SELECT scope AS source_file, seq, raw, mon AS month, dom AS day, clock AS time, host, process, pid,
 coalesce(said, raw) AS message, src_ip, username, port, CASE WHEN matched THEN strftime(ts, '{SQL_STAMP}') END AS stamp FROM auth"""),
)
register(
    "src3_web_events",
    lambda logs: logs.web.select(
        "source_file", "seq", "raw", "src_ip", "username", "timestamp", "method", "path", "protocol", "http_status",
        "size", "referer", "useragent", "message", _stamp().alias("stamp"),
    ),
    sql("web", f"""SELECT scope AS source_file, seq, raw, src_ip, username, stamp AS timestamp, CASE WHEN matched THEN 'GET' END AS method, path,
 CASE WHEN matched THEN 'HTTP/1.1' END AS protocol, code AS http_status, size, referer, agent AS useragent,
 CASE WHEN NOT matched THEN raw END AS message, CASE WHEN matched THEN strftime(ts, '{SQL_STAMP}') END AS stamp FROM web"""),
)
register(
    "src4_win_tabular",
    lambda logs: logs.win.select(
        "source_file", "seq", "raw", "date", "time", "source", "event_id", "category", "message", _stamp().alias("stamp")
    ),
    sql("win", f"""SELECT scope AS source_file, seq, raw, day AS date, clock AS time, CASE WHEN NOT loose THEN 'Microsoft-Windows-Security-Auditing' END AS source,
 event_id, category, message, CASE WHEN NOT loose THEN strftime(happened, '{SQL_STAMP}') END AS stamp FROM win"""),
)
register(
    "src5_win_blocks",
    lambda logs: logs.blocks.select(
        "source_file", "seq", "raw", "event_id", "username", "src_ip", "logon_type", "workstation", "process_name", "timestamp", "message",
        _stamp().alias("stamp"),
    ),
    sql("blocks", f"""SELECT scope AS source_file, seq, raw, event_id, username, src_ip, logon_type, workstation, process_name, stamp AS timestamp,
 raw[1:200] AS message, strftime(happened, '{SQL_STAMP}') AS stamp FROM blocks"""),
)
register(
    "src6_win_layout",
    lambda logs: win_layout(logs.raw("win_lines").unionByName(logs.raw("win_blocks"))),
    f"""SELECT DISTINCT 'win-' || (o_custkey // 5) || '.log' AS source_file, 'tabular' AS layout FROM orders
 UNION ALL SELECT DISTINCT 'winblocks-' || (o_custkey // 5) || '.log', 'blocks' FROM orders""",
)
_STRUCTURED = ["source_file", "seq", "raw", "src_ip", "dst_ip", "dst_port", "username", "action", "status_code", "event_id", "message",
               "timestamp", "host", "protocol"]
register(
    "src7_csv_events",
    lambda logs: logs.csv.select(*_STRUCTURED, F.try_element_at("fields", F.lit("note")).alias("note"), F.size("fields").alias("width")),
    sql("csv", """SELECT scope AS source_file, seq, raw, src_ip, dst_ip, dst_port, username, action, status_code, event_id, message,
 stamp AS timestamp, host, 'tcp' AS protocol, note, 9 AS width FROM csv"""),
)
_CLOUD_SELECT = """src_ip, username, action, status_code, event_id, message, stamp AS timestamp, 'acc' || (user_id % 5) AS nested"""


def _cloud_columns(events: DataFrame, *more: str) -> DataFrame:
    return events.select(
        "source_file", "seq", *more, "src_ip", "username", "action", "status_code", "event_id", "message", "timestamp",
        F.try_element_at("fields", F.lit("userIdentity.ids[1].accountName")).alias("nested"),
    )


register("src8_json_lines", lambda logs: _cloud_columns(logs.cloud, "raw"),
         sql("cloud", f"SELECT scope AS source_file, seq, raw, {_CLOUD_SELECT} FROM cloud"))
register("src8_json_documents", lambda logs: _cloud_columns(logs.documents),
         sql("documents", f"SELECT scope AS source_file, seq, {_CLOUD_SELECT} FROM documents"))
register(
    "src9_xml_events",
    lambda logs: logs.xml.select(
        "source_file", "seq", "src_ip", "username", "action", "event_id", "status_code",
        F.try_element_at("fields", F.lit("tag[1]")).alias("tag"), F.try_element_at("fields", F.lit("code.#text")).alias("code"),
        F.try_element_at("fields", F.lit("net.@kind")).alias("kind"),
    ),
    sql("xml", """SELECT scope AS source_file, seq, src_ip, username, action, CAST(NULL AS INT) AS event_id, CAST(NULL AS INT) AS status_code,
 'b' AS tag, CAST(200 + seq % 300 AS VARCHAR) AS code, 'v4' AS kind FROM xml"""),
)
register(
    "src10_windows_event_xml",
    lambda logs: logs.winevent.select(
        "source_file", "seq", "raw", "event_id", "src_ip", "username", "host", "timestamp",
        F.try_element_at("fields", F.lit("System.Provider.@Name")).alias("provider"), F.size("fields").alias("width"),
    ),
    sql("winevent", """SELECT scope AS source_file, seq, raw, event_id, src_ip, username, host, CAST(NULL AS VARCHAR) AS timestamp,
 'Auditing' AS provider, 7 AS width FROM winevent"""),
)


def _all_files(logs: Logs) -> DataFrame:
    names = ["auth_lines", "web_lines", "win_lines", "firewall_lines", "cloud_lines", "winevent_records"]
    parts = [logs.raw(n) for n in names]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return lines


_FILES = """files AS (
 SELECT DISTINCT 'auth-' || strftime(ts, '%Y%m%d') || '.log' AS source_file, NULL AS by_name FROM events
 UNION ALL SELECT DISTINCT 'web-' || strftime(ts, '%Y%m%d') || '.log', NULL FROM events
 UNION ALL SELECT DISTINCT 'win-' || (o_custkey // 5) || '.log', NULL FROM orders
 UNION ALL SELECT DISTINCT 'fw-' || (l_suppkey // 10) || '.csv', 'csv' FROM lineitem
 UNION ALL SELECT DISTINCT 'cloud-' || strftime(ts, '%Y%m%d') || '.jsonl', 'json' FROM events
 UNION ALL SELECT DISTINCT 'winevent-' || (o_custkey // 5) || '.xml', 'xml' FROM orders)"""
register(
    "src11_route_by_extension",
    lambda logs: formats.route_by_extension(_all_files(logs).select("source_file").distinct()),
    f"WITH {_FILES} SELECT source_file, by_name AS log_type FROM files",
)


def _sniffed(view: str, where: str = "") -> str:
    """Format by content in SQL: the rule applied to the rebuilt first 50 lines."""
    return f"""head AS (SELECT scope, raw, row_number() OVER (PARTITION BY scope ORDER BY seq) AS n FROM {view} {where}), score AS (
 SELECT scope,
  max(CAST(regexp_matches(raw, '(?i)sshd\\[') AS INT)) + max(CAST(regexp_matches(raw, '(?i)sudo:\\s+\\w+') AS INT)) + max(CAST(regexp_matches(raw, '(?i)PAM:\\s+') AS INT))
   + max(CAST(regexp_matches(raw, '(?i)Failed password for') AS INT)) + max(CAST(regexp_matches(raw, '(?i)Accepted publickey') AS INT)) + max(CAST(regexp_matches(raw, '(?i)su\\[') AS INT)) AS auth_score,
  max(CAST(regexp_matches(raw, '(?i)"\\s*(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\\s+/') AS INT)) + max(CAST(regexp_matches(raw, '(?i)\\s+\\d{{3}}\\s+\\d+\\s+"https?://') AS INT))
   + max(CAST(regexp_matches(raw, '(?i)Mozilla/\\d+\\.\\d+') AS INT)) + max(CAST(regexp_matches(raw, '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\s+-\\s+-\\s+\\[') AS INT)) AS apache_score,
  max(CAST(regexp_matches(raw, '(?i)EventID:\\s*\\d+') AS INT)) + max(CAST(regexp_matches(raw, '(?i)EventCode=\\d+') AS INT)) + max(CAST(regexp_matches(raw, '(?i)Security\\s+ID:') AS INT))
   + max(CAST(regexp_matches(raw, '(?i)Logon\\s+Type:') AS INT)) + max(CAST(regexp_matches(raw, '(?i)Account\\s+Name:') AS INT)) + max(CAST(regexp_matches(raw, '(?i)Source\\s+Network\\s+Address:') AS INT))
   + max(CAST(regexp_matches(raw, '(?i)Keywords:\\s+Audit') AS INT)) + max(CAST(regexp_matches(raw, '(?i)Microsoft-Windows-\\S+\\s+\\d+\\s') AS INT)) AS windows_score
 FROM head WHERE n <= 50 GROUP BY scope)
SELECT scope AS source_file, CASE WHEN greatest(auth_score, apache_score, windows_score) = 0 THEN 'generic' WHEN auth_score = greatest(auth_score, apache_score, windows_score) THEN 'auth'
 WHEN apache_score = greatest(auth_score, apache_score, windows_score) THEN 'apache' ELSE 'windows' END AS log_type,
 CAST(auth_score AS INT) AS auth_score, CAST(apache_score AS INT) AS apache_score, CAST(windows_score AS INT) AS windows_score FROM score"""


_NOTES = """auth_all AS (SELECT scope, seq, raw FROM auth UNION ALL SELECT scope, seq + 1, '# note ' || event_id FROM auth WHERE event_id % 7 = 0)"""
register("src12_detect_auth_content", lambda logs: formats.detect_formats(logs.raw("auth_lines")),
         f"WITH {oracle.AUTH}, {_NOTES}, {_sniffed('auth_all')}")
register("src12_detect_web_content", lambda logs: formats.detect_formats(logs.raw("web_lines")), f"WITH {oracle.WEB}, {_sniffed('web')}")
register(
    "src12_detect_structured_content",
    lambda logs: formats.detect_formats(logs.raw("firewall_lines").unionByName(logs.raw("cloud_lines")).unionByName(logs.raw("winevent_records"))
                                        .withColumn("source_file", F.regexp_replace("source_file", r"\.[a-z]+$", ""))).select("source_file", F.col("log_type").isin("json", "xml").alias("nested")),
    """SELECT DISTINCT 'fw-' || (l_suppkey // 10) AS source_file, false AS nested FROM lineitem
 UNION ALL SELECT DISTINCT 'cloud-' || strftime(ts, '%Y%m%d'), true FROM events UNION ALL SELECT DISTINCT 'winevent-' || (o_custkey // 5), true FROM orders""",
)
register("src13_generic_fallback", lambda logs: detect.detect(logs.generic, rules(log_types=["csv"])).select(
    "scope", "log_type", "rule_name", "severity", "hit_count", "sample_entry", F.to_json("evidence").alias("evidence")),
    keyed("auth", "generic_repeated_auth_failures", "high", "is_failed_auth", 5, "offending_sources", "max_attempts").replace(
        "SELECT scope, 'generic", "SELECT scope, 'generic' AS log_type, 'generic", 1))

# --------------------------------------------------------------------- scalar functions
register(
    "sc1_sniff_delimiter",
    lambda logs: logs.raw("firewall_lines").select("source_file", "seq", text.sniff_delimiter(F.col("value")).alias("delimiter")),
    sql("csv", "SELECT scope AS source_file, seq, ',' AS delimiter FROM csv UNION ALL SELECT DISTINCT scope, -1, ',' FROM csv"),
)
register("sc2_percent_decode", lambda logs: logs.web.filter("target is not null").select("seq", "target", text.percent_decode(F.col("target")).alias("decoded")),
         sql("web", "SELECT seq, target, path AS decoded FROM web WHERE target IS NOT NULL"))
register(
    "sc3_clean_key",
    lambda logs: logs.raw("cloud_lines").select("seq", text.clean_key(F.concat(F.lit("Outer.Key - "), F.col("seq"), F.lit(" B "))).alias("name")),
    "SELECT event_id AS seq, 'key_' || event_id || '_b' AS name FROM events",
)
register(
    "sc4_flatten",
    lambda logs: logs.cloud.select("seq", F.explode("fields").alias("key", "value")),
    sql("cloud", """SELECT seq, unnest(['eventTime', 'eventName', 'sourceIPAddress', 'userIdentity.type', 'userIdentity.userName', 'userIdentity.ids[0]',
  'userIdentity.ids[1].accountName', 'responseElements.status', 'responseElements.httpStatus.code', 'eventID']) AS key,
 unnest([stamp, action, src_ip, 'IAMUser', caller, '1', 'acc' || (user_id % 5), NULL, CAST(status_code AS VARCHAR), 'e-' || event_id]) AS value FROM cloud
 UNION ALL SELECT seq, 'errorMessage', message FROM cloud WHERE message IS NOT NULL
 UNION ALL SELECT seq, 'requestParameters.userName', username FROM cloud WHERE action = 'CreateUser'"""),
)
register("sc5_canonical_alias", lambda logs: logs.winevent.select("seq", "username", "src_ip", "host"),
         sql("winevent", "SELECT seq, username, src_ip, host FROM winevent"))
register("sc6_id_and_status", lambda logs: logs.cloud.select("seq", "event_id_raw", "event_id", "status_code"),
         sql("cloud", "SELECT seq, 'e-' || event_id AS event_id_raw, event_id, status_code FROM cloud"))
register("sc7_event_type", lambda logs: logs.win.select("seq", "event_id", "event_type"), sql("win", "SELECT seq, event_id, event_type FROM win"))
register("sc8_auth_fields", lambda logs: logs.auth.select("seq", "src_ip", "username", "port"), sql("auth", "SELECT seq, src_ip, username, port FROM auth"))
register(
    "sc9_status_blob",
    lambda logs: logs.csv.select("source_file", "seq", F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("status", "action", "message")])).alias("blob")),
    sql("csv", "SELECT scope AS source_file, seq, ' ' || lower(action) || ' ' AS blob FROM csv"),
)

# --------------------------------------------------------------------- flags
_FLAG_NAMES = {
    "auth": ["is_failed_auth", "is_accepted_auth", "is_invalid_user", "is_sudo", "is_root_login", "is_disconnected", "is_session_opened", "is_session_closed"],
    "web": ["is_sqli", "is_xss", "is_path_traversal", "is_rfi", "is_webshell", "is_scanner", "is_4xx", "is_5xx", "is_admin_access", "is_backup_file"],
    "blocks": ["is_failed_logon", "is_privileged_logon", "is_service_install", "is_scheduled_task", "is_account_created", "is_group_modified", "is_log_cleared", "is_kerberoast", "is_pass_the_hash"],
    "csv": ["is_denied", "is_failed_auth", "is_success_auth", "is_sensitive_action", "is_admin_user", "is_error_status", "is_auth_context"],
}


def _flag_query(view: str, name: str):
    return lambda logs: getattr(logs, view).filter(flag(name)).groupBy("source_file").agg(F.count(F.lit(1)).alias("hits"), F.min("seq").alias("first_seq"))


_number = 0
for _view, _names in _FLAG_NAMES.items():
    for _name in _names:
        _number += 1
        register(f"f{_number}_{_view}_{_name}", _flag_query(_view, _name),
                 sql(_view, f"SELECT scope AS source_file, count(*) AS hits, min(seq) AS first_seq FROM {_view} WHERE {_name} GROUP BY scope"))
register("p1_filter_on_flag", lambda logs: selections.select_flag(logs.web, "is_5xx").filter("seq > 0").select("seq", "path"),
         sql("web", "SELECT seq, path FROM web WHERE is_5xx AND seq > 0"))


# --------------------------------------------------------------------- detections
def _findings(events: DataFrame, *ids: str) -> DataFrame:
    return detect.detect(events, rules(ids=ids)).select(
        "scope", "rule_name", "severity", "hit_count", "sample_entry", F.to_json("evidence").alias("evidence"))


def _rule(rule_id: str, name: str, view: str, statement: str) -> None:
    register(f"{rule_id}_{name}", lambda logs: _findings(getattr(logs, view), rule_id), statement)


_rule("d1", "ssh_brute_force_by_ip", "auth", keyed("auth", "ssh_brute_force_by_ip", "high", "is_failed_auth", 5, "offending_ips", "max_attempts"))
_rule("d2", "ssh_user_enumeration", "auth", sql("auth", """SELECT s.scope, 'ssh_user_enumeration' AS rule_name, 'medium' AS severity, count(*) AS hit_count,
 any_value(s.sample) AS sample_entry, '{"invalid_users_count":' || count(*) || ',"sample_users":["' || array_to_string(list(u.username ORDER BY u.first)[1:10], '","') || '"]}' AS evidence
FROM (SELECT scope, arg_min(raw, seq) AS sample FROM auth GROUP BY scope) s
JOIN (SELECT scope, username, min(seq) AS first FROM auth WHERE is_invalid_user AND username IS NOT NULL GROUP BY ALL) u ON u.scope = s.scope
GROUP BY s.scope HAVING count(*) >= 5"""))
_rule("d3", "ssh_root_login_attempt", "auth", total("auth", "ssh_root_login_attempt", "high", "is_root_login", 1, """'{"attempt_count":' || count(*) || '}'"""))
_rule("d4", "ssh_success_after_failures", "auth", sql("auth", """, failed AS (SELECT scope, src_ip, count(*) AS n, min(seq) AS first FROM auth WHERE is_failed_auth AND src_ip IS NOT NULL GROUP BY ALL),
good AS (SELECT a.scope, a.src_ip, any_value(f.n) AS n, min(a.seq) AS first, arg_max(a.raw, a.seq) AS sample FROM auth a JOIN failed f ON f.scope = a.scope AND f.src_ip = a.src_ip
 WHERE a.is_accepted_auth AND a.seq >= f.first GROUP BY a.scope, a.src_ip)
SELECT scope, 'ssh_successful_login_after_brute_force' AS rule_name, 'critical' AS severity, arg_min(n, first) AS hit_count, arg_min(sample, first) AS sample_entry,
 '{"src_ip":"' || arg_min(src_ip, first) || '","failed_before":' || arg_min(n, first) || '}' AS evidence FROM good GROUP BY scope"""))


def _paths(flag_name: str, member: str, k: int, cut: str = "") -> str:
    return f"""'{{"{member}":["' || array_to_string(list(path{cut} ORDER BY seq)[1:{k}], '","') || '"]}}'"""


for _id, _n, _sev, _flag, _member, _k, _cut in [
    ("d5", "web_sql_injection_attempt", "high", "is_sqli", "sample_paths", 3, "[1:120]"),
    ("d6", "web_xss_attempt", "medium", "is_xss", "sample_paths", 3, "[1:120]"),
    ("d7", "web_path_traversal_attempt", "high", "is_path_traversal", "sample_paths", 3, "[1:120]"),
    ("d8", "web_webshell_access", "critical", "is_webshell", "accessed_paths", 5, ""),
]:
    _rule(_id, _n, "web", total("web", _n, _sev, _flag, 1, _paths(_flag, _member, _k, _cut)))
_rule("d9", "web_scanner_detected", "web", sql("web", """SELECT scope, 'web_scanner_detected' AS rule_name, 'medium' AS severity, any_value(n) AS hit_count, any_value(sample) AS sample_entry,
 '{"scanner_uas":["' || array_to_string(list(agent ORDER BY first), '","') || '"]}' AS evidence
FROM (SELECT scope, agent[1:80] AS agent, min(rank) AS first, any_value(n) AS n, any_value(sample) AS sample FROM (
 SELECT scope, agent, row_number() OVER (PARTITION BY scope ORDER BY seq) AS rank, count(*) OVER (PARTITION BY scope) AS n, first_value(raw) OVER (PARTITION BY scope ORDER BY seq) AS sample
 FROM web WHERE is_scanner) WHERE rank <= 5 GROUP BY ALL) GROUP BY scope""".replace("GROUP BY ALL", "GROUP BY scope, agent[1:80]")))
register("d10_web_directory_scanning", lambda logs: detect.detect_rule(logs.web, "d10", threshold=8).select(
    "scope", "rule_name", "severity", "hit_count", "sample_entry", F.to_json("evidence").alias("evidence")),
    keyed("web", "web_directory_scanning", "medium", "is_4xx", 8, "offending_ips", None, sample="arg_min(src_ip, (-n, first))"))

def _windows_brute_force(view: str) -> str:
    return sql(view, f""", ips AS (SELECT scope, coalesce(src_ip, 'unknown') AS ip, count(*) AS n, min(seq) AS first, arg_min(raw, seq) AS raw FROM {view} WHERE is_failed_logon GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, first) AS rank FROM ips)
SELECT scope, 'windows_brute_force_logon' AS rule_name, 'high' AS severity, CAST(sum(n) AS BIGINT) AS hit_count, arg_min(raw, first) AS sample_entry,
 '{{"total_failures":' || sum(n) || ',"top_source_ips":{{' || string_agg('"' || ip || '":' || n, ',' ORDER BY rank) FILTER (WHERE rank <= 5) || '}}}}' AS evidence
FROM ranked GROUP BY scope HAVING sum(n) >= 5""")


_rule("d11", "windows_brute_force_logon", "blocks", _windows_brute_force("blocks"))
_TICKETS = """'{"ticket_requests":' || count(*) || '}'"""
for _view, _suffix in (("win", ""), ("blocks", "_blocks")):
    for _id, _n, _sev, _flag, _t, _e in [
        ("d12", "windows_suspicious_service_install", "high", "is_service_install", 1, "'{}'"),
        ("d13", "windows_scheduled_task_created", "medium", "is_scheduled_task", 1, "'{}'"),
        ("d14", "windows_new_account_created", "medium", "is_account_created", 1, "'{}'"),
        ("d15", "windows_privileged_group_modification", "high", "is_group_modified", 1, "'{}'"),
        ("d16", "windows_audit_log_cleared", "critical", "is_log_cleared", 1, "'{}'"),
        ("d17", "windows_kerberoasting_attempt", "high", "is_kerberoast", 3, _TICKETS),
    ]:
        if _view == "win" or _id == "d17":
            register(f"{_id}_{_n}{_suffix}", lambda logs, v=_view, i=_id: _findings(getattr(logs, v), i), total(_view, _n, _sev, _flag, _t, _e))
_rule("d18", "generic_repeated_auth_failures", "csv", keyed("csv", "generic_repeated_auth_failures", "high", "is_failed_auth", 5, "offending_sources", "max_attempts"))
_rule("d19", "generic_block_deny_surge", "csv", keyed("csv", "generic_block_deny_surge", "medium", "is_denied", 10, "offending_sources", "max_events"))
_rule("d20", "generic_error_status_spike", "csv", keyed("csv", "generic_error_status_spike", "medium", "is_error_status", 20, "offending_sources", None))


def _sensitive(view: str) -> str:
    return sql(view, f""", acts AS (SELECT scope, coalesce(action, 'unknown') AS action, count(*) AS n, min(seq) AS first, arg_min(raw, seq) AS raw FROM {view} WHERE is_sensitive_action GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, first) AS rank FROM acts)
SELECT scope, 'generic_sensitive_action_detected' AS rule_name, 'high' AS severity, CAST(sum(n) AS BIGINT) AS hit_count, arg_min(raw, first) AS sample_entry,
 '{{"action_counts":{{' || string_agg('"' || action || '":' || n, ',' ORDER BY rank) FILTER (WHERE rank <= 10) || '}}}}' AS evidence,
 array_to_string(list(action ORDER BY first)[1:10], ',') AS keywords FROM ranked GROUP BY scope""")


register("d21_generic_sensitive_action", lambda logs: detect.detect_rule(logs.cloud, "d21").select(
    "scope", "rule_name", "severity", "hit_count", "sample_entry", F.to_json("evidence").alias("evidence"), F.array_join("keywords", ",").alias("keywords")),
    _sensitive("cloud"))
for _id, _n, _sev, _flag, _t, _e in [
    ("d22", "windows_brute_force_logon", "high", "is_failed_logon", 5, """'{"total_failures":' || count(*) || '}'"""),
    ("d23", "windows_audit_log_cleared", "critical", "is_log_cleared", 1, "'{}'"),
    ("d24", "windows_kerberoasting_attempt", "high", "is_kerberoast", 3, _TICKETS),
    ("d25", "windows_suspicious_service_install", "high", "is_service_install", 1, "'{}'"),
    ("d26", "windows_privileged_group_modification", "high", "is_group_modified", 1, "'{}'"),
]:
    _rule(_id, f"xml_{_n}", "winevent", total("winevent", f"xml_{_n}", _sev, _flag, _t, _e))


def _mixed(logs: Logs) -> DataFrame:
    return logs.auth.unionByName(logs.blocks).unionByName(logs.winevent)


def _counts(view: str, log_type: str, cases: list[tuple[str, str, int]]) -> list[str]:
    return [f"SELECT scope, '{log_type}' AS log_type, '{n}' AS rule_name, count(*) AS hit_count FROM {view} WHERE {f} GROUP BY scope HAVING count(*) >= {t}" for n, f, t in cases]


_EVENT_CASES = [("windows_brute_force_logon", "is_failed_logon", 5), ("windows_audit_log_cleared", "is_log_cleared", 1), ("windows_kerberoasting_attempt", "is_kerberoast", 3),
                ("windows_suspicious_service_install", "is_service_install", 1), ("windows_privileged_group_modification", "is_group_modified", 1)]


def _joined(*views: str) -> str:
    """CTEs of several views in one statement; helper names get the view's name."""
    out, helpers = [], ("base", "typed", "said", "aimed", "numbered", "stamped", "lined", "told")
    import re
    for v in views:
        body = oracle.VIEWS[v]
        for h in helpers:
            body = re.sub(rf"\b{h}\b(?= AS \()", f"{v}_{h}", body)
            body = re.sub(rf"(FROM|JOIN) {h}\b", rf"\1 {v}_{h}", body)
        out.append(body)
    return "WITH " + ",\n".join(out)


_AUTH_CASES = """SELECT scope, 'auth' AS log_type, 'ssh_brute_force_by_ip' AS rule_name, CAST(sum(n) AS BIGINT) AS hit_count FROM (SELECT scope, src_ip, count(*) AS n FROM auth WHERE is_failed_auth GROUP BY ALL HAVING count(*) >= 5) GROUP BY scope
UNION ALL SELECT scope, 'auth', 'ssh_user_enumeration', count(DISTINCT username) FROM auth WHERE is_invalid_user GROUP BY scope HAVING count(DISTINCT username) >= 5
UNION ALL SELECT scope, 'auth', 'ssh_root_login_attempt', count(*) FROM auth WHERE is_root_login GROUP BY scope
UNION ALL SELECT scope, 'auth', 'ssh_successful_login_after_brute_force', arg_min(n, first) FROM (SELECT a.scope, a.src_ip, any_value(f.n) AS n, min(a.seq) AS first
 FROM auth a JOIN (SELECT scope, src_ip, count(*) AS n, min(seq) AS first FROM auth WHERE is_failed_auth GROUP BY ALL) f ON f.scope = a.scope AND f.src_ip = a.src_ip WHERE a.is_accepted_auth AND a.seq >= f.first GROUP BY a.scope, a.src_ip) GROUP BY scope"""
_WIN_CASES = _EVENT_CASES + [("windows_scheduled_task_created", "is_scheduled_task", 1), ("windows_new_account_created", "is_account_created", 1)]
_DISPATCH = _joined("auth", "blocks", "winevent") + ", found AS (" + "\nUNION ALL ".join(
    [_AUTH_CASES] + _counts("blocks", "windows", _WIN_CASES) + _counts("winevent", "xml", [(f"xml_{n}", f, t) for n, f, t in _EVENT_CASES])) + ")"
register("d27_rule_dispatch", lambda logs: detect.detect_all(_mixed(logs)).select("scope", "log_type", "rule_name", "hit_count"),
         _DISPATCH + " SELECT * FROM found")

# --------------------------------------------------------------------- aggregates
register("a1_failures_per_user", lambda logs: aggregates.failures_per_user(logs.auth),
         sql("auth", "SELECT scope AS source_file, username, count(*) AS failures FROM auth WHERE is_failed_auth GROUP BY ALL"))
register("a2_sudo_commands", lambda logs: aggregates.sudo_commands(logs.auth), sql("auth", "SELECT scope AS source_file, seq, raw FROM auth WHERE is_sudo"))
register("a3_web_exposure", lambda logs: aggregates.web_exposure(logs.web),
         sql("web", "SELECT scope AS source_file, count(*) FILTER (is_rfi) AS rfi_hits, count(*) FILTER (is_admin_access) AS admin_hits, count(*) FILTER (is_backup_file) AS backup_hits FROM web GROUP BY scope"))
register("a4_privileged_logons", lambda logs: aggregates.privileged_logons(logs.blocks),
         sql("blocks", "SELECT scope AS source_file, count(*) FILTER (is_privileged_logon) AS privileged_logons FROM blocks GROUP BY scope"))
register("a5_admin_actions", lambda logs: aggregates.admin_actions(logs.csv).select("source_file", "seq", "username", "action"),
         sql("csv", "SELECT scope AS source_file, seq, username, action FROM csv WHERE is_admin_user AND (is_sensitive_action OR is_failed_auth)"))
register("a6_unruled_event_types", lambda logs: aggregates.unruled_event_types(logs.win),
         sql("win", "SELECT scope AS source_file, event_type, count(*) AS n FROM win WHERE event_id IN (4648, 4724, 4776, 4768, 4771, 4946) GROUP BY ALL"))
register("a7_run_summary", lambda logs: aggregates.run_summary(logs.auth, detect.detect(logs.auth, rules(["auth"])), formats=2),
         sql("auth", f""", found AS ({_AUTH_CASES})
SELECT a.scope, 'auth' AS log_type, any_value(a.n) AS entries, count(f.scope) AS findings, count(f.scope) * 2 AS rules
FROM (SELECT scope, count(*) AS n FROM auth GROUP BY scope) a LEFT JOIN found f ON f.scope = a.scope GROUP BY a.scope"""))

# --------------------------------------------------------------------- ranking
_KEYS = "(SELECT scope, src_ip, count(*) AS n, min(seq) AS first_seq FROM auth WHERE src_ip IS NOT NULL GROUP BY ALL)"
register("k1_top_key", lambda logs: ranking.top_k(logs.auth, "source_file", "src_ip", 1).select("source_file", "src_ip", "n"),
         sql("auth", f"SELECT scope AS source_file, arg_min(src_ip, (-n, first_seq)) AS src_ip, max(n) AS n FROM {_KEYS} GROUP BY scope"))
register("k2_top_keys", lambda logs: ranking.top_k(logs.auth, "source_file", "src_ip", 5),
         sql("auth", f"SELECT scope AS source_file, src_ip, n, first_seq, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scope ORDER BY n DESC, first_seq) AS INT) AS rank FROM {_KEYS}) WHERE rank <= 5"))
register("k3_first_keys", lambda logs: ranking.first_k_keys(logs.auth, "source_file", "username", 10).select("source_file", "username", "rank"),
         sql("auth", "SELECT scope AS source_file, username, rank FROM (SELECT scope, username, CAST(row_number() OVER (PARTITION BY scope ORDER BY min(seq)) AS INT) AS rank FROM auth WHERE username IS NOT NULL GROUP BY scope, username) WHERE rank <= 10"))
register("k3_first_records", lambda logs: ranking.first_k(logs.web.filter(flag("is_scanner")), "source_file", 3).select("source_file", "seq", "path", "rank"),
         sql("web", "SELECT scope AS source_file, seq, path, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scope ORDER BY seq) AS INT) AS rank FROM web WHERE is_scanner) WHERE rank <= 3"))
register("k4_first_record", lambda logs: ranking.first_record(logs.blocks.filter(flag("is_kerberoast")), "source_file"),
         sql("blocks", "SELECT scope AS source_file, arg_min(raw, seq) AS sample_entry FROM blocks WHERE is_kerberoast GROUP BY scope"))
register("k5_distinct_values", lambda logs: ranking.distinct_values(logs.web, "source_file", "useragent"),
         sql("web", "SELECT scope AS source_file, count(DISTINCT agent) AS distinct_values FROM web GROUP BY scope"))
_SEVERITY = "CASE WHEN rule_name LIKE '%audit_log_cleared' OR rule_name LIKE 'ssh_successful%' THEN 'critical' WHEN rule_name IN ('ssh_user_enumeration', 'windows_scheduled_task_created', 'windows_new_account_created') THEN 'medium' ELSE 'high' END"
register("k6_order_by_severity", lambda logs: ranking.order_findings(detect.detect(logs.blocks, rules(["windows"]))).select("scope", "rule_name", "severity", text.severity_rank(F.col("severity")).cast("int").alias("rank")),
         sql("blocks", f", found AS ({' UNION ALL '.join(_counts('blocks', 'windows', _WIN_CASES))}) SELECT scope, rule_name, {_SEVERITY} AS severity, CASE {_SEVERITY} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END AS rank FROM found ORDER BY rank DESC"))
register("k7_severity_filter", lambda logs: ranking.filter_severity(detect.detect(logs.auth, rules(["auth"])), "high").select("scope", "rule_name", "severity", "hit_count"),
         sql("auth", f", found AS ({_AUTH_CASES}) SELECT scope, rule_name, {_SEVERITY} AS severity, hit_count FROM found WHERE rule_name <> 'ssh_user_enumeration'"))
register("k8_append_findings", lambda logs: _findings(logs.auth, "d3").unionByName(_findings(logs.blocks, "d16")).select("scope", "rule_name", "hit_count"),
         _joined("auth", "blocks") + " SELECT scope, 'ssh_root_login_attempt' AS rule_name, count(*) AS hit_count FROM auth WHERE is_root_login GROUP BY scope UNION ALL SELECT scope, 'windows_audit_log_cleared', count(*) FROM blocks WHERE is_log_cleared GROUP BY scope")
register("k9_event_id_list", lambda logs: selections.select_event_ids(logs.win, [4728, 4732, 4756]).select("seq", "event_id"),
         sql("win", "SELECT seq, event_id FROM win WHERE event_id IN (4728, 4732, 4756)"))

# --------------------------------------------------------------------- selections
register("g1_keyword_selection", lambda logs: selections.select_keywords(logs.auth, ["failed PASSWORD for root", "Invalid user g5"]).select("seq", "raw"),
         sql("auth", "SELECT seq, raw FROM auth WHERE contains(lower(raw), 'failed password for root') OR contains(lower(raw), 'invalid user g5')"))
register("g2_query_all_and_any", lambda logs: selections.select_query_keywords(logs.web, ["union", "select", "+from", "nowhere"]).select("seq", "target"),
         sql("web", "SELECT seq, target FROM web WHERE contains(lower(uri_query), 'union') AND contains(lower(uri_query), 'select') AND contains(lower(uri_query), '+from')"))
register("g3_event_id_selection", lambda logs: selections.select_event_ids(logs.winevent, [4625]).select("seq", "src_ip"),
         sql("winevent", "SELECT seq, src_ip FROM winevent WHERE event_id = 4625"))
register("g4_any_field", lambda logs: selections.select_fields(logs.csv, ["failed", "DENY"]).select("source_file", "seq"),
         sql("csv", "SELECT scope AS source_file, seq FROM csv WHERE action IN ('login failed', 'deny')"))
register("g5_fallback", lambda logs: selections.select_fallback(logs.auth, "session opened").select("seq"), sql("auth", "SELECT seq FROM auth WHERE is_session_opened"))

# --------------------------------------------------------------------- hunts
register("q1_hunt_brute_force", lambda logs: hunts.hunt_ssh_brute_force(logs.auth),
         sql("auth", """SELECT src_ip AS "Source IP", count(*) AS "Failed Attempts", CASE WHEN count(*) > 50 THEN 'critical' WHEN count(*) > 20 THEN 'high' ELSE 'medium' END AS risk_score FROM auth WHERE is_failed_auth GROUP BY src_ip HAVING count(*) >= 5"""))
register("q2_hunt_user_enumeration", lambda logs: hunts.hunt_user_enumeration(logs.auth),
         sql("auth", "SELECT src_ip, count(DISTINCT invalid_user) AS distinct_users, count(*) AS count FROM auth WHERE invalid_user IS NOT NULL AND contains(raw, 'Invalid user') GROUP BY src_ip HAVING count(DISTINCT invalid_user) >= 5"))
register("q3_hunt_root_logins", lambda logs: hunts.hunt_root_logins(logs.auth), sql("auth", "SELECT src_ip, count(*) AS attempts FROM auth WHERE is_root_login GROUP BY src_ip"))
register("q4_hunt_failed_and_accepted", lambda logs: hunts.hunt_failed_and_accepted(logs.auth).withColumn("results", F.array_join("results", ",")),
         sql("auth", "SELECT src_ip, 'Accepted,Failed' AS results, 'Successful login after failures - possible brute force success' AS message FROM auth GROUP BY src_ip HAVING bool_or(is_failed_auth) AND bool_or(is_accepted_auth) AND src_ip IS NOT NULL"))
register("q5_hunt_sqli", lambda logs: hunts.hunt_sql_injection(logs.web).withColumn("time", F.date_format("time", STAMP)),
         sql("web", f"""SELECT src_ip, uri_path, strftime(ts, '{SQL_STAMP}') AS time, count(*) AS count FROM web WHERE regexp_matches(lower(uri_query), 'union.*select') OR contains(lower(uri_query), 'or+1=1')
 OR contains(lower(uri_query), 'drop+table') OR contains(lower(uri_query), 'insert+into') OR contains(lower(uri_query), '''--') OR contains(lower(uri_path), 'union select') GROUP BY ALL"""))
register("q6_hunt_xss", lambda logs: hunts.hunt_xss(logs.web),
         sql("web", "SELECT src_ip, uri_path, count(*) AS count FROM web WHERE contains(lower(uri_query), '<script') OR contains(lower(uri_query), 'javascript:') OR contains(lower(uri_query), 'onerror=') OR contains(lower(uri_query), 'document.cookie') GROUP BY ALL"))
register("q7_hunt_traversal", lambda logs: hunts.hunt_path_traversal(logs.web),
         sql("web", "SELECT src_ip, uri_path, code AS status, count(*) AS count FROM web WHERE (contains(uri_path, '../') OR contains(uri_path, '..\\') OR contains(lower(uri_path), '%2e%2e%2f')) AND code <> 404 GROUP BY ALL"))
register("q8_hunt_webshell", lambda logs: hunts.hunt_webshell(logs.web).withColumn("time", F.date_format("time", STAMP)),
         sql("web", f"SELECT strftime(ts, '{SQL_STAMP}') AS time, src_ip, uri_path, code AS status, agent AS http_user_agent FROM web WHERE regexp_matches(lower(uri_path), 'cmd\\.php|shell\\.php|c99|r57|webshell')"))
register("q9_hunt_scanner", lambda logs: hunts.hunt_scanner(logs.web),
         sql("web", "SELECT src_ip, agent AS http_user_agent, count(*) AS count FROM web WHERE regexp_matches(lower(agent), 'nikto|sqlmap|dirbuster|gobuster|masscan|burp') GROUP BY ALL"))
register("q10_hunt_enumeration", lambda logs: hunts.hunt_enumeration(logs.web),
         sql("web", "SELECT src_ip, count(*) AS error_count, 'Possible directory enumeration' AS risk FROM web WHERE code = 404 GROUP BY src_ip HAVING count(*) >= 20"))
register("q11_hunt_windows_brute_force", lambda logs: hunts.hunt_windows_brute_force(logs.blocks, threshold=2),
         sql("blocks", "SELECT src_ip, username, count(*) AS failures FROM blocks WHERE event_id = 4625 AND src_ip IS NOT NULL GROUP BY ALL HAVING count(*) >= 2"))
register("q12_hunt_log_cleared", lambda logs: hunts.hunt_log_cleared(logs.blocks).withColumn("time", F.date_format("time", STAMP)),
         sql("blocks", f"SELECT strftime(happened, '{SQL_STAMP}') AS time, workstation AS host, username AS user, raw[1:200] AS message FROM blocks WHERE event_id = 1102"))
register("q13_hunt_kerberoast", lambda logs: hunts.hunt_kerberoast(logs.blocks, threshold=1),
         sql("blocks", "SELECT username, count(DISTINCT service) AS service_count, 'Possible Kerberoasting' AS alert FROM blocks WHERE event_id = 4769 GROUP BY username HAVING count(DISTINCT service) >= 1"))
register("q14_hunt_windows_events", lambda logs: hunts.hunt_windows_events(logs.win, [4697, 7045]).withColumn("time", F.date_format("time", STAMP)),
         sql("win", f"SELECT CASE WHEN NOT loose THEN strftime(happened, '{SQL_STAMP}') END AS time, CAST(NULL AS VARCHAR) AS host, CAST(NULL AS VARCHAR) AS user, event_id AS event_code, message FROM win WHERE event_id IN (4697, 7045)"))
register("q15_hunt_event_brute_force", lambda logs: hunts.hunt_event_brute_force(logs.winevent, threshold=2),
         sql("winevent", "SELECT src_ip, count(*) AS failures FROM winevent WHERE event_id = 4625 GROUP BY src_ip HAVING count(*) >= 2"))
register("q16_hunt_event_table", lambda logs: hunts.hunt_event_table(logs.winevent, [1102]).withColumn("time", F.date_format("time", STAMP)),
         sql("winevent", "SELECT CAST(NULL AS VARCHAR) AS time, host, src_ip, username, event_id, CAST(NULL AS VARCHAR) AS message FROM winevent WHERE event_id = 1102"))
register("q17_hunt_auth_failures", lambda logs: hunts.hunt_auth_failures(logs.csv), sql("csv", "SELECT src_ip, count(*) AS failures FROM csv WHERE is_failed_auth GROUP BY src_ip HAVING count(*) >= 5"))
register("q18_hunt_denied", lambda logs: hunts.hunt_denied(logs.csv), sql("csv", "SELECT src_ip, count(*) AS denied_events FROM csv WHERE is_denied GROUP BY src_ip HAVING count(*) >= 10"))
register("q19_hunt_error_status", lambda logs: hunts.hunt_error_status(logs.csv), sql("csv", "SELECT src_ip, count(*) AS errors FROM csv WHERE is_error_status GROUP BY src_ip HAVING count(*) >= 20"))
register("q20_hunt_sensitive_actions", lambda logs: hunts.hunt_sensitive_actions(logs.cloud).withColumn("time", F.date_format("time", STAMP)),
         sql("cloud", f"SELECT strftime(ts, '{SQL_STAMP}') AS time, host, username, action, src_ip FROM cloud WHERE is_sensitive_action"))
register("q21_hunt_table", lambda logs: hunts.hunt_table(logs.cloud).withColumn("time", F.date_format("time", STAMP)),
         sql("cloud", f"SELECT strftime(ts, '{SQL_STAMP}') AS time, host, src_ip, username, action, message FROM cloud"))
register("q22_hunt_text", lambda logs: hunts.hunt_text(logs.auth, "-- mark --").withColumn("time", F.date_format("time", STAMP)),
         sql("auth", "SELECT CAST(NULL AS VARCHAR) AS time, CAST(NULL AS VARCHAR) AS host, CAST(NULL AS VARCHAR) AS user, raw FROM auth WHERE NOT matched"))

# --------------------------------------------------------------------- texts of findings
_TECHNIQUES = """CASE rule_name WHEN 'ssh_brute_force_by_ip' THEN 'T1110/001' WHEN 'ssh_user_enumeration' THEN 'T1087/001' WHEN 'ssh_root_login_attempt' THEN 'T1078/003' ELSE 'T1110' END"""
_AUTH_FOUND = f", found AS ({_AUTH_CASES})"


def _auth_sql(body: str) -> str:
    return f"WITH {oracle.AUTH}{_AUTH_FOUND}\n{body}"


def _auth_findings(logs: Logs) -> DataFrame:
    return detect.detect(logs.auth, rules(["auth"]))


register("sc10_technique", lambda logs: _auth_findings(logs).select("scope", "rule_name", text.technique_path(F.col("mitre_technique")).alias("path"), F.array_join(text.technique_tags(F.col("mitre_technique")), ",").alias("tags")),
         _auth_sql(f"SELECT scope, rule_name, {_TECHNIQUES} AS path, CASE WHEN contains({_TECHNIQUES}, '/') THEN 'attack.' || lower({_TECHNIQUES}[1:5]) || ',attack.' || replace(lower({_TECHNIQUES}), '/', '.') ELSE 'attack.t1110' END AS tags FROM found"))
register("sc11_severity_rank_and_risk", lambda logs: _auth_findings(logs).select("scope", "rule_name", text.severity_rank(F.col("severity")).cast("int").alias("rank"), text.risk_score(F.col("severity")).alias("risk")),
         _auth_sql(f"SELECT scope, rule_name, CASE {_SEVERITY} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END AS rank, CASE {_SEVERITY} WHEN 'critical' THEN 10 WHEN 'high' THEN 7 ELSE 3 END AS risk FROM found"))
register("sc12_risk_tier", lambda logs: logs.csv.groupBy("src_ip", "action").agg(F.count(F.lit(1)).alias("n")).withColumn("tier", text.risk_tier(F.col("n"))),
         sql("csv", "SELECT src_ip, action, count(*) AS n, CASE WHEN count(*) > 50 THEN 'critical' WHEN count(*) > 20 THEN 'high' ELSE 'medium' END AS tier FROM csv GROUP BY ALL"))
register("sc13_text_cuts", lambda logs: logs.blocks.select("seq", "message", F.substring("raw", 1, 120).alias("cut")), sql("blocks", "SELECT seq, raw[1:200] AS message, raw[1:120] AS cut FROM blocks"))

_RULE_ID = "regexp_replace(md5(scope || '|' || rule_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
register("r1_sigma_rules", lambda logs: catalog.sigma_rules(_auth_findings(logs), DAY).select(
    "scope", "rule_name", F.col("rule.id").alias("id"), F.col("rule.title").alias("title"), F.col("rule.status").alias("status"), F.col("rule.date").alias("date"),
    F.array_join("rule.references", " ").alias("refs"), F.col("rule.level").alias("level")),
    _auth_sql(f"""SELECT scope, rule_name, {_RULE_ID} AS id, CASE rule_name WHEN 'ssh_brute_force_by_ip' THEN 'SSH Brute Force from Single IP' WHEN 'ssh_user_enumeration' THEN 'SSH User Enumeration'
 WHEN 'ssh_root_login_attempt' THEN 'SSH Root Login Attempt' ELSE 'Successful SSH Login Following Failed Attempts' END AS title, 'experimental' AS status, '{DAY}' AS date,
 'https://attack.mitre.org/techniques/' || {_TECHNIQUES} || ' https://github.com/SigmaHQ/sigma' AS refs, {_SEVERITY} AS level FROM found"""))
register("r2_log_source", lambda logs: detect.detect_all(_mixed(logs)).select("scope", "rule_name", catalog.log_source(F.col("log_type")).alias("s")).select("scope", "rule_name", "s.product", "s.service", "s.category"),
         _DISPATCH + """ SELECT scope, rule_name, CASE log_type WHEN 'auth' THEN 'linux' WHEN 'windows' THEN 'windows' ELSE 'generic' END AS product,
 CASE log_type WHEN 'auth' THEN 'auth' WHEN 'windows' THEN 'security' ELSE 'xml_log' END AS service, CASE log_type WHEN 'auth' THEN 'authentication' WHEN 'windows' THEN 'process_creation' ELSE 'application' END AS category FROM found""")
register("r3_false_positives", lambda logs: _auth_findings(logs).select("scope", "rule_name", F.array_join(catalog.false_positives(F.col("rule_name")), "; ").alias("lines")),
         _auth_sql("""SELECT scope, rule_name, CASE rule_name WHEN 'ssh_brute_force_by_ip' THEN 'Legitimate automated systems with many auth attempts; Misconfigured scripts'
 WHEN 'ssh_user_enumeration' THEN 'Developers testing SSH connectivity; Automated deployment tools' WHEN 'ssh_root_login_attempt' THEN 'Legacy systems requiring root SSH access'
 ELSE 'Unknown / Legitimate administrative activity' END AS lines FROM found"""))


def _detections(findings: DataFrame) -> DataFrame:
    return findings.withColumn("d", catalog.detection()).select("scope", "rule_name", F.to_json("d.selection").alias("selection"), "d.condition", "d.timeframe")


_CSV_FOUND = """, found AS (SELECT scope, 'generic_repeated_auth_failures' AS rule_name FROM (SELECT scope, src_ip FROM csv WHERE is_failed_auth GROUP BY ALL HAVING count(*) >= 5) GROUP BY scope
UNION ALL SELECT scope, 'generic_block_deny_surge' FROM (SELECT scope, src_ip FROM csv WHERE is_denied GROUP BY ALL HAVING count(*) >= 10) GROUP BY scope
UNION ALL SELECT scope, 'generic_error_status_spike' FROM (SELECT scope, src_ip FROM csv WHERE is_error_status GROUP BY ALL HAVING count(*) >= 20) GROUP BY scope)"""
register("r4_detection", lambda logs: _detections(detect.detect(logs.csv, rules(["csv"], ids=["d18", "d19", "d20"]))),
         f"WITH {oracle.CSV}{_CSV_FOUND}" + """ SELECT scope, rule_name, CASE rule_name WHEN 'generic_repeated_auth_failures' THEN '{"fields|contains":["fail","failed","denied","unauthorized"]}'
 WHEN 'generic_block_deny_surge' THEN '{"fields|contains":["deny","denied","block","blocked","drop"]}' ELSE '{"fields|contains":["status_code"]}' END AS selection,
 'selection | count() by src_ip > ' || CASE rule_name WHEN 'generic_repeated_auth_failures' THEN 5 WHEN 'generic_block_deny_surge' THEN 10 ELSE 20 END AS condition, '10m' AS timeframe FROM found""")
register("r4_detection_event_ids", lambda logs: _detections(detect.detect(logs.blocks, rules(ids=["d11", "d12"]))),
         f"WITH {oracle.BLOCKS}" + """ SELECT scope, 'windows_brute_force_logon' AS rule_name, '{"EventID":["4625"]}' AS selection, 'selection | count() by SourceAddress > 5' AS condition, '5m' AS timeframe FROM blocks WHERE is_failed_logon GROUP BY scope HAVING count(*) >= 5
UNION ALL SELECT scope, 'windows_suspicious_service_install', '{"EventID":["4697","7045"]}', 'selection', NULL FROM blocks WHERE is_service_install GROUP BY scope""")
_GENERIC_SEARCH = """chr(10) || 'is_' || flagged || '=true' || chr(10) || '| stats count AS ' || named || ' BY src_ip' || chr(10) || '| where ' || named || ' >= ' || t || chr(10) || '| sort -' || named"""
register("r5_splunk_searches", lambda logs: catalog.splunk_searches(detect.detect(logs.csv, rules(["csv"], ids=["d18", "d19", "d20"])), DAY).select("scope", "rule_name", "search", "body"),
         f"WITH {oracle.CSV}{_CSV_FOUND}" + f""", texts AS (SELECT *, CASE rule_name WHEN 'generic_repeated_auth_failures' THEN 'generic_auth_failures' WHEN 'generic_block_deny_surge' THEN 'generic_deny_surge' ELSE 'generic_error_spike' END AS search,
 CASE rule_name WHEN 'generic_repeated_auth_failures' THEN 'failed_auth' WHEN 'generic_block_deny_surge' THEN 'denied' ELSE 'error_status' END AS flagged,
 CASE rule_name WHEN 'generic_repeated_auth_failures' THEN 'failures' WHEN 'generic_block_deny_surge' THEN 'denied_events' ELSE 'errors' END AS named,
 CASE rule_name WHEN 'generic_repeated_auth_failures' THEN 5 WHEN 'generic_block_deny_surge' THEN 10 ELSE 20 END AS t,
 CASE rule_name WHEN 'generic_repeated_auth_failures' THEN 'HIGH' ELSE 'MEDIUM' END AS level, CASE rule_name WHEN 'generic_repeated_auth_failures' THEN 7 ELSE 3 END AS risk,
 CASE rule_name WHEN 'generic_repeated_auth_failures' THEN 'T1110 — Brute Force' WHEN 'generic_block_deny_surge' THEN 'T1595 — Active Scanning' ELSE 'T1595.002 — Active Scanning: Vulnerability Scanning' END AS mitre,
 CASE rule_name WHEN 'generic_repeated_auth_failures' THEN 'Repeated Authentication Failures from Single Source' WHEN 'generic_block_deny_surge' THEN 'High Volume of Denied/Blocked Events from Single Source' ELSE 'High Volume of Error Responses from Single Source' END AS title FROM found)
SELECT scope, rule_name, search, '| *** Vigilake Auto-Generated Splunk Search ***' || chr(10) || '| *** Rule: ' || title || chr(10) || '| *** Severity: ' || level || chr(10) || '| *** MITRE: ' || mitre || chr(10) || '| *** Generated: {DAY}' || chr(10) || chr(10) ||
 'index=* sourcetype=csv_log' || {_GENERIC_SEARCH} || chr(10) || chr(10) || '| *** === Alert Configuration ===' || chr(10) || '| *** Alert Name     : Vigilake - ' || title || chr(10) || '| *** Cron Schedule  : */15 * * * *  (every 15 minutes)' || chr(10) ||
 '| *** Severity       : ' || level || chr(10) || '| *** Risk Score     : ' || risk || '/10' || chr(10) || '| *** MITRE ATT&CK   : ' || mitre || chr(10) || '| *** Throttle       : 1 alert per source per 1 hour' || chr(10) || '| ***' || chr(10) || '| *** To deploy: Splunk > Settings > Searches & Reports > New Report' || chr(10) || '| *** Paste the SPL above and configure the alert trigger.' || chr(10) AS body FROM texts""")
register("r6_formats", lambda logs: catalog.rules_table(_auth_findings(logs), "both", DAY).select("scope", "rule_name", "format", (F.length("body") > 100).alias("filled")),
         _auth_sql("SELECT scope, rule_name, unnest(['sigma', 'splunk']) AS format, true AS filled FROM found"))


def _rules_sink(logs: Logs) -> DataFrame:
    path = shared_path(logs.spark, "rules")
    # as in ``analyze``: the logs are parsed into stored events once, and the rules read those
    columns = ["source_file", "seq", "log_type", "raw", "src_ip", "username", *sorted({r.flag for r in rules(["auth"])})]
    events = written(logs.auth.select(*columns), "auth-events")
    for formats_ in ("sigma", "both"):  # the second run replaces the first
        catalog.write_rules(catalog.rules_table(detect.detect(events, rules(["auth"])), formats_, DAY), path)
    return logs.spark.read.parquet(path).select("scope", "format", "rule_name")


def _events_sink(logs: Logs) -> DataFrame:
    path = shared_path(logs.spark, "events")
    catalog.write_events(logs.auth.unionByName(logs.blocks), path)
    stored = logs.spark.read.parquet(path)
    return stored.filter("log_type = 'windows' and is_kerberoast").select("scope", "seq", "event_id", "raw")


register("r7_rules_sink", _rules_sink, _auth_sql("SELECT scope, rule_name, unnest(['sigma', 'splunk']) AS format FROM found"))
register("r8_events_sink", _events_sink, sql("blocks", "SELECT scope, seq, event_id, raw FROM blocks WHERE is_kerberoast"))


# --------------------------------------------------------------------- windows and streams
def _dense(events: DataFrame) -> DataFrame:
    """Events with time pressed together a hundred times, so that windows fill up."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    seconds = F.unix_timestamp("event_ts") - F.unix_timestamp(start)
    return events.withColumn("event_ts", F.timestamp_seconds(F.unix_timestamp(start) + (seconds / 100).cast("bigint")))


def _alert_columns(df: DataFrame) -> DataFrame:
    return df.select("rule_name", "src_ip", _stamp("window_start").alias("window_start"), _stamp("window_end").alias("window_end"), "hits")


_PRESSED = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(epoch(date_trunc('second', {at}) - TIMESTAMP '2024-01-01 00:00:00') // 100)"


def _windowed(view: str, rule: str, flag_name: str, minutes: int, threshold: int, at: str = "ts") -> str:
    pressed = _PRESSED.format(at=at)
    return sql(view, f"""SELECT '{rule}' AS rule_name, src_ip, strftime(start, '{SQL_STAMP}') AS window_start, strftime(start + INTERVAL {minutes} MINUTE, '{SQL_STAMP}') AS window_end, count(*) AS hits
FROM (SELECT src_ip, time_bucket(INTERVAL {minutes} MINUTE, {pressed}) AS start FROM {view} WHERE {flag_name} AND src_ip IS NOT NULL) GROUP BY src_ip, start HAVING count(*) > {threshold}""")


def _windowed_query(view: str, rule: str, threshold: int | None = None):
    return lambda logs: _alert_columns(alerts.windowed_alerts(_dense(getattr(logs, view)), alerts.selection(rule), rule, threshold=threshold))


register("w1_window_event_ids", _windowed_query("cloud", "event_id_brute_force", 1), _windowed("cloud", "event_id_brute_force", "is_failed_logon", 5, 1))
register("w2_window_auth_failures", _windowed_query("cloud", "repeated_auth_failures", 1), _windowed("cloud", "repeated_auth_failures", "is_failed_auth", 10, 1))
register("w2_window_error_status", _windowed_query("cloud", "error_status_spike", 1), _windowed("cloud", "error_status_spike", "is_error_status", 10, 1))
register("w2_window_denied", lambda logs: alerts.windowed_alerts(logs.csv, alerts.selection("block_deny_surge"), "block_deny_surge", threshold=1).select(
    "src_ip", _stamp("window_start").alias("window_start"), "hits"),
    sql("csv", f"SELECT src_ip, strftime(happened, '{SQL_STAMP}') AS window_start, count(*) AS hits FROM csv WHERE is_denied GROUP BY ALL HAVING count(*) > 1"))
register("w2_window_keywords", lambda logs: _alert_columns(alerts.windowed_alerts(_dense(logs.cloud), alerts.selection("repeated_auth_failures", ["failed"]), "repeated_auth_failures", threshold=1)),
         _windowed("cloud", "repeated_auth_failures", "is_failed_auth", 10, 1))
register("w4_throttle", lambda logs: _alert_columns(alerts.throttle(alerts.windowed_alerts(_dense(logs.cloud), alerts.selection("error_status_spike"), "error_status_spike", threshold=0))),
         "WITH alerts AS (" + _windowed("cloud", "error_status_spike", "is_error_status", 10, 0) + """)
SELECT rule_name, src_ip, min(window_start) AS window_start, arg_min(window_end, window_start) AS window_end, arg_min(hits, window_start) AS hits FROM alerts GROUP BY rule_name, src_ip, window_start[1:13]""")


def _stream(logs: Logs, events: DataFrame, name: str) -> DataFrame:
    """Write events to the shared folder and read them back as a stream of files."""
    path = shared_path(logs.spark, name)
    events.write.parquet(path)
    return logs.spark.readStream.schema(events.schema).parquet(path)


def _drained(logs: Logs, streaming: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there, into a table; update mode keeps the last batch per key."""
    out, checkpoint = shared_path(logs.spark, name), shared_path(logs.spark, f"{name}-state")
    writer = streaming.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).start()
    query.awaitTermination()
    return logs.spark.read.schema(streaming.schema if mode == "append" else streaming.schema.add("batch", T.LongType())).parquet(out)


_NARROW = ["source_file", "seq", "raw", "src_ip", "event_ts", "is_failed_auth", "is_accepted_auth"]


def _stream_windows(logs: Logs) -> DataFrame:
    """W3/W6: file stream, watermark, windows, throttle-free append sink, one run."""
    stream = _stream(logs, _dense(logs.auth).select(*_NARROW), "w3-in")
    found = alerts.windowed_alerts(stream, flag("is_failed_auth"), "repeated_auth_failures", threshold=1, watermark="0 seconds")
    return _alert_columns(_drained(logs, found, "w3-out", "append"))


_LAST = _PRESSED.format(at="ts")
register("w3_w6_stream_windows", _stream_windows,
         sql("auth", f"""SELECT * FROM (SELECT 'repeated_auth_failures' AS rule_name, src_ip, strftime(start, '{SQL_STAMP}') AS window_start, strftime(start + INTERVAL 10 MINUTE, '{SQL_STAMP}') AS window_end, count(*) AS hits
FROM (SELECT src_ip, time_bucket(INTERVAL 10 MINUTE, {_LAST}) AS start FROM auth WHERE is_failed_auth) GROUP BY src_ip, start HAVING count(*) > 1)
WHERE window_end <= (SELECT strftime(max({_LAST}), '{SQL_STAMP}') FROM auth WHERE is_failed_auth)"""))


def _stream_throttle(logs: Logs) -> DataFrame:
    stream = _stream(logs, _dense(logs.auth).select(*_NARROW), "w4-in").filter(flag("is_failed_auth"))
    found = alerts.throttle(stream.withColumn("rule_name", F.lit("repeated_auth_failures")), per="30 days", time="event_ts")
    return _drained(logs, found.select("rule_name", "src_ip"), "w4-out", "append")


register("w4_stream_throttle", _stream_throttle, sql("auth", "SELECT DISTINCT 'repeated_auth_failures' AS rule_name, src_ip FROM auth WHERE is_failed_auth"))


def _stream_counts(logs: Logs) -> DataFrame:
    stream = _stream(logs, logs.auth.select(*_NARROW), "w5-in")
    found = alerts.running_counts(stream, "ssh_brute_force_by_ip", "is_failed_auth", 5)
    return _drained(logs, found, "w5-out", "update").groupBy("rule_name", "source_file", "src_ip").agg(F.max("hits").alias("hits"))


def _stream_success(logs: Logs) -> DataFrame:
    stream = _stream(logs, logs.auth.select(*_NARROW), "w5s-in")
    rows = _drained(logs, alerts.running_success_after_failures(stream), "w5s-out", "update")
    return rows.groupBy("source_file", "src_ip").agg(F.max_by(F.struct("failures", "sample_entry"), "batch").alias("x")).select("source_file", "src_ip", "x.*")


register("w5_stream_counts", _stream_counts,
         sql("auth", "SELECT 'ssh_brute_force_by_ip' AS rule_name, scope AS source_file, src_ip, count(*) AS hits FROM auth WHERE is_failed_auth GROUP BY ALL HAVING count(*) >= 5"))
register("w5_stream_success_after_failures", _stream_success,
         sql("auth", """SELECT scope AS source_file, src_ip, count(*) FILTER (is_failed_auth) AS failures, arg_max(raw, seq) FILTER (is_accepted_auth) AS sample_entry FROM auth WHERE src_ip IS NOT NULL GROUP BY ALL
HAVING max(seq) FILTER (is_accepted_auth) >= min(seq) FILTER (is_failed_auth)"""))

# --- the readers on real files: same results, but for the line numbers ---------------
_ON_FILES = ["src1_text_lines", "src2_auth_events", "src3_web_events", "src4_win_tabular", "src5_win_blocks", "src7_csv_events",
             "src8_json_lines", "src8_json_documents", "src9_xml_events", "src10_windows_event_xml"]
for _name in _ON_FILES:
    register(f"{_name}_files", lambda logs, run=QUERIES[_name]: run(FileLogs(logs.spark, logs.sf_dir)).drop("seq"),
             f"SELECT * EXCLUDE (seq) FROM ({SQL[_name]}) AS t")
register("src7_csv_quoted_breaks_files", lambda logs: QUERIES["src7_csv_events"](QuotedLogs(logs.spark, logs.sf_dir)).drop("seq"),
         f"""SELECT * EXCLUDE (seq) REPLACE (replace(raw, 'a, quoted', 'a,' || chr(10) || 'quoted') AS raw, replace(note, 'a, quoted', 'a,' || chr(10) || 'quoted') AS note)
FROM ({SQL['src7_csv_events']}) AS t""")
register("src13_directory_files", directory_counts, "\nUNION ALL ".join(
    f"SELECT source_file, '{kind}' AS log_type, count(*) AS n FROM ({SQL[name]}) AS t GROUP BY source_file"
    for name, kind in (("src2_auth_events", "auth"), ("src3_web_events", "apache"), ("src4_win_tabular", "windows"), ("src5_win_blocks", "windows"),
                       ("src8_json_lines", "json"), ("src10_windows_event_xml", "xml"))))
register("src12_directory_all_formats", directory_of_all, SQL["src13_directory_files"] + f"""
UNION ALL SELECT source_file, 'xml' AS log_type, count(*) AS n FROM ({SQL['src9_xml_events']}) AS t GROUP BY source_file
UNION ALL SELECT source_file, 'csv' AS log_type, count(*) AS n FROM ({sql('csv', "SELECT scope AS source_file FROM csv WHERE l_linenumber > 3")}) AS t GROUP BY source_file
UNION ALL SELECT 'day-' || strftime(ts, '%Y%m%d') || '.json' AS source_file, 'json' AS log_type, count(*) AS n FROM events GROUP BY 1""")

# --- streams in several micro-batches ------------------------------------------------
for _name, _run in streams.registered(QUERIES, SQL)[0].items():
    register(_name, _run, streams.registered(QUERIES, SQL)[1][_name])

# --- rules and keywords from tables, re-runs per scope --------------------------------
for _name, (_run, _statement) in tables.REGISTERED.items():
    register(_name, _run, _statement)
