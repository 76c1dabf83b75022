"""Registered queries of rules and keywords that come from tables, and of re-runs per scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.operators import keyword_table, table_rules
from vigilake.operators.detect import detect_rule
from vigilake.plans import catalog
from vigilake.session import shared_path, written
from workloads.logs import Logs
from workloads.oracle import sql
from workloads.views import table

SQL_STAMP = "%Y-%m-%d %H:%M:%S"

#: rule_id, rule_name, log_types, predicate, key, window, threshold, severity, technique, and the SQL's view and condition
RULES = [
    ("t1", "failed logins of an address", ["auth"], "is_failed_auth", "src_ip", None, 5, "high", "T1110", "auth", "is_failed_auth"),
    ("t2", "root tried by the hour", ["auth"], "is_root_login and username = 'root'", "src_ip", "1 hour", 1, "high", "T1078", "auth", "is_root_login"),
    ("t3", "sessions of a scope", None, "is_session_opened", None, None, 3, "low", None, "auth", "is_session_opened"),
    ("t4", "errors of a client by the day", ["apache"], "is_4xx or is_5xx", "src_ip", "1 day", 4, "medium", None, "web", "(is_4xx OR is_5xx)"),
    ("t5", "forbidden pages by status", ["apache"], "http_status = 403 and path is not null", "http_status", "6 hours", 1, "low", None, "web", "code = 403"),
    ("t6", "scanners", ["apache"], "is_scanner and not coalesce(is_sqli, false)", "src_ip", None, 2, "medium", "T1595", "web", "is_scanner AND NOT is_sqli"),
]


def rules_from_table(logs: Logs) -> DataFrame:
    """Rules of a stored table over login and web logs, as one aggregate."""
    kinds = ", ".join(f"{c} {k}" for c, k in table_rules.COLUMNS.items())
    stored = written(logs.spark.createDataFrame([r[:9] for r in RULES], kinds), "rule-table")
    events = logs.auth.unionByName(logs.web)
    found = table_rules.detect_table(events, table_rules.load_rules(stored, events))
    return found.select("rule_id", "rule_name", "severity", "scope", "key", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                        F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "hits", "threshold")


def _rule_sql(rule) -> str:
    i, name, _, _, key, window, threshold, severity, _, view, condition = rule
    keyed = {None: "NULL::VARCHAR", "src_ip": "src_ip", "http_status": "code::VARCHAR"}[key]
    start = f"time_bucket(INTERVAL {window}, date_trunc('second', ts))" if window else "NULL::TIMESTAMP"
    end = f"start + INTERVAL {window}" if window else "start"
    return sql(view, f"""SELECT '{i}' AS rule_id, '{name}' AS rule_name, '{severity}' AS severity, scope, key, strftime(start, '{SQL_STAMP}') AS window_start,
 strftime({end}, '{SQL_STAMP}') AS window_end, count(*) AS hits, {threshold} AS threshold
FROM (SELECT scope, {keyed} AS key, {start} AS start FROM {view} WHERE {condition} {'AND ' + keyed + ' IS NOT NULL' if key else ''}) GROUP BY ALL HAVING count(*) >= {threshold}""")


def keywords_from_table(logs: Logs) -> DataFrame:
    """Login lines that name a user of the events table, whatever the case; a rule per user."""
    users = table(logs.spark, logs.sf_dir, "events").select("user_id").distinct()
    words = users.selectExpr("concat('user-', user_id) as rule_id", "explode(array(concat('For U', user_id, ' FROM'), concat('sudo: u', user_id, ' '))) as keyword")
    return keyword_table.keyword_hits(logs.auth, words)


KEYWORDS = sql("auth", """, k AS (SELECT DISTINCT 'user-' || user_id AS rule_id, unnest(['for u' || user_id || ' from', 'sudo: u' || user_id || ' ']) AS keyword FROM events)
SELECT scope AS source_file, seq, rule_id, min(keyword) AS keyword FROM auth JOIN k ON contains(lower(raw), keyword) GROUP BY ALL""")


def fields_from_table(logs: Logs) -> DataFrame:
    """Cloud records in which a field holds a keyword of a rule."""
    rows = [("denied", "Denied"), ("denied", "unauthorized"), ("failed", "FAILED"), ("failed", "failure"), ("console", "consolelogin")]
    words = logs.spark.createDataFrame(rows, "rule_id string, keyword string")
    found = keyword_table.keyword_hits(logs.cloud, words, keyword_table.all_fields())
    return found.groupBy("source_file", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def rerun_scopes(logs: Logs) -> DataFrame:
    """Findings of two runs over different files, then one of them again with another threshold."""
    path = shared_path(logs.spark, "scoped-findings")
    day = F.regexp_extract("source_file", r"(\d\d)\.log$", 1).cast("int")
    events = logs.auth
    for part, threshold in ((0, 1), (1, 1), (0, 4), (1, 1)):
        mine = events.filter(day % 2 == part)
        found = detect_rule(mine, "d1", threshold=threshold).select("scope", "log_type", "rule_name", "severity", "hit_count")
        catalog.replace_scopes(found, path, mine.select(F.col("source_file").alias("scope")))
    return catalog.read_scopes(logs.spark, path)


RERUN = sql("auth", """, n AS (SELECT scope, src_ip, count(*) AS n, CASE WHEN scope[12:13]::INT % 2 = 0 THEN 4 ELSE 1 END AS least FROM auth WHERE is_failed_auth GROUP BY scope, src_ip)
SELECT scope, 'auth' AS log_type, 'ssh_brute_force_by_ip' AS rule_name, 'high' AS severity, sum(n)::BIGINT AS hit_count FROM n WHERE n >= least GROUP BY scope""")

REGISTERED = {
    "d27_rules_from_table": (rules_from_table, "\nUNION ALL ".join(f"SELECT * FROM ({_rule_sql(r)})" for r in RULES)),
    "g1_keywords_from_table": (keywords_from_table, KEYWORDS),
    "g4_fields_from_table": (fields_from_table, sql("cloud", """SELECT source_file, rule_id, count(*) AS n
FROM (SELECT scope AS source_file, unnest(['failed', 'console']) AS rule_id FROM cloud WHERE is_failed_auth) GROUP BY ALL""")),
    "r7_rerun_scopes": (rerun_scopes, RERUN),
}
