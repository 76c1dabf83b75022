"""Hunting queries over events, one per search kind.

Keyed counts leave out records without the key. ``time`` is ``event_ts``; tables list
the newest record first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake import fixed
from vigilake.functions import text
from vigilake.operators.selections import uri_path, uri_query

IPV4 = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"


def _raw_group(pattern: str, group: int = 1) -> Column:
    return text.absent_if_empty(F.regexp_extract("raw", pattern, group))


def _counted(rows: DataFrame, keys: list[str], name: str, at_least: int = 1) -> DataFrame:
    keyed = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return keyed.filter(F.col(name) >= at_least).orderBy(F.desc(name))


def _newest(rows: DataFrame, **columns: Column) -> DataFrame:
    table = rows.select(F.col("event_ts").alias("time"), *[c.alias(n) for n, c in columns.items()])
    # a sort samples its input by running it: without a shuffle in between all logs would be parsed twice
    return table.hint("rebalance").orderBy(F.desc("time"))


def _raw_holds(*words: str) -> Column:
    return text.contains_any(F.lower("raw"), [w.lower() for w in words])


# ------------------------------------------------------------------ system logins
def hunt_ssh_brute_force(events: DataFrame, threshold: int = 5) -> DataFrame:
    hits = events.filter(_raw_holds("Failed password", "Failed publickey")).withColumn("src_ip", _raw_group("from " + IPV4))
    counted = _counted(hits, ["src_ip"], "failure_count", threshold)
    return counted.withColumn("risk_score", text.risk_tier(F.col("failure_count"))).withColumnsRenamed(
        {"src_ip": "Source IP", "failure_count": "Failed Attempts"}
    )


def hunt_user_enumeration(events: DataFrame, threshold: int = 5) -> DataFrame:
    pattern = r"Invalid user (\S+) from (\S+)"
    hits = events.filter(_raw_holds("Invalid user")).select(
        _raw_group(pattern, 1).alias("invalid_user"), _raw_group(pattern, 2).alias("src_ip")
    ).dropna(subset=["src_ip"])
    return hits.groupBy("src_ip").agg(
        F.count_distinct("invalid_user").alias("distinct_users"), F.count(F.lit(1)).alias("count")
    ).filter(F.col("distinct_users") >= threshold).orderBy(F.desc("distinct_users"))


def hunt_root_logins(events: DataFrame) -> DataFrame:
    hits = events.filter(_raw_holds("Failed password for root", "Failed password for invalid user root"))
    return _counted(hits.withColumn("src_ip", _raw_group(r"from (\S+) port")), ["src_ip"], "attempts")


def hunt_failed_and_accepted(events: DataFrame) -> DataFrame:
    """Addresses with failed and accepted logins, in whatever order."""
    result = _raw_group(r"(Failed|Accepted) (password|publickey)")
    rows = events.select(_raw_group(r"from (\S+)").alias("src_ip"), result.alias("result")).dropna()
    both = rows.groupBy("src_ip").agg(
        F.bool_or(F.col("result") == "Failed").alias("failed"), F.bool_or(F.col("result") == "Accepted").alias("accepted")
    ).filter("failed and accepted")
    return both.select(
        "src_ip", F.array(F.lit("Accepted"), F.lit("Failed")).alias("results"),
        F.lit("Successful login after failures - possible brute force success").alias("message"),
    )


# ------------------------------------------------------------------ web access
def _web(events: DataFrame) -> DataFrame:
    return events.withColumns({
        "src_ip": _raw_group(IPV4), "uri_path": uri_path(F.col("target")), "uri_query": uri_query(F.col("target")),
    })


def _holds(column: str, words: list[str]) -> Column:
    return text.contains_any(F.lower(column), words)


def hunt_sql_injection(events: DataFrame) -> DataFrame:
    query = F.lower("uri_query")
    patterns = [query.rlike(r"(?s)" + ".*".join(map(_quoted, words))) for words in fixed.HUNT_SQLI_QUERY]
    hit = _holds("uri_path", fixed.HUNT_SQLI_PATH)
    for p in patterns:
        hit = hit | F.coalesce(p, F.lit(False))
    hits = _web(events).filter(hit).withColumn("time", F.col("event_ts"))
    return _counted(hits, ["src_ip", "uri_path", "time"], "count")


def _quoted(words: str) -> str:
    return r"\Q" + words + r"\E"


def hunt_xss(events: DataFrame) -> DataFrame:
    hits = _web(events).filter(_holds("uri_query", fixed.HUNT_XSS_QUERY))
    return hits.dropna(subset=["src_ip"]).groupBy("src_ip", "uri_path").agg(F.count(F.lit(1)).alias("count"))


def hunt_path_traversal(events: DataFrame) -> DataFrame:
    hits = _web(events).filter(_holds("uri_path", fixed.HUNT_TRAVERSAL_PATH))
    keyed = hits.dropna(subset=["src_ip", "http_status"]).filter("http_status <> 404")
    return keyed.groupBy("src_ip", "uri_path", F.col("http_status").alias("status")).agg(F.count(F.lit(1)).alias("count"))


def hunt_webshell(events: DataFrame) -> DataFrame:
    hits = _web(events).filter(_holds("uri_path", fixed.HUNT_WEBSHELL_PATH))
    return _newest(hits, src_ip=F.col("src_ip"), uri_path=F.col("uri_path"), status=F.col("http_status"), http_user_agent=F.col("useragent"))


def hunt_scanner(events: DataFrame) -> DataFrame:
    hits = _web(events).filter(_holds("useragent", fixed.HUNT_SCANNER_AGENTS))
    return hits.dropna(subset=["src_ip"]).groupBy("src_ip", F.col("useragent").alias("http_user_agent")).agg(
        F.count(F.lit(1)).alias("count")
    )


def hunt_enumeration(events: DataFrame, threshold: int = 20) -> DataFrame:
    """Only 404 counts here, unlike the detection, which takes every 4xx."""
    counted = _counted(_web(events).filter("http_status = 404"), ["src_ip"], "error_count", threshold)
    return counted.withColumn("risk", F.lit("Possible directory enumeration"))


# ------------------------------------------------------------------ Windows
def _ids(events: DataFrame, event_ids: list[int]) -> DataFrame:
    return events.filter(F.col("event_id").isin(event_ids))


_ACCOUNT = r"(?i)Account Name:\s+(\S+)"


def hunt_windows_brute_force(events: DataFrame, threshold: int = 5, event_ids=(4625,)) -> DataFrame:
    rows = _ids(events, list(event_ids)).select(
        _raw_group(r"(?i)Source Network Address:\s+(\S+)").alias("src_ip"), _raw_group(_ACCOUNT).alias("username")
    )
    return _counted(rows, ["src_ip", "username"], "failures", threshold)


def hunt_log_cleared(events: DataFrame) -> DataFrame:
    return _newest(_ids(events, [1102]), host=F.col("host"), user=F.col("username"), message=F.col("message"))


def hunt_kerberoast(events: DataFrame, threshold: int = 3) -> DataFrame:
    """Different services per account, unlike the detection, which counts tickets."""
    rows = _ids(events, [4769]).select(
        _raw_group(_ACCOUNT).alias("username"), _raw_group(r"(?i)Service Name:\s+(\S+)").alias("service")
    ).dropna(subset=["username"])
    return rows.groupBy("username").agg(F.count_distinct("service").alias("service_count")).filter(
        F.col("service_count") >= threshold
    ).withColumn("alert", F.lit("Possible Kerberoasting"))


def hunt_windows_events(events: DataFrame, event_ids: list[int]) -> DataFrame:
    return _newest(_ids(events, event_ids), host=F.col("host"), user=F.col("username"),
                   event_code=F.col("event_id"), message=F.col("message"))


# ------------------------------------------------------------------ structured logs
def hunt_event_brute_force(events: DataFrame, threshold: int = 5, event_ids=(4625,)) -> DataFrame:
    return _counted(_ids(events, list(event_ids)), ["src_ip"], "failures", threshold)


def hunt_event_table(events: DataFrame, event_ids: list[int]) -> DataFrame:
    return _newest(_ids(events, event_ids), host=F.col("host"), src_ip=F.col("src_ip"), username=F.col("username"),
                   event_id=F.col("event_id"), message=F.col("message"))


def hunt_auth_failures(events: DataFrame, threshold: int = 5) -> DataFrame:
    return _counted(events.filter("is_failed_auth"), ["src_ip"], "failures", threshold)


def hunt_denied(events: DataFrame, threshold: int = 10) -> DataFrame:
    return _counted(events.filter("is_denied"), ["src_ip"], "denied_events", threshold)


def hunt_error_status(events: DataFrame, threshold: int = 20) -> DataFrame:
    return _counted(events.filter("is_error_status"), ["src_ip"], "errors", threshold)


def hunt_sensitive_actions(events: DataFrame) -> DataFrame:
    return _newest(events.filter("is_sensitive_action"), host=F.col("host"), username=F.col("username"),
                   action=F.col("action"), src_ip=F.col("src_ip"))


def hunt_table(events: DataFrame) -> DataFrame:
    return _newest(events, host=F.col("host"), src_ip=F.col("src_ip"), username=F.col("username"),
                   action=F.col("action"), message=F.col("message"))


def hunt_text(events: DataFrame, words: str) -> DataFrame:
    """Records whose text holds the words, newest first."""
    return _newest(events.filter(_raw_holds(words)), host=F.col("host"), user=F.col("username"), raw=F.col("raw"))
