"""One scenario per format: files on disk -> events -> findings."""

import pytest

from tests import samples
from vigilake.operators import aggregates
from vigilake.operators.detect import detect_all
from vigilake.plans.analyze import analyze, load_events


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    files = {
        "gate.log": "\n".join(samples.auth()), "access": "\n".join(samples.web()), "sec.txt": "\n".join(samples.windows()),
        "fw.csv": "\n".join(samples.firewall()), "trail.json": samples.cloud(), "win.xml": samples.winevents(),
    }
    for name, content in files.items():
        (root / name).write_text(content + "\n")
    return root


@pytest.fixture(scope="module")
def found(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    rows = analyze(spark, str(folder), str(out), formats="both", default_year=2024).collect()
    return {(r.scope.rsplit("/", 1)[1], r.rule_name): r for r in rows}, out


EXPECTED = {
    "gate.log": {"ssh_brute_force_by_ip": 9, "ssh_user_enumeration": 7, "ssh_root_login_attempt": 3, "ssh_successful_login_after_brute_force": 9},
    "access": {"web_sql_injection_attempt": 2, "web_xss_attempt": 1, "web_path_traversal_attempt": 1, "web_webshell_access": 2,
               "web_scanner_detected": 21, "web_directory_scanning": 20},
    "sec.txt": {"windows_brute_force_logon": 6, "windows_suspicious_service_install": 1, "windows_scheduled_task_created": 1,
                "windows_new_account_created": 1, "windows_privileged_group_modification": 1, "windows_audit_log_cleared": 1,
                "windows_kerberoasting_attempt": 4},
    "fw.csv": {"generic_block_deny_surge": 13},
    "trail.json": {"generic_repeated_auth_failures": 5, "generic_sensitive_action_detected": 10},
    "win.xml": {"xml_windows_brute_force_logon": 5, "xml_windows_audit_log_cleared": 1, "xml_windows_kerberoasting_attempt": 3,
                "xml_windows_privileged_group_modification": 1},
}


@pytest.mark.parametrize("name", EXPECTED)
def test_findings_of_a_format(found, name):
    rows, _ = found
    assert {rule: r.hit_count for (file, rule), r in rows.items() if file == name} == EXPECTED[name]


def test_evidence_and_samples(found):
    rows, _ = found
    brute = rows["gate.log", "ssh_brute_force_by_ip"]
    assert brute.evidence.offending_ips == [samples.ATTACKER]
    assert (brute.evidence.max_attempts, brute.evidence.threshold) == (9, 5)
    assert brute.sample_entry == samples.auth()[1]
    users = rows["gate.log", "ssh_user_enumeration"]
    assert users.evidence.sample_users == ["ada", "invalid", "bob", "cyd", "dan", "eve", "fay"]
    assert users.sample_entry == samples.auth()[0]
    assert rows["sec.txt", "windows_brute_force_logon"].evidence.top_source_ips == {"unknown": 6}
    assert rows["access", "web_directory_scanning"].sample_entry == samples.ATTACKER
    assert rows["access", "web_scanner_detected"].evidence.scanner_uas == ["sqlmap/9"]
    cloud = rows["trail.json", "generic_sensitive_action_detected"]
    assert cloud.evidence.action_counts["ConsoleLogin"] == 6
    assert cloud.keywords == ["ConsoleLogin", "CreateUser", "AttachUserPolicy", "CreateAccessKey", "StopLogging"]


def test_sinks(spark, found):
    rows, out = found
    stored = spark.read.parquet(f"{out}/rules")
    assert stored.count() == 2 * len(rows)
    body = stored.filter("format = 'splunk' and rule_name = 'windows_audit_log_cleared'").first().body
    assert "EventCode=1102" in body and "Risk Score     : 10/10" in body
    assert {r.log_type for r in spark.read.parquet(f"{out}/events").select("log_type").distinct().collect()} == {
        "auth", "apache", "windows", "csv", "json", "xml"}


def test_severity_threshold(spark, folder):
    kept = analyze(spark, str(folder / "gate.log"), severity="critical", default_year=2024).collect()
    assert [r.rule_name for r in kept] == ["ssh_successful_login_after_brute_force"]


def test_later_key_wins(spark, folder):
    events = load_events(spark, str(folder / "trail.json"))
    assert events.filter("action = 'CreateUser'").first().username == "hidden"


def test_flags_without_finding(spark, folder):
    web = load_events(spark, str(folder / "access"))
    assert aggregates.web_exposure(web).first()[1:] == (0, 0, 0)
    windows = load_events(spark, str(folder / "sec.txt"))
    assert aggregates.privileged_logons(windows).first().privileged_logons == 1
    assert detect_all(windows).filter("rule_name like '%privileged_logon%'").count() == 0
