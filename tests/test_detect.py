"""Thresholds, order of events, ties, evidence lists and rule texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import samples
from vigilake.operators import hunts, ranking
from vigilake.operators.detect import detect, detect_all, detect_rule, success_after_failures
from vigilake.operators.rules import RULES, rules
from vigilake.plans import catalog
from vigilake.sources.auth import auth_events
from vigilake.sources.delimited import csv_events
from vigilake.sources.web import web_events


def fail(ip, user="u"):
    return f"Feb  3 04:00:00 h sshd[1]: Failed password for {user} from {ip} port 1 ssh2"


def accept(ip):
    return f"Feb  3 04:00:00 h sshd[1]: Accepted password for u from {ip} port 1 ssh2"


@pytest.mark.parametrize("n, fires", [(4, False), (5, True)])
def test_threshold(lines, n, fires):
    events = auth_events(lines(*[fail("1.1.1.1")] * n), 2024)
    assert (detect_rule(events, "d1").count() == 1) is fires


def test_threshold_is_a_setting(lines):
    events = auth_events(lines(fail("1.1.1.1"), fail("1.1.1.1")), 2024)
    row = detect_rule(events, "d1", threshold=2).first()
    assert (row.hit_count, row.evidence.threshold) == (2, 2)


@pytest.mark.parametrize("n, fires", [(19, False), (20, True)])
def test_error_spike(lines, n, fires):
    events = csv_events(lines("ip,status_code", *["9.9.9.9,HTTP 500"] * n))
    assert ("generic_error_status_spike" in {r.rule_name for r in detect_all(events).collect()}) is fires


def test_scopes_are_judged_apart(lines):
    both = lines(*[fail("1.1.1.1")] * 3).unionByName(lines(*[fail("1.1.1.1")] * 3, source_file="g.log"))
    events = auth_events(both, 2024)
    assert detect_rule(events, "d1").count() == 0
    assert detect_rule(events.withColumn("all", F.lit("x")), "d1", scope="all").first().hit_count == 6


def test_success_before_any_failure_does_not_count(lines):
    assert detect_rule(auth_events(lines(accept("1.1.1.1"), fail("1.1.1.1")), 2024), "d4").count() == 0


def test_earliest_success_after_failure_wins(lines):
    a, b = "1.1.1.1", "2.2.2.2"
    # b failed first, but a's success after a failure comes first; a also logged in before
    events = auth_events(lines(accept(a), fail(b), fail(a), accept(a), accept(b), accept(a), fail(a)), 2024)
    row = detect_rule(events, "d4").first()
    assert (row.evidence.src_ip, row.hit_count) == (a, 2)
    first = {r.src_ip: r.first_success for r in success_after_failures(events.withColumn("scope", F.lit("s"))).collect()}
    assert first == {a: 3, b: 4}


def test_random_logs_against_plain_python(spark, lines):
    rng = random.Random(7)
    addresses = [f"10.0.0.{n}" for n in range(6)]
    log = [(rng.choice([fail, accept]), rng.choice(addresses)) for _ in range(200)]
    events = auth_events(lines(*[f(ip) for f, ip in log]), 2024)
    failures, after = {}, {}
    for f, ip in log:
        if f is fail:
            failures.setdefault(ip, []).append(ip)
        elif ip in failures:
            after.setdefault(ip, None)
    expected = next(iter(after))
    row = detect_rule(events, "d4").first()
    assert (row.evidence.src_ip, row.hit_count) == (expected, len(failures[expected]))
    brute = detect_rule(events, "d1").first()
    over = {ip: len(v) for ip, v in failures.items() if len(v) >= 5}
    assert brute.evidence.offending_ips == list(over)[:5]
    assert (brute.hit_count, brute.evidence.max_attempts) == (sum(over.values()), max(over.values()))
    top = ranking.top_k(events, "source_file", "src_ip", 3).orderBy("rank").collect()
    assert [(r.src_ip, r.n) for r in top] == Counter(ip for _, ip in log).most_common(3)


def test_ties_go_to_the_first_seen(lines):
    events = auth_events(lines(*[fail("2.2.2.2"), fail("1.1.1.1")] * 5), 2024)
    row = detect_rule(events, "d1").first()
    assert row.sample_entry == fail("2.2.2.2") and row.evidence.offending_ips == ["2.2.2.2", "1.1.1.1"]


def test_many_addresses_in_one_scope(lines):
    """Evidence lists stay first-seen although they are built in salted parts."""
    names = [f"10.{n // 250}.{n % 250}.1" for n in range(400)]
    events = auth_events(lines(*[fail(ip) for ip in names for _ in range(5)]), 2024)
    row = detect_rule(events, "d1").first()
    assert row.evidence.offending_ips == names[:5] and row.hit_count == 2000


def test_look_alikes_stay_different(lines):
    ip = "1.1.1.1"
    unordered = auth_events(lines(accept(ip), fail(ip)), 2024)
    assert hunts.hunt_failed_and_accepted(unordered).count() == 1 and detect_rule(unordered, "d4").count() == 0
    denied = web_events(lines(*[f'{ip} - - [03/Feb/2024:04:00:00 +0000] "GET / HTTP/1.1" 403 1'] * 20))
    assert detect_rule(denied, "d10").count() == 1 and hunts.hunt_enumeration(denied).count() == 0


def test_every_rule_has_a_text():
    assert len(RULES) == 26 and all(r.title and r.severity for r in RULES)
    assert [r.id for r in RULES] == [f"d{n}" for n in range(1, 27)]


def test_rule_bodies(spark, lines):
    found = detect(auth_events(lines(*samples.auth()), 2024), rules(["auth"]))
    rule = {r.rule_name: r.rule for r in catalog.sigma_rules(found, "2024-02-03").collect()}["ssh_brute_force_by_ip"]
    assert rule.references[0] == "https://attack.mitre.org/techniques/T1110/001"
    assert rule.tags == ["attack.t1110", "attack.t1110.001"] and rule.detection.condition == "keywords"
    assert rule.detection.selection == {"keywords": ["Failed password", "Failed publickey"]}
    assert len(rule.id) == 36 and rule.date == "2024-02-03"
    body = {r.rule_name: r.body for r in catalog.splunk_searches(found, "2024-02-03").collect()}
    assert "| where failure_count >= 5" in body["ssh_brute_force_by_ip"]
    assert "mvfind" in body["ssh_successful_login_after_brute_force"]
    assert catalog.rules_table(found, "sigma").count() == 4 and catalog.rules_table(found, "both").count() == 8


def test_findings_are_sorted_by_severity(lines):
    found = detect(auth_events(lines(*samples.auth()), 2024), rules(["auth"]))
    ordered = [r.severity for r in ranking.order_findings(found).collect()]
    assert ordered == ["critical", "high", "high", "medium"]
