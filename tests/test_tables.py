"""Rules and keywords from tables, and tables that keep the scopes a run did not read."""

import datetime
import random

import pytest

from vigilake.operators import keyword_table, table_rules
from vigilake.plans import catalog
from vigilake.session import shared_path
from vigilake.sources.auth import auth_events
from tests import samples

KINDS = ", ".join(f"{c} {k}" for c, k in table_rules.COLUMNS.items())
GOOD = ("a", "many", ["auth"], "is_failed_auth", "src_ip", "10 minutes", 2, "high", "T1110")


@pytest.fixture
def events(spark, lines):
    return auth_events(lines(*samples.auth()), 2024)


def loaded(spark, events, *rows):
    return table_rules.load_rules(spark.createDataFrame([tuple(r) for r in rows], KINDS), events)


def test_rules_count_by_key_and_window(spark, events):
    rules = loaded(spark, events, GOOD, ("b", "all", None, "is_failed_auth or is_sudo", None, None, 1, "low", None),
                   ("c", "none", ["apache"], "true", None, None, 1, "low", None), ("d", "null", None, "is_4xx", None, None, 1, "low", None))
    found = table_rules.detect_table(events, rules).collect()
    rows = [r for r in events.select("src_ip", "event_ts", "is_failed_auth", "is_sudo", "seq").collect()]
    per = {}
    for r in rows:
        if r.is_failed_auth and r.src_ip:
            start = r.event_ts.replace(minute=r.event_ts.minute // 10 * 10, second=0)
            per.setdefault((r.src_ip, start), []).append(r.seq)
    assert {(r.key, r.window_start, r.hits, r.first_seq) for r in found if r.rule_id == "a"} == {
        (ip, start, len(s), min(s)) for (ip, start), s in per.items() if len(s) >= 2} != set()
    assert all(r.window_end - r.window_start == datetime.timedelta(minutes=10) for r in found if r.rule_id == "a")
    assert [(r.key, r.hits, r.window_start) for r in found if r.rule_id == "b"] == [(None, sum(bool(r.is_failed_auth or r.is_sudo) for r in rows), None)]
    assert {r.rule_id for r in found} == {"a", "b"}
    assert table_rules.detect_table(events.limit(0), rules).collect() == []


@pytest.mark.parametrize("place, value, said", [
    (0, "", "rule_id"), (1, None, "rule_name"), (3, "no_such_column = 1", "predicate"), (3, "src_ip", "not a condition"), (3, "rand() < 0.5", "run to run"),
    (3, "count(1) > 2", "predicate"), (3, "src_ip in (select 1)", "more than an expression"), (3, None, "predicate"), (3, "is_sudo and", "predicate"),
    (4, "fields", "key"), (4, "nothing", "key"), (5, "soon", "window"), (5, "0 hours", "window"), (6, 0, "threshold"), (6, None, "threshold"), (7, "dire", "severity")])
def test_faulty_rules_are_named(spark, events, place, value, said):
    row = list(GOOD)
    row[place] = value
    with pytest.raises(ValueError, match=said):
        loaded(spark, events, GOOD, row if place == 0 else ["z" if n == 0 else v for n, v in enumerate(row)])


def test_rule_tables(spark, events):
    with pytest.raises(ValueError, match="twice"):
        loaded(spark, events, GOOD, GOOD)
    with pytest.raises(ValueError, match="missing"):
        table_rules.load_rules(spark.createDataFrame([("a",)], "rule_id string"), events)
    assert loaded(spark, events, ("q", "quoted", None, "message = 'select; --' or message = ''", None, None, 1, "low", None))[0].key is None


def test_keywords(spark, monkeypatch):
    rng = random.Random(3)
    words = ["Fail", "failed pass", "ÄRGER", "x", "sudo", "a\x01b", "", None]
    rows = [(f"f{n % 3}", n, rng.choice([None, ""]) if n % 11 == 0 else " ".join(rng.choice(["FAILED", "password", "ärger", "Sudo", "x1", "-"]) for _ in range(4))) for n in range(80)]
    pairs = [(f"r{n % 3}", w) for n, w in enumerate(words)] + [("r9", "fail"), ("r0", "Fail"), (None, "sudo")]
    events = spark.createDataFrame(rows, "source_file string, seq long, raw string").repartition(3)
    table = spark.createDataFrame(pairs, "rule_id string, keyword string")
    want = set()
    for f, n, text in rows:
        for rule in {r for r, _ in pairs if r}:
            hit = sorted(w.lower() for r, w in pairs if r == rule and w and "\x01" not in w and w.lower() in (text or "").lower())
            if hit:
                want.add((f, n, rule, hit[0]))
    for block in (4_000_000, 12):
        monkeypatch.setattr(keyword_table, "BLOCK_CHARS", block)
        got = keyword_table.keyword_hits(events, table).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert keyword_table.keyword_hits(events, table.limit(0)).collect() == []
    fields = spark.createDataFrame([("f", 1, {"a": "left", "b": "right"}), ("f", 2, None)], "source_file string, seq long, fields map<string,string>")
    hits = keyword_table.keyword_hits(fields, spark.createDataFrame([("r", "tri"), ("r", "IGHT"), ("s", "ft")], "rule_id string, keyword string"), keyword_table.all_fields())
    assert {tuple(r) for r in hits.collect()} == {("f", 1, "r", "ight"), ("f", 1, "s", "ft")}


def test_runs_replace_their_own_scopes(spark):
    path = shared_path(spark, "scopes")

    def run(rows, *scopes):
        found = spark.createDataFrame(rows, "scope string, log_type string, n int")
        catalog.replace_scopes(found, path, spark.createDataFrame([(s,) for s in scopes], "scope string"), buckets=3)
        return sorted(((r.scope, r.log_type, r.n) for r in catalog.read_scopes(spark, path, found.schema).collect()), key=str)

    assert run([(f"s{n}", "auth", 1) for n in range(9)], *[f"s{n}" for n in range(9)]) == [(f"s{n}", "auth", 1) for n in range(9)]
    assert run([("t", "csv", 5)], "t") == [(f"s{n}", "auth", 1) for n in range(9)] + [("t", "csv", 5)]
    # one scope changes its type, one has nothing any more; the others stay
    want = [("s0", "a=b/c", 2)] + [(f"s{n}", "auth", 1) for n in range(2, 9)] + [("t", "csv", 5)]
    assert run([("s0", "a=b/c", 2)], "s0", "s1") == want
    assert run([("s0", "a=b/c", 2)], "s0", "s1") == want
    assert run([], *[f"s{n}" for n in range(9)], "t") == []
    assert run([("u", None, 7)], "u") == [("u", None, 7)]


def test_analyze_keeps_what_it_did_not_read(spark, tmp_path):
    from vigilake.plans.analyze import analyze

    out = str(tmp_path / "out")
    for name, rows in (("a.log", samples.auth()), ("b.log", samples.auth())):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    for name, thresholds in (("a.log", None), ("b.log", None), ("a.log", {"d1": 10 ** 6, "d2": 10 ** 6})):
        analyze(spark, str(tmp_path / name), out, scoped=True, thresholds=thresholds, default_year=2024)
    found = {}
    for r in catalog.read_scopes(spark, f"{out}/findings").collect():
        found.setdefault(r.scope[-5:], set()).add(r.rule_name)
    assert found["a.log"] == found["b.log"] - {"ssh_brute_force_by_ip", "ssh_user_enumeration"} != found["b.log"]
    assert {r.scope[-5:] for r in catalog.read_scopes(spark, f"{out}/events").select("scope").distinct().collect()} == {"a.log", "b.log"}
    assert catalog.read_scopes(spark, f"{out}/rules").count() == sum(map(len, found.values()))
