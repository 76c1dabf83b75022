"""A cross-section of the registered queries against their SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as registered
from check import TABLES

DATA = "/root/testdata/sf0.001"
CHOSEN = ["src2_auth_events", "src3_web_events", "src5_win_blocks", "src7_csv_events", "src8_json_documents", "src9_xml_events",
          "d2_ssh_user_enumeration", "d4_ssh_success_after_failures", "d9_web_scanner_detected", "d11_windows_brute_force_logon",
          "d21_generic_sensitive_action", "q5_hunt_sqli", "w1_window_event_ids"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    df = registered.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = Counter(tuple(r[c] for c in columns) for r in df.collect())
    result = con.execute(registered.oracle_sql()[name])
    place = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(place) == columns
    assert ours == Counter(tuple(r[place[c]] for c in columns) for r in result.fetchall())


def test_every_query_has_sql():
    """All but the training-text queries that SQL cannot express, each of which names its plain version."""
    without = set(registered.llm.NO_SQL) if registered.llm else set()
    assert set(registered.oracle_sql()) == set(registered.queries()) - without
    assert without <= set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).count() > 0
