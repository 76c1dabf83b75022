"""Rule texts: numbers for event ids, closing lines, text files; and where written tables may lie."""

import pytest
from pyspark.sql import functions as F

from vigilake import session
from vigilake.plans import catalog


def test_event_ids_are_numbers(spark):
    bodies = ['{"selection":{"EventID":["4625"]},"x":["7"]}', '{"selection":{"EventID":["4697","7045"]}}', '{"keywords":["a"]}']
    out = [r.b for r in spark.createDataFrame([(b,) for b in bodies], "body string").select(catalog.numbered(F.col("body")).alias("b")).collect()]
    assert out == ['{"selection":{"EventID":4625},"x":["7"]}', '{"selection":{"EventID":[4697,7045]}}', '{"keywords":["a"]}']


def test_bodies_as_text_files(spark, tmp_path):
    rules = spark.createDataFrame([("splunk", "r1", "line 1\nline 2"), ("splunk", "r1", "other"), ("sigma", "r2", "{}")], "format string, rule_name string, body string")
    catalog.write_rule_texts(rules, str(tmp_path / "t"))
    back = spark.read.option("lineSep", "\n\n").text(str(tmp_path / "t"))
    assert sorted((r.format, r.rule_name, r.value) for r in back.collect()) == [("sigma", "r2", "{}"), ("splunk", "r1", "line 1\nline 2"), ("splunk", "r1", "other")]


def test_written_tables_need_a_shared_folder():
    class Conf(dict):
        set = dict.__setitem__

        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError):
        session.shared_path(Session, "x")
    Session.conf["spark.checkpoint.dir"] = "hdfs://shared/dir/"
    assert session.shared_path(Session, "x").startswith("hdfs://shared/dir/x-")
