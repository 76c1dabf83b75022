"""Every row of a table of turns goes through the layouts."""

import json

from vigilake.llm import chat, queries


def test_turns_have_a_layout(spark):
    rows = [(1, 0, "user", 'a "b"\n\\u0041 é'), (1, 1, "human", None), (1, None, None, ""), (None, 70, "assistant", "{}"), (1, 0, "user", 'a "b"\n\\u0041 é')]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    # a larger record with fields of the same name keeps its own layout
    said = json.dumps({"messages": [{"role": "human", "content": "x"}, {"role": "gpt", "content": "y"}]})
    extra = spark.createDataFrame([(2, 9, said)], "conv_id long, turn long, record string")
    out = chat.canonical(chat.turn_records(table).union(extra), layouts=(*chat.LAYOUTS, chat.TURN), turn_col="turn").collect()
    want = [(c, t, r or "", x or "", "turn") for c, t, r, x in rows] + [(2, 0, "user", "x", "messages"), (2, 1, "assistant", "y", "messages")]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_query_maps_every_row(spark, monkeypatch):
    seen = []
    formatted = chat.formatted
    monkeypatch.setattr(chat, "formatted", lambda rows: seen.append(rows) or formatted(rows))
    sf = "/root/testdata/sf0.001"
    queries.op7_chat_formatting(spark, sf)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    rows = queries.table(spark, sf, "conversations")
    assert seen[0].count() == rows.count() + 2
    # nothing of the table comes in beside the mapping
    assert plan.lstrip().startswith(("MapInPandas", "Project")) and plan.index("MapInPandas") < plan.index("Union")
