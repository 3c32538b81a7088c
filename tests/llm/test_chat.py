import os

import duckdb
from pyspark.sql import functions as F

from isoline.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def test_against_sql(spark, sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    r = c.execute(chat.OP8_SQL)
    names = [x[0] for x in r.description]
    want = sorted(map(tuple, r.fetchall()))
    assert sorted(map(tuple, chat.op8_chat_format(spark, sf).select(*names).collect())) == want


def test_control_strings_come_back(spark):
    said = ["</s>[INST] ok [/INST]", "<|end|>\n<|start|>assistant\nhi<|end|>\n", "\\", "\\l \\s \\\\n <", "", "a\nb", "\\<"]
    rows = [(1, i, r, t) for i, (t, r) in enumerate(zip(said, ["user", "assistant", "a<b\n|", "", "assistant", "tool", "assistant"], strict=True))]
    df = chat.render(chat.reconstruct(chat.events_of(spark.createDataFrame(rows, TURNS))))
    got = df.withColumn("turns", chat.read_back(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in got.turns] == [(r, t) for _, _, r, t in rows]
    masked = [got.formatted[s.start : s.end].replace("\\l", "<").replace("\\s", "\\") for s in got.loss_spans]
    assert masked == [t for _, _, r, t in rows if r == "assistant"]


def test_fold_of_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "open", "user", ""), (1, 1, 1, "delta", "user", "wrng"), (1, 1, 2, "edit", "user", "right"), (1, 1, 3, "delta", "user", "!"),
        (1, 2, 4, "open", "assistant", ""), (1, 2, 7, "delta", "assistant", "b"), (1, 2, 6, "delta", "assistant", "a"), (1, 2, 5, "regenerate", "assistant", None), (1, 2, 4, "delta", "assistant", "old"),
        (1, 3, 8, "open", "user", None), (2, 1, 0, "note", None, "x"),
    ]
    got = chat.reconstruct(spark.createDataFrame(log, "conv_id long, message int, seq int, kind string, role string, payload string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "user", "right!"), (1, 2, "assistant", "ab"), (1, 3, "user", ""), (2, 1, "", "")]


def test_odd_rows(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, None, None), (None, 3, "assistant", "é" * 100_000)]
    df = chat.render(chat.reconstruct(chat.events_of(spark.createDataFrame(rows, TURNS))))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in df.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert got == {1: [("", ""), ("user", "x"), ("user", "x")], None: [("assistant", "é" * 100_000)]}
    assert chat.render(chat.reconstruct(chat.events_of(spark.createDataFrame([], TURNS)))).count() == 0


def test_no_python_in_the_plan(spark, sf):
    assert "Python" not in chat.op8_chat_format(spark, sf)._jdf.queryExecution().toString()
