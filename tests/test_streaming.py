"""Streams give what the batch folds give."""

import pytest
from pyspark.sql import functions as F

from isoline.operators import sequence as Q
from isoline.sources.tables import samples
from isoline.streaming import stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fed(spark, tmp_path_factory):
    """A stream of each user's events, cut into three files by time."""
    d = tmp_path_factory.mktemp("stream")
    rows = samples(spark, SF).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "t", "value", "event_type").orderBy("t", "id").toPandas()
    third = len(rows) // 3 + 1
    for i in range(3):
        rows.iloc[i * third : (i + 1) * third].to_parquet(f"{d}/part{i}.parquet")
    schema = "key long, id long, t double, value double, event_type string"
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(d))


def ran(df, tmp_path):
    return stateful.run_once(df, str(tmp_path / "out"), str(tmp_path / "checkpoint"))


def same(a, b, value):
    got = {r.id: r[value] for r in a.collect()}
    want = {r[0]: r[1] for r in b.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_one_euro(spark, fed, tmp_path):
    batch = Q.one_euro(samples(spark, SF), "user_id", "value", "t", "event_id").select("event_id", "smooth")
    same(ran(stateful.one_euro(fed().drop("event_type")), tmp_path), batch, "smooth")


def test_presence(spark, fed, tmp_path):
    hit = F.col("event_type").isin("click", "view")
    batch = Q.presence(samples(spark, SF).withColumn("hit", hit), "user_id", "hit", ["t", "event_id"], 0.34, 0.16).select("event_id", "presence")
    stream = fed().withColumn("value", F.when(hit, 1.0).otherwise(0.0)).drop("event_type")
    same(ran(stateful.presence(stream), tmp_path), batch, "presence")


def test_rolling(spark, fed, tmp_path):
    batch = Q.rolling(samples(spark, SF), "user_id", "value").select("event_id", "rms")
    same(ran(stateful.rolling(fed().drop("event_type")), tmp_path), batch, "rms")


def test_windows_leave_late_rows_out(spark, fed, tmp_path):
    stream = fed().select(F.col("event_type").alias("name"), F.timestamp_seconds("t").alias("ts"), "value")
    got = ran(stateful.windowed_metrics(stream), tmp_path)
    rows = samples(spark, SF).select(F.col("event_type").alias("name"), F.timestamp_seconds("t").alias("ts"), "value")
    want = {(r.start, r.name): r.n for r in rows.groupBy(F.window("ts", "1 hour").start.alias("start"), "name").agg(F.count("*").alias("n")).collect()}
    seen = {(r.start, r.name): r.n for r in got.collect()}
    assert seen and all(want[k] == n for k, n in seen.items())
    assert len(want) - len(seen) <= 10  # the last windows stay open
