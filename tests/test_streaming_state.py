"""State of a stream over restarts against one batch over everything."""

import pytest
from pyspark.sql import functions as F

from foldsmith.plans.curves import status_latest
from foldsmith.session import table
from foldsmith.streaming import events, state

SF = "/root/testdata/sf0.001"


def updates(df):
    return df.select(F.concat_ws("/", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("tie"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))


def test_three_restarts_equal_one_batch(spark, tmp_path):
    e = table(spark, SF, "events")
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in (2, 0, 1):  # so that older updates come after newer ones
        e.where(F.col("event_id") % 3 == part).repartition(2).write.mode("append").parquet(source)
        state.track(updates(spark.readStream.schema(e.schema).parquet(source)), target, checkpoint)
    got = {r.key: round(r.value, 6) for r in state.tracked(spark, checkpoint).collect()}
    want = {f"{r.user_id}/{r.event_type}": round(r.value, 6) for r in status_latest(spark, SF).collect()}
    assert got == want and got
    changes = spark.read.parquet(target)
    assert changes.where("deleted").count() > 0 and changes.where("deleted AND value IS NOT NULL").count() == 0
    n = changes.count()
    state.track(updates(spark.readStream.schema(e.schema).parquet(source)), target, checkpoint)  # nothing new
    assert spark.read.parquet(target).count() == n


def test_save_state_after_a_crash_and_another_configuration(spark, tmp_path):
    path = str(tmp_path / "state")
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    assert events.save_state(one(0), path, 0, "a") == 0
    assert events.save_state(one(1), path, 1, "a") == 1
    (tmp_path / "state" / "version=000000001" / "_SUCCESS").unlink()
    kept, n = events.load_state(spark, path, "a")
    assert (kept.first().v, n) == (0, 0)
    assert events.save_state(one(2), path, n + 1, "a") == 1 and events.load_state(spark, path, "a")[0].first().v == 2
    # A changed configuration starts anew beside what the old one has written.
    assert events.load_state(spark, path, "b") == (None, -1)
    assert events.save_state(one(9), path, 0, "b") == 2 and events.load_state(spark, path, "b")[1] == 2


@pytest.mark.parametrize("rows", [[], [("a", None)]])
def test_upsert_edges(spark, rows):
    df = spark.createDataFrame(rows, "k string, value double").withColumn("at", F.lit(1))
    assert events.upsert(None, df, ["k"], "at").count() == 0
