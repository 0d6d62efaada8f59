"""The stateful stream against its batch form: order of arrival, cancellation, going on after a stop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from selvage.streaming import settled as W

SCHEMA = "key long, event long, ts timestamp, kind string"
BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows(events):
    return {(r["key"], r["event"], r["changes"]) for r in events.collect()}


def test_batch_runs(spark):
    at = [(1, 1, 0, "a"), (1, 2, 100, "b"), (1, 3, 350, "c"), (1, 4, 601, "cancel"), (2, 5, 0, "a"), (2, 6, 0, "b"), (3, 7, 0, "cancel"), (3, 8, 250, "a")]
    events = spark.createDataFrame([(k, e, BEGIN + dt.timedelta(milliseconds=t), kind) for k, e, t, kind in at], SCHEMA)
    assert rows(W.settled_batch(events, 250, ["cancel"])) == {(1, 3, 3), (2, 6, 2), (3, 8, 2)}
    assert rows(W.settled_batch(events.where("false"), 250, [])) == set()


@pytest.mark.parametrize("stops", [1, 3])
def test_stream_equals_batch(spark, tmp_path, stops):
    """Late and shuffled arrivals, in one go or with the stream stopped and started again from its state."""
    draw = random.Random(stops)
    t, made = 0, []
    for e in range(300):
        t += draw.choice([10, 60, 240, 251, 900])
        made.append((draw.randint(1, 5), e, BEGIN + dt.timedelta(milliseconds=t), draw.choice(["a", "b", "cancel"])))
    end = [(9, 1000, BEGIN + dt.timedelta(hours=9), "a")]  # moves the watermark past everything
    parts = [made[i::stops] if stops == 1 else made[i * 100:(i + 1) * 100] for i in range(stops)]
    for part in parts:
        draw.shuffle(part)
    parts[-1] += end
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(source)
        W.run_to_end(W.settled(spark.readStream.schema(SCHEMA).parquet(source), 250, ["cancel"], "1 hour"), out)
    got = spark.read.parquet(f"{out}/rows")
    want = W.settled_batch(spark.createDataFrame(made, SCHEMA), 250, ["cancel"])
    assert rows(got) == rows(want) and got.count() == want.count()
    assert got.where(F.col("key") == 9).count() == 0  # still waiting
