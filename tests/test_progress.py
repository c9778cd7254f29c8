"""The log watcher against the batch form on a replay."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.operators.evaluate import progress
from veilspan.streaming.progress import PROVIDER, watched

LINES = "log string, line_no long, time timestamp, value string"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    spark.conf.set("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true")
    yield spark
    spark.conf.set(PROVIDER[0], before)


def replayed(spark, path, name, silence):
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).json(str(path))
    query = watched(stream, silence=silence).writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_a_replay_equals_the_batch_form(rocks, tmp_path):
    rng = random.Random(4)
    rows = {}
    for log in "abc":
        rows[log] = [(log, k, f"2024-05-01 10:{k // 60:02d}:{k % 60:02d}", rng.choice([f"{k}%|##  | {k * 3}/300 [x]", "loading", f"loss {k}"])) for k in range(90)]
    rows["b"][70] = ("b", 70, "2024-05-01 10:01:10", "RuntimeError: out of memory")
    rows["c"][80] = ("c", 80, "2024-05-01 10:01:20", "Training completed")
    for batch in range(3):  # a shuffled file for each batch
        part = [r for own in rows.values() for r in own[30 * batch : 30 * batch + 30]]
        rng.shuffle(part)
        df = rocks.createDataFrame([(a, b, c, d) for a, b, c, d in part], "log string, line_no long, t string, value string")
        df.select("log", "line_no", F.to_timestamp("t").alias("time"), "value").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    found = replayed(rocks, tmp_path / "in", "replay", silence=100_000)
    last = {r.log: r for r in found.orderBy("seen").collect()}
    for log, own in rows.items():
        lines = rocks.createDataFrame([(k, v) for _, k, _, v in own], "line_no long, value string")
        wanted = progress(lines).first()
        assert (last[log].percent, last[log].step, last[log].of, last[log].state) == (wanted.percent, wanted.step, wanted.of, wanted.state)
    assert found.where("state = 'stalled'").isEmpty() and found.count() == 9  # a row a log and batch


def test_a_silent_log_stalls(rocks, tmp_path):
    batches = [
        [("a", 1, "2024-05-01 10:00:00", "10%|# | 1/10"), ("b", 1, "2024-05-01 10:00:00", "finished"), ("c", 1, "2024-05-01 10:00:00", "starts")],
        [("c", 2, "2024-05-01 10:30:00", "50%|# | 5/10")],
        [("c", 3, "2024-05-01 10:31:00", "60%|# | 6/10")],
    ]
    for rows in batches:
        df = rocks.createDataFrame(rows, "log string, line_no long, t string, value string")
        df.select("log", "line_no", F.to_timestamp("t").alias("time"), "value").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    found = replayed(rocks, tmp_path / "in", "silent", silence=600).collect()
    assert [(r.log, r.percent, r.step) for r in found if r.state == "stalled" and r.log != "c"] == [("a", 10, 1)]
    assert {r.state for r in found if r.log == "b"} == {"done"} and max(r.percent or 0 for r in found if r.log == "c") == 60
