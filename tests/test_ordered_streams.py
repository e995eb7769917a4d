"""Queue and fence on streams, with shuffled and replayed batches, against their batch forms and plain folds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heliograph.streaming import ordered as O

T0 = datetime(2024, 1, 1)
QUEUE_EVENT = "item long, at timestamp, seq long, kind string, stat string, decoder long"
FENCE_EVENT = "slot long, at timestamp, seq long, kind string, epoch long, value double"


def feed(spark, folder, rows, schema, end, rnd, files):
    """Writes rows in shuffled order, some of them twice, in some files, then an event that ends time."""
    rows = [*rows, *rnd.sample(rows, len(rows) // 3)]
    rnd.shuffle(rows)
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, name, stream, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def queue_rows(rnd):
    kinds = ["seen", "seen", "sweep", "claim", "claim", "claim", "done", "failed", "failed", "skipped"]
    return [(rnd.randrange(12), T0 + timedelta(seconds=rnd.randrange(3000)), i, rnd.choice(kinds), rnd.choice(["a", "a", "b", None]), rnd.choice([1, 1, 2])) for i in range(400)]


@pytest.mark.parametrize("files", [1, 5])
def test_queue(spark, tmp_path, files):
    rnd = random.Random(files)
    rows = queue_rows(rnd)
    want = {}
    for item, _, _, kind, stat, decoder in sorted(rows, key=lambda r: r[1:3]):
        want[item] = O.queue_step(want.get(item, O.FRESH), kind, stat, decoder)
    want = sorted(O._queue_row(i, r) for i, r in want.items())
    assert {r[1] for r in want} > {"done"} and max(r[4] for r in want) > 2
    batch = spark.createDataFrame([*rows, *rows[:50]], QUEUE_EVENT)
    assert sorted(map(tuple, O.run_queue(batch).collect())) == want
    feed(spark, str(tmp_path / "in"), rows, QUEUE_EVENT, (99, T0 + timedelta(days=1), 10_000, "seen", None, None), rnd, files)
    stream = spark.readStream.schema(QUEUE_EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "1 hour")
    out = run(spark, f"queue{files}", O.queue_stream(stream), tmp_path)
    last = out.groupBy("item").agg(F.max_by(F.struct("state", "retries", "stat", "claims"), "version").alias("r")).select("item", "r.*")
    got = {r[0]: tuple(r) for r in last.collect()}
    # an item whose events never change it has no version
    assert [got.get(r[0], r if r[1] is None else None) for r in want] == want


def test_queue_rules():
    def after(*events):
        row = O.FRESH
        for e in events:
            row = O.queue_step(row, *e)
        return row["state"], row["retries"], row["claims"]

    seen, claim, done, failed = ("seen", "a", None), ("claim", None, None), ("done", None, 1), ("failed", None, None)
    assert after(claim) == (None, 0, 0)
    assert after(seen, claim, claim, done, claim) == ("done", 0, 1)  # claimed once
    assert after(seen, claim, ("sweep", None, 1), claim) == ("hashing", 0, 2)
    assert after(seen, claim, done, ("seen", "b", None)) == ("stale", 0, 1)
    assert after(seen, claim, ("skipped", None, 1), ("sweep", None, 1)) == ("skipped", 0, 1)
    assert after(seen, claim, ("skipped", None, 1), ("sweep", None, 2)) == ("pending", 0, 1)
    assert after(seen, *[claim, failed] * 4) == ("failed", 3, 3)
    assert after(seen, done) == ("pending", 0, 0)


def fence_rows(rnd):
    rows = [(rnd.randrange(4), T0 + timedelta(seconds=rnd.randrange(3000)), i, rnd.choice(["begin", "result", "result"]), rnd.randrange(6), float(i)) for i in range(300)]
    return rows


@pytest.mark.parametrize("files", [1, 6])
def test_fence(spark, tmp_path, files):
    rnd = random.Random(files)
    rows = fence_rows(rnd)
    want, top = [], {}
    for slot, _, seq, kind, epoch, value in sorted(rows, key=lambda r: r[1:3]):
        if kind == "begin":
            top[slot] = max(epoch, top.get(slot, -1))
        elif epoch >= top.get(slot, -1):
            want.append((slot, epoch, seq, value))
    assert 0 < len(want) < sum(r[3] == "result" for r in rows)
    assert sorted(map(tuple, O.fence(spark.createDataFrame([*rows, *rows[:40]], FENCE_EVENT)).collect())) == sorted(want)
    feed(spark, str(tmp_path / "in"), rows, FENCE_EVENT, (99, T0 + timedelta(days=1), 10_000, "begin", 0, None), rnd, files)
    stream = spark.readStream.schema(FENCE_EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "1 hour")
    got = run(spark, f"fence{files}", O.fence_stream(stream), tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(want)
