"""The stored tag index: updates against rebuilds, pruned plans, odd rows."""

import datetime as dt
import random

import pytest

from heliograph.operators import tag_index as I
from heliograph.operators import tags as T

TAGS = ["Places/Italy/Lazio/Rome", "Places/Italy/Lazio", "places/italy", "Places", "Scenes/Beach/Sunset", "Scenes/Beach", "People/Ann Lee", "Mood", "Objects/car", "", " Odd / Space "]
SCHEMA = "id long, filename string, date_taken timestamp_ntz, tags array<string>"


def some(rnd, ids):
    day = dt.datetime(2024, 1, 1)
    return [(i, f"IMG_{i}{rnd.choice(['a', 'beach', ''])}.jpg", rnd.choice([None, day + dt.timedelta(days=i % 9)]), rnd.sample(TAGS, rnd.randrange(5))) for i in ids]


def state(index):
    return sorted(map(str, index.postings().collect())), sorted(map(str, index.names().collect())), sorted(map(str, index.terms().collect()))


def test_update_equals_rebuild(spark, tmp_path):
    rnd = random.Random(4)
    now = {r[0]: r for r in some(rnd, range(60))}
    index = I.build(spark.createDataFrame(list(now.values()), SCHEMA), f"{tmp_path}/a", 8)
    for step in range(3):
        gone = rnd.sample(sorted(now), 10)
        new = {r[0]: r for r in some(rnd, rnd.sample(sorted(now), 8) + list(range(100 * step + 100, 100 * step + 110)))}
        before = [now[i] for i in {*gone, *new} if i in now]
        now = {i: r for i, r in now.items() if i not in gone} | new
        index = index.update(spark.createDataFrame(before, SCHEMA), spark.createDataFrame(list(new.values()), SCHEMA))
    again = I.build(spark.createDataFrame(list(now.values()), SCHEMA), f"{tmp_path}/b", 8)
    assert len(index.folders) == 4 and state(index) == state(again) == state(index.compacted(f"{tmp_path}/c"))


@pytest.mark.parametrize("text,required", [("Places/ITALY", ()), ("scenes/beach", ()), ("beach", ()), ("", ("Places/Italy",)), ("img", ("places/italy/lazio", "Mood")), ("zzz", ()), ("", ()), ("mood", ()), ("places", ())])
def test_search_is_that_of_a_scan(spark, tmp_path, text, required):
    photos = spark.createDataFrame(some(random.Random(7), range(80)), SCHEMA)
    index = I.build(photos, f"{tmp_path}/i", 4)
    assert sorted(r.id for r in index.search(text, required).collect()) == sorted(r.id for r in T.search(photos, text, required).collect())


def test_more_keys_than_are_listed(spark, tmp_path, monkeypatch):
    photos = spark.createDataFrame(some(random.Random(8), range(80)), SCHEMA)
    index = I.build(photos, f"{tmp_path}/i", 4)
    want = sorted(r.id for r in index.search("ea").collect())
    monkeypatch.setattr(I, "FEW_KEYS", 0)
    assert sorted(r.id for r in index.search("ea").collect()) == want != []


def test_search_reads_one_bucket(spark, tmp_path):
    index = I.build(spark.createDataFrame(some(random.Random(9), range(200)), SCHEMA), f"{tmp_path}/i", 16)
    plan = index.photos_for("Scenes/Beach")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(key,scenes/beach)" in plan
    files = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in index.photos_for("Scenes/Beach").inputFiles()}
    assert len(files) <= 16  # files of the relation; the scan keeps those of one bucket
    scanned = index.photos_for("Scenes/Beach").select("id", "taken", "exact").selectExpr("input_file_name() AS f").distinct().collect()
    assert len({r.f.rsplit("bucket=", 1)[1].split("/")[0] for r in scanned}) == 1


def test_uncommitted_generation_is_not_seen(spark, tmp_path):
    photos = spark.createDataFrame(some(random.Random(1), range(20)), SCHEMA)
    index = I.build(photos, f"{tmp_path}/i", 4)
    I.postings(photos).write.parquet(f"{tmp_path}/i/gen-000001-lost/postings")
    assert state(I.open_index(spark, f"{tmp_path}/i")) == state(index)


def test_empty_library(spark, tmp_path):
    index = I.build(spark.createDataFrame([], SCHEMA), f"{tmp_path}/i", 4)
    assert index.search("x").count() == index.search("").count() == index.suggestions().count() == 0
