import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heliograph.functions import text as X
from heliograph.operators import geo, scan, sequences, sets, tags, vectors
from heliograph.streaming import gates

T0 = datetime(2024, 1, 1)


def test_tag_parts_drop_empty_before_trimming(spark):
    df = spark.createDataFrame([("a// b /c ",), ("People",), ("",)], "t string")
    assert [r.p for r in df.select(tags.parts(F.col("t")).alias("p")).collect()] == [["a", "b", "c"], ["People"], []]
    assert [r.k for r in df.select(tags.index_keys(F.lit("Places/A/B/C")).alias("k")).limit(1).collect()] == [["places/a/b/c", "places/a", "places/a/b"]]
    assert [r.k for r in df.select(tags.index_keys(F.lit("People/A/B")).alias("k")).limit(1).collect()] == [["people/a/b"]]


def test_dedup_is_anchored_at_the_last_kept_row(spark):
    r = random.Random(1)
    rows = [(k, T0 + timedelta(seconds=r.randrange(0, 4000))) for k in range(5) for _ in range(80)] + [(1, None)]
    got = sorted(tuple(x) for x in sequences.dedup_anchored(spark.createDataFrame(rows, "k int, t timestamp_ntz"), "k", "t", 60).collect())
    want = []
    for k in range(5):
        last = None
        for t in sorted(t for q, t in rows if q == k and t):
            if last is None or (t - last).total_seconds() >= 60:
                want.append((k, t))
                last = t
    assert got == want


def test_nearest_by_brute_force(spark):
    from math import atan2, cos, radians, sin, sqrt

    def km(a, b, c, d):
        h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
        return 2 * 6371 * atan2(sqrt(h), sqrt(1 - h))

    r = random.Random(2)
    places = [(i, r.uniform(-89.9, 89.9), r.uniform(-180, 180)) for i in range(300)]
    points = [(i, p[1] + r.uniform(-1, 1) / 3, p[2] + r.uniform(-1, 1) / 3) for i, p in enumerate(places)] + [(900, 0.0, 179.99), (901, None, 1.0), (902, 89.0, 10.0)]
    points = [(i, min(90.0, max(-90.0, a)) if a is not None else None, b) for i, a, b in points]
    got = {x.id: x.place for x in geo.nearest(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(places, "place long, lat double, lon double"), 60.0).collect()}
    want = {}
    for i, a, b in points:
        near = [(km(a, b, c, d), p) for p, c, d in places if a is not None]
        if near and min(near)[0] < 60:
            want[i] = min(near)[1]
    assert got == want and len(got) > 150


def test_diff_and_plan(spark):
    old = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, m int")
    new = spark.createDataFrame([(2, None), (3, 8), (4, 1)], "id int, m int")
    assert sorted(map(tuple, sets.diff(old, new, "id", ("m",)).collect())) == [(1, "removed"), (2, "unchanged"), (3, "modified"), (4, "added")]
    s = lambda *v: spark.createDataFrame([(1, x) for x in v], "id int, v string")
    plan = {r.v: (r.action, r.owned_after) for r in sets.ownership_plan(s("a", "b", "c"), s("b", "d"), s("b", "c", "d", "e")).collect()}
    assert plan == {"a": ("add", True), "b": ("keep", True), "c": ("keep", False), "d": ("remove", False), "e": ("keep", False)}


def test_components(spark):
    nodes = spark.range(0, 50)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 40), (40, 45)], "a long, b long")
    got = {r.id: r.component for r in vectors.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[45] == 30 and got[49] == 49


def test_listing(spark):
    df = spark.createDataFrame([("d", n) for n in ("A.JPG", "a.mov", "b.MOV", ".x.jpg", "noext", "c.xmp")], "dir string, name string")
    assert {r.name: r.k for r in df.select("name", scan.kind(F.col("name")).alias("k")).collect()} == {"A.JPG": "image", "a.mov": "video", "b.MOV": "video", ".x.jpg": "skipped", "noext": "skipped", "c.xmp": "sidecar"}
    assert sorted((r.name, r.live) for r in scan.pair(df).collect()) == [("A.JPG", "a.mov"), ("b.mov", None)]


def test_text(spark):
    df = spark.createDataFrame([("",), ("a",)], "s string")
    assert [r.h for r in df.select(X.fnv1a("s").alias("h")).collect()] == [f"{14695981039346656037:016x}", "af63dc4c8601ec8c"]
    one = df.limit(1)
    assert one.select(X.join_names(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("x")).first().x == "A, B & C"
    assert one.select(X.match_key(F.lit("CAFÉ")).alias("x")).first().x == "café"
    assert one.select(X.person(F.lit("  a \n b ")).alias("x"), X.person(F.lit("a/b")).alias("y")).first() == ("a b", None)


@pytest.mark.parametrize("files", [1, 4])
def test_streams(spark, tmp_path, files):
    r = random.Random(files)
    rows = sorted((T0 + timedelta(seconds=r.randrange(0, 90000)), r.randrange(3)) for _ in range(200)) + [(T0 + timedelta(days=9), 0)]
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame(r.sample(part, len(part)), "ts timestamp, k long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    batch = spark.read.parquet(str(tmp_path / "in"))
    for name, live, done in (("deb", gates.debounce(stream, "k", "ts", "10 minutes"), gates.debounce(batch, "k", "ts", "10 minutes")), ("thr", gates.throttle_stream(stream, "k", "ts", 600), gates.throttle(batch, "k", "ts", 600))):
        q = live.writeStream.format("memory").queryName(f"{name}{files}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        got, want = (sorted(map(tuple, x.collect())) for x in (spark.table(f"{name}{files}"), done))
        want = [x for x in want if x[1] < T0 + timedelta(days=9)]  # the last event is still open
        assert got == want and got


@pytest.mark.parametrize("parts", [1, 3, 16])
@pytest.mark.parametrize("gap", [2, 40, 400])
def test_fold_of_one_hot_key_over_many_partitions(spark, parts, gap):
    r = random.Random(parts * gap)
    rows = [(7, T0 + timedelta(seconds=r.randrange(300 * gap) / 4)) for _ in range(900)] + [(k, T0 + timedelta(seconds=k)) for k in range(5)] + [(None, T0), (3, None)]
    want = []
    for k in {k for k, _ in rows}:
        last = None
        for t in sorted(t for q, t in rows if q == k and t is not None):
            if last is None or t - last >= timedelta(seconds=60):
                want.append((k, t))
                last = t
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(x) for x in sequences.dedup_anchored(spark.createDataFrame(rows, "k int, t timestamp_ntz"), "k", "t", 60).collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_admission_streams_through_its_caps(spark):
    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, 2, None]), i, r.choice([1, 5, 9, 30, 80])) for i in range(400)]
    want = []
    for k in (1, 2, None):
        used = taken = 0
        for q, i, s in rows:
            if q == k and taken < 20 and s <= 50 and used + s <= 150:
                used, taken = used + s, taken + 1
                want.append((k, i))
    got = [tuple(x) for x in sequences.admit(spark.createDataFrame(rows, "k int, i int, s long").repartition(5), "k", "i", "s", 20, 50, 150).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sequences.admit(spark.createDataFrame([], "k int, i int, s long"), "k", "i", "s", 20, 50, 150).count() == 0


def _sorted_batches(rows, cuts, anchor=None):
    """Batches of (k, t) as a partition of the fold gives them, with a nested key."""
    import pyarrow as pa

    kind = pa.struct([("v", pa.struct([("owner", pa.int64()), ("g", pa.struct([("kind", pa.string()), ("at", pa.int64())]))]))])
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        k = pa.array([None if o is None else {"v": {"owner": o, "g": {"kind": g, "at": None}}} for o, g, _ in rows[a:b]], type=kind)
        yield pa.RecordBatch.from_arrays([k, pa.array([t for *_, t in rows[a:b]], type=pa.int64()), pa.array([3] * (b - a), type=pa.int64()), pa.array([anchor] * (b - a), type=pa.int64())], names=["k", "t", "part", "anchor"])


@pytest.mark.parametrize("seed", range(6))
def test_fold_reads_a_partition_batch_by_batch(seed):
    r = random.Random(seed)
    rows = sorted({(r.choice([1, 2] if seed % 2 else [1]), r.choice(["a", None, "b"] if seed > 1 else ["a"]), r.randrange(30_000)) for _ in range(900)}, key=lambda x: (x[0], x[1] or "", x[2]))
    least, anchor = r.choice([1, 7, 500]), r.choice([None, -100, 900])
    want, last = [], {rows[0][:2]: anchor}
    for o, g, t in rows:
        if last.get((o, g)) is None or t - last[o, g] >= least:
            last[o, g] = t
            want.append((o, g, t))
    for cuts in ([], sorted(r.sample(range(1, len(rows)), 9)), [5, 5, 6]):
        got = [(x["k"]["v"]["owner"], x["k"]["v"]["g"]["kind"], x["t"]) for b in sequences._fold(_sorted_batches(rows, cuts, anchor), least) for x in b.to_pylist()]
        assert got == want
        ends = [x for b in sequences._borders(_sorted_batches(rows, cuts), least) for x in b.to_pylist()]
        one = len({x[:2] for x in rows}) == 1
        fresh = {}
        for o, g, t in rows:
            if (o, g) not in fresh or t - fresh[o, g] >= least:
                fresh[o, g] = t
        assert [(x["k"]["v"]["owner"], x["k"]["v"]["g"]["kind"], x["end"], x["whole"], x["fresh"]) for x in ends] == [(*rows[0][:2], 0, one, fresh[rows[0][:2]])] + ([] if one else [(*rows[-1][:2], 1, False, fresh[rows[-1][:2]])])
    drawn = []
    batches = (drawn.append(1) or b for b in _sorted_batches(rows, [100, 200, 300], anchor))
    next(sequences._fold(batches, least))
    assert len(drawn) == 1  # a partition isn't held whole
