"""Pruned joins, alignment, anchors, rotation, sidecars as trees, collation, export: against plain forms and by their properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import text as X
from heliograph.functions import xml as M
from heliograph.operators import export as P
from heliograph.operators import faces as A
from heliograph.operators import pivots as V
from heliograph.operators import rotation as R
from heliograph.session import ensure_checkpoint_dir


def unit(v):
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()


@pytest.mark.parametrize("chunk", [V.CHUNK, 7])
def test_pruned_join_finds_all_pairs_and_skips(spark, monkeypatch, chunk):
    monkeypatch.setattr(V, "CHUNK", chunk)
    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = unit(np.concatenate([centres[i % 12] + rng.normal(size=(20, 16)) * 0.15 for i in range(12)] + [rng.normal(size=(40, 16)), centres[:1].repeat(5, axis=0)]))
    df = spark.createDataFrame(list(enumerate(vectors)) + [(9999, None)], "id long, v array<double>")
    report = {}
    got = {(r.a, r.b): r.sim for r in V.similar_pairs(df, 0.9, report).collect()}
    v = np.array(vectors)
    want = {(i, j): s for i in range(len(v)) for j in range(i + 1, len(v)) if (s := float(v[i] @ v[j])) >= 0.9}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert report["skipped"] > report["pairs"] / 2
    assert len(V.similar_pairs(df, 0.9).collect()) == len(want)  # no pair twice
    assert V.similar_pairs(df.limit(0), 0.9).count() == 0


def test_bounds_never_exclude_a_pair():
    rng = np.random.default_rng(1)
    v, pivots = np.array(unit(rng.normal(size=(300, 5)))), np.array(unit(rng.normal(size=(6, 5))))
    angle = np.arccos(np.clip(v @ pivots.T, -1, 1))
    cell = angle.argmin(axis=1) * 2 * V.RINGS + (angle.min(axis=1) / math.pi * 2 * V.RINGS).astype(int)
    cells = [(int(c), angle.min(axis=1)[cell == c].min(), angle.min(axis=1)[cell == c].max()) for c in sorted(set(cell))]
    for least in (0.5, 0.95, 0.999):
        pairs = set(V.cell_pairs(cells, pivots, least))
        for i, j in zip(*np.nonzero(v @ v.T >= least), strict=True):
            assert tuple(sorted((int(cell[i]), int(cell[j])))) in pairs


def test_similarity_is_the_least_squares_one(spark):
    rng = np.random.default_rng(2)
    target = [(38.3, 51.7), (73.5, 51.5), (56.0, 71.7), (41.5, 92.4), (70.7, 92.2)]
    rows = []
    for k in range(30):
        s, th, tx, ty = rng.uniform(0.2, 3), rng.uniform(-3, 3), *rng.uniform(-50, 50, 2)
        t = np.array(target)
        p = (t - [tx, ty]) @ np.array([[math.cos(th), -math.sin(th)], [math.sin(th), math.cos(th)]]) / s
        rows.append((k, [(float(x), float(y)) for x, y in p + (rng.normal(size=p.shape) if k % 2 else 0)]))
    rows += [(100, [(1.0, 1.0)] * 5), (101, [(math.nan, 1.0)] + [(2.0, 1.0)] * 4)]
    df = spark.createDataFrame(rows, "k long, m array<struct<x:double,y:double>>")
    out = {r.k: r for r in A.similarity(df, "m", target, "s").select("k", "s", A.residual(F.col("s"), F.col("m"), target).alias("e")).collect()}
    assert out[100].s is None and out[101].s is None
    for k, pts in rows[:30]:
        assert out[k].e < 1e-6 if k % 2 == 0 else True
        # the same fit by a general solver
        a = np.array([r for x, y in pts for r in ((x, -y, 1, 0), (y, x, 0, 1))])
        sol = np.linalg.lstsq(a, np.array(target).reshape(-1), rcond=None)[0]
        assert np.allclose([out[k].s.a, out[k].s.c, out[k].s.tx, out[k].s.ty], sol)


def test_anchors(spark):
    rows = [(1, 16, 0.5, [0.9, 0.1, float("nan"), 0.5] * 2, [1.0, 2.0, 3.0, 4.0] * 8, [0.5] * 80)]
    schema = "img long, stride int, scale double, scores array<double>, boxes array<double>, points array<double>"
    got = {r.anchor: r for r in A.decode_anchors(spark.createDataFrame(rows, schema), 32, 2, 0.5).collect()}
    assert sorted(got) == [0, 3, 4, 7]
    assert (got[3].x0, got[3].y0, got[3].x1, got[3].y1) == (0.0, -64.0, 128.0, 128.0) and (got[4].points[0].x, got[4].points[0].y) == (16.0, 48.0)
    with pytest.raises(Exception, match="fit its grid"):
        A.decode_anchors(spark.createDataFrame([(1, 16, 0.5, [0.9], [1.0], [1.0])], schema), 32, 2, 0.5).collect()
    b = A.usable(spark.createDataFrame([(1, -5.0, 2.0, 30.0, 40.0), (2, 98.0, 0.0, 130.0, 50.0)], "i long, x0 double, y0 double, x1 double, y1 double"), F.lit(100), F.lit(100), 5.0)
    assert [tuple(r) for r in b.collect()] == [(1, 0.0, 2.0, 30.0, 40.0)]


@pytest.mark.parametrize("seed", ["a", "b"])
def test_rotation(spark, seed):
    pool = [(n, i) for n in (1, 2, 3, 5, 12, 30) for i in range(n)]
    got = {}
    for r in R.rotation(spark.createDataFrame(pool, "k long, item long"), "k", "item", 24, F.lit(seed)).collect():
        got.setdefault(r.k, {})[r.slot] = r.item
    for n, slots in got.items():
        row = [slots[i] for i in range(24)]
        assert len(slots) == 24
        assert n == 1 or all(a != b for a, b in zip(row, row[1:], strict=False))
        assert all(len(set(row[i : i + n])) == len(row[i : i + n]) for i in range(0, 24, n))


def document(pre, coords):
    names = {"rdf": M.RDF, "dc": M.DC, "m": M.MWG_RS, "a": M.ST_AREA}
    decl = " ".join(f"xmlns:{pre}{k}='{v}'" for k, v in names.items())
    area = f"<{pre}m:Area {pre}a:x='0.1' {pre}a:y='0.2' {pre}a:w='0.3' {pre}a:h='0.4'/>" if coords else f"<{pre}m:Area>" + "".join(f"<{pre}a:{s}>0.{i + 1}</{pre}a:{s}>" for i, s in enumerate("xywh")) + f"</{pre}m:Area>"
    bag = lambda *x: f"<{pre}rdf:Bag>" + "".join(f"<{pre}rdf:li>{i}</{pre}rdf:li>" for i in x) + f"</{pre}rdf:Bag>"
    return f"<{pre}rdf:RDF {decl}><{pre}rdf:Description {pre}dc:subject='alone'><{pre}dc:subject>{bag('one', ' two ')}</{pre}dc:subject></{pre}rdf:Description><{pre}dc:subject>{bag('three')}</{pre}dc:subject><{pre}m:RegionList>{bag(f'<{pre}m:Name>Ann</{pre}m:Name>{area}')}</{pre}m:RegionList></{pre}rdf:RDF>"


def test_documents_by_namespace():
    one = M.view_of(document("", True))
    assert one[0] == ["alone", "one", "two", "three"] and one[-1] == [("Ann", None, 0.1, 0.2, 0.3, 0.4)]
    assert all(M.view_of(document(p, a)) == one for p in ("", "q", "x-") for a in (True, False))
    # a prefix that means something else further down
    inner = f"<d xmlns:p='{M.DC}'><p:subject>in</p:subject><e xmlns:p='urn:other'><p:subject>out</p:subject></e></d>"
    assert M.view_of(inner)[0] == ["in"]
    assert M.view_of("<a>") is M.view_of(None) is M.view_of("") is M.view_of("<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>") is None


def test_collation_orders_like_its_key(spark):
    names = ["Zoë", "Zoë", "zoa", "Ångström", "Ångstrom", "angstroma", "Émile", "emil", "émilie", "Öz", "oy", "Pa", "ñu", "nv", "nt", ""]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    key = [r.k for r in df.orderBy(X.collation_key(F.col("n")), "n").select(X.collation_key(F.col("n")).alias("k")).collect()]
    got = [r.k for r in df.orderBy(X.collated(F.col("n")), "n").select(X.collation_key(F.col("n")).alias("k")).collect()]
    assert got == key and df.groupBy(X.collated(F.col("n"))).count().count() == df.select(X.collation_key(F.col("n"))).distinct().count()


def test_export_writes_what_changed(spark, tmp_path):
    path = str(tmp_path / "out")
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["x", "y", None]), [i, i + 1]) for i in range(50)]
    frame = lambda r, n=3: spark.createDataFrame(r, "i long, s string, a array<long>").repartition(n)
    other = spark.range(5)
    assert P.export({"t": frame(rows), "o": other}, path) == ["t", "o"]
    assert P.export({"t": frame(rows[::-1], 5), "o": other}, path) == []  # another order, the same rows
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    rows[7] = (7, "changed", [7, 8])
    assert P.export({"t": frame(rows), "o": other}, path) == ["t"]
    assert len(list((tmp_path / "out").iterdir())) == len(before) + 1
    assert sorted(map(str, P.exported(spark, path, "t", "i long, s string, a array<long>").collect())) == sorted(map(str, frame(rows).collect()))
    assert P.exported(spark, path, "o", "id long").count() == 5
    (tmp_path / "out" / "t-000009-lost").mkdir()  # an export that was lost before its line was written
    assert P.export({"t": frame(rows)}, path) == [] and P.exported(spark, path, "t", "i long, s string").count() == 50
    assert P.table_fingerprint(frame(rows)) != P.table_fingerprint(frame([*rows, rows[0]])) != P.table_fingerprint(frame([])) == P.table_fingerprint(frame([], 1))
