"""Overlap joins, binding and region plans against plain loops."""

import random

import pytest

from heliograph.operators import regions as R

BOX = "k long, i long, x double, y double, w double, h double"


def iou(a, b):
    side = lambda p, s: max(0.0, min(a[p] + a[s] / 2, b[p] + b[s] / 2) - max(a[p] - a[s] / 2, b[p] - b[s] / 2))
    inter = side(0, 2) * side(1, 3)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter)


def coords(b):
    return ",".join(f"{v:.6f}" for v in b)


def plain(regions, claims, wanted, people, retracting):
    """(actions) of one picture: regions (box, kind, name), claims and wanted (box, name)."""
    pairs = sorted((-iou(c[0], r[0]), ci, ri) for ci, c in enumerate(claims) for ri, r in enumerate(regions) if iou(c[0], r[0]) > 0.5)
    owner, used = {}, set()
    for _, ci, ri in pairs:
        if ci not in used and ri not in owner:
            used.add(ci)
            owner[ri] = ci
    out, paired, keep, deferred = set(), {}, set(), 0
    for b, name in wanted:
        best = max((ri for ri in owner if ri not in paired and iou(regions[ri][0], b) > 0.5), key=lambda ri: (iou(regions[ri][0], b), -ri), default=None)
        text = f"{coords(b)} {name}"
        if best is not None:
            paired[best] = text
            out.add(("own", text))
            box, kind, own = regions[best]
            if kind == "Face" and coords(box) == coords(b) and own == name:
                keep.add(best)
            else:
                out.add(("add", text))
        elif any(ri not in owner and iou(r[0], b) > 0.5 for ri, r in enumerate(regions)):
            deferred += 1
        else:
            out |= {("own", text), ("add", text)}
    speaks = lambda n: retracting is None or n in retracting or n in people
    doomed = {regions[ri][0] for ri, ci in owner.items() if ri not in keep and (ri in paired or speaks(claims[ci][1]))}
    out |= {("remove", coords(b)) for b in doomed}
    out |= {("own", f"{coords(claims[ci][0])} {claims[ci][1]}") for ri, ci in owner.items() if ri not in paired and regions[ri][0] not in doomed}
    out |= {("add", paired[ri]) for ri in keep if regions[ri][0] in doomed}
    return out | ({("defer", str(deferred))} if deferred else set())


def pictures(rnd, n):
    out = {}
    for k in range(n):
        base = [(rnd.choice([0.2, 0.5, 0.8]), rnd.choice([0.3, 0.6]), rnd.choice([0.1, 0.2, 0.25]), 0.2) for _ in range(5)]
        near = lambda: tuple(round(v + rnd.choice([0, 0, 0.01, -0.015]), 4) for v in rnd.choice(base))  # noqa: B023, E731
        name = lambda: rnd.choice(["Ann", "Bob", "Zoë"])
        out[k] = (
            [(near(), rnd.choice(["Face", "Face", "Pet", None]), name()) for _ in range(rnd.randrange(7))],
            [(near(), name()) for _ in range(rnd.randrange(6))],
            [(near(), name()) for _ in range(rnd.randrange(6))],
            [name()],
            rnd.choice([None, [], ["Ann"], ["Bob", "Zoë"]]),
        )
    return out


def tables(spark, made):
    boxes = lambda at: [(k, i, *b[0], *b[1:]) for k, p in made.items() for i, b in enumerate(p[at])]
    return (
        spark.createDataFrame(boxes(0), BOX + ", kind string, name string"), spark.createDataFrame(boxes(1), BOX + ", name string"), spark.createDataFrame(boxes(2), BOX + ", name string"),
        spark.createDataFrame([(k, p[3], p[4]) for k, p in made.items()], "k long, people array<string>, retracting array<string>"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_plan_is_the_plain_one(spark, seed):
    made = pictures(random.Random(seed), 60)
    got = {}
    for r in R.region_plan(*tables(spark, made)).collect():
        got.setdefault(r.k, set()).add((r.action, r.value))
    assert got == {k: x for k, p in made.items() if (x := plain(*p))}


def test_overlap_join_loses_no_pair(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(2), i, rnd.random(), rnd.random(), rnd.choice([0.01, 0.05, 0.1, 0.15, 0.3, 0.5]) * rnd.uniform(0.7, 1.4), rnd.uniform(0.1, 0.4)) for i in range(250)]
    df = spark.createDataFrame(rows, BOX)
    got = {(r.k, r.i, r.j) for r in R.overlapping(df, df).collect()}
    assert got == {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and iou(a[2:], b[2:]) > 0.5} and len(got) > len(rows)
    assert R.overlapping(df.limit(0), df).count() == 0


def test_query_is_the_plain_plan(spark):
    from heliograph.plans import region_queries as Q

    sf = "/root/testdata/sf0.001"
    regions, claims, wanted, requests = (t.orderBy("k", *(["i"] if "i" in t.columns else [])).collect() for t in Q.tables(spark, sf))
    made = {r.k: ([], [], [], r.people, r.retracting) for r in requests}
    for at, table in enumerate((regions, claims, wanted)):
        for r in table:
            made.setdefault(r.k, ([], [], [], [], []))[at].append(((r.x, r.y, r.w, r.h), *([r.kind] if at == 0 else []), r.name))
    got = {}
    for r in Q.l3(spark, sf).collect():
        got.setdefault(r.k, set()).add((r.action, r.value))
    want = {k: x for k, p in made.items() if (x := plain(*p))}
    assert got == want and {a for x in want.values() for a, _ in x} == {"add", "remove", "own", "defer"}


@pytest.mark.parametrize("most", [0, 6])
def test_large_pictures_give_the_same_rows_by_rounds(spark, monkeypatch, most):
    made = pictures(random.Random(7), 30)
    monkeypatch.setattr(R, "MOST_BOXES", most)
    got = {}
    for r in R.region_plan(*tables(spark, made)).collect():
        got.setdefault(r.k, []).append((r.action, r.value))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, p in made.items() if (x := plain(*p))}


def test_plan_moves_boxes_once_and_keeps_no_pairs(spark):
    """Of a table dealt by picture, the plan shuffles nothing but the requests."""
    made = pictures(random.Random(3), 40)
    regions, claims, wanted, requests = tables(spark, made)
    of = lambda df, role: df.selectExpr("k", f"{role} AS role", "i", "x", "y", "w", "h", "kind" if role == 0 else "CAST(NULL AS STRING) AS kind", "name")
    boxes = of(regions, 0).union(of(claims, 1)).union(of(wanted, 2)).repartition("k")
    plan = R.plan_of_boxes(boxes, requests)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    whole = sorted(map(tuple, plan.collect()))
    old = sorted((k, a, v) for k, p in made.items() for a, v in plain(*p))
    assert whole == old
