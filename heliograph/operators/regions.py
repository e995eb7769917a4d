"""Face boxes in pictures: overlap joins, binding of claims, and the plan of what a request writes.

Tables have a row per box: regions(k, i, x, y, w, h, kind, name) as a sidecar holds them, claims(k, i, x, y, w, h, name) as the tool recorded
what it wrote, wanted(k, i, x, y, w, h, name) as a request asks for, and requests(k, people, retracting). k is the picture, i a box's place in its list (whole numbers); x and y are centres.

Boxes of a picture meet in one task: they are dealt by picture once, and pictures are worked on many at a time, as columns. Pictures of more than ``MOST_BOXES`` boxes go
by overlap joins and rounds of mutual bests instead, where no task holds a picture. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators import edits as E
from heliograph.session import ensure_checkpoint_dir, ship_package, shuffles_removed

C = F.col
SIDES = ("x", "y", "w", "h")
FACE = "Face"
MOST_BOXES = 300  #: of a picture that is worked on in one task
GATHERED = 10_000  #: boxes that a task works on at a time
REGION, CLAIM, WANTED = range(3)  #: roles of boxes


def box(side: str = "") -> Column:
    return F.struct(*[C(f"{side}{s}").alias(s) for s in SIDES])


def coordinates(a: Column) -> Column:
    """A box as claims write it, with six places."""
    return F.format_string("%.6f,%.6f,%.6f,%.6f", *[a[s] for s in SIDES])


def overlapping(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """k, i, j, iou of the pairs of boxes of a picture whose intersection over union is more than ``least`` (0.5 or more).

    An equi-join on the picture, the size of the width in powers of two, and the strip in which the centre lies: boxes that overlap so much
    have widths within a factor of two, and centres within half of the larger width. So a picture with many boxes meets only near ones.
    """
    if least < 0.5:
        raise ValueError("blocks are made for an overlap of at least a half")
    level = F.floor(F.log2("w")).cast("int")
    strip = lambda size: F.floor(C("x") / F.pow(F.lit(2.0), size + 1)).cast("long")
    left = a.where("w > 0 and h > 0").select("k", "i", box().alias("a"), level.alias("level"), strip(level).alias("strip"))
    near = b.where("w > 0 and h > 0").select("k", C("i").alias("j"), "x", box().alias("b"), F.explode(F.array(level - 1, level, level + 1)).alias("level"))
    right = near.select("k", "j", "b", "level", F.explode(F.array(*[strip(C("level")) + d for d in (-1, 0, 1)])).alias("strip"))
    pairs = left.join(right, ["k", "level", "strip"]).select("k", "i", "j", E.overlap(C("a"), C("b")).alias("iou"))
    return pairs.where(C("iou") > least)


def bind_claims(claims: DataFrame, regions: DataFrame) -> DataFrame:
    """k, claim, region: which box each claim is about, the best overlap first (ties: first claim, then first box), each one once."""
    pairs = overlapping(claims, regions).select("k", C("i").alias("claim"), C("j").alias("region"), "iou")
    return E.greedy_pairs(pairs, "k", "claim", "region", "iou").select("k", "claim", "region")


def region_plan(regions: DataFrame, claims: DataFrame, wanted: DataFrame, requests: DataFrame) -> DataFrame:
    """k, action, value: what a request does to each picture's boxes.

    Boxes that claims are bound to are the tool's own, the others foreign. Each wanted box, in its order, takes the own box that it overlaps most (of those
    not taken); if there is none but a foreign box is there, it defers to it. Own boxes go if they are taken by a box with other text or place, or if
    nothing takes them and the request speaks for their name (a complete request, with ``retracting`` null, for everyone). Actions: ``add`` (coordinates and name), ``remove``
    (coordinates), ``own`` (claim that holds afterwards), ``defer`` (how many wanted boxes did).
    """
    of = lambda df, role: df.select("k", F.lit(role).alias("role"), C("i").cast("long").alias("i"), *[C(c).cast("double").alias(c) for c in SIDES], (C("kind") if role == REGION else F.lit(None)).cast("string").alias("kind"), "name")
    return plan_of_boxes(of(regions, REGION).unionByName(of(claims, CLAIM)).unionByName(of(wanted, WANTED)), requests)


def plan_of_boxes(boxes: DataFrame, requests: DataFrame) -> DataFrame:
    """The same from one table boxes(k, role, i, x, y, w, h, kind, name), read twice. If it is dealt by k already, it isn't dealt again."""
    spark = boxes.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    with shuffles_removed(spark):
        large = boxes.groupBy("k").agg(F.count("*").alias("n")).where(C("n") > MOST_BOXES).select("k").checkpoint()
        some = not large.isEmpty()
    small = boxes.where("k is not null")
    out = _in_tasks(small.join(large, "k", "left_anti") if some else small, requests)
    none = boxes.where("k is null")
    if not some and none.isEmpty():
        return out
    rest = boxes.join(large, "k", "left_semi").unionByName(none).checkpoint()
    return out.unionByName(_in_rounds(*[rest.where(C("role") == r).drop("role") for r in (REGION, CLAIM, WANTED)], requests))


def _in_tasks(boxes: DataFrame, requests: DataFrame) -> DataFrame:
    """The plan of pictures of few boxes."""
    asked = requests.select("k", F.coalesce("people", F.array().cast("array<string>")).alias("people"), "retracting", F.lit(True).alias("asked"))
    b = boxes.join(asked, "k", "left").withColumn("gone", (C("role") == CLAIM) & F.coalesce(C("asked") & E.speaks_for(C("name"), C("people"), C("retracting")), F.lit(False))).drop("people", "retracting", "asked")
    b = b.withColumn("n", F.count("*").over(Window.partitionBy("k")))  # brings the boxes of a picture together, one after the other
    b = b.select("k", "role", "i", *SIDES, (C("kind") == FACE).alias("face"), coordinates(box()).alias("at"), "name", "gone", "n")
    return b.mapInArrow(_plans, f"k {boxes.schema['k'].dataType.simpleString()}, action string, value string")


def _plans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plans of a partition's pictures, which stand one after the other; works on whole pictures, at least GATHERED boxes of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= GATHERED:
            t = pa.Table.from_batches(held).combine_chunks()
            k = t.column("k").to_numpy()
            whole = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
            if whole:
                yield _plan(t.slice(0, whole))
            held = t.slice(whole).to_batches()
    if sum(x.num_rows for x in held):
        yield _plan(pa.Table.from_batches(held))


def _codes(a) -> np.ndarray:
    """A number for each text, -1 for null."""
    return pc.fill_null(pc.cast(a.dictionary_encode().combine_chunks().indices, pa.int64()), -1).to_numpy(zero_copy_only=False)


def _meeting(a: np.ndarray, b: np.ndarray, picture: np.ndarray, sides: np.ndarray, least: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, iou) of the boxes a and b (places, by picture) of one picture that overlap more than ``least``; in the arithmetic of ``edits.overlap``."""
    lo, hi = np.searchsorted(picture[b], picture[a]), np.searchsorted(picture[b], picture[a], "right")
    n = hi - lo
    i = np.repeat(a, n)
    j = b[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    with np.errstate(invalid="ignore", divide="ignore"):
        side = lambda p, s: np.maximum(0.0, np.minimum(sides[p][i] + sides[s][i] / 2, sides[p][j] + sides[s][j] / 2) - np.maximum(sides[p][i] - sides[s][i] / 2, sides[p][j] - sides[s][j] / 2))
        inter = side(0, 2) * side(1, 3)
        iou = inter / (sides[2][i] * sides[3][i] + sides[2][j] * sides[3][j] - inter)
        good = (iou > least) & (sides[2][i] > 0) & (sides[3][i] > 0) & (sides[2][j] > 0) & (sides[3][j] > 0)
    return i[good], j[good], iou[good]


def _greedy(a: np.ndarray, b: np.ndarray, iou: np.ndarray, place: np.ndarray, first_come: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``edits.greedy_pairs``, of all pictures at once; place: a box's place in its list."""
    order = np.lexsort((place[b], place[a], -iou))
    a, b = a[order], b[order]
    rank = np.arange(len(a))
    turn = np.argsort(np.argsort(place[a], kind="stable")) if first_come else rank
    taken = np.zeros(len(a), bool)
    left = rank
    while len(left):
        best_a, best_b = (np.full(len(place), len(a)) for _ in range(2))
        np.minimum.at(best_a, a[left], left)
        np.minimum.at(best_b, b[left], turn[left])
        now = left[(best_a[a[left]] == left) & (best_b[b[left]] == turn[left])]
        taken[now] = True
        used = np.zeros(len(place), bool)
        used[a[now]] = used[b[now]] = True
        left = left[~used[a[left]] & ~used[b[left]]]
    return a[taken], b[taken]


def _plan(t: pa.Table) -> pa.RecordBatch:
    """The plan of whole pictures, as ``_in_rounds`` makes it."""
    k, role, place = (t.column(c).to_numpy() for c in ("k", "role", "i"))
    order = np.lexsort((place, role, k))
    t, k, role, place = t.take(pa.array(order)), k[order], role[order], place[order]
    picture = np.cumsum(np.r_[False, k[1:] != k[:-1]])
    sides = [pc.fill_null(t.column(c), float("nan")).to_numpy() for c in SIDES]
    face, gone = (pc.fill_null(t.column(c), False).to_numpy() for c in ("face", "gone"))
    at, name = _codes(t.column("at")), _codes(t.column("name"))
    regions, claims, wanted = (np.flatnonzero(role == r) for r in (REGION, CLAIM, WANTED))
    nobody = lambda: np.full(len(k), -1)

    claim, want, taker = nobody(), nobody(), nobody()
    c, r = _greedy(*_meeting(claims, regions, picture, sides), place)
    claim[r] = c
    own, foreign = regions[claim[regions] >= 0], regions[claim[regions] < 0]
    w, r = _greedy(*_meeting(wanted, own, picture, sides), place, first_come=True)
    want[r], taker[w] = w, r
    paired = want[own] >= 0
    keep = paired & face[own] & (at[own] == at[want[own]]) & (name[own] == name[want[own]])
    doomed = ~keep & (paired | gone[claim[own]])
    area = np.unique(np.stack([picture[own].astype(float), *(x[own] + 0.0 for x in sides)], 1), axis=0, return_inverse=True)[1].ravel()  # + 0.0: there is one zero
    removed = np.isin(area, area[doomed])
    blocked = np.zeros(len(k), bool)
    blocked[_meeting(wanted, foreign, picture, sides)[0]] = True
    free = wanted[taker[wanted] < 0]
    fresh, deferred = free[~blocked[free]], free[blocked[free]]

    add = np.concatenate([fresh, want[own[paired & ~keep]], want[own[keep & removed]]])
    owned = np.concatenate([fresh, want[own[paired]], claim[own[~paired & ~removed]]])
    rows = np.concatenate([add, owned, own[doomed]])
    action = np.repeat([0, 1, 2], [len(add), len(owned), doomed.sum()])
    named = np.where(action < 2, name[rows], -1)
    once = np.unique(np.stack([picture[rows], action, at[rows], named], 1), axis=0, return_index=True)[1]
    rows, action = rows[once], action[once]
    name_of = pc.if_else(pa.array(action < 2), t.column("name").take(pa.array(rows)).combine_chunks(), pa.scalar(None, pa.string()))
    value = pc.binary_join_element_wise(t.column("at").take(pa.array(rows)).combine_chunks(), name_of, " ", null_handling="skip")
    of, n = np.unique(picture[deferred], return_index=False, return_counts=True)
    first = np.searchsorted(picture, of)
    names = pa.array(["add", "own", "remove"]).take(pa.array(action))
    return pa.RecordBatch.from_arrays([t.column("k").take(pa.array(np.r_[rows, first])).combine_chunks(), pa.concat_arrays([names, pa.array(["defer"] * len(of), pa.string())]), pa.concat_arrays([value, pa.array(map(str, n.tolist()), pa.string())])], names=["k", "action", "value"])


def _in_rounds(regions: DataFrame, claims: DataFrame, wanted: DataFrame, requests: DataFrame) -> DataFrame:
    """The plan of pictures of any number of boxes: joins, and a checkpoint each round."""
    ensure_checkpoint_dir(regions.sparkSession)
    bound = bind_claims(claims, regions)
    named = claims.select("k", C("i").alias("claim"), F.concat_ws(" ", coordinates(box()), "name").alias("text"), C("name").alias("claimed"))
    own = regions.join(bound.withColumnRenamed("region", "i"), ["k", "i"]).join(named, ["k", "claim"])
    foreign = regions.join(bound.select("k", C("region").alias("i")), ["k", "i"], "left_anti")
    near = overlapping(wanted, own).select("k", C("i").alias("want"), C("j").alias("region"), "iou")
    taken = E.greedy_pairs(near, "k", "want", "region", "iou", first_come=True).select("k", "want", "region").checkpoint()
    w = wanted.select("k", C("i").alias("want"), box().alias("to"), C("name").alias("to_name"), F.concat_ws(" ", coordinates(box()), "name").alias("to_text"))
    mine = own.select("k", C("i").alias("region"), "kind", "name", box().alias("at"), "text", "claimed").join(taken, ["k", "region"], "left").join(w, ["k", "want"], "left")
    same = (C("kind") == FACE) & (coordinates(C("at")) == coordinates(C("to"))) & C("name").eqNullSafe(C("to_name"))
    people = F.coalesce("people", F.array().cast("array<string>"))
    mine = mine.join(requests.select("k", people.alias("people"), "retracting", F.lit(True).alias("asked")), "k", "left")
    mine = mine.withColumns({"paired": C("want").isNotNull(), "keep": F.coalesce(same & C("want").isNotNull(), F.lit(False))})
    gone = C("asked") & E.speaks_for(C("claimed"), C("people"), C("retracting"))
    mine = mine.withColumn("doomed", ~C("keep") & (C("paired") | F.coalesce(gone, F.lit(False)))).checkpoint()
    removed = mine.where("doomed").select("k", "at").distinct()
    free = w.join(taken.select("k", "want"), ["k", "want"], "left_anti")
    blocked = overlapping(wanted, foreign).select("k", C("i").alias("want")).distinct()
    deferred = free.join(blocked, ["k", "want"], "left_semi")
    fresh = free.join(blocked, ["k", "want"], "left_anti")
    # a box that stays but has the very area of one that goes is written again
    again = mine.where("keep").join(removed, ["k", "at"], "left_semi")
    row = lambda df, action, value: df.select("k", F.lit(action).alias("action"), value.alias("value"))
    out = row(fresh, "add", C("to_text")).unionByName(row(mine.where("paired and not keep"), "add", C("to_text"))).unionByName(row(again, "add", C("to_text")))
    out = out.unionByName(row(removed, "remove", coordinates(C("at"))))
    stay = mine.where("not paired").join(removed, ["k", "at"], "left_anti")
    out = out.unionByName(row(fresh, "own", C("to_text"))).unionByName(row(mine.where("paired"), "own", C("to_text"))).unionByName(row(stay, "own", C("text")))
    return out.distinct().unionByName(row(deferred.groupBy("k").agg(F.count("*").cast("string").alias("n")), "defer", C("n")))
