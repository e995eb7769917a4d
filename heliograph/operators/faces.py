"""Geometry of detected faces: anchors to boxes, letterbox sizes, alignment by least squares. Column arithmetic only; no pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
EPSILON = 2.220446049250313e-16  #: fixed value: spacing of doubles at 1


def letterbox(w: Column, h: Column, size: int) -> Column:
    """scale and the content's width and height when an image is scaled to fit a square of ``size`` from its top left corner; null for images without area."""
    scale = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
    side = lambda x: F.least(F.greatest(F.round(x * scale), F.lit(1.0)), F.lit(float(size))).cast("int")
    return F.when((w > 0) & (h > 0), F.struct(scale.alias("scale"), side(w).alias("w"), side(h).alias("h")))


def from_letterbox(box: Column, scale: Column) -> Column:
    """A box (x0, y0, x1, y1) of the square, in the image's pixels."""
    return F.struct(*[(box[s] / scale).alias(s) for s in ("x0", "y0", "x1", "y1")])


def similarity(df: DataFrame, source: str, target: list[tuple[float, float]], out: str) -> DataFrame:
    """df with ``out``: the scaling, turn and shift that bring the points of source (array of x, y) onto the target with the least squared error: a, b, tx, c, d, ty.

    In the plane the best turn follows from two sums over the centred points, so there is no decomposition: scale times cosine is their trace over the source's
    variance, scale times sine their skew. Null for points that coincide, or if no turn fits better than any other. In steps, so no sum is written out twice.
    """
    n = float(len(target))
    total = lambda xs: sum(xs[1:], xs[0])
    points = range(len(target))
    mean = {f"__m{k}": total([C(source)[i][k] for i in points]) / n for k in ("x", "y")}
    ux, uy = (sum(p[k] for p in target) / n for k in (0, 1))
    t = [(p[0] - ux, p[1] - uy) for p in target]
    s = [(C(source)[i]["x"] - C("__mx"), C(source)[i]["y"] - C("__my")) for i in points]
    sums = {
        "__trace": total([a * u + b * v for (a, b), (u, v) in zip(s, t, strict=True)]) / n,
        "__skew": total([a * v - b * u for (a, b), (u, v) in zip(s, t, strict=True)]) / n,
        "__var": total([a * a + b * b for a, b in s]) / n,
    }
    a, c = C("__trace") / C("__var"), C("__skew") / C("__var")
    m = F.struct(a.alias("a"), (-c).alias("b"), (F.lit(ux) - (a * C("__mx") - c * C("__my"))).alias("tx"), c.alias("c"), a.alias("d"), (F.lit(uy) - (c * C("__mx") + a * C("__my"))).alias("ty"))
    good = (C("__var") > EPSILON) & ~F.isnan("__var") & (C("__var") != float("inf")) & ((C("__trace") != 0) | (C("__skew") != 0)) & ~F.isnan("__trace") & ~F.isnan("__skew")
    return df.withColumns(mean).withColumns(sums).withColumn(out, F.when(good, m)).drop("__mx", "__my", *sums)


def residual(m: Column, source: Column, target: list[tuple[float, float]]) -> Column:
    """The root mean square distance of the mapped points from the target."""
    out = F.lit(0.0)
    for i, (u, v) in enumerate(target):
        x, y = source[i]["x"], source[i]["y"]
        out = out + F.pow(m["a"] * x + m["b"] * y + m["tx"] - u, 2) + F.pow(m["c"] * x + m["d"] * y + m["ty"] - v, 2)
    return F.sqrt(out / len(target))


def decode_anchors(outputs: DataFrame, size: int, anchors: int, least: float) -> DataFrame:
    """img, stride, anchor, score, x0, y0, x1, y1, points of outputs(img, stride, scale, scores, boxes, points): arrays per image and level.

    Anchors walk the level's grid row by row, ``anchors`` per cell. Boxes are four distances from the cell's corner in strides, points five pairs. What scores less than
    ``least``, or has a place that isn't a finite number, is dropped. Levels whose arrays don't fit the grid raise.
    """
    cells = F.floor(F.lit(size) / C("stride")).cast("long")
    n = cells * cells * anchors
    fits = (F.size("scores") == n) & (F.size("boxes") == n * 4) & (F.size("points") == n * 10)
    checked = outputs.withColumn("scores", F.when(fits, C("scores")).otherwise(F.raise_error(F.lit("a level's arrays don't fit its grid"))))
    rows = checked.select("img", "stride", "scale", "boxes", "points", cells.alias("cells"), F.posexplode("scores").alias("i", "score")).where(~F.isnan("score") & (C("score") >= least))
    cell = F.expr(f"i div {anchors}")
    cx, cy = (cell % C("cells")) * C("stride"), F.floor(cell / C("cells")) * C("stride")
    b = lambda k: F.get(C("boxes"), C("i") * 4 + k) * C("stride")
    p = lambda k: F.get(C("points"), C("i") * 10 + k) * C("stride")
    sides = {"x0": cx - b(0), "y0": cy - b(1), "x1": cx + b(2), "y1": cy + b(3)}
    marks = F.array(*[F.struct(((cx + p(2 * k)) / C("scale")).alias("x"), ((cy + p(2 * k + 1)) / C("scale")).alias("y")) for k in range(5)])
    out = rows.select("img", "stride", C("i").alias("anchor"), "score", *[(v / C("scale")).alias(k) for k, v in sides.items()], marks.alias("points"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    for s in sides:
        out = out.where(finite(C(s)))
    return out.where(F.forall("points", lambda q: finite(q["x"]) & finite(q["y"])))


def usable(boxes: DataFrame, w: Column, h: Column, least_side: float) -> DataFrame:
    """Boxes clipped to their image, without those that are then too small."""
    clip = lambda c, most: F.greatest(F.lit(0.0), F.least(C(c), most.cast("double")))
    b = boxes.withColumns({"x0": clip("x0", w), "y0": clip("y0", h), "x1": clip("x1", w), "y1": clip("y1", h)})
    return b.where((F.least(C("x1") - C("x0"), C("y1") - C("y0")) >= least_side) & ((C("x1") - C("x0")) * (C("y1") - C("y0")) > 0))
