"""Memories by rule: dense days, home regions, folder events, trips, anniversaries; assignment, proposals and calibration of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.operators import vectors as V
from heliograph.operators.pivots import similar_pairs

C = F.col
LEAST_PHOTOS = 15
DEDUP_SECONDS = 60
FEW_CLUSTERS = 10_000  #: so many centroids (a few MB) may be broadcast; more are dealt in blocks


def in_month_of(day: Column, today: str) -> Column:
    return F.date_trunc("month", day) == F.date_trunc("month", F.lit(today).cast("date"))


def density_days(rows: DataFrame, day: str, today: str) -> DataFrame:
    """day, n, score of the days with at least three times the average of days that have any, and 15; not in the current month."""
    days = rows.where(C(day).isNotNull()).groupBy(C(day).alias("day")).agg(F.count("*").alias("n"))
    avg = F.broadcast(days.agg((F.sum("n").cast("double") / F.count("*")).alias("avg")))  # one row
    dense = days.crossJoin(avg).where(C("n") >= F.greatest(F.lit(LEAST_PHOTOS), F.floor(3.0 * C("avg"))))
    return dense.where(~in_month_of(C("day"), today)).select("day", "n", F.lit(8.0).alias("score"))


def home_regions(geo: DataFrame, most_span: int = 180, least_span: int = 30, most_days: int = 30, least_days: int = 10) -> DataFrame:
    """Cells (cy, cx) of geo(cy, cx, day), and those around them, that are used over a long enough span and on enough days.

    Thresholds follow the whole table: half its span and a quarter of its days, within the given bounds.
    """
    span = F.datediff(F.max("day"), F.min("day"))
    cells = geo.groupBy("cy", "cx").agg(F.countDistinct("day").alias("days"), span.alias("span"))
    whole = geo.groupBy("day").agg(F.lit(1)).agg(F.count("*").alias("all_days"), span.alias("all_span"))
    need = cells.crossJoin(F.broadcast(whole))  # one row
    home = need.where((C("span") >= F.least(F.lit(most_span), F.greatest(F.lit(least_span), F.expr("all_span div 2")))) & (C("days") >= F.least(F.lit(most_days), F.greatest(F.lit(least_days), F.expr("all_days div 4")))))
    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return home.select("cy", "cx", F.explode(ring).alias("r")).select((C("cy") + C("r.i")).alias("cy"), (C("cx") + C("r.j")).alias("cx")).distinct()


def best_scores(rows: DataFrame, centroids: DataFrame, key: str, vector: str) -> DataFrame:
    """key, named, s, label: the best centroid(label, centroid, named) of either kind for each row; ties go to the least label.

    Up to FEW_CLUSTERS centroids are broadcast. More are dealt into that many blocks as it takes: each row goes to every block, its best of a
    block leaves it, so a task holds one block and the shuffle carries rows times blocks, not pairs.
    """
    n = centroids.count()
    score = V.dot(C(vector), C("centroid"))
    best = F.max(F.struct(score.alias("s"), (-C("label")).alias("l"))).alias("b")
    if n <= FEW_CLUSTERS:
        some = rows.select(key, vector).crossJoin(F.broadcast(centroids)).groupBy(key, "named").agg(best)
    else:
        blocks = -(-n // FEW_CLUSTERS)
        dealt = centroids.withColumn("block", F.pmod(F.xxhash64("label"), F.lit(blocks)))
        copies = rows.select(key, vector, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        some = copies.join(dealt, "block").groupBy(key, "named").agg(best)
    return some.select(key, "named", C("b.s").alias("s"), (-C("b.l")).alias("label"))


def assign(rows: DataFrame, centroids: DataFrame, key: str, vector: str, auto: float, join: float) -> DataFrame:
    """key, tier, cluster: the best named cluster from ``auto`` on, or else the best other one from ``join`` on, or else a new seed."""
    pick = lambda named, x: F.max(F.when(C("named") == F.lit(named), C(x)))
    g = best_scores(rows, centroids, key, vector).groupBy(key).agg(pick(True, "s").alias("sn"), pick(True, "label").alias("ln"), pick(False, "s").alias("so"), pick(False, "label").alias("lo"))
    a, b = F.coalesce(C("sn") >= auto, F.lit(False)), F.coalesce(C("so") >= join, F.lit(False))
    return g.select(key, F.when(a, "auto").when(b, "join").otherwise("seed").alias("tier"), F.when(a, C("ln")).when(b, C("lo")).alias("cluster"))


def proposals(centroids: DataFrame, label: str, vector: str, least: float) -> DataFrame:
    """a, b, sim of the pairs of (unit) centroids that are alike enough: an exact join that skips what the triangle inequality rules out."""
    kind = centroids.schema[label].dataType
    p = similar_pairs(centroids.select(C(label).cast("long").alias("id"), C(vector).alias("v")), least)
    return p.select(C("a").cast(kind).alias("a"), C("b").cast(kind).alias("b"), "sim")


def calibrate(rows: DataFrame, centroids: DataFrame, grid: list[float]) -> DataFrame:
    """label, least, taken, right_ones, bias, best of rows(truth, embedding) against the centroids of a label set, the stated query set.

    Up to FEW_CLUSTERS labels are broadcast; more are dealt into blocks, each row goes to every block, and sums per label leave a task.
    """
    n = centroids.count()
    if n <= FEW_CLUSTERS:
        pairs = rows.crossJoin(F.broadcast(centroids))
    else:
        blocks = -(-n // FEW_CLUSTERS)
        dealt = centroids.withColumn("block", F.pmod(F.xxhash64("label"), F.lit(blocks)))
        pairs = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "block")
    s = pairs.select("truth", "label", F.round(V.dot(C("embedding"), C("centroid")), 9).alias("q"))
    took = lambda t: F.struct(F.lit(t).alias("least"), F.count_if(C("q") >= t).alias("taken"), F.count_if((C("q") >= t) & (C("truth") == C("label"))).alias("right_ones"))
    g = s.groupBy("label").agg(F.array(*map(took, grid)).alias("g"), F.round(F.avg("q"), 6).alias("bias"), F.max("q").alias("best"))
    return g.select("label", F.explode("g").alias("g"), "bias", "best").select("label", "g.least", "g.taken", "g.right_ones", "bias", "best")


def sidecar_of(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """dir, name, sidecar: that of the whole name first, then that of the stem; the case doesn't matter, and the least name wins."""
    x = sidecars.groupBy("dir", F.lower(F.regexp_replace("name", r"\.[^.]*$", "")).alias("base")).agg(F.min("name").alias("x"))
    full = x.select("dir", C("base").alias("__full"), C("x").alias("__f"))
    stem = x.select("dir", C("base").alias("__stem"), C("x").alias("__s"))
    i = images.withColumns({"__full": F.lower("name"), "__stem": F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))})
    return i.join(full, ["dir", "__full"], "left").join(stem, ["dir", "__stem"], "left").select("dir", "name", F.coalesce("__f", "__s").alias("sidecar"))
