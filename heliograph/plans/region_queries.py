"""The plan of boxes that a request writes (inventory L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.operators import regions as R
from heliograph.plans.registry import query
from heliograph.session import read_table

c = F.col


def boxes(spark, d):
    """The order lines as boxes of three roles, dealt by picture: regions; claims and wanted boxes lie a little beside some of them, or elsewhere."""
    li = read_table(spark, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").cast("long").alias("i"), c("l_quantity").alias("q"), c("l_suppkey").alias("s"), c("l_partkey").alias("p"), c("l_returnflag").alias("f"))
    li = li.repartition("k").groupBy("k", "i").agg(*[F.min(x).alias(x) for x in "qspf"])
    name = lambda m: F.concat(F.lit("N"), ((c("s") + m) % 3).cast("string")).alias("name")
    left = F.round(c("q") / 60, 4)
    sides = lambda dx: [F.round(left + dx, 4).alias("x"), F.lit(0.5).alias("y"), F.lit(0.2).alias("w"), F.lit(0.3).alias("h")]
    as_box = lambda role, dx, m, kind=None: F.struct(F.lit(role).alias("role"), "i", *sides(dx), F.lit(kind).cast("string").alias("kind") if kind is None else kind.alias("kind"), name(m))
    region = as_box(R.REGION, 0.0, 0, F.when(c("p") % 7 != 0, "Face"))
    claim = F.when(c("f") != "N", as_box(R.CLAIM, F.lit(0.004) * (c("p") % 4), 0))
    wanted = F.when(c("p") % 3 != 0, as_box(R.WANTED, F.lit(0.01) * (c("p") % 5) * (c("i") % 2), F.when(c("p") % 2 == 0, 0).otherwise(1)))
    return li.select("k", F.explode(F.array(region, claim, wanted)).alias("b")).where("b is not null").select("k", "b.*")


def asked(spark, d):
    """A request for each picture."""
    some = F.when(c("k") % 3 == 0, F.array(F.lit("N0"))).when(c("k") % 3 == 1, F.array().cast("array<string>"))
    k = read_table(spark, d, "lineitem").select(c("l_orderkey").alias("k")).distinct()
    return k.select("k", F.array(F.concat(F.lit("N"), (c("k") % 3).cast("string"))).alias("people"), some.alias("retracting"))


def tables(spark, d):
    """regions, claims, wanted, requests."""
    b = boxes(spark, d)
    return *[b.where(c("role") == r).drop("role") for r in (R.REGION, R.CLAIM, R.WANTED)], asked(spark, d)


@query("L3_region_plan")
def l3(spark, d):
    """Its test holds it against a plain loop over each picture."""
    return R.plan_of_boxes(boxes(spark, d), asked(spark, d))
