"""Runs in ordered sequences, split by ranges: a key that holds most rows is spread over all tasks.

Rows are dealt by ranges of (key, order) and sorted, so a partition holds consecutive rows. Windows run within (partition, key) only. What
a partition must know of those before it, the last row and the number of runs so far, comes from a table of one row per partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.session import settled

C = F.col


def with_previous(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """df with ``__prev``, the values of the row before within its key (null for the first one), and ``__part``, ``__at``, ``__head``, ``__tail``."""
    d = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    d = settled(d.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    value = F.struct(*values)
    ends = d.groupBy("__part").agg(F.min_by(F.struct(C(key).alias("k")), "__at").alias("__head"), F.max_by(F.struct(C(key).alias("k")), "__at").alias("__tail"), F.max_by(value, "__at").alias("__last"))
    w = Window.orderBy("__part")  # a row per partition
    joined = F.lag("__tail").over(w).eqNullSafe(C("__head"))
    ends = ends.select("__part", "__head", "__tail", F.when(joined, F.lag("__last").over(w)).alias("__before"))
    inner = F.lag(value).over(Window.partitionBy("__part", key).orderBy("__at"))
    head = F.struct(C(key).alias("k")).eqNullSafe(C("__head"))
    return d.join(F.broadcast(ends), "__part").withColumn("__prev", F.coalesce(inner, F.when(head, C("__before")))).drop("__before")


def runs(df: DataFrame, key: str, order: list[str], values: list[str], starts: Callable[[Callable[[str], Column], Column], Column]) -> DataFrame:
    """df with ``run``: how many rows of its key, up to this one in order, start a run.

    starts(prev, first) tells whether a row does, from prev(name), the value in the row before, and first, whether there is none.
    """
    p = with_previous(df, key, order, values)
    p = p.withColumn("__s", F.when(starts(lambda c: C(f"__prev.{c}"), C("__prev").isNull()), 1).otherwise(0))
    own = F.struct(C(key).alias("k"))
    tails = p.where(own.eqNullSafe(C("__tail"))).groupBy("__part").agg(F.first("__tail").alias("k"), F.sum("__s").alias("s")).select("__part", "k", F.lit(1).alias("end"), "s")
    heads = p.groupBy("__part").agg(F.first("__head").alias("k")).select("__part", "k", F.lit(0).alias("end"), F.lit(None).cast("long").alias("s"))
    w = Window.partitionBy("k").orderBy("__part", "end").rowsBetween(Window.unboundedPreceding, -1)  # two rows per partition
    carry = heads.unionByName(tails).withColumn("__carry", F.coalesce(F.sum("s").over(w), F.lit(0))).where("end = 0").select("__part", "__carry")
    so_far = F.sum("__s").over(Window.partitionBy("__part", key).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    run = so_far + F.when(own.eqNullSafe(C("__head")), C("__carry")).otherwise(0)
    out = p.join(F.broadcast(carry), "__part").withColumn("run", run)
    return out.drop("__part", "__at", "__head", "__tail", "__prev", "__s", "__carry")


def last_before(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with ``out``: the last value that isn't null in the rows before, within the key."""
    p = with_previous(df, key, order, [value])
    own = F.struct(C(key).alias("k"))
    tails = p.where(own.eqNullSafe(C("__tail"))).groupBy("__part").agg(F.first("__tail").alias("k"), F.max_by(value, F.when(C(value).isNotNull(), C("__at"))).alias("s")).select("__part", "k", F.lit(1).alias("end"), "s")
    heads = p.groupBy("__part").agg(F.first("__head").alias("k")).select("__part", "k", F.lit(0).alias("end"), F.lit(None).cast(df.schema[value].dataType).alias("s"))
    w = Window.partitionBy("k").orderBy("__part", "end").rowsBetween(Window.unboundedPreceding, -1)  # two rows per partition
    carry = heads.unionByName(tails).withColumn("__carry", F.last("s", ignorenulls=True).over(w)).where("end = 0").select("__part", "__carry")
    inner = F.last(value, ignorenulls=True).over(Window.partitionBy("__part", key).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    r = p.join(F.broadcast(carry), "__part").withColumn(out, F.coalesce(inner, F.when(own.eqNullSafe(C("__head")), C("__carry"))))
    return r.drop("__part", "__at", "__head", "__tail", "__prev", "__carry")


def gap_over(now: str, prev: Column, seconds: float) -> Column:
    """Whether the row is more than ``seconds`` after the one before."""
    return F.timestamp_diff("MICROSECOND", prev, C(now)) > F.lit(int(seconds * 1_000_000))
