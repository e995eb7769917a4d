"""Snapshots, ownership-aware set plans and queue states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key, change of every row of either snapshot: added, removed, modified or unchanged. One full outer join."""
    o = old.select(key, *[F.col(f).alias(f"o_{f}") for f in fields], F.lit(True).alias("o_has"))
    n = new.select(key, *[F.col(f).alias(f"n_{f}") for f in fields], F.lit(True).alias("n_has"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}"))
    change = F.when(F.col("o_has").isNull(), "added").when(F.col("n_has").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def same_content(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Identifiers a and b decide when both are present, x and y when neither is; otherwise the contents differ."""
    return F.when(a.isNotNull() & b.isNotNull(), a == b).when(a.isNull() & b.isNull(), x.eqNullSafe(y)).otherwise(False)


def ownership_plan(requested: DataFrame, owned: DataFrame, existing: DataFrame) -> DataFrame:
    """id, v, action, owned_after for sets of (id, v).

    Requested values that aren't there are added; only owned values that are no longer requested are removed; afterwards the
    requested ones among the owned and the added are owned. One grouping of the three sets, so no join.
    """
    tag = lambda df, name: df.select("id", "v", *[F.lit(name == x).alias(x) for x in ("r", "o", "h")])
    every = tag(requested, "r").unionByName(tag(owned, "o")).unionByName(tag(existing, "h"))
    f = every.groupBy("id", "v").agg(*[F.bool_or(x).alias(x) for x in ("r", "o", "h")])
    action = F.when(F.expr("r and not h"), "add").when(F.expr("o and not r"), "remove").otherwise("keep")
    return f.select("id", "v", action.alias("action"), F.expr("r and (o or not h)").alias("owned_after"))


def advance(queue: DataFrame, pack: int, most_retries: int) -> DataFrame:
    """item and its next state: claimable items start, done ones of another pack go stale, the rest stay."""
    s = F.col("state")
    claim = (s == "pending") | ((s == "failed") & (F.col("retries") < most_retries))
    return queue.select("item", F.when(claim, "hashing").when((s == "done") & (F.col("pack") != pack), "stale").otherwise(s).alias("state"))


def insert_if_absent(queue: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """queue and a pending row for each item that it lacks."""
    return queue.unionByName(items.distinct().join(queue, key, "left_anti").withColumn("state", F.lit("pending")))
