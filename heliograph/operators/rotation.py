"""Rotation of a pool over time slots: seeded permutations one after the other, without an item after itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def rotation(pool: DataFrame, key: str, item: str, slots: int, seed: Column) -> DataFrame:
    """key, slot (from 0), item of pool(key, item): ``slots`` of them for each key.

    A pool of at least as many items gives the first ones of one permutation. A smaller one is permuted anew as often as needed; where a permutation
    would start with the item before it, its first two items change places. So any ``n`` slots from a multiple of n on hold each item once. Order is by the hash of the
    seed, the number of the permutation and the item. Of two items the permutations alternate; a single one has all slots.
    """
    counts = pool.groupBy(key).agg(F.count("*").alias("n"))
    rows = pool.join(counts, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.lit(slots) - 1) / F.least(C("n"), F.lit(slots))).cast("int"))))
    which = F.when(C("n") == 2, F.lit(0)).otherwise(C("block"))
    rows = rows.withColumn("h", F.sha2(F.concat_ws("|", seed, C(key).cast("string"), which.cast("string"), C(item).cast("string")), 256))
    r = F.row_number().over(Window.partitionBy(key, "block").orderBy("h", item))
    rows = rows.withColumn("r", r).where(C("r") <= slots)  # of a large pool only the first ones leave a task
    # from here on a key has fewer than twice as many rows as slots
    before = F.lag(item).over(Window.partitionBy(key).orderBy("block", "r"))
    clash = rows.withColumn("clash", (C("r") == 1) & (C("block") > 0) & (C("n") > 1) & before.eqNullSafe(C(item)))
    clash = clash.withColumn("swap", F.bool_or("clash").over(Window.partitionBy(key, "block")))
    place = F.when(C("swap") & (C("r") <= 2), 3 - C("r")).otherwise(C("r"))
    out = clash.withColumn("slot", (C("block") * C("n") + place - 1).cast("int")).where(C("slot") < slots)
    return out.select(key, "slot", item)
