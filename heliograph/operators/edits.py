"""Ownership-aware plans for people, projections and decisions; cluster edits; queue states; overlap of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.session import settled

C = F.col


def leaf(tag: Column) -> Column:
    return F.substring_index(tag, "/", -1)


def in_order(xs: Column) -> Column:
    return F.array_sort(F.array_distinct(xs))


def without(xs: Column, gone: Column) -> Column:
    return F.filter(xs, lambda x: ~F.array_contains(gone, x))


def low(xs: Column) -> Column:
    return F.transform(xs, F.lower)


def speaks_for(name: Column, people: Column, retracting: Column) -> Column:
    """A complete request (retracting null) speaks for everyone, a partial one for those it names or takes back."""
    return retracting.isNull() | F.array_contains(F.coalesce(retracting, F.array().cast("array<string>")), name) | F.array_contains(people, name)


def people_plan(df: DataFrame) -> DataFrame:
    """df(tags_list, owned, people, retracting) with to_add, to_remove and owned_after of People tags."""
    wanted = F.transform("people", lambda x: F.concat(F.lit("People/"), x))
    df = df.withColumn("to_add", without(wanted, C("tags_list")))
    df = df.withColumn("to_remove", in_order(F.filter("owned", lambda t: ~F.array_contains(wanted, t) & speaks_for(leaf(t), C("people"), C("retracting")))))
    return df.withColumn("owned_after", in_order(F.concat(without(C("owned"), C("to_remove")), C("to_add"))))


def surviving_people(df: DataFrame) -> Column:
    """People tags of the list that stay, in its order, then the added ones."""
    return F.concat(without(F.filter("tags_list", lambda t: F.startswith(t, F.lit("People/"))), C("to_remove")), C("to_add"))


def subject_plan(df: DataFrame) -> DataFrame:
    """A people plan with (existing) subjects, those claimed for people and those of the tagger: subject_add, subject_remove, subject_owned."""
    kept = low(F.transform(surviving_people(df), leaf))
    df = df.withColumn("subject_remove", in_order(F.filter("people_subjects", lambda s: ~F.array_contains(kept, F.lower(s)) & ~F.array_contains(low(C("tagger_subjects")), F.lower(s)))))
    leaves = F.transform("to_add", leaf)
    fresh = F.filter(leaves, lambda x, i: ~F.array_contains(low(C("subjects")), F.lower(x)) & ~F.exists(F.slice(leaves, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    df = df.withColumn("subject_add", F.array_sort(fresh))
    stay = F.filter("people_subjects", lambda s: ~F.array_contains(low(C("subject_remove")), F.lower(s)))
    return df.withColumn("subject_owned", in_order(F.concat(stay, C("subject_add"))))


def image_people(df: DataFrame) -> DataFrame:
    """A people plan with person_in_image: its new list (null if it stays) and, with nobody left, the names to take out."""
    leaves = F.filter(F.transform(surviving_people(df), leaf), lambda x: x != "")
    first = F.filter(leaves, lambda x, i: ~F.exists(F.slice(leaves, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    df = df.withColumn("__new", first)
    gone = in_order(F.filter(F.transform("to_remove", leaf), lambda x: F.array_contains(low(C("person_in_image")), F.lower(x))))
    some = F.size("__new") > 0
    df = df.withColumn("image_list", F.when(some & (C("__new") != C("person_in_image")), C("__new")))
    return df.withColumn("image_remove", F.when(some, F.array().cast("array<string>")).otherwise(gone)).drop("__new")


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two areas given by centre and size (x, y, w, h)."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s] / 2, b[p] + b[s] / 2) - F.greatest(a[p] - a[s] / 2, b[p] - b[s] / 2))
    inter = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def box_overlap(a: Column, b: Column) -> Column:
    """The same for boxes given by corners (x0, y0, x1, y1)."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    inter = side("x0", "x1") * side("y0", "y1")
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def superseded(existing: Column, wanted: Column, people: Column, retracting: Column) -> Column:
    """Whether a decision gives way: a wanted one covers its place, or the request may speak for it."""
    covered = F.exists(wanted, lambda w: overlap(w, existing) > 0.5)
    return covered | F.when(existing["kind"] == "named", speaks_for(existing["name"], people, retracting)).otherwise(retracting.isNull())


def decision_plan(df: DataFrame, text) -> Column:
    """The claims (by text) of df(decisions, wanted, people, retracting) that are owned afterwards; as they are if nothing is wanted (null)."""
    kept = F.filter("decisions", lambda e: ~superseded(e, C("wanted"), C("people"), C("retracting")))
    after = in_order(F.concat(F.transform(kept, text), F.transform("wanted", text)))
    return F.when(C("wanted").isNull(), F.transform("decisions", text)).otherwise(after)


def merge_direction(a: str, b: str) -> Column:
    """The survivor of clusters a and b (columns <c>_id, <c>_name, <c>_size): named, then larger, then of less id; null for one and the same."""
    named = lambda x: F.coalesce(F.trim(C(f"{x}_name")) != "", F.lit(False))
    rank = lambda x: F.struct((~named(x)).alias("n"), (-C(f"{x}_size")).alias("s"), C(f"{x}_id").alias("i"))
    return F.when(C(f"{a}_id") != C(f"{b}_id"), F.when(rank(a) < rank(b), C(f"{a}_id")).otherwise(C(f"{b}_id")))


def apply_naming(clusters: DataFrame, orders: DataFrame) -> DataFrame:
    """clusters(id, name, state, pinned) after orders(id, verb, new_name), and ``retracts``: the name that sidecars lose.

    name sets state named; unname, ignore and reject clear the name and set unlabeled, ignored or rejected; unname unpins.
    """
    to = {"name": "named", "unname": "unlabeled", "ignore": "ignored", "reject": "rejected"}
    j = clusters.join(orders, "id", "left")
    state = C("state")
    for verb, s in to.items():
        state = F.when(C("verb") == verb, F.lit(s)).otherwise(state)
    name = F.when(C("verb").isNull(), C("name")).when(C("verb") == "name", C("new_name"))
    retracts = F.when(C("verb").isNotNull() & ~C("name").eqNullSafe(name), C("name"))
    return j.select("id", name.alias("name"), state.alias("state"), (C("pinned") & ~C("verb").eqNullSafe(F.lit("unname"))).alias("pinned"), retracts.alias("retracts"))


def move(members: DataFrame, into: int, gone: list[int]) -> DataFrame:
    """members with the clusters of gone merged into one."""
    return members.withColumn("cluster", F.when(C("cluster").isin(gone), F.lit(into)).otherwise(C("cluster")))


def reclaim(state: Column) -> Column:
    """Work that was begun and abandoned waits again."""
    return F.when(state == "hashing", "pending").otherwise(state)


def queue_stats(queue: DataFrame, most_retries: int) -> DataFrame:
    """done, pending (waiting, begun, stale or to be tried again), failed (for good), skipped: one row."""
    again = (C("state") == "failed") & (C("retries") < most_retries)
    count = lambda x, name: F.count_if(x).alias(name)
    return queue.agg(count(C("state") == "done", "done"), count(C("state").isin("pending", "hashing", "stale") | again, "pending"), count((C("state") == "failed") & ~again, "failed"), count(C("state") == "skipped", "skipped"))


def greedy_pairs(pairs: DataFrame, key: str, a: str, b: str, score: str, first_come: bool = False) -> DataFrame:
    """One-to-one pairs within each key, best first (ties by a, then b): the greedy choice. first_come: each a in its order chooses the best b that is left.

    A pair that is the best of both its ends is one that the greedy choice takes. So rounds of mutual bests, with a checkpoint each,
    give the same pairs; the most that a round leaves is what waited for a better pair of its ends. Needs a strict order of pairs. Where each a chooses in turn, b's
    best pair is that of the first a that could take it.
    """
    taken, left = None, pairs.checkpoint()
    while not left.isEmpty():
        best = lambda e: F.row_number().over(Window.partitionBy(key, e).orderBy(*([a] if first_come and e == b else [F.desc(score), a, b]))) == 1
        now = left.withColumns({"__a": best(a), "__b": best(b)}).where("__a and __b").drop("__a", "__b").checkpoint()
        taken = now if taken is None else taken.unionByName(now)
        left = left.join(now.select(key, a), [key, a], "left_anti").join(now.select(key, b), [key, b], "left_anti").checkpoint()
    return pairs.limit(0) if taken is None else taken


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with its rank in a total order: rows are dealt by range and sorted, and each partition is told how many rows stand before it.

    Only a row per partition meets in one place.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = settled(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    parts = dealt.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__from"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", "__from", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
    out = dealt.join(F.broadcast(parts), "__part")  # a row per partition
    return out.withColumn("rank", C("__at") - C("__from") + C("__before") + 1).drop("__part", "__at", "__from", "__before")
