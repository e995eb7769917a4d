"""Upkeep of a library: scans against a cache, snapshots, enrichment, queue marks, clusters after edits, people, prompts, suggestions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import text as X
from heliograph.operators import edits as E
from heliograph.operators import scan as SC
from heliograph.operators import tags as T
from heliograph.operators import vectors as V

C = F.col


def scan(listing: DataFrame, cache: DataFrame, failed: DataFrame) -> DataFrame:
    """dir, name, kind, live, sidecar, status of listing(dir, name, size) against cache(dir, name, size).

    status: added, changed (another size), same; removed for what the cache has and the listing lacks, but carried in folders of failed(dir), which couldn't be
    read. Hidden files and those of no kind are left out. An image has the first video of its stem as ``live`` and a sidecar of its name or stem.
    """
    now = listing.join(failed, "dir", "left_anti").withColumns({"kind": SC.kind(C("name")), "stem": SC.stem(C("name"))}).where("kind <> 'skipped'")
    live = now.where("kind = 'video'").groupBy("dir", "stem").agg(F.min("name").alias("live"))
    side = now.where("kind = 'sidecar'").groupBy("dir", "stem").agg(F.min("name").alias("sidecar"))
    whole = side.select("dir", C("stem").alias("low"), C("sidecar").alias("own"))
    rows = now.withColumn("low", F.lower("name")).join(live, ["dir", "stem"], "left").join(side, ["dir", "stem"], "left").join(whole, ["dir", "low"], "left")
    image = C("kind") == "image"
    rows = rows.select("dir", "name", "size", "kind", F.when(image, C("live")).alias("live"), F.when(image, F.coalesce("own", "sidecar")).alias("sidecar"))
    was = cache.select("dir", "name", C("size").alias("was"), F.lit(True).alias("cached"))
    j = rows.withColumn("there", F.lit(True)).join(was, ["dir", "name"], "full")
    lost = failed.select("dir", F.lit(True).alias("lost"))
    status = F.when(C("there") & C("cached"), F.when(C("size").eqNullSafe(C("was")), "same").otherwise("changed")).when(C("there"), "added").when(C("lost"), "carried").otherwise("removed")
    return j.join(lost, "dir", "left").select("dir", "name", F.coalesce("kind", SC.kind(C("name"))).alias("kind"), "live", "sidecar", status.alias("status"))


def snapshot_version(text: Column) -> Column:
    """The version of a snapshot's text; null if the text is no document with a whole number there."""
    return F.get_json_object(text, "$.version").try_cast("long")


def load_snapshot(snapshots: DataFrame, text: str, version: int, schema: str) -> DataFrame:
    """snapshots with status and value: ``ok`` with the value of this version; ``mismatch`` for another version, whatever its value looks like; ``corrupt`` for what can't be read.

    The version is asked first, so a value of an older form is never parsed.
    """
    found = snapshot_version(C(text))
    value = F.when(found == version, F.from_json(F.get_json_object(C(text), "$.value"), schema, {"mode": "PERMISSIVE"}))
    out = snapshots.withColumns({"__v": found, "value": value})
    status = F.when(C("__v").isNull(), "corrupt").when(C("__v") != version, "mismatch").when(C("value").isNull(), "corrupt").otherwise("ok")
    return out.withColumn("status", status).drop("__v")


def resolved(succeeded: Column, read: Column, existing: Column) -> Column:
    """A read that succeeded replaces the value, also by nothing; a failed one leaves it."""
    return F.when(F.coalesce(succeeded, F.lit(False)), read).otherwise(existing)


def enrich(photos: DataFrame, reads: DataFrame, fields: list[str]) -> DataFrame:
    """photos with ``fields`` from reads(id, succeeded, at, fields...) and ``outcome``: only rows without ``enriched_at`` are looked at; they get it, whether or not their sidecar could be read."""
    r = reads.select("id", "succeeded", "at", *[C(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__read"))
    j = photos.join(r, "id", "left")
    open_ = C("enriched_at").isNull() & C("__read").isNotNull()
    outcome = F.when(C("enriched_at").isNotNull(), "done").when(C("__read").isNull(), "unread").when(C("succeeded"), "enriched").otherwise("failed")
    new = {f: F.when(open_, resolved(C("succeeded"), C(f"__{f}"), C(f))).otherwise(C(f)) for f in fields}
    j = j.withColumns({"outcome": outcome, **new})
    return j.withColumn("enriched_at", F.when(open_, C("at")).otherwise(C("enriched_at"))).select(*photos.columns, "outcome")


def mark_stale(queue: DataFrame, pack: int | None = None, listing: DataFrame | None = None) -> DataFrame:
    """queue(item, state, pack, stat) whose done rows become stale: those of another pack and, with a listing(item, stat), those whose stat is another one now. Items that the listing lacks stay."""
    stale = F.lit(False)
    q = queue
    if pack is not None:
        stale = ~C("pack").eqNullSafe(F.lit(pack))
    if listing is not None:
        q = q.join(listing.select("item", C("stat").alias("__now"), F.lit(True).alias("__there")), "item", "left")
        stale = stale | (C("__there").isNotNull() & ~C("stat").eqNullSafe(C("__now")))
    return q.withColumn("state", F.when((C("state") == "done") & stale, "stale").otherwise(C("state"))).drop("__now", "__there")


def already_current(state: Column, stamp: Column, pack: int, force: bool = False) -> Column:
    """Whether work may be passed over: nobody forces it, it isn't stale, and its sidecar bears this pack's stamp."""
    return F.lit(not force) & (state != "stale") & stamp.eqNullSafe(F.lit(pack))


def ml_eligible(is_video: Column, is_remote: Column, is_downloaded: Column) -> Column:
    """Stills that are on this machine."""
    return ~is_video & (~is_remote | is_downloaded)


def refresh_plan(written: DataFrame, path: str) -> DataFrame:
    """place, path: each written path once, in order, by a range sort."""
    return E.ranked(written.select(path).where(C(path).isNotNull()).distinct(), C(path)).select(C("rank").cast("long").alias("place"), path)


def centres(members: DataFrame, cluster: str, vector: str) -> DataFrame:
    """cluster, dim, n, x: the mean of each dimension."""
    m = V.centroids(members, cluster, vector)
    return m.join(members.groupBy(cluster).agg(F.count("*").alias("n")), cluster).select(cluster, "dim", "n", C("mean").alias("x"))


def merge_clusters(members: DataFrame, clusters: DataFrame, into: int, gone: list[int], vector: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, clusters with new centres and pins, pictures and the names that their sidecars lose) after clusters of ``gone`` go into one.

    members(cluster, picture, vector), clusters(cluster, name, pinned). A name is retracted where it differs from the survivor's, from every picture of its cluster.
    """
    gone = [g for g in gone if g != into]
    moved = E.move(members, into, gone)
    own = clusters.where(C("cluster") == into).select(C("name").alias("__own"))
    lost = clusters.where(C("cluster").isin(gone) & C("name").isNotNull()).join(F.broadcast(own), ~C("name").eqNullSafe(C("__own")))  # one row
    retracted = members.join(lost.select("cluster", "name"), "cluster").select("picture", "name").distinct()
    left = clusters.where(~C("cluster").isin(gone)).withColumn("pinned", C("pinned") | (C("cluster") == into))
    return moved, left.join(centres(moved, "cluster", vector), "cluster"), retracted


def split_cluster(members: DataFrame, cluster: int, chosen: DataFrame, next_id: int, vector: str) -> tuple[DataFrame, DataFrame]:
    """(members, cluster, dim, n, x, pinned of all clusters) after the chosen(picture) members of a cluster become a new, pinned one with the next id."""
    c = chosen.select("picture", F.lit(True).alias("__chosen")).distinct()
    m = members.join(c, "picture", "left").withColumn("cluster", F.when((C("cluster") == cluster) & C("__chosen"), F.lit(next_id)).otherwise(C("cluster")).cast("long")).drop("__chosen")
    return m, centres(m, "cluster", vector).withColumn("pinned", C("cluster") == next_id)


def reset_results(tables: dict[str, DataFrame], counter: int, ids: DataFrame) -> tuple[dict[str, DataFrame], int]:
    """(the tables without rows, the id that the next cluster gets): ids(id) that were given are never given again."""
    most = ids.agg(F.max("id")).first()[0]
    return {n: t.limit(0) for n, t in tables.items()}, max(counter, -1 if most is None else most) + 1


def visible_people(people: DataFrame, featured: DataFrame, hidden: DataFrame, now: dt.datetime | None = None, most: int | None = None, years: int = 2) -> DataFrame:
    """person, n, place of people(person, n, latest) that aren't hidden: featured(person, at) first, in their order, then by number of photos.

    With ``now``, others than featured ones need a photo of the last two years. ``most`` is the feature's cap.
    """
    p = people.join(hidden, "person", "left_anti").join(featured, "person", "left")
    if now is not None:
        p = p.where(C("at").isNotNull() | (C("latest") >= F.add_months(F.lit(now.date()), -12 * years).cast("timestamp_ntz")))
    order = [C("at").asc_nulls_last(), F.desc("n"), C("person")]
    if most is not None:
        p = p.orderBy(*order).limit(most)
    return E.ranked(p, *order).select("person", "n", C("rank").cast("long").alias("place"))


def featured_photo(photos: DataFrame, pinned: DataFrame) -> DataFrame:
    """person, id of photos(id, date_taken, tags): the pinned(person, id) photo if the person is on it, else the newest of those with nobody else, else the newest."""
    people = F.array_distinct(F.filter("tags", lambda t: F.lower(T.namespace(t)) == "people"))
    p = photos.select("id", "date_taken", people.alias("p")).select("id", "date_taken", (F.size("p") == 1).alias("alone"), F.explode("p").alias("person"))
    j = p.join(pinned.select("person", "id", F.lit(True).alias("pin")), ["person", "id"], "left")
    best = F.max_by("id", F.struct(C("pin").isNotNull().alias("a"), C("alone"), C("date_taken").isNotNull().alias("b"), "date_taken", (-C("id")).alias("c")))
    return j.groupBy("person").agg(best.alias("id"))


def name_suggestions(typed: DataFrame, library: DataFrame, contacts: DataFrame, most: int = 8) -> DataFrame:
    """q, place, name, score for each text of typed(q), a stated set: names of library(name) and contacts(name, linked) that start with it (300), have a word that does (200) or hold it (50).

    Case and accents don't matter. A library's name comes before a contact's of the same score; linked contacts, and contacts of a name that the library has, are left out.
    """
    key = X.collated(C("name"))
    own = library.select("name", F.lit(0).alias("of"))
    more = contacts.where(~C("linked")).select("name").withColumn("k", key).join(library.select(key.alias("k")).distinct(), "k", "left_anti").select("name", F.lit(1).alias("of"))
    plain = lambda x: F.lower(x)
    j = own.unionByName(more).join(F.broadcast(typed.select("q", plain(F.trim("q")).alias("t"))), F.contains(plain(C("name")), C("t")))
    score = F.when(F.startswith(plain(C("name")), C("t")), 300).when(F.contains(plain(C("name")), F.concat(F.lit(" "), C("t"))), 200).otherwise(50)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "of", key, "name")
    r = j.where("t <> ''").withColumn("score", score).withColumn("place", F.row_number().over(w))
    return r.where(C("place") <= most).select("q", "place", "name", "score")


def prompts(paths: DataFrame, overrides: DataFrame) -> DataFrame:
    """path, prompt: that of overrides(path, prompt), else ``a photo of a`` and the last segment, with its parent where several paths end alike."""
    p = paths.select("path").distinct().withColumn("parts", T.parts(C("path"))).withColumn("leaf", F.lower(F.try_element_at("parts", F.lit(-1))))
    twice = p.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf", F.lit(True).alias("twice"))
    j = p.join(twice, "leaf", "left").join(overrides.withColumnRenamed("prompt", "own"), "path", "left")
    made = F.concat(F.lit("a photo of "), F.when(C("leaf").rlike("^[aeiou]"), "an ").otherwise("a "), "leaf", F.when(C("twice") & (F.size("parts") > 1), F.concat(F.lit(", a kind of "), F.lower(F.get("parts", F.size("parts") - 2)))).otherwise(""))
    return j.select("path", F.coalesce("own", made).alias("prompt"))


def event_folders(photos: DataFrame) -> DataFrame:
    """folder, n, newest, place of photos(folder, date_taken): folders with photos of their own and no folder below them, newest first."""
    g = photos.groupBy("folder").agg(F.count("*").alias("n"), F.max("date_taken").alias("newest"))
    above = g.select(F.explode(F.slice(SC.ancestors(C("folder")), F.lit(1), F.greatest(F.size(SC.ancestors(C("folder"))) - 1, F.lit(0)))).alias("folder")).distinct()
    leaves = g.join(above, "folder", "left_anti")
    return E.ranked(leaves, C("newest").desc_nulls_last(), C("folder")).select("folder", "n", "newest", C("rank").cast("long").alias("place"))
