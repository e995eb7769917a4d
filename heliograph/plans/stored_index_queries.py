"""The stored tag index: built, updated by changes, searched (inventory N1, N2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.operators import tag_index as I
from heliograph.plans.index_queries import WITH
from heliograph.plans.registry import query
from heliograph.session import scratch_folder
from heliograph.sources.adapters import photos

c = F.col


def _index(spark, d):
    return I.build(photos(spark, d), scratch_folder(spark, "tag-index"))


@query("N1_index_build", WITH + "SELECT key, count(*) AS n, max(date_taken) AS latest FROM keyed GROUP BY key")
def n1(spark, d):
    return _index(spark, d).suggestions()


def _before(spark, d):
    """The library as it was: photos of every fifth id weren't there, every third one had other tags, and there were more of user 1."""
    p = photos(spark, d)
    old = p.where("id % 5 <> 0").withColumn("tags", F.when(c("id") % 3 == 0, F.array(F.lit("Mood"), F.lit("Places/Old/Town/Square"))).otherwise(c("tags")))
    return old.unionByName(p.where("user_id = 1").withColumn("id", -c("id") - 1))


@query("N1_index_update", WITH + "SELECT key, count(*) AS n, max(date_taken) AS latest FROM keyed GROUP BY key")
def n1b(spark, d):
    """An index of the old library, updated by the difference of the two: as if it were built from the new one."""
    old, new = _before(spark, d), photos(spark, d)
    index = I.build(old, scratch_folder(spark, "tag-index"))
    same = ["id", "filename", "date_taken", "tags"]
    before, after = old.select(same).exceptAll(new.select(same)), new.select(same).exceptAll(old.select(same))
    return index.update(before, after).suggestions()


@query("N1_index_terms", WITH + ", x AS (SELECT DISTINCT id, lower(tag) AS key FROM tagged) SELECT k.key, count(*) AS n, count(x.id) AS exact FROM keyed k LEFT JOIN x USING (id, key) GROUP BY k.key")
def n1c(spark, d):
    return _index(spark, d).terms()


@query("N2_search_place", WITH + "SELECT DISTINCT id, date_taken AS taken FROM tagged WHERE lower(tag) LIKE 'places/europe/%' AND split_part(lower(tag), '/', 3) = (SELECT min(split_part(lower(tag), '/', 3)) FROM tagged WHERE lower(tag) LIKE 'places/europe/%')")
def n2(spark, d):
    """All photos beneath the first country of Europe."""
    index = _index(spark, d)
    first = index.terms().where(F.startswith("key", F.lit("places/europe/"))).agg(F.min("key")).first()[0] or "places/europe/none"
    return index.search("/".join(first.split("/")[:3]))


@query("N2_search_text", WITH + "SELECT DISTINCT id, date_taken AS taken FROM tagged WHERE contains(lower(tag), 'city 1') OR contains(lower(filename), 'city 1')")
def n2b(spark, d):
    return _index(spark, d).search("City 1")


@query("N2_search_required", WITH + "SELECT DISTINCT id, date_taken AS taken FROM tagged WHERE lower(tag) LIKE 'places/africa/%' AND list_contains(list_transform(tags, lambda t: lower(t)), 'objects/view')")
def n2c(spark, d):
    """A text within the photos of a required place, by an index that was updated."""
    index = I.build(_before(spark, d), scratch_folder(spark, "tag-index"))
    same = ["id", "filename", "date_taken", "tags"]
    old, new = _before(spark, d).select(same), photos(spark, d).select(same)
    return index.update(old.exceptAll(new), new.exceptAll(old)).search("objects/VIEW", ("Places/Africa",))
