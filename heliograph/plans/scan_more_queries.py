"""Whole scans, snapshots, sidecar text, places pass and the grid's filter (inventory A, C, D, M)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heliograph.functions import text as X
from heliograph.operators import geo as G
from heliograph.plans.geo_vector_queries import HAVERSINE, SITES, _points, _sites
from heliograph.plans.registry import query
from heliograph.session import read_table, shared_folder
from heliograph.sources.adapters import PHOTOS, photos

c = F.col
W = f"WITH {PHOTOS} "


def _snapshot(spark, df, version):
    """Saves rows with a version as Parquet in the shared folder; its path."""
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    df.withColumn("version", F.lit(version)).write.parquet(path)
    return path


def _load(spark, path, version):
    """The rows of a snapshot of this version; those of another one count as none."""
    return spark.read.parquet(path).where(c("version") == version).drop("version")


@query("A17_snapshot_save", "SELECT o_orderkey, o_custkey, 20 AS version FROM orders")
def a17(spark, d):
    path = _snapshot(spark, read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), 20)
    return spark.read.parquet(path)


def _regions_xml():
    """A sidecar with a box for each of two names, one in pixels, which doesn't count."""
    x = lambda i: F.format_string("%.2f", (c("c_custkey") % (50 + i)) / F.lit(100.0))
    box = lambda name, i, unit: F.concat(F.lit('<rdf:li mwg-rs:Name="'), name, F.lit('"><mwg-rs:Area stArea:x="'), x(i), F.lit('" stArea:y="0.5" stArea:w="0.2" stArea:h="0.1"'), F.lit(unit), F.lit("/></rdf:li>"))
    tags = F.concat(F.lit("<digiKam:TagsList><rdf:Seq><rdf:li> People/"), c("c_name"), F.lit("</rdf:li><rdf:li></rdf:li></rdf:Seq></digiKam:TagsList>"))
    return F.concat(tags, box(c("c_name"), 0, ' stArea:unit="normalized"'), box(F.lit("px"), 1, ' stArea:unit="pixel"'), box(F.lit("Ann"), 2, ""), F.lit("<photoshop:CountryCode> AT </photoshop:CountryCode>"))


def regions(xml):
    """name, x, y, w, h of the boxes in a sidecar's text: units absent or normalized; the name is the nearest one before, within 2,000 characters."""
    found = F.regexp_extract_all(xml, F.lit(r'(?s)(mwg-rs:Name="[^"]*"(?:(?!mwg-rs:Name=").){0,2000}?<mwg-rs:Area [^>]*>)'), F.lit(1))
    at = lambda s, k: F.regexp_extract(s, f'stArea:{k}="([^"]*)"', 1).try_cast("double")
    rows = F.transform(found, lambda s: F.struct(F.regexp_extract(s, 'mwg-rs:Name="([^"]*)"', 1).alias("name"), *[at(s, k).alias(k) for k in "xywh"], F.regexp_extract(s, 'stArea:unit="([^"]*)"', 1).alias("unit")))
    return F.filter(rows, lambda r: r["unit"].isin("", "normalized") & r["x"].isNotNull() & r["y"].isNotNull() & r["w"].isNotNull() & r["h"].isNotNull())


@query("A24_xmp_parse", "SELECT c_custkey, 'People/' || c_name AS tags, 'AT' AS country, 2::INT AS regions FROM customer")
def a24(spark, d):
    """A sidecar's text at once: its tags, country and boxes."""
    t = read_table(spark, d, "customer").select("c_custkey", _regions_xml().alias("xml"))
    block = F.regexp_extract("xml", r"(?s)<digiKam:TagsList>(.*?)</digiKam:TagsList>", 1)
    tags = F.filter(F.transform(F.regexp_extract_all(block, F.lit(r"(?s)<rdf:li>(.*?)</rdf:li>"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return t.select("c_custkey", F.array_join(tags, "|").alias("tags"), X.filled(F.regexp_extract("xml", "<photoshop:CountryCode>([^<]*)<", 1)).alias("country"), F.size(regions(c("xml"))).alias("regions"))


NEAR = f"""x AS (SELECT id, place, {HAVERSINE} AS d FROM (SELECT id, place, pow(sin(radians(plat - gps_lat) / 2), 2) + cos(radians(gps_lat)) * cos(radians(plat)) * pow(sin(radians(plon - gps_lon) / 2), 2) AS a FROM photos, sites)),
r AS (SELECT id, arg_min(place, (d, place)) AS place FROM x WHERE d < 150 GROUP BY id)"""


@query("D9_resolve_place", W + f", {SITES}, {NEAR} SELECT p.id, r.place, CASE WHEN r.place IS NULL THEN 'lookup' ELSE 'cached' END AS how FROM photos p LEFT JOIN r USING (id)")
def d9(spark, d):
    """The cached place near each point; the rest is left to a live lookup, which there is none of here."""
    p = _points(spark, d)
    j = p.select("id").join(G.nearest(p, _sites(spark, d), 150.0).select("id", "place"), "id", "left")
    return j.select("id", "place", F.when(c("place").isNull(), "lookup").otherwise("cached").alias("how"))


@query("M11_places_pass", W + f", {SITES}, {NEAR} SELECT p.id, CASE WHEN p.id % 3 = 0 THEN 'finished' WHEN r.place IS NULL THEN 'lookup' ELSE 'write' END AS action, CASE WHEN p.id % 3 <> 0 THEN 'Places/Site ' || r.place END AS path FROM photos p LEFT JOIN r USING (id)")
def m11(spark, d):
    """Photos whose place isn't finished get the cached one near them; the others wait for a lookup."""
    p = _points(spark, d)
    near = G.nearest(p.where("id % 3 <> 0"), _sites(spark, d), 150.0).select("id", "place")
    j = p.select("id").join(near, "id", "left")
    path = X.places_path(F.concat(F.lit("Site "), c("place").cast("string")))
    return j.select("id", F.when(c("id") % 3 == 0, "finished").when(c("place").isNull(), "lookup").otherwise("write").alias("action"), path.alias("path"))


@query("C3_grid_filter", W + "SELECT id FROM photos WHERE len(list_filter(tags, lambda t: lower(t) = 'scenes/bright' OR lower(t) LIKE 'scenes/bright/%')) > 0 OR contains(lower(filename), '_1') OR len(list_filter(tags, lambda t: contains(lower(list_last(string_split(t, '/'))), 'city 9'))) > 0")
def c3(spark, d):
    """A tag under a prefix of places, objects or scenes, or a part of the file's or a tag's name."""
    from heliograph.operators import tags as T

    q = "scenes/bright"
    under = F.exists("tags", lambda t: (F.lower(t) == q) | (F.lower(T.namespace(t)).isin(*T.PREFIXED) & F.startswith(F.lower(t), F.lit(q + "/"))))
    part = F.contains(F.lower("filename"), F.lit("_1")) | F.exists("tags", lambda t: F.contains(F.lower(T.display_name(t)), F.lit("city 9")))
    return photos(spark, d).where(under | part).select("id")


