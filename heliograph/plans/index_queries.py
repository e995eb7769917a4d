"""Projections, search, tag index and grouping queries (inventory B, C, E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heliograph.operators import tags as T
from heliograph.plans.registry import query
from heliograph.session import read_table
from heliograph.sources.adapters import PHOTOS, TAGS, photos

KEYS = """keyed AS (SELECT DISTINCT id, date_taken, key FROM (
  SELECT id, date_taken, lower(tag) AS key FROM tagged UNION ALL
  SELECT id, date_taken, array_to_string(list_slice(string_split(lower(tag), '/'), 1, k), '/') FROM tagged, unnest(range(2, len(string_split(tag, '/')))) AS u(k)
  WHERE lower(string_split(tag, '/')[1]) IN ('places', 'objects', 'scenes')))"""
WITH = f"WITH {PHOTOS}, {TAGS}, {KEYS} "


@query("E1_tag_counts", WITH + "SELECT key, count(*) AS n, max(date_taken) AS latest FROM keyed GROUP BY key")
def e1(spark, d):
    return T.suggestions(photos(spark, d))


@query("E3_people_suggestions", WITH + "SELECT key, count(*) AS n, max(date_taken) AS latest FROM keyed WHERE key LIKE 'people/%' GROUP BY key")
def e3(spark, d):
    return T.suggestions(photos(spark, d)).where(F.startswith("key", F.lit("people/")))


@query("E4_collection_groups", WITH + "SELECT coalesce(ns, 'Other') AS grp, max(n) AS n, count(*) AS tags FROM (SELECT key, CASE WHEN key LIKE '%/%' THEN split_part(key, '/', 1) END AS ns, count(*) AS n FROM keyed GROUP BY key) WHERE ns IS NULL OR ns <> 'people' GROUP BY 1")
def e4(spark, d):
    s = T.suggestions(photos(spark, d)).withColumn("ns", T.namespace(F.col("key")))
    return s.where("ns is null or ns <> 'people'").groupBy(F.coalesce("ns", F.lit("Other")).alias("grp")).agg(F.max("n").alias("n"), F.count("*").alias("tags"))


@query("E6_leaf_folders", f"""WITH {PHOTOS}, f AS (SELECT DISTINCT folder FROM photos), a AS (SELECT folder AS path FROM f UNION SELECT regexp_replace(folder, '/[^/]*$', '') FROM f)
SELECT path FROM a WHERE path NOT IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM a)""")
def e6(spark, d):
    f = photos(spark, d).select("folder").distinct()
    up = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    every = f.select(F.explode(F.array("folder", up("folder"))).alias("path")).distinct()
    return every.join(every.select(up("path").alias("path")).distinct(), "path", "left_anti")


@query("E7_month_sections", "SELECT coalesce(strftime(o_orderdate, '%Y-%m'), 'unknown') AS section, count(*) AS n, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY 1")
def e7(spark, d):
    s = F.coalesce(F.date_format("o_orderdate", "yyyy-MM"), F.lit("unknown"))
    return read_table(spark, d, "orders").groupBy(s.alias("section")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


@query("E8_people_index", f"WITH {PHOTOS} SELECT person, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM photos GROUP BY person")
def e8(spark, d):
    return photos(spark, d).groupBy("person").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("E14_shared_place_prefix", f"""WITH {PHOTOS}, {TAGS}, p AS (SELECT country, string_split(tag, '/') AS s FROM tagged WHERE tag LIKE 'Places/%'),
l AS (SELECT country, k, min(s[k]) AS lo, max(s[k]) AS hi, count(*) AS n FROM p, unnest(range(2, 5)) AS u(k) GROUP BY ALL),
x AS (SELECT country, min(CASE WHEN lo <> hi THEN k END) AS stop FROM l GROUP BY country)
SELECT l.country, array_to_string(list(lo ORDER BY k), '/') AS prefix FROM l JOIN x USING (country) WHERE stop IS NULL OR k < stop GROUP BY l.country""")
def e14(spark, d):
    segs = photos(spark, d).select("country", F.explode("tags").alias("t")).where(F.startswith("t", F.lit("Places/"))).select("country", F.posexplode(T.parts(F.col("t"))).alias("k", "s")).where("k > 0")
    level = segs.groupBy("country", "k").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    stop = F.min(F.when(F.col("lo") != F.col("hi"), F.col("k"))).over(Window.partitionBy("country"))
    kept = level.withColumn("stop", stop).where("stop is null or k < stop")
    return kept.groupBy("country").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "lo"))), lambda x: x["lo"]), "/").alias("prefix"))


@query("E17_input_summary", f"WITH {PHOTOS} SELECT count(*) AS n, count(date_taken) AS dated, count(gps_lat) AS located, count(*) FILTER (WHERE is_video) AS videos, count(DISTINCT person) AS people FROM photos")
def e17(spark, d):
    return photos(spark, d).agg(F.count("*").alias("n"), F.count("date_taken").alias("dated"), F.count("gps_lat").alias("located"), F.count_if("is_video").alias("videos"), F.countDistinct("person").alias("people"))


@query("E24_local_day_range", f"""WITH {PHOTOS}, m AS (SELECT person, min((date_taken + tz_offset_s * INTERVAL 1 SECOND)::DATE) AS a, max((date_taken + tz_offset_s * INTERVAL 1 SECOND)::DATE) AS b FROM photos GROUP BY person)
SELECT person, CASE WHEN a = b THEN strftime(a, '%Y-%m-%d') ELSE strftime(a, '%Y-%m-%d') || ' – ' || strftime(b, '%Y-%m-%d') END AS days FROM m""")
def e24(spark, d):
    day = F.to_date(F.col("date_taken") + F.make_dt_interval(secs=F.col("tz_offset_s")))
    m = photos(spark, d).groupBy("person").agg(F.min(day).alias("a"), F.max(day).alias("b"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return m.select("person", F.when(F.col("a") == F.col("b"), text("a")).otherwise(F.concat(text("a"), F.lit(" – "), text("b"))).alias("days"))


@query("B1_tag_split", f"WITH {PHOTOS}, {TAGS} SELECT DISTINCT tag, CASE WHEN tag LIKE '%/%' THEN split_part(tag, '/', 1) END AS namespace, list_last(string_split(tag, '/')) AS display_name FROM tagged")
def b1(spark, d):
    t = photos(spark, d).select(F.explode("tags").alias("tag")).distinct()
    return t.select("tag", T.namespace(F.col("tag")).alias("namespace"), T.display_name(F.col("tag")).alias("display_name"))


UUID_SQL = """upper(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""


def stable_id(text):
    """A name-based identifier of a path: 128 bits of SHA-256 with version 5 and the RFC variant."""
    h = F.sha2(text, 256)
    v = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    s = lambda a, n: F.substring(h, a, n)
    return F.upper(F.concat(s(1, 8), F.lit("-"), s(9, 4), F.lit("-5"), s(14, 3), F.lit("-"), v, s(18, 3), F.lit("-"), s(21, 12)))


@query("B2_photo_id", f"WITH {PHOTOS}, h AS (SELECT id, sha256(path) AS h FROM photos) SELECT id, {UUID_SQL} AS uuid FROM h")
def b2(spark, d):
    return photos(spark, d).select("id", stable_id(F.col("path")).alias("uuid"))


@query("B3_folder_id", f"WITH {PHOTOS}, h AS (SELECT DISTINCT folder, sha256('folder:' || folder) AS h FROM photos) SELECT folder, {UUID_SQL} AS uuid FROM h")
def b3(spark, d):
    return photos(spark, d).select("folder").distinct().select("folder", stable_id(F.concat(F.lit("folder:"), "folder")).alias("uuid"))


@query("B5_breadcrumbs", f"WITH {PHOTOS} SELECT DISTINCT folder, array_to_string(list_filter(string_split(folder, '/'), lambda x: x <> ''), ' › ') AS crumbs FROM photos")
def b5(spark, d):
    return photos(spark, d).select("folder").distinct().select("folder", F.array_join(T.parts(F.col("folder")), " › ").alias("crumbs"))


@query("B6_people_tags", f"WITH {PHOTOS} SELECT id, array_to_string(list_filter(tags, lambda t: lower(t) LIKE 'people/%'), '|') AS people FROM photos")
def b6(spark, d):
    return photos(spark, d).select("id", F.array_join(F.filter("tags", lambda t: F.lower(T.namespace(t)) == "people"), "|").alias("people"))


@query("B8_places_segments", f"WITH {PHOTOS} SELECT id, array_to_string(list_slice(string_split(tags[1], '/'), 2, 99), '|') AS segments FROM photos")
def b8(spark, d):
    ranked = F.transform("tags", lambda t, i: F.struct(F.when(F.lower(T.namespace(t)) == "places", F.size(T.parts(t))).otherwise(0).alias("n"), (-i).alias("first"), T.parts(t).alias("p")))
    best = F.array_max(ranked)
    return photos(spark, d).select("id", F.when(best["n"] > 0, F.array_join(F.slice(best["p"], F.lit(2), F.greatest(best["n"] - 1, F.lit(0))), "|")).otherwise("").alias("segments"))


@query("B9_corpus_terms", f"WITH {PHOTOS} SELECT id, lower(filename) || chr(10) || array_to_string(flatten(list_transform(tags, lambda t: [lower(list_last(string_split(t, '/'))), lower(t)])), chr(10)) AS corpus FROM photos")
def b9(spark, d):
    return photos(spark, d).select("id", F.array_join(T.corpus_terms(F.col("filename"), F.col("tags")), "\n").alias("corpus"))


@query("C1_search_tag", WITH + "SELECT id FROM keyed WHERE key = 'places/asia' UNION SELECT id FROM tagged WHERE lower(tag) = 'places/asia'")
def c1(spark, d):
    return T.search(photos(spark, d), "Places/ASIA").select("id")


@query("C1_search_text", f"WITH {PHOTOS}, {TAGS} SELECT DISTINCT id FROM tagged WHERE contains(lower(tag), 'city 1') OR contains(lower(filename), 'city 1')")
def c1b(spark, d):
    return T.search(photos(spark, d), "City 1").select("id")


@query("C1_search_required", f"WITH {PHOTOS}, {TAGS} SELECT DISTINCT id FROM tagged WHERE list_contains(list_transform(tags, lambda t: lower(t)), 'objects/view') AND contains(lower(tag), 'africa')")
def c1c(spark, d):
    return T.search(photos(spark, d), "africa", ("Objects/view",)).select("id")


@query("C7_first_by_id", "SELECT o_custkey AS id, o_orderkey AS pos, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def c7(spark, d):
    first = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min_by("o_totalprice", "o_orderkey").alias("price"), F.min("o_orderkey").alias("pos"))
    return first.select("id", "pos", "price")


@query("C9_place_candidates", f"WITH {PHOTOS} SELECT id FROM photos WHERE NOT is_video AND gps_lat IS NOT NULL AND gps_lon IS NOT NULL")
def c9(spark, d):
    return photos(spark, d).where("not is_video and gps_lat is not null and gps_lon is not null").select("id")


@query("C10_places_needed", f"WITH {PHOTOS} SELECT id, coalesce(list_max(list_transform(list_filter(tags, lambda t: t LIKE 'Places/%'), lambda t: len(string_split(t, '/')))), 0) < 5 AS needed FROM photos")
def c10(spark, d):
    depth = F.array_max(F.transform(F.filter("tags", lambda t: F.lower(T.namespace(t)) == "places"), lambda t: F.size(T.parts(t))))
    return photos(spark, d).select("id", (F.coalesce(depth, F.lit(0)) < 5).alias("needed"))


@query("C13_leaf_tags", WITH + ", k AS (SELECT DISTINCT key FROM keyed) SELECT key FROM k WHERE key NOT IN (SELECT regexp_replace(key, '/[^/]*$', '') FROM k WHERE key LIKE '%/%')")
def c13(spark, d):
    k = T.suggestions(photos(spark, d)).select("key")
    up = k.where(F.contains("key", F.lit("/"))).select(F.regexp_replace("key", "/[^/]*$", "").alias("key")).distinct()
    return k.join(up, "key", "left_anti")


@query("C12_content_tags", f"WITH {PHOTOS}, {TAGS} SELECT DISTINCT tag FROM tagged WHERE lower(split_part(tag, '/', 1)) IN ('objects', 'scenes')")
def c12(spark, d):
    return photos(spark, d).select(F.explode("tags").alias("tag")).where(F.lower(F.split("tag", r"[/|]")[0]).isin("objects", "scenes")).distinct()


@query("C20_all_tags", f"WITH {PHOTOS} SELECT id FROM photos WHERE len(list_filter(tags, lambda t: lower(t) = 'places/europe' OR lower(t) LIKE 'places/europe/%')) > 0 AND list_contains(tags, 'Mood')")
def c20(spark, d):
    df = photos(spark, d)
    for q in ("places/europe", "mood"):
        df = df.where(_under(q))
    return df.select("id")


def _under(q: str):
    return F.exists("tags", lambda t: (F.lower(t) == q) | F.startswith(F.lower(t), F.lit(q + "/")))
