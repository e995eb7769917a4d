"""Smaller rows of the inventory over the same views: keys, predicates, lookups, calendar text, queue states."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.operators import scan as S
from heliograph.plans.registry import query
from heliograph.plans.scan_queries import LISTING, _listing
from heliograph.plans.set_queue_queries import QUEUE, _queue
from heliograph.session import read_table
from heliograph.sources.adapters import PHOTOS, TAGS, photos

c = lambda x: F.col(x)
P = f"WITH {PHOTOS} "
LOCAL_SQL = "(date_taken + tz_offset_s * INTERVAL 1 SECOND)"


def _local():
    return F.col("date_taken") + F.make_dt_interval(secs=F.col("tz_offset_s"))


@query("A5_live_keys", f"WITH {LISTING} SELECT DISTINCT name, lower(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '(?i)\\.(heic|jpg)$', '')) AS key FROM listing")
def a5(spark, d):
    key = F.lower(F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), r"(?i)\.(heic|jpg)$", ""))
    return _listing(spark, d).select("name", key.alias("key")).distinct()


@query("A37_stem_keys", f"WITH {LISTING} SELECT DISTINCT name, lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem FROM listing")
def a37(spark, d):
    return _listing(spark, d).select("name", S.stem(c("name")).alias("stem")).distinct()


@query("A38_hidden", f"WITH {LISTING} SELECT name LIKE '.%' AS hidden, count(*) AS n FROM listing GROUP BY 1")
def a38(spark, d):
    return _listing(spark, d).groupBy(F.startswith("name", F.lit(".")).alias("hidden")).agg(F.count("*").alias("n"))


@query("B4_folder_of", P + "SELECT path, folder FROM photos")
def b4(spark, d):
    p = photos(spark, d).select("path")
    return p.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"))


@query("C5_prefix_namespaces", f"WITH {PHOTOS}, {TAGS} SELECT tag, lower(split_part(tag, '/', 1)) IN ('places', 'objects', 'scenes') AND contains(tag, '/') AS by_prefix FROM tagged GROUP BY tag")
def c5(spark, d):
    t = photos(spark, d).select(F.explode("tags").alias("tag")).distinct()
    return t.select("tag", (F.lower(F.substring_index("tag", "/", 1)).isin("places", "objects", "scenes") & F.contains("tag", F.lit("/"))).alias("by_prefix"))


@query("C14_unnamed_boxes", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus = 'F'")
def c14(spark, d):
    name = F.when(c("l_returnflag") == "A", c("l_returnflag")).otherwise("  ")
    return read_table(spark, d, "lineitem").where((F.trim(name) == "") & (c("l_linestatus") == "F")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("C24_folder_photos", P + "SELECT id FROM photos WHERE folder = '/Library/view/u7'")
def c24(spark, d):
    return photos(spark, d).where("folder = '/Library/view/u7'").select("id")


@query("D20_paths_of_hash", "SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) >= 1")
def d20(spark, d):
    return read_table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("G6_title_dedupe", "SELECT lower(p_name) AS title, arg_min(p_partkey, (-p_size, p_partkey)) AS kept, max(p_size) AS photos FROM part GROUP BY 1")
def g6(spark, d):
    return read_table(spark, d, "part").groupBy(F.lower("p_name").alias("title")).agg(F.min_by("p_partkey", F.struct((-c("p_size")).alias("n"), "p_partkey")).alias("kept"), F.max("p_size").alias("photos"))


@query("H1_lowercase", "SELECT doc_id, md5(lower(text)) AS h FROM documents")
def h1(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.md5(F.lower("text")).alias("h"))


@query("H14_subtitles", P + f"SELECT folder, strftime(min({LOCAL_SQL}), '%b %-d, %Y') || ' · ' || count(*) || CASE count(*) WHEN 1 THEN ' photo' ELSE ' photos' END AS subtitle FROM photos GROUP BY folder")
def h14(spark, d):
    g = photos(spark, d).groupBy("folder").agg(F.min(_local()).alias("t"), F.count("*").alias("n"))
    return g.select("folder", F.concat(F.date_format("t", "MMM d, yyyy"), F.lit(" · "), c("n").cast("string"), F.when(c("n") == 1, " photo").otherwise(" photos")).alias("subtitle"))


@query("I6_iso_days", P + f"SELECT id, strftime({LOCAL_SQL}, '%Y-%m-%d') AS day FROM photos")
def i6(spark, d):
    return photos(spark, d).select("id", F.date_format(_local(), "yyyy-MM-dd").alias("day"))


@query("I8_add_days", "SELECT o_orderkey, (o_orderdate + INTERVAL 45 DAY)::DATE AS later FROM orders")
def i8(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 45).alias("later"))


@query("I9_earliest", "SELECT l_orderkey, min(l_shipdate) AS ship, least(min(l_shipdate), min(o_orderdate)) AS earliest FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def i9(spark, d):
    j = read_table(spark, d, "lineitem").join(read_table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey"))
    return j.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"), F.least(F.min("l_shipdate"), F.min("o_orderdate")).alias("earliest"))


@query("I14_same_local_day", P + f"SELECT id, {LOCAL_SQL}::DATE = date_taken::DATE AS same FROM photos")
def i14(spark, d):
    return photos(spark, d).select("id", (F.to_date(_local()) == F.to_date("date_taken")).alias("same"))


@query("I15_add_years", "SELECT o_orderkey, (o_orderdate + INTERVAL 3 YEAR)::DATE AS later FROM orders")
def i15(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", F.add_months("o_orderdate", 36).alias("later"))


@query("I17_offsets", P + "SELECT id, CASE WHEN tz_offset_s = 0 THEN 'Z' ELSE CASE WHEN tz_offset_s < 0 THEN '-' ELSE '+' END || lpad((abs(tz_offset_s) // 3600)::VARCHAR, 2, '0') || ':00' END AS txt, tz_offset_s AS seconds FROM photos")
def i17(spark, d):
    """Offset texts are made, then parsed back to seconds."""
    o = c("tz_offset_s")
    t = F.when(o == 0, "Z").otherwise(F.concat(F.when(o < 0, "-").otherwise("+"), F.lpad(F.expr("abs(tz_offset_s) div 3600").cast("string"), 2, "0"), F.lit(":00")))
    p = photos(spark, d).select("id", t.alias("txt"))
    n = F.regexp_extract("txt", r"^[+-](\d{2})", 1).cast("int") * 3600 + F.regexp_extract("txt", r"(\d{2})$", 1).cast("int") * 60
    seconds = F.when(c("txt").isin("", "Z"), 0).otherwise(F.when(F.startswith("txt", F.lit("-")), -1).otherwise(1) * n)
    return p.select("id", "txt", seconds.cast("int").alias("seconds"))


@query("M4_finish", f"WITH {QUEUE} SELECT item, CASE WHEN state = 'pending' AND pack = 1 THEN 'done' WHEN state = 'pending' AND pack = 2 THEN 'failed' ELSE state END AS state FROM q")
def m4(spark, d):
    s, k = c("state"), c("pack")
    return _queue(spark, d).select("item", F.when((s == "pending") & (k == 1), "done").when((s == "pending") & (k == 2), "failed").otherwise(s).alias("state"))


