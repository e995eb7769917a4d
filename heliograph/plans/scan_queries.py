"""Listing, sidecar, hashing and snapshot queries (inventory A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.operators import scan as S
from heliograph.plans.registry import query
from heliograph.session import read_table
from heliograph.sources.adapters import PHOTOS, photos

#: One file per order line: images, videos of the same stem, sidecars and others.
LISTING = """listing AS (SELECT '/r/' || (l_suppkey % 20) || '/' || l_suppkey AS dir, CASE WHEN l_returnflag = 'N' THEN '.' ELSE '' END || 'Img' || l_orderkey || '.' ||
 CASE l_linenumber WHEN 1 THEN 'JPG' WHEN 2 THEN 'mov' WHEN 3 THEN 'xmp' WHEN 4 THEN 'heic' WHEN 5 THEN 'mp4' ELSE 'txt' END AS name, l_quantity::BIGINT AS size FROM lineitem)"""
KIND = """CASE WHEN name LIKE '.%' THEN 'skipped' WHEN lower(regexp_extract(name, '\\.([^.]+)$', 1)) IN ('jpg', 'heic') THEN 'image' WHEN lower(regexp_extract(name, '\\.([^.]+)$', 1)) IN ('mov', 'mp4') THEN 'video'
 WHEN lower(regexp_extract(name, '\\.([^.]+)$', 1)) = 'xmp' THEN 'sidecar' ELSE 'skipped' END"""


def _listing(spark, d):
    c = F.col
    ext = F.when(c("l_linenumber") == 1, "JPG").when(c("l_linenumber") == 2, "mov").when(c("l_linenumber") == 3, "xmp").when(c("l_linenumber") == 4, "heic").when(c("l_linenumber") == 5, "mp4").otherwise("txt")
    folder = F.concat(F.lit("/r/"), (c("l_suppkey") % 20).cast("string"), F.lit("/"), c("l_suppkey").cast("string"))
    name = F.concat(F.when(c("l_returnflag") == "N", ".").otherwise(""), F.lit("Img"), c("l_orderkey").cast("string"), F.lit("."), ext)
    return read_table(spark, d, "lineitem").select(folder.alias("dir"), name.alias("name"), c("l_quantity").cast("long").alias("size"))


@query("A4_media_kinds", f"WITH {LISTING} SELECT {KIND} AS kind, count(*) AS n, sum(size)::BIGINT AS bytes FROM listing GROUP BY 1")
def a4(spark, d):
    return _listing(spark, d).groupBy(S.kind(F.col("name")).alias("kind")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("A7_live_pairs", f"""WITH {LISTING}, k AS (SELECT dir, name, lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem, {KIND} AS kind FROM listing),
v AS (SELECT dir, stem, min(name) AS live FROM k WHERE kind = 'video' GROUP BY ALL)
SELECT k.dir, k.name, v.live FROM k LEFT JOIN v USING (dir, stem) WHERE kind = 'image' UNION ALL
SELECT dir, lower(name), NULL FROM k WHERE kind = 'video' AND NOT EXISTS (SELECT 1 FROM k i WHERE i.kind = 'image' AND i.dir = k.dir AND i.stem = k.stem)""")
def a7(spark, d):
    return S.pair(_listing(spark, d))


@query("A40_sidecar_paths", f"WITH {LISTING} SELECT DISTINCT dir || '/' || name AS path, CASE WHEN regexp_matches(name, '^[^.].*\\.[^.]+$') AND lower(regexp_extract(name, '\\.([^.]+)$', 1)) <> 'xmp' THEN dir || '/' || regexp_replace(name, '\\.[^.]*$', '') || '.xmp' END AS sidecar FROM listing")
def a40(spark, d):
    path = F.concat("dir", F.lit("/"), "name")
    return _listing(spark, d).select(path.alias("path"), S.sidecar_path(path).alias("sidecar")).distinct()


@query("A10_removed", f"""WITH {LISTING}, k AS (SELECT DISTINCT dir, name FROM listing WHERE size <= 40), c AS (SELECT DISTINCT dir, name FROM listing)
SELECT c.dir, c.name FROM c LEFT JOIN k USING (dir, name) WHERE k.name IS NULL AND NOT (c.dir LIKE '/r/3/%' OR c.dir LIKE '/r/7/%')""")
def a10(spark, d):
    """Rows gone from a listing, but for those under folders that could not be read."""
    every = _listing(spark, d)
    gone = every.select("dir", "name").distinct().join(every.where("size <= 40").select("dir", "name"), ["dir", "name"], "left_anti")
    failed = ("/r/3", "/r/7")
    for f in failed:
        gone = gone.where(~F.startswith("dir", F.lit(f + "/")))
    return gone


@query("A11_folder_tree", f"WITH {LISTING} SELECT path, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT '/r' AS path, size FROM listing UNION ALL SELECT '/r/' || string_split(dir, '/')[3], size FROM listing UNION ALL SELECT dir, size FROM listing) GROUP BY path")
def a11(spark, d):
    """Totals per own folder first, then per ancestor: few rows are exploded."""
    own = _listing(spark, d).groupBy("dir").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return own.select(F.explode(S.ancestors(F.col("dir"))).alias("path"), "n", "bytes").groupBy("path").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


@query("A36_content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents")
def a36(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("A20_exif_dates", """SELECT o_orderkey, strftime(o_orderdate, '%Y:%m:%d') || ' ' || lpad((o_orderkey % 25)::VARCHAR, 2, '0') || ':07:09' AS raw,
o_orderdate + (o_orderkey % 25) * INTERVAL 1 HOUR + CASE WHEN o_orderkey % 25 = 24 THEN INTERVAL 0 MINUTE ELSE INTERVAL 429 SECOND END AS taken FROM orders""")
def a20(spark, d):
    """Hour 24 is the next day's midnight."""
    o = read_table(spark, d, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy:MM:dd"), F.lit(" "), F.lpad((F.col("o_orderkey") % 25).cast("string"), 2, "0"), F.lit(":07:09")).alias("raw"))
    day = F.to_timestamp_ntz(F.substring("raw", 1, 10), F.lit("yyyy:MM:dd"))
    h, m, s = (F.substring("raw", a, 2).cast("int") for a in (12, 15, 18))
    ok = F.col("raw").rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$")
    t = F.when(h == 24, day + F.make_dt_interval(days=F.lit(1))).otherwise(day + F.make_dt_interval(F.lit(0), h, m, s))
    return o.select("o_orderkey", "raw", F.when(ok, t).alias("taken"))


@query("A21_gps_decode", """SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN -1 ELSE 1 END * ((s_suppkey % 90) + (s_suppkey % 60) / 60.0::DOUBLE + (s_suppkey % 30) / 3600.0::DOUBLE) AS lat FROM supplier""")
def a21(spark, d):
    c = F.col
    s = read_table(spark, d, "supplier").select("s_suppkey", (c("s_suppkey") % 90).alias("deg"), (c("s_suppkey") % 60).alias("mn"), (c("s_suppkey") % 30).alias("sec"), F.when(c("s_nationkey") % 2 == 0, "S").otherwise("N").alias("ref"))
    value = c("deg") + c("mn") / F.lit(60.0) + c("sec") / F.lit(3600.0)
    return s.select("s_suppkey", (F.when(c("ref") == "S", -1).otherwise(1) * value).alias("lat"))


XMP = """xmp AS (SELECT c_custkey, '<rdf><digiKam:TagsList><rdf:Seq><rdf:li> People/' || c_name || ' </rdf:li><rdf:li></rdf:li><rdf:li>Places/' || n_name || '</rdf:li></rdf:Seq></digiKam:TagsList><photoshop:CountryCode>' || c_nationkey || '</photoshop:CountryCode></rdf>' AS xml
 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _xmp(spark, d):
    c = read_table(spark, d, "customer").join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    xml = F.concat(
        F.lit("<rdf><digiKam:TagsList><rdf:Seq><rdf:li> People/"), "c_name", F.lit(" </rdf:li><rdf:li></rdf:li><rdf:li>Places/"), "n_name",
        F.lit("</rdf:li></rdf:Seq></digiKam:TagsList><photoshop:CountryCode>"), F.col("c_nationkey").cast("string"), F.lit("</photoshop:CountryCode></rdf>"),
    )
    return c.select("c_custkey", xml.alias("xml"))


@query("A25_xmp_tags", f"WITH {XMP} SELECT c_custkey, array_to_string(list_filter(list_transform(regexp_extract_all(xml, '<rdf:li>([^<]*)</rdf:li>', 1), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM xmp")
def a25(spark, d):
    block = F.regexp_extract("xml", r"(?s)<digiKam:TagsList>(.*?)</digiKam:TagsList>", 1)
    items = F.transform(F.regexp_extract_all(block, F.lit("<rdf:li>([^<]*)</rdf:li>"), F.lit(1)), lambda x: F.trim(x))
    return _xmp(spark, d).select("c_custkey", F.array_join(F.filter(items, lambda x: x != ""), "|").alias("tags"))


@query("A44_xmp_country", f"WITH {XMP} SELECT c_custkey, nullif(trim(regexp_extract(xml, '<photoshop:CountryCode>([^<]*)<', 1)), '') AS country FROM xmp")
def a44(spark, d):
    return _xmp(spark, d).select("c_custkey", F.nullif(F.trim(F.regexp_extract("xml", "<photoshop:CountryCode>([^<]*)<", 1)), F.lit("")).alias("country"))


@query("A48_claims", "SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS x, round(l_tax, 6) AS y, 'P ' || l_suppkey AS name FROM lineitem")
def a48(spark, d):
    """Claim texts are made, then parsed back; malformed ones would be null."""
    c = F.col
    text = F.concat(F.format_string("%.6f,%.6f,0.100000,0.200000 ", "l_discount", "l_tax"), F.lit("P "), c("l_suppkey").cast("string"))
    p = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"))
    n = F.split(F.substring_index("t", " ", 1), ",")
    ok = F.size(n) == 4
    return p.select("l_orderkey", "l_linenumber", F.when(ok, F.get(n, F.lit(0)).try_cast("double")).alias("x"), F.when(ok, F.get(n, F.lit(1)).try_cast("double")).alias("y"), F.regexp_replace("t", "^[^ ]* ", "").alias("name"))


@query("A28_merge_tags", f"""WITH {PHOTOS}, t AS (SELECT id, u.tag, u.p FROM photos, unnest(list_concat(tags, list_transform(tags, lambda x: upper(x)))) WITH ORDINALITY AS u(tag, p)),
f AS (SELECT id, lower(tag) AS k, min(p) AS p, arg_min(tag, p) AS tag FROM t GROUP BY ALL) SELECT id, string_agg(tag, '|' ORDER BY p) AS tags FROM f GROUP BY id""")
def a28(spark, d):
    """Case-insensitive dedup, the first spelling wins, order kept; within each row's array."""
    both = F.concat("tags", F.transform("tags", lambda t: F.upper(t)))
    p = photos(spark, d).select("id", both.alias("b")).withColumn("low", F.transform("b", lambda t: F.lower(t)))
    kept = F.filter("b", lambda t, i: F.array_position("low", F.lower(t)) == i + 1)
    return p.select("id", F.array_join(kept, "|").alias("tags"))
