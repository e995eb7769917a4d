"""Faces' geometry, rotation, collation, sidecars as trees, export (inventory A26, A27, A34, A35, F14, F16, F17, G13, H4, J8, J13, J17, J18)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from heliograph.functions import text as X
from heliograph.operators import export as P
from heliograph.operators import faces as A
from heliograph.operators import rotation as R
from heliograph.plans.registry import query
from heliograph.plans.rules_queries import frontality
from heliograph.session import read_table, scratch_folder
from heliograph.sources.adapters import PHOTOS, photos

c = F.col
#: Where the five points of an aligned face of 112 pixels lie.
TEMPLATE = [(38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041)]


def _marks(spark, d):
    """Order lines as five points of a face; every hundredth part's points coincide."""
    q, t, disc = c("l_quantity"), c("l_tax"), c("l_discount")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    one = p(F.lit(5.0), F.lit(5.0))
    marks = F.array(p(F.lit(10.0) + t * 10, F.lit(20.0)), p(F.lit(30.0), F.lit(20.0) + disc * 20), p(F.lit(20.0) + q / 10, F.lit(30.0)), p(F.lit(12.0), F.lit(40.0)), p(F.lit(28.0), F.lit(41.0)))
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", F.when(c("l_partkey") % 100 == 0, F.array(*[one] * 5)).otherwise(marks).alias("m"))


MARKS = """mk AS (SELECT l_orderkey, l_linenumber, l_discount, l_quantity, CASE WHEN l_partkey % 100 = 0 THEN [5.0, 5.0, 5.0, 5.0, 5.0] ELSE [10 + l_tax * 10, 30, 20 + l_quantity / 10, 12, 28] END::DOUBLE[] AS xs,
  CASE WHEN l_partkey % 100 = 0 THEN [5.0, 5.0, 5.0, 5.0, 5.0] ELSE [20, 20 + l_discount * 20, 30, 40, 41] END::DOUBLE[] AS ys FROM lineitem)"""
TX, TY = (f"({[p[k] for p in TEMPLATE]}::DOUBLE[])" for k in (0, 1))


@query("J13_similarity_transform", f"""WITH {MARKS}, a AS (SELECT *, list_avg(xs) AS mx, list_avg(ys) AS my, list_avg({TX}) AS ux, list_avg({TY}) AS uy FROM mk),
s AS (SELECT *, list_sum(list_transform(range(1, 6), lambda i: (xs[i] - mx) * ({TX}[i] - ux) + (ys[i] - my) * ({TY}[i] - uy))) / 5 AS tr, list_sum(list_transform(range(1, 6), lambda i: (xs[i] - mx) * ({TY}[i] - uy) - (ys[i] - my) * ({TX}[i] - ux))) / 5 AS sk,
 list_sum(list_transform(range(1, 6), lambda i: (xs[i] - mx) * (xs[i] - mx) + (ys[i] - my) * (ys[i] - my))) / 5 AS var FROM a)
SELECT l_orderkey, l_linenumber, round(tr / var, 6) AS a, round(sk / var, 6) AS c, round(ux - (tr / var * mx - sk / var * my), 6) AS tx, round(uy - (sk / var * mx + tr / var * my), 6) AS ty,
 round(sqrt(list_sum(list_transform(range(1, 6), lambda i: pow(tr / var * (xs[i] - mx) - sk / var * (ys[i] - my) + ux - {TX}[i], 2) + pow(sk / var * (xs[i] - mx) + tr / var * (ys[i] - my) + uy - {TY}[i], 2))) / 5), 6) AS error FROM s WHERE var > 1e-9""")
def j13(spark, d):
    """The transform that aligns each face, and how far its points then are from the template's; faces whose points coincide have none."""
    m = A.similarity(_marks(spark, d), "m", TEMPLATE, "s").where("s is not null")
    r = lambda x: F.round(c(f"s.{x}"), 6).alias(x)
    return m.select("l_orderkey", "l_linenumber", r("a"), r("c"), r("tx"), r("ty"), F.round(A.residual(c("s"), c("m"), TEMPLATE), 6).alias("error"))


@query("J8_face_quality", f"""WITH {MARKS}, v AS (SELECT *, sqrt(pow(xs[1] - xs[2], 2) + pow(ys[1] - ys[2], 2)) AS eyes, (xs[4] + xs[5]) / 2 - (xs[1] + xs[2]) / 2 AS ux, (ys[4] + ys[5]) / 2 - (ys[1] + ys[2]) / 2 AS uy, xs[3] - (xs[1] + xs[2]) / 2 AS tx, ys[3] - (ys[1] + ys[2]) / 2 AS ty FROM mk),
f AS (SELECT *, CASE WHEN eyes > 0 AND sqrt(ux * ux + uy * uy) > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - 2 * abs(tx * uy - ty * ux) / sqrt(ux * ux + uy * uy) / eyes)) ELSE 0 END AS fr FROM v)
SELECT l_orderkey, l_linenumber, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (1 - l_discount) * least(1.0::DOUBLE, l_quantity / 40) * fr)), 9) AS q FROM f""")
def j8(spark, d):
    """Certainty times size times how far a face looks into the camera."""
    q = (1 - c("l_discount")) * F.least(F.lit(1.0), c("l_quantity") / 40)
    return _marks(spark, d).select("l_orderkey", "l_linenumber", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), q * frontality(F.transform("m", lambda p: F.array(p["x"], p["y"]))))), 9).alias("q"))


@query("J18_letterbox", """WITH i AS (SELECT o_orderkey, (o_custkey * 7) % 4000 AS w, o_orderkey % 3000 AS h FROM orders), s AS (SELECT *, least(640.0::DOUBLE / w, 640.0::DOUBLE / h) AS scale FROM i WHERE w > 0 AND h > 0)
SELECT o_orderkey, round(scale, 9) AS scale, least(greatest(round(w * scale), 1), 640)::INT AS cw, least(greatest(round(h * scale), 1), 640)::INT AS ch, round(100 / scale, 6) AS x1 FROM s""")
def j18(spark, d):
    """How images fit a square of 640, and where its pixel 100 lies in the image."""
    o = read_table(spark, d, "orders").select("o_orderkey", A.letterbox((c("o_custkey") * 7 % 4000).cast("double"), (c("o_orderkey") % 3000).cast("double"), 640).alias("l")).where("l is not null")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(100.0).alias("y1"))
    return o.select("o_orderkey", F.round("l.scale", 9).alias("scale"), c("l.w").alias("cw"), c("l.h").alias("ch"), F.round(A.from_letterbox(box, c("l.scale"))["x1"], 6).alias("x1"))


@query("J17_anchor_decode", """WITH o AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(0, 64)) AS i FROM embeddings), v AS (SELECT vec_id, i, e[i + 1] AS score, e, ((i // 4) % 4) * 16 AS cx, (i // 16) * 16 AS cy FROM o),
f AS (SELECT *, list_transform(range(0, 4), lambda k: abs(e[(i * 4 + k) % 64 + 1]) * 3) AS b, list_transform(range(0, 10), lambda k: e[(i * 30 + k * 3) % 64 + 1]) AS p FROM v WHERE score >= 0.1)
SELECT vec_id AS img, i::INT AS anchor, round((cx - b[1] * 16) / 0.5, 6) AS x0, round((cy - b[2] * 16) / 0.5, 6) AS y0, round((cx + b[3] * 16) / 0.5, 6) AS x1, round((cy + b[4] * 16) / 0.5, 6) AS y1, round((cx + p[5] * 16) / 0.5, 6) AS nose_x, round((cy + p[6] * 16) / 0.5, 6) AS nose_y
FROM f WHERE NOT (vec_id % 5 = 0 AND i % 3 = 0) AND NOT (vec_id % 7 = 0 AND i % 2 = 0)""")
def j17(spark, d):
    """Vectors as a detector's output: four by four cells of 16 pixels with four anchors; some distances are not finite."""
    e, n = c("embedding"), 64
    value = lambda k: F.get(e, (k % n).cast("int")).cast("double")
    boxes = F.transform(F.sequence(F.lit(0), F.lit(4 * n - 1)), lambda k: F.when((c("vec_id") % 5 == 0) & (F.floor(k / 4) % 3 == 0), F.lit(float("nan"))).otherwise(F.abs(value(k)) * 3))
    points = F.transform(F.sequence(F.lit(0), F.lit(10 * n - 1)), lambda k: F.when((c("vec_id") % 7 == 0) & (k % 20 == 3), F.lit(float("inf"))).otherwise(value(k * 3)))
    out = read_table(spark, d, "embeddings").select(c("vec_id").alias("img"), F.lit(16).alias("stride"), F.lit(0.5).alias("scale"), F.transform(e, lambda x: x.cast("double")).alias("scores"), boxes.alias("boxes"), points.alias("points"))
    found = A.decode_anchors(out, 64, 4, 0.1)
    r = lambda x, name: F.round(x, 6).alias(name)
    return found.select("img", "anchor", *[r(c(s), s) for s in ("x0", "y0", "x1", "y1")], r(c("points")[2]["x"], "nose_x"), r(c("points")[2]["y"], "nose_y"))


ROTATED = """n AS (SELECT k, count(*) AS n FROM pool GROUP BY k), b AS (SELECT p.k, p.item, n, unnest(range(0, ({s} - 1) // least(n, {s}) + 1)) AS b FROM pool p JOIN n USING (k)),
h AS (SELECT *, row_number() OVER (PARTITION BY k, b ORDER BY sha256('2024-02-10|' || k || '|' || CASE WHEN n = 2 THEN 0 ELSE b END || '|' || item), item) AS r FROM b),
cl AS (SELECT *, r = 1 AND b > 0 AND n > 1 AND lag(item) OVER (PARTITION BY k ORDER BY b, r) = item AS clash FROM h WHERE r <= {s}), sw AS (SELECT *, bool_or(clash) OVER (PARTITION BY k, b) AS swap FROM cl),
rot AS (SELECT k, (b * n + CASE WHEN swap AND r <= 2 THEN 3 - r ELSE r END - 1)::INT AS slot, item FROM sw WHERE b * n + CASE WHEN swap AND r <= 2 THEN 3 - r ELSE r END - 1 < {s})"""


@query("G13_rotation", f"WITH pool AS (SELECT c_nationkey::BIGINT AS k, c_custkey::BIGINT AS item FROM customer UNION ALL SELECT 100 + n_regionkey, n_nationkey FROM nation WHERE n_nationkey < 13), {ROTATED.format(s=24)} SELECT k, slot, item FROM rot")
def g13(spark, d):
    """24 slots for each nation from its customers, and for each region from its nations, of which there are fewer."""
    a = read_table(spark, d, "customer").select(c("c_nationkey").cast("long").alias("k"), c("c_custkey").cast("long").alias("item"))
    b = read_table(spark, d, "nation").where("n_nationkey < 13").select((c("n_regionkey") + 100).cast("long").alias("k"), c("n_nationkey").cast("long").alias("item"))
    return R.rotation(a.unionByName(b), "k", "item", 24, F.lit("2024-02-10"))


@query("F17_timeline_slots", f"""WITH pool AS (SELECT DISTINCT user_id AS k, event_id AS item FROM events WHERE event_type = 'view'), {ROTATED.format(s=12)}, f AS (SELECT user_id, min(ts) AS t FROM events GROUP BY user_id)
SELECT user_id, slot, t + slot * INTERVAL 2 HOUR AS starts, item FROM f JOIN rot ON k = user_id""")
def f17(spark, d):
    """Twelve slots of two hours for each user, filled from the rotation of their views."""
    e = read_table(spark, d, "events")
    pool = e.where("event_type = 'view'").select(c("user_id").alias("k"), c("event_id").alias("item")).distinct()
    slots = R.rotation(pool, "k", "item", 12, F.lit("2024-02-10"))
    first = e.groupBy("user_id").agg(F.min("ts").alias("t"))
    j = first.join(slots, c("user_id") == c("k"))
    return j.select("user_id", "slot", (c("t") + F.make_dt_interval(hours=c("slot") * 2)).alias("starts"), "item")


#: Names with accents in both forms of writing, and without.
NAMES = ["Zoë", "Zoë", "zoe", "Ångström", "Ångstrom", "ANGSTROM", "Émile", "emile", "Ñandu", "nandu", "Öz", "Oz", "Müller", "MULLER", "Łukasz"]
NAMED = f"nm AS (SELECT c_custkey, {json.dumps(NAMES[:-1], ensure_ascii=False).replace(chr(34), chr(39))}[1 + c_custkey % {len(NAMES) - 1}] || ' ' || (c_custkey % 40) AS name FROM customer)"


def _names(spark, d):
    pick = F.get(F.array(*map(F.lit, NAMES[:-1])), (c("c_custkey") % (len(NAMES) - 1)).cast("int"))
    return read_table(spark, d, "customer").select("c_custkey", F.concat(pick, F.lit(" "), (c("c_custkey") % 40).cast("string")).alias("name"))


@query("H4_collation_key", f"WITH {NAMED} SELECT c_custkey, strip_accents(lower(name)) AS key FROM nm")
def h4(spark, d):
    return _names(spark, d).select("c_custkey", X.collation_key(c("name")).alias("key"))


@query("H4_collated_groups", f"WITH {NAMED} SELECT strip_accents(lower(name)) AS key, count(*) AS n, min(c_custkey) AS first FROM nm GROUP BY 1")
def h4b(spark, d):
    """Names that differ in case, accents or their way of writing are one group; grouped by the collation itself."""
    g = _names(spark, d).groupBy(X.collated(c("name")).alias("g")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"), F.min_by("name", "c_custkey").alias("name"))
    return g.select(X.collation_key(c("name")).alias("key"), "n", "first")


@query("H4_collated_join", f"WITH {NAMED} SELECT a.c_custkey AS a, b.c_custkey AS b FROM nm a JOIN nm b ON strip_accents(lower(a.name)) = strip_accents(lower(b.name)) AND b.c_custkey < 100")
def h4c(spark, d):
    n = _names(spark, d).select(c("c_custkey").alias("a"), X.collated(c("name")).alias("k"))
    return n.join(_names(spark, d).where("c_custkey < 100").select(c("c_custkey").alias("b"), X.collated(c("name")).alias("k")), "k").select("a", "b")


def _sidecars(spark, d):
    """Customers' sidecars under three sets of prefixes, boxes as attributes or elements, lists in two descriptions, some documents broken."""
    from heliograph.functions import xml as M

    k = c("c_custkey")
    pre = F.when(k % 3 == 0, "").when(k % 3 == 1, "x").otherwise("zz")
    p = lambda name: F.concat(pre, F.lit(name))
    tag = lambda name, *body: F.concat(F.lit("<"), p(name), F.lit(">"), *body, F.lit("</"), p(name), F.lit(">"))
    bag = lambda *items: F.concat(F.lit("<"), p("rdf:Bag>"), *[tag("rdf:li", i) for i in items], F.lit("</"), p("rdf:Bag>"))
    x = F.format_string("%.2f", (k % 50) / F.lit(100.0))
    attribute = F.concat(F.lit("<"), p("rdf:li><"), p("rdf:Description "), p("mwg:Name='"), c("c_name"), F.lit("' "), p("mwg:Type='Face'><"), p("mwg:Area "), p("sa:x='"), x, F.lit("' "), p("sa:y='0.5' "), p("sa:w='0.2' "), p("sa:h='0.1' "), p("sa:unit='normalized'/></"), p("rdf:Description></"), p("rdf:li>"))
    element = F.concat(F.lit("<"), p("rdf:li>"), tag("mwg:Name", c("c_name")), tag("mwg:Type", F.lit("Face")), tag("mwg:Area", tag("sa:x", x), tag("sa:y", F.lit("0.5")), tag("sa:w", F.lit("0.2")), tag("sa:h", F.lit("0.1"))), F.lit("</"), p("rdf:li>"))
    pixel = F.concat(F.lit("<"), p("rdf:li><"), p("mwg:Area "), p("sa:x='3' "), p("sa:y='3' "), p("sa:w='9' "), p("sa:h='9' "), p("sa:unit='pixel'/></"), p("rdf:li>"))
    box = F.when(k % 2 == 0, attribute).otherwise(element)
    names = {"rdf": M.RDF, "dc": M.DC, "dk": M.DIGIKAM, "mwg": M.MWG_RS, "sa": M.ST_AREA}
    declared = F.concat(*[F.concat(F.lit(" xmlns:"), p(n), F.lit(f"='{uri}'")) for n, uri in names.items()])
    body = F.concat(tag("rdf:Description", tag("dc:subject", bag(c("c_name"), F.lit(" a &amp; b "))), tag("dk:TagsList", bag(F.concat(F.lit("People/"), c("c_name"))))), tag("rdf:Description", tag("dc:subject", bag(F.lit("again"), F.lit(" "))), tag("mwg:RegionList", bag()), tag("mwg:RegionList", F.concat(F.lit("<"), p("rdf:Bag>"), box, pixel, F.lit("</"), p("rdf:Bag>")))))
    text = F.concat(F.lit("<"), p("rdf:RDF"), declared, F.lit(">"), body, F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("</"), p("rdf:RDF>"))))
    return read_table(spark, d, "customer").select("c_custkey", text.alias("xml"))


@query("A27_sidecar_view", "SELECT c_custkey, c_name || '|a & b|again' AS subject, 'People/' || c_name AS tags, 1::INT AS regions FROM customer WHERE c_custkey % 11 <> 0")
def a27(spark, d):
    """The same document under any prefixes gives the same rows; repeated properties add up; broken documents give none."""
    from heliograph.functions.xml import sidecar_view

    v = _sidecars(spark, d).select("c_custkey", sidecar_view("xml").alias("v")).where("v.subject is not null")
    return v.select("c_custkey", F.array_join("v.subject", "|").alias("subject"), F.array_join("v.tags_list", "|").alias("tags"), F.size("v.regions").alias("regions"))


@query("A26_xmp_regions", "SELECT c_custkey, 0::INT AS i, c_name AS name, 'Face' AS kind, round((c_custkey % 50) / 100.0::DOUBLE, 2) AS x, 0.5::DOUBLE AS y, 0.2::DOUBLE AS w, 0.1::DOUBLE AS h FROM customer WHERE c_custkey % 11 <> 0")
def a26(spark, d):
    """Boxes whose coordinates are attributes, and those whose coordinates are elements."""
    from heliograph.functions.xml import sidecar_view

    v = _sidecars(spark, d).select("c_custkey", F.posexplode(sidecar_view("xml")["regions"]).alias("i", "r"))
    return v.select("c_custkey", "i", *[c(f"r.{x}").alias(x) for x in ("name", "kind", "x", "y", "w", "h")])


def _library(spark, d):
    return photos(spark, d).withColumn("owner", (c("user_id") % 7).cast("long"))


@query("A34_widget_export", f"WITH {PHOTOS} SELECT owner, place, id, folder FROM (SELECT user_id % 7 AS owner, id, folder, row_number() OVER (PARTITION BY user_id % 7 ORDER BY date_taken DESC NULLS LAST, pos)::INT AS place FROM photos WHERE NOT is_video AND (id % 3 <> 0 OR id % 9 = 0)) WHERE place <= 500")
def a34(spark, d):
    """Index, folders and tags exported, then again unchanged, then with more photos: what is read is the last export."""
    path = scratch_folder(spark, "export")
    p = _library(spark, d)
    tables = lambda q: {"index": P.photo_index(q), "folders": q.groupBy("owner", "folder").agg(F.max("date_taken").alias("newest")), "tags": q.select("owner", F.explode("tags").alias("tag")).distinct()}
    old, new = p.where("id % 3 <> 0"), p.where("id % 3 <> 0 or id % 9 = 0")
    first, second, third = P.export(tables(old), path), P.export(tables(old), path), P.export(tables(new), path)
    if second or "index" not in third or len(first) != 3:
        raise AssertionError(f"exports wrote {first}, {second}, {third}")
    return P.exported(spark, path, "index", "owner long, place int, id long, folder string")


LINE = "sha256(length(filename) || ':' || filename || length(file_size::VARCHAR) || ':' || file_size)"


@query("A35_export_fingerprint", f"WITH {PHOTOS}, l AS (SELECT folder, {LINE} AS h FROM photos) SELECT folder, count(*) || '-' || " + " || '-' || ".join(f"sum(('0x' || substr(h, {k}, 15))::BIGINT::HUGEINT)" for k in P.SLICES) + " AS fingerprint FROM l GROUP BY folder")
def a35(spark, d):
    """A fingerprint of each folder that no order of its files changes, added up where they lie."""
    return photos(spark, d).groupBy("folder").agg(P.fingerprint(c("filename"), c("file_size")).alias("fingerprint"))


def _memories(spark, d):
    """Folders as memories of five libraries; the last photo by name is the cover, and every seventh photo is gone."""
    p = photos(spark, d).withColumn("owner", (c("user_id") % 5).cast("long"))
    g = p.groupBy("owner", c("folder").alias("mid")).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("date_taken", "id"))), lambda x: x["id"]).alias("photos"), F.max("id").alias("cover"))
    return p.where("id % 7 <> 0"), g.where("n >= 5").select("owner", c("mid").alias("title"), "mid", (c("n") + c("cover") % 2 * F.lit(0.5)).alias("score"), F.slice("photos", 1, 75).alias("photos"), "cover")


MEM = f"""{PHOTOS}, m0 AS (SELECT user_id % 5 AS owner, folder AS mid, count(*) AS n, list(id ORDER BY date_taken, id) AS ids, max(id) AS cover FROM photos GROUP BY ALL HAVING count(*) >= 5),
m AS (SELECT owner, mid, n + cover % 2 * 0.5::DOUBLE AS score, ids[1:75] AS ids, cover FROM m0), e AS (SELECT owner, mid, score, id, min(i) AS i FROM (SELECT owner, mid, score, cover AS id, 0 AS i FROM m UNION ALL SELECT owner, mid, score, ids[k], k FROM m, unnest(range(1, len(ids) + 1)) AS u(k)) GROUP BY ALL),
r AS (SELECT owner, mid, score, list(id ORDER BY i)[1:12] AS refs FROM e WHERE id % 7 <> 0 GROUP BY ALL)"""


@query("F16_memory_refs", f"WITH {MEM} SELECT owner, mid, array_to_string(refs, ',') AS refs FROM r")
def f16(spark, d):
    """The cover, then the other photos, those that are still there, twelve at most."""
    known, m = _memories(spark, d)
    items = m.withColumn("item", F.concat_ws("|", c("owner").cast("string"), "mid"))
    return items.join(P.memory_refs(items, known), "item").select("owner", "mid", F.array_join("refs", ",").alias("refs"))


@query("F14_widget_items", f"""WITH {MEM}, i AS (SELECT owner, mid, refs, score, 0 AS src, TIMESTAMP '2024-02-10 00:00:00' AS valid_from FROM r WHERE mid NOT LIKE '%/error/%' UNION ALL SELECT owner, mid, refs, score, 1, TIMESTAMP '2024-02-12 00:00:00' FROM r WHERE mid LIKE '%/error/%' OR mid LIKE '%/view/%')
SELECT owner, mid, array_to_string(refs, ',') AS refs, valid_from, valid_from + INTERVAL 1 DAY AS valid_to, round(score)::INT AS priority, row_number() OVER (PARTITION BY owner ORDER BY round(score) DESC, src, mid)::INT AS place FROM i""")
def f14(spark, d):
    """Today's memories and scheduled ones by priority, each with its window."""
    known, m = _memories(spark, d)
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    today = m.where("mid not like '%/error/%'").withColumn("rank", F.lit(1))
    ahead = m.where("mid like '%/error/%' or mid like '%/view/%'").withColumns({"valid_from": day("2024-02-12 00:00:00"), "valid_to": day("2024-02-13 00:00:00")})
    out = P.memory_items(today, ahead, known, day("2024-02-10 00:00:00"), day("2024-02-11 00:00:00"))
    return out.withColumn("refs", F.array_join("refs", ",")).drop("title")
