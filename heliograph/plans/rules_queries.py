"""Tag text, dates, plans for people and decisions, cluster edits, queue states and detections (inventory A, B, C, D, H, I, J, K, L, M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heliograph.functions import text as X
from heliograph.operators import edits as E
from heliograph.operators import geo as G
from heliograph.plans.registry import query
from heliograph.plans.scan_queries import LISTING, _listing
from heliograph.plans.set_queue_queries import QUEUE, _queue
from heliograph.session import ensure_checkpoint_dir, read_table
from heliograph.sources.adapters import PHOTOS, photos

c = F.col
W = f"WITH {PHOTOS} "
LOCAL_SQL = "(date_taken + tz_offset_s * INTERVAL 1 SECOND)"


def local():
    return c("date_taken") + F.make_dt_interval(secs=c("tz_offset_s"))


# --- tag text -------------------------------------------------------------------------------------------------------------

#: Untidy tags made of the parts' names: spaces, empty segments, small words, internal capitals, decomposed letters.
RAW = """raw AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' objects / the ' || p_name || '  of mcDonald//' WHEN 1 THEN 'People/' || p_name WHEN 2 THEN p_name || '/a' || chr(9) || 'b'
 WHEN 3 THEN 'cafe' || chr(769) || '/at ' || p_name WHEN 4 THEN ' / ' ELSE 'vs. ' || p_name || ' via ' || p_brand END AS tag FROM part)"""
SMALL = str(X.SMALL_WORDS).replace(" ", "")
TITLE = f"""array_to_string(list_transform(list_filter(regexp_split_to_array(seg, '\\s+'), lambda w: w <> ''), lambda w, i: CASE WHEN regexp_matches(substr(w, 2), '\\p{{Lu}}') THEN w
 WHEN i > 1 AND i < len(list_filter(regexp_split_to_array(seg, '\\s+'), lambda v: v <> '')) AND list_contains({SMALL}, lower(w)) THEN lower(w) ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ')"""
NORMAL = f"""segs AS (SELECT p_partkey, tag, i, regexp_replace(u.seg, '^\\s+|\\s+$', '', 'g') AS seg FROM raw, unnest(string_split(nfc_normalize(tag), '/')) WITH ORDINALITY AS u(seg, i)),
titled AS (SELECT p_partkey, i, {TITLE} AS t FROM segs WHERE seg <> ''),
normal AS (SELECT p_partkey, string_agg(t, '/' ORDER BY i) AS tag, arg_min(t, i) AS root FROM titled GROUP BY 1),
kept AS (SELECT r.p_partkey, CASE WHEN n.root <> 'People' AND NOT regexp_matches(r.tag, '[\\x00-\\x1f\\x7f]') THEN n.tag END AS tag FROM raw r LEFT JOIN normal n USING (p_partkey))"""


def _raw(spark, d):
    n, k = c("p_name"), c("p_partkey") % 6
    t = F.when(k == 0, F.concat(F.lit(" objects / the "), n, F.lit("  of mcDonald//"))).when(k == 1, F.concat(F.lit("People/"), n)).when(k == 2, F.concat(n, F.lit("/a\tb")))
    t = t.when(k == 3, F.concat(F.lit("cafe\u0301/at "), n)).when(k == 4, F.lit(" / ")).otherwise(F.concat(F.lit("vs. "), n, F.lit(" via "), c("p_brand")))
    return read_table(spark, d, "part").select("p_partkey", t.alias("tag"))


@query("H5_normalize_tag", f"WITH {RAW}, {NORMAL} SELECT p_partkey, tag FROM kept")
def h5(spark, d):
    return _raw(spark, d).select("p_partkey", X.normalize_tag(c("tag")).alias("tag"))


@query("H6_titlecase", f"WITH {RAW}, segs AS (SELECT p_partkey, replace(tag, '/', ' ') AS seg FROM raw) SELECT p_partkey, {TITLE} AS title FROM segs")
def h6(spark, d):
    return _raw(spark, d).select("p_partkey", X.titlecase(F.replace("tag", F.lit("/"), F.lit(" "))).alias("title"))


@query("H2_nfc", f"WITH {RAW} SELECT p_partkey, nfc_normalize(tag) AS tag FROM raw")
def h2(spark, d):
    return _raw(spark, d).select("p_partkey", X.nfc(c("tag")).alias("tag"))


@query("H3_match_key", f"WITH {RAW} SELECT p_partkey, nfc_normalize(lower(tag)) AS key FROM raw")
def h3(spark, d):
    return _raw(spark, d).select("p_partkey", X.match_key(c("tag")).alias("key"))


@query("A39_nfd_path", "SELECT c_custkey, nfc_normalize(name) AS composed, length(name)::INT AS n FROM (SELECT c_custkey, 'Cafe' || chr(769) || '/' || c_name AS name FROM customer)")
def a39(spark, d):
    name = F.concat(F.lit("Café/"), c("c_name"))
    t = read_table(spark, d, "customer").select("c_custkey", X.nfd(name).alias("name"))
    return t.select("c_custkey", X.nfc(c("name")).alias("composed"), F.length("name").alias("n"))


@query("H10_lr_path", W + "SELECT DISTINCT replace(t.tag, '/', '|') AS path FROM photos p, unnest(p.tags) AS t(tag)")
def h10(spark, d):
    return photos(spark, d).select(F.explode("tags").alias("t")).select(F.replace("t", F.lit("/"), F.lit("|")).alias("path")).distinct()


@query("H11_places_path", """SELECT s_suppkey, 'Places/' || concat_ws('/', nullif(trim(CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE r_name END), ''), nullif(trim(n_name || ' '), ''), CASE WHEN s_suppkey % 2 = 0 THEN s_name END) AS path
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def h11(spark, d):
    s, n, r = (read_table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, c("s_nationkey") == c("n_nationkey")).join(r, c("n_regionkey") == c("r_regionkey"))
    return j.select("s_suppkey", X.places_path(F.when(c("s_suppkey") % 3 == 0, " ").otherwise(c("r_name")), F.concat("n_name", F.lit(" ")), F.when(c("s_suppkey") % 2 == 0, c("s_name")), F.lit("")).alias("path"))


@query("H15_trip_titles", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || ' with Anna' WHEN 1 THEN 'A trip to ' || n_name WHEN 2 THEN 'A trip with Anna' ELSE 'A trip' END AS title FROM nation")
def h15(spark, d):
    k = c("n_nationkey") % 4
    return read_table(spark, d, "nation").select("n_nationkey", X.trip_title(F.when(k < 2, c("n_name")), F.when(k % 2 == 0, "Anna")).alias("title"))


FIRSTS = """firsts AS (SELECT o_orderkey AS k, list_value('Anna ' || chr(65 + (o_custkey % 3)::INT) || 'x', 'anna ' || chr(65 + (o_orderkey % 3)::INT) || 'y', 'Bob', 'Ben ' || 'Q', 'Bob Z') AS names FROM orders),
f AS (SELECT k, i, x, split_part(x, ' ', 1) AS first, CASE WHEN x LIKE '% %' THEN upper(substr(list_last(string_split(x, ' ')), 1, 1)) END AS initial FROM firsts, unnest(names) WITH ORDINALITY AS u(x, i)),
g AS (SELECT k, lower(first) AS l, count(*) AS n, count(DISTINCT initial) AS m FROM f GROUP BY ALL)"""


@query("H16_short_names", f"WITH {FIRSTS} SELECT k, string_agg(CASE WHEN n > 1 AND n = m THEN first || ' ' || initial || '.' ELSE first END, ', ' ORDER BY i) AS names FROM f JOIN g USING (k) WHERE lower(first) = l GROUP BY k")
def h16(spark, d):
    letter = lambda x: F.expr(f"char(65 + cast({x} % 3 as int))")
    names = F.array(F.concat(F.lit("Anna "), letter("o_custkey"), F.lit("x")), F.concat(F.lit("anna "), letter("o_orderkey"), F.lit("y")), F.lit("Bob"), F.lit("Ben Q"), F.lit("Bob Z"))
    return read_table(spark, d, "orders").select(c("o_orderkey").alias("k"), F.array_join(X.short_names(names), ", ").alias("names"))


NOMINATIM = """j AS (SELECT s_suppkey AS k, '{"country":"' || n_name || '","state":" ","city":"' || CASE WHEN s_suppkey % 3 = 0 THEN 'C' || s_suppkey ELSE '' END || '","town":"' || CASE WHEN s_suppkey % 3 = 1 THEN 'T' || s_suppkey ELSE ' ' END
 || '","village":"V' || s_suppkey || '","suburb":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'S' ELSE '' END || '"}' AS js FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("H18_geocoder_reply", f"""WITH {NOMINATIM} SELECT k, 'Places/' || concat_ws('/', nullif(trim(js->>'country'), ''), nullif(trim(js->>'state'), ''), coalesce(nullif(trim(js->>'city'), ''), nullif(trim(js->>'town'), ''), nullif(trim(js->>'village'), '')), nullif(trim(js->>'suburb'), '')) AS path FROM j""")
def h18(spark, d):
    """A geocoder's reply as a place: the first of city, town, village and municipality, then of suburb, neighbourhood and district."""
    k = c("s_suppkey")
    t = lambda x: F.concat(F.lit(x), k.cast("string"))
    js = F.to_json(F.struct(c("n_name").alias("country"), F.lit(" ").alias("state"), F.when(k % 3 == 0, t("C")).otherwise("").alias("city"), F.when(k % 3 == 1, t("T")).otherwise(" ").alias("town"), t("V").alias("village"), F.when(k % 2 == 0, "S").otherwise("").alias("suburb")))
    j = read_table(spark, d, "supplier").join(read_table(spark, d, "nation"), c("s_nationkey") == c("n_nationkey")).select(k.alias("k"), js.alias("js"))
    names = "country state city town village municipality suburb neighbourhood city_district".split()
    a = j.select("k", F.from_json("js", ", ".join(f"{x} string" for x in names)).alias("a"))
    first = lambda xs: F.coalesce(*[X.filled(c(f"a.{x}")) for x in xs])
    return a.select("k", X.places_path(c("a.country"), c("a.state"), first(names[2:6]), first(names[6:])).alias("path"))


@query("B10_corpus_entry", W + "SELECT id, nfc_normalize(lower(filename) || chr(10) || array_to_string(list_transform(tags, lambda t: lower(t)), chr(10))) AS entry FROM photos")
def b10(spark, d):
    return photos(spark, d).select("id", X.nfc(F.concat_ws("\n", F.lower("filename"), F.transform("tags", F.lower))).alias("entry"))


@query("B14_file_url", "SELECT c_custkey, 'file://' || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '/' END || 'a%20b:c/%C3%A9%3F%23+' || replace(c_name, '#', '%23') || '.jpg' AS url FROM customer")
def b14(spark, d):
    path = F.concat(F.when(c("c_custkey") % 2 == 0, "/").otherwise(""), F.lit("a b:c/é?#+"), c("c_name"), F.lit(".jpg"))
    return read_table(spark, d, "customer").select("c_custkey", X.file_url(path).alias("url"))


# --- dates and numbers ----------------------------------------------------------------------------------------------------


@query("I3_midnight_instant", W + f"SELECT id, ({LOCAL_SQL}::DATE::TIMESTAMP - tz_offset_s * INTERVAL 1 SECOND) AS midnight FROM photos")
def i3(spark, d):
    return photos(spark, d).select("id", (F.date_trunc("day", local()) - F.make_dt_interval(secs=c("tz_offset_s"))).alias("midnight"))


@query("I10_utc_text", "SELECT event_id, strftime(to_timestamp(floor((epoch_us(ts) + 500) / 1000) / 1000.0)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S.') || lpad((((epoch_us(ts) + 500) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS utc FROM events")
def i10(spark, d):
    ms = F.expr("(unix_micros(cast(ts as timestamp)) + 500) div 1000")
    return read_table(spark, d, "events").select("event_id", F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("utc"))


@query("I11_quicktime_date", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch(o_orderdate + INTERVAL 3661 SECOND) WHEN 1 THEN epoch(o_orderdate + INTERVAL 3661 SECOND) - 7200 WHEN 2 THEN epoch(o_orderdate + INTERVAL 3661 SECOND) + 19800 END::BIGINT AS secs FROM orders""")
def i11(spark, d):
    """A stamp with T between day and time and an optional offset, with or without a colon; none is UTC; others are null."""
    k = c("o_orderkey") % 4
    raw = F.concat(F.date_format(c("o_orderdate") + F.make_dt_interval(secs=F.lit(3661)), "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 0, "").when(k == 1, "+0200").when(k == 2, "-05:30").otherwise("x"))
    return read_table(spark, d, "orders").select("o_orderkey", quicktime(raw).alias("secs"))


def quicktime(raw):
    """Seconds since 1970 of yyyy-MM-ddTHH:mm:ss with an offset, none or Z; null for other texts."""
    rx = r"^\s*(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)(Z|([+-])(\d\d):?(\d\d))?\x00*\s*$"
    g = lambda i: F.regexp_extract(raw, rx, i)
    off = F.coalesce(g(5).try_cast("long") * 3600 + g(6).try_cast("long") * 60, F.lit(0)) * F.when(g(4) == "-", -1).otherwise(1)
    return F.when(raw.rlike(rx), F.unix_seconds(F.concat(g(1), F.lit(" "), g(2), F.lit(" UTC")).try_cast("timestamp")) - off)


@query("I12_day_key", W + f"SELECT id, strftime({LOCAL_SQL}, '%Y-%m-%d') AS seed FROM photos")
def i12(spark, d):
    return photos(spark, d).select("id", F.date_format(local(), "yyyy-MM-dd").alias("seed"))


@query("I16_days_in_month", "SELECT DISTINCT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(last_day(o_orderdate))::INT AS days FROM orders")
def i16(spark, d):
    return read_table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth(F.last_day("o_orderdate")).alias("days")).distinct()


@query("J2_haversine_geo", W + """, x AS (SELECT id, pow(sin(radians(-33.87 - gps_lat) / 2), 2) + cos(radians(gps_lat)) * cos(radians(-33.87)) * pow(sin(radians(151.2 - gps_lon) / 2), 2) AS a FROM photos)
SELECT id, round(2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, a))), 5) AS km FROM x""")
def j2(spark, d):
    return photos(spark, d).select("id", F.round(G.haversine(c("gps_lat"), c("gps_lon"), F.lit(-33.87), F.lit(151.2)), 5).alias("km"))


BOXES = "boxes AS (SELECT l_orderkey AS img, l_linenumber AS i, l_discount AS score, (l_partkey % 30)::DOUBLE AS x0, (l_suppkey % 30)::DOUBLE AS y0, (l_partkey % 30 + 20 + l_quantity)::DOUBLE AS x1, (l_suppkey % 30 + 20 + l_quantity)::DOUBLE AS y1 FROM lineitem)"


def _boxes(spark, d):
    x, y, q = c("l_partkey") % 30, c("l_suppkey") % 30, c("l_quantity")
    return read_table(spark, d, "lineitem").select(c("l_orderkey").alias("img"), c("l_linenumber").alias("i"), c("l_discount").alias("score"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 20 + q).cast("double").alias("x1"), (y + 20 + q).cast("double").alias("y1"))


@query("J7_box_iou", f"""WITH {BOXES}, x AS (SELECT a.img, a.i AS a, b.i AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s
FROM boxes a JOIN boxes b ON a.img = b.img AND a.i < b.i) SELECT img, a, b, round(inter / (s - inter), 9) AS iou FROM x""")
def j7(spark, d):
    b = _boxes(spark, d).select("img", "i", F.struct("x0", "y0", "x1", "y1").alias("r"))
    p = b.select("img", c("i").alias("a"), c("r").alias("ra")).join(b.select("img", c("i").alias("b"), c("r").alias("rb")), "img").where("a < b")
    return p.select("img", "a", "b", F.round(E.box_overlap(c("ra"), c("rb")), 9).alias("iou"))


@query("G10_detection_order", f"WITH {BOXES} SELECT img, i, row_number() OVER (PARTITION BY img ORDER BY score DESC, x0, y0, x1, y1, i)::INT AS place FROM boxes")
def g10(spark, d):
    w = Window.partitionBy("img").orderBy(F.desc("score"), "x0", "y0", "x1", "y1", "i")
    return _boxes(spark, d).select("img", "i", F.row_number().over(w).alias("place"))


@query("G9_suppression", f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, x0, y0, x1, y1, i)::INT AS p FROM boxes),
k(img, p, kept) AS (SELECT img, 0, [0] FROM (SELECT DISTINCT img FROM o) UNION ALL SELECT o.img, o.p, CASE WHEN len(kept) < 5 AND NOT EXISTS (SELECT 1 FROM o q WHERE q.img = o.img AND list_contains(kept, q.p) AND
 greatest(0, least(q.x1, o.x1) - greatest(q.x0, o.x0)) * greatest(0, least(q.y1, o.y1) - greatest(q.y0, o.y0)) > 0.4::DOUBLE * ((q.x1 - q.x0) * (q.y1 - q.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - greatest(0, least(q.x1, o.x1) - greatest(q.x0, o.x0)) * greatest(0, least(q.y1, o.y1) - greatest(q.y0, o.y0))))
 THEN list_append(kept, o.p) ELSE kept END FROM k JOIN o ON o.img = k.img AND o.p = k.p + 1),
l AS (SELECT img, arg_max(kept, p) AS kept FROM k GROUP BY img) SELECT o.img, o.i FROM o JOIN l USING (img) WHERE list_contains(l.kept, o.p)""")
def g9(spark, d):
    """Boxes of an image, best first, that overlap no kept one by more than 0.4, four at most; an image's boxes are a small group."""
    boxes = _boxes(spark, d).groupBy("img").agg(F.array_sort(F.collect_list(F.struct((-c("score")).alias("s"), "x0", "y0", "x1", "y1", "i"))).alias("bs"))
    none = F.slice("bs", 1, 0)

    def step(kept, b):
        clear = ~F.exists(kept, lambda k: E.box_overlap(k, b) > 0.4) & (F.size(kept) < 4)
        return F.when(clear, F.concat(kept, F.array(b))).otherwise(kept)

    return boxes.select("img", F.explode(F.aggregate("bs", none, step)).alias("b")).select("img", c("b.i").alias("i"))


@query("J9_frontality", """WITH m AS (SELECT l_orderkey, l_linenumber, 10.0::DOUBLE + l_tax * 10 AS lx, 20.0::DOUBLE AS ly, 30.0::DOUBLE AS rx, 20.0::DOUBLE + l_discount * 20 AS ry, 20.0::DOUBLE + l_quantity / 10 AS nx, 30.0::DOUBLE AS ny, 12.0::DOUBLE AS ax, 40.0::DOUBLE AS ay, 28.0::DOUBLE AS bx, 41.0::DOUBLE AS "by" FROM lineitem),
v AS (SELECT *, sqrt(pow(lx - rx, 2) + pow(ly - ry, 2)) AS eyes, (ax + bx) / 2 - (lx + rx) / 2 AS ux, (ay + "by") / 2 - (ly + ry) / 2 AS uy, nx - (lx + rx) / 2 AS tx, ny - (ly + ry) / 2 AS ty FROM m)
SELECT l_orderkey, l_linenumber, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - 2 * abs(tx * uy - ty * ux) / sqrt(ux * ux + uy * uy) / eyes)), 9) AS frontality FROM v""")
def j9(spark, d):
    p = lambda x, y: F.array(x, y)
    q, t, disc = c("l_quantity"), c("l_tax"), c("l_discount")
    marks = F.array(p(F.lit(10.0) + t * 10, F.lit(20.0)), p(F.lit(30.0), F.lit(20.0) + disc * 20), p(F.lit(20.0) + q / 10, F.lit(30.0)), p(F.lit(12.0), F.lit(40.0)), p(F.lit(28.0), F.lit(41.0)))
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", marks.alias("m"))
    return rows.select("l_orderkey", "l_linenumber", F.round(frontality(c("m")), 9).alias("frontality"))


def frontality(m):
    """Of the five points eye, eye, nose, mouth, mouth: 1 less twice the nose's distance from the face's axis over that of the eyes, in 0 .. 1."""
    dx, dy = m[0][0] - m[1][0], m[0][1] - m[1][1]
    eyes = F.sqrt(dx * dx + dy * dy)
    mid = lambda i, j, k: (m[i][k] + m[j][k]) / 2
    ux, uy = mid(3, 4, 0) - mid(0, 1, 0), mid(3, 4, 1) - mid(0, 1, 1)
    axis = F.sqrt(ux * ux + uy * uy)
    off = F.abs((m[2][0] - mid(0, 1, 0)) * uy - (m[2][1] - mid(0, 1, 1)) * ux) / axis
    return F.when((eyes > 0) & (axis > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 2 * off / eyes))).otherwise(F.lit(0.0))


MOD = "18446744073709551616::UHUGEINT"
FNV = f"list_reduce(list_transform(range(0, length(seed) + 1), lambda i: CASE WHEN i = 0 THEN {X.FNV_START}::UHUGEINT ELSE ord(substr(seed, i, 1))::UHUGEINT END), lambda s, b: (xor(s, b) * {X.FNV_PRIME}::UHUGEINT) % {MOD})"
MIXED = f"""s AS (SELECT id, {FNV} AS h FROM seeds), g AS (SELECT id, h, k, (h + {int(X.GAMMA)}::UHUGEINT * k) % {MOD} AS z0 FROM s, (SELECT unnest([1, 2, 3])::UHUGEINT AS k)),
z1 AS (SELECT id, h, k, (xor(z0, z0 // 1073741824::UHUGEINT) * {int(X.MIX_A)}::UHUGEINT) % {MOD} AS z FROM g), z2 AS (SELECT id, h, k, (xor(z, z // 134217728::UHUGEINT) * {int(X.MIX_B)}::UHUGEINT) % {MOD} AS z FROM z1),
z3 AS (SELECT id, h, k, xor(z, z // 2147483648::UHUGEINT) % 9007199254740992::UHUGEINT AS r FROM z2)"""


@query("J10_seed_hash", W + f", seeds AS (SELECT id, filename AS seed FROM photos), {MIXED} SELECT id, lpad(to_hex(h), 16, '0') AS seed FROM s".replace("to_hex(h)", "lower(hex(h))"))
def j10(spark, d):
    """The generator's state after seeding with each file name, as hexadecimal."""
    return photos(spark, d).select("id", X.fnv1a(c("filename")).alias("seed"))


@query("J11_jitter_draws", W + f", seeds AS (SELECT id, filename AS seed FROM photos), {MIXED} SELECT id, k::INT AS k, 12.0::DOUBLE * (r::DOUBLE * 1.1102230246251565e-16::DOUBLE) AS jitter FROM z3")
def j11(spark, d):
    return photos(spark, d).select("id", F.posexplode(X.draws(c("filename"), 3, 12.0)).alias("k", "jitter")).select("id", (c("k") + 1).alias("k"), "jitter")


@query("J12_permutation", "WITH p AS (SELECT * FROM (VALUES (0, 3), (1, 1), (2, 2), (3, 4), (4, 0)) AS t(slot, place)) SELECT vec_id, place::INT AS place FROM embeddings JOIN p ON vec_id % 5 = p.slot".replace("(VALUES (0, 3), (1, 1), (2, 2), (3, 4), (4, 0))", "(VALUES " + ", ".join(f"({i}, {x})" for i, x in enumerate(X.permutation(5, 42))) + ")"))
def j12(spark, d):
    """Vectors dealt by a fixed shuffle of five places; the shuffle itself is held against hand-computed draws in the tests."""
    order = F.array(*map(F.lit, X.permutation(5, 42)))
    return read_table(spark, d, "embeddings").select("vec_id", F.element_at(order, (c("vec_id") % 5 + 1).cast("int")).alias("place"))


@query("J16_embedding_bytes", None)
def j16(spark, d):
    """Base64 of each vector's little-endian 32-bit floats, and its dimensions."""
    return read_table(spark, d, "embeddings").select("vec_id", F.base64(X.float_bytes(c("embedding"))).alias("b64"), F.size("embedding").alias("dims"))


# --- people, projections, decisions -----------------------------------------------------------------------------------------

VIEW = """v AS (SELECT k, CASE WHEN k % 2 = 0 THEN ['People/A' || k % 5, 'Places/X', 'People/B' || k % 3] ELSE ['Places/X', 'People/C' || k % 4] END AS tags_list, list_sort(list_distinct(['People/A' || k % 5, 'People/C' || k % 4])) AS owned,
 list_sort(list_distinct(['A' || k % 7, 'B' || k % 3])) AS people, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN ['C' || k % 4] ELSE []::VARCHAR[] END AS retracting, ['a' || k % 5, 'c' || k % 4] AS people_subjects, ['x', 'A' || k % 2] AS tagger_subjects,
 ['A' || k % 5, 'other'] AS subjects, ['A' || k % 5, 'B0'] AS person_in_image FROM (SELECT c_custkey AS k FROM customer)),
w AS (SELECT *, list_transform(people, lambda x: 'People/' || x) AS wanted FROM v),
a AS (SELECT *, list_filter(wanted, lambda x: NOT list_contains(tags_list, x)) AS to_add, list_sort(list_distinct(list_filter(owned, lambda t: NOT list_contains(wanted, t) AND (retracting IS NULL OR list_contains(coalesce(retracting, []::VARCHAR[]), split_part(t, '/', 2)) OR list_contains(people, split_part(t, '/', 2)))))) AS to_remove FROM w),
p AS (SELECT *, list_sort(list_distinct(list_concat(list_filter(owned, lambda t: NOT list_contains(to_remove, t)), to_add))) AS owned_after, list_concat(list_filter(tags_list, lambda t: t LIKE 'People/%' AND NOT list_contains(to_remove, t)), to_add) AS stay FROM a)"""


def _view(spark, d):
    k = c("c_custkey")
    t = lambda x, n: F.concat(F.lit(x), (k % n).cast("string"))
    none = F.array().cast("array<string>")
    return read_table(spark, d, "customer").select(
        k.alias("k"), F.when(k % 2 == 0, F.array(t("People/A", 5), F.lit("Places/X"), t("People/B", 3))).otherwise(F.array(F.lit("Places/X"), t("People/C", 4))).alias("tags_list"),
        F.array_distinct(F.array(t("People/A", 5), t("People/C", 4))).alias("owned"), F.array_distinct(F.array(t("A", 7), t("B", 3))).alias("people"),
        F.when(k % 3 == 1, F.array(t("C", 4))).when(k % 3 == 2, none).alias("retracting"), F.array(t("a", 5), t("c", 4)).alias("people_subjects"), F.array(F.lit("x"), t("A", 2)).alias("tagger_subjects"),
        F.array(t("A", 5), F.lit("other")).alias("subjects"), F.array(t("A", 5), F.lit("B0")).alias("person_in_image"),
    )


def _text(x):
    return F.array_join(x, "|")


@query("L2_people_plan", f"WITH {VIEW} SELECT k, array_to_string(list_sort(to_add), '|') AS to_add, array_to_string(to_remove, '|') AS to_remove, array_to_string(owned_after, '|') AS owned_after FROM p")
def l2(spark, d):
    p = E.people_plan(_view(spark, d))
    return p.select("k", _text(F.array_sort("to_add")).alias("to_add"), _text(c("to_remove")).alias("to_remove"), _text(c("owned_after")).alias("owned_after"))


@query("L8_subject_plan", f"""WITH {VIEW}, r AS (SELECT *, list_sort(list_distinct(list_filter(people_subjects, lambda s: NOT list_contains(list_transform(stay, lambda t: lower(split_part(t, '/', 2))), lower(s)) AND NOT list_contains(list_transform(tagger_subjects, lambda t: lower(t)), lower(s))))) AS gone,
 list_sort(list_filter(list_transform(to_add, lambda t: split_part(t, '/', 2)), lambda x: NOT list_contains(list_transform(subjects, lambda s: lower(s)), lower(x)))) AS fresh FROM p)
SELECT k, array_to_string(fresh, '|') AS subject_add, array_to_string(gone, '|') AS subject_remove, array_to_string(list_sort(list_distinct(list_concat(list_filter(people_subjects, lambda s: NOT list_contains(gone, s)), fresh))), '|') AS subject_owned FROM r""")
def l8(spark, d):
    p = E.subject_plan(E.people_plan(_view(spark, d)))
    return p.select("k", *[_text(c(x)).alias(x) for x in ("subject_add", "subject_remove", "subject_owned")])


@query("L9_image_people", f"""WITH {VIEW}, r AS (SELECT *, list_transform(stay, lambda t: split_part(t, '/', 2)) AS names FROM p), u AS (SELECT *, list_filter(names, lambda x, i: NOT list_contains(list_transform(names[1:i - 1], lambda y: lower(y)), lower(x))) AS uniq FROM r)
SELECT k, CASE WHEN len(uniq) > 0 AND uniq <> person_in_image THEN array_to_string(uniq, '|') END AS image_list, CASE WHEN len(uniq) > 0 THEN '' ELSE array_to_string(list_filter(list_transform(to_remove, lambda t: split_part(t, '/', 2)), lambda x: list_contains(list_transform(person_in_image, lambda y: lower(y)), lower(x))), '|') END AS image_remove FROM u""")
def l9(spark, d):
    p = E.image_people(E.people_plan(_view(spark, d)))
    return p.select("k", _text(c("image_list")).alias("image_list"), _text(c("image_remove")).alias("image_remove"))


@query("C23_authority", f"WITH {VIEW} SELECT k, retracting IS NULL OR list_contains(retracting, 'C' || k % 4) OR list_contains(people, 'C' || k % 4) AS speaks FROM p")
def c23(spark, d):
    name = F.concat(F.lit("C"), (c("k") % 4).cast("string"))
    return _view(spark, d).select("k", E.speaks_for(name, c("people"), c("retracting")).alias("speaks"))


DECISIONS = """ds AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN l_returnflag = 'A' THEN 'named' WHEN l_returnflag = 'N' THEN 'ignored' ELSE 'rejected' END AS kind, CASE WHEN l_returnflag = 'A' THEN 'P' || l_suppkey % 3 END AS name,
 (l_partkey % 10) / 10.0::DOUBLE AS x, (l_suppkey % 10) / 10.0::DOUBLE AS y, 0.33::DOUBLE AS w, 0.33::DOUBLE AS h, l_linestatus = 'O' AS wanted, 'd' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS claim FROM lineitem),
rq AS (SELECT k, list(DISTINCT name) FILTER (WHERE wanted AND kind = 'named') AS people, k % 2 = 0 AS complete FROM ds GROUP BY k),
sup AS (SELECT e.k, e.i, e.claim, coalesce(bool_or(greatest(0, 0.33::DOUBLE - abs(e.x - n.x)) * greatest(0, 0.33::DOUBLE - abs(e.y - n.y)) > 0.5::DOUBLE * (0.2178::DOUBLE - greatest(0, 0.33::DOUBLE - abs(e.x - n.x)) * greatest(0, 0.33::DOUBLE - abs(e.y - n.y)))), false)
 OR any_value(q.complete) OR any_value(e.kind) = 'named' AND coalesce(list_contains(any_value(q.people), any_value(e.name)), false) AS superseded FROM ds e JOIN rq q USING (k) LEFT JOIN ds n ON n.k = e.k AND n.wanted WHERE NOT e.wanted GROUP BY e.k, e.i, e.claim)"""


def _decisions(spark, d):
    kind = F.when(c("l_returnflag") == "A", "named").when(c("l_returnflag") == "N", "ignored").otherwise("rejected")
    one = F.struct(
        c("l_linenumber").alias("i"), kind.alias("kind"), F.when(c("l_returnflag") == "A", F.concat(F.lit("P"), (c("l_suppkey") % 3).cast("string"))).alias("name"), (c("l_partkey") % 10 / F.lit(10.0)).alias("x"), (c("l_suppkey") % 10 / F.lit(10.0)).alias("y"),
        F.lit(0.33).alias("w"), F.lit(0.33).alias("h"), F.concat(F.lit("d"), c("l_linenumber").cast("string"), F.lit(":"), c("l_partkey").cast("string"), F.lit(":"), c("l_suppkey").cast("string")).alias("claim"),
    )
    li = read_table(spark, d, "lineitem").select(c("l_orderkey").alias("k"), (c("l_linestatus") == "O").alias("o"), one.alias("one"))
    g = li.groupBy("k").agg(F.collect_list(F.when(~c("o"), c("one"))).alias("decisions"), F.collect_list(F.when(c("o"), c("one"))).alias("wanted"))
    people = F.filter(F.transform("wanted", lambda x: x["name"]), lambda x: x.isNotNull())
    return g.withColumns({"people": people, "retracting": F.when(c("k") % 2 != 0, F.array().cast("array<string>"))})


@query("L10_superseded", f"WITH {DECISIONS} SELECT k, i, claim, superseded FROM sup")
def l10(spark, d):
    g = _decisions(spark, d).select("k", "wanted", "people", "retracting", F.explode("decisions").alias("e"))
    return g.select("k", c("e.i").alias("i"), c("e.claim").alias("claim"), E.superseded(c("e"), c("wanted"), c("people"), c("retracting")).alias("superseded"))


@query("L4_decision_plan", f"WITH {DECISIONS}, o AS (SELECT k, claim FROM sup WHERE NOT superseded UNION SELECT k, claim FROM ds WHERE wanted) SELECT r.k, coalesce(array_to_string(list_sort(list(claim) FILTER (WHERE claim IS NOT NULL)), '|'), '') AS owned FROM rq r LEFT JOIN o USING (k) GROUP BY r.k")
def l4(spark, d):
    return _decisions(spark, d).select("k", _text(E.decision_plan(c("k"), lambda x: x["claim"])).alias("owned"))


# --- clusters -------------------------------------------------------------------------------------------------------------

CLUSTERS = "cl AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'N' || s_suppkey % 5 END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'named' ELSE 'unlabeled' END AS state, s_suppkey % 2 = 0 AS pinned, n AS size FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"


def _clusters(spark, d):
    k = c("s_suppkey")
    n = read_table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("size"))
    return read_table(spark, d, "supplier").join(n, "s_suppkey").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("N"), (k % 5).cast("string"))).alias("name"), F.when(k % 3 == 0, "named").otherwise("unlabeled").alias("state"), (k % 2 == 0).alias("pinned"), "size")


@query("K5_merge_direction", f"WITH {CLUSTERS} SELECT a.id AS a, b.id AS b, CASE WHEN (a.name IS NOT NULL) <> (b.name IS NOT NULL) THEN CASE WHEN a.name IS NOT NULL THEN a.id ELSE b.id END WHEN a.size > b.size OR a.size = b.size AND a.id < b.id THEN a.id ELSE b.id END AS survivor FROM cl a JOIN cl b ON b.id = a.id + 1")
def k5(spark, d):
    cl = _clusters(spark, d)
    side = lambda x: cl.select(*[c(f).alias(f"{x}_{f}") for f in ("id", "name", "size")])
    j = side("a").join(side("b"), c("b_id") == c("a_id") + 1)
    return j.select(c("a_id").alias("a"), c("b_id").alias("b"), E.merge_direction("a", "b").alias("survivor"))


ORDERS_OF = "od AS (SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'name' WHEN 1 THEN 'unname' WHEN 2 THEN 'ignore' WHEN 3 THEN 'reject' END AS verb, CASE WHEN s_suppkey % 5 = 0 THEN 'N' || s_suppkey % 2 END AS new_name FROM supplier WHERE s_suppkey % 5 < 4)"


@query("K8_naming", f"""WITH {CLUSTERS}, {ORDERS_OF}, j AS (SELECT id, cl.name AS old, CASE WHEN verb IS NULL THEN cl.name WHEN verb = 'name' THEN new_name END AS name, CASE verb WHEN 'name' THEN 'named' WHEN 'unname' THEN 'unlabeled' WHEN 'ignore' THEN 'ignored' WHEN 'reject' THEN 'rejected' ELSE state END AS state,
 pinned AND verb IS DISTINCT FROM 'unname' AS pinned, verb FROM cl LEFT JOIN od USING (id)) SELECT id, name, state, pinned, CASE WHEN verb IS NOT NULL AND old IS DISTINCT FROM name THEN old END AS retracts FROM j""")
def k8(spark, d):
    k = c("s_suppkey")
    verb = F.when(k % 5 == 0, "name").when(k % 5 == 1, "unname").when(k % 5 == 2, "ignore").when(k % 5 == 3, "reject")
    orders = read_table(spark, d, "supplier").where("s_suppkey % 5 < 4").select(k.alias("id"), verb.alias("verb"), F.when(k % 5 == 0, F.concat(F.lit("N"), (k % 2).cast("string"))).alias("new_name"))
    return E.apply_naming(_clusters(spark, d).select("id", "name", "state", "pinned"), orders)


@query("K9_rename_person", f"WITH {CLUSTERS} SELECT id, CASE WHEN name = 'N3' THEN 'Nora' ELSE name END AS name FROM cl WHERE name IS NOT NULL")
def k9(spark, d):
    named = _clusters(spark, d).where("name is not null")
    orders = named.where("name = 'N3'").select("id", F.lit("name").alias("verb"), F.lit("Nora").alias("new_name"))
    return E.apply_naming(named.select("id", "name", "state", "pinned"), orders).select("id", "name")


@query("K10_write_plan", f"""WITH {CLUSTERS}, f AS (SELECT l_orderkey AS h, l_linenumber AS i, l_discount AS q, CASE WHEN l_suppkey % 7 = 0 THEN 'ignored' ELSE state END AS state, name FROM lineitem JOIN cl ON l_suppkey = id)
SELECT h, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE state = 'named')), '|'), '') AS keywords, count(*) FILTER (WHERE state = 'named' AND q >= 0.05) AS regions, count(*) FILTER (WHERE state IN ('named', 'ignored')) AS decisions FROM f GROUP BY h""")
def k10(spark, d):
    """Per picture: keywords of all named faces, boxes of those above the quality floor, decisions of named and dismissed ones."""
    state = F.when(c("l_suppkey") % 7 == 0, "ignored").otherwise(c("state"))
    f = read_table(spark, d, "lineitem").join(_clusters(spark, d), c("l_suppkey") == c("id")).select(c("l_orderkey").alias("h"), c("l_discount").alias("q"), state.alias("state"), "name")
    named = c("state") == "named"
    return f.groupBy("h").agg(_text(F.array_sort(F.collect_set(F.when(named, c("name"))))).alias("keywords"), F.count_if(named & (c("q") >= 0.05)).alias("regions"), F.count_if(c("state").isin("named", "ignored")).alias("decisions"))


# --- queues, listings, faces by picture ---------------------------------------------------------------------------------------


@query("M7_reopen_skipped", f"WITH {QUEUE} SELECT item, CASE WHEN state = 'skipped' AND nullif(pack, 0) IS DISTINCT FROM 3 THEN 'pending' ELSE state END AS state FROM q")
def m7(spark, d):
    """Items skipped by another version of the decoder, or none, wait again."""
    other = ~F.nullif("pack", F.lit(0)).eqNullSafe(F.lit(3))
    return _queue(spark, d).select("item", F.when((c("state") == "skipped") & other, "pending").otherwise(c("state")).alias("state"))


@query("M25_release", f"WITH {QUEUE} SELECT item, CASE WHEN state = 'hashing' AND item % 3 = 0 THEN 'pending' ELSE state END AS state FROM q")
def m25(spark, d):
    return _queue(spark, d).select("item", F.when(c("item") % 3 == 0, E.reclaim(c("state"))).otherwise(c("state")).alias("state"))


@query("M20_put_faces", """WITH old AS (SELECT l_orderkey AS h, l_linenumber AS i, 'old' AS src FROM lineitem WHERE l_linestatus = 'F'), new AS (SELECT l_orderkey AS h, l_linenumber AS i, 'new' AS src FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N')
SELECT h, i, src FROM old WHERE h NOT IN (SELECT h FROM new) UNION ALL SELECT h, i, src FROM new""")
def m20(spark, d):
    """A picture's faces are replaced as a whole by those of its new scan."""
    li = read_table(spark, d, "lineitem")
    rows = lambda where, src: li.where(where).select(c("l_orderkey").alias("h"), c("l_linenumber").alias("i"), F.lit(src).alias("src"))
    old, new = rows("l_linestatus = 'F'", "old"), rows("l_linestatus = 'O' and l_returnflag = 'N'", "new")
    return old.join(new.select("h").distinct(), "h", "left_anti").unionByName(new)


@query("D16_dismissed_faces", f"WITH {CLUSTERS} SELECT l_orderkey AS h, l_linenumber AS i, id % 7 AS why FROM lineitem JOIN cl ON l_suppkey = id WHERE id % 7 IN (2, 3)")
def d16(spark, d):
    return read_table(spark, d, "lineitem").join(_clusters(spark, d), c("l_suppkey") == c("id")).where("id % 7 in (2, 3)").select(c("l_orderkey").alias("h"), c("l_linenumber").alias("i"), (c("id") % 7).alias("why"))


@query("D19_faces_of_picture", "SELECT l_orderkey AS h, l_linenumber AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::INT AS place FROM lineitem WHERE l_orderkey % 4 = 0")
def d19(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return read_table(spark, d, "lineitem").where("l_orderkey % 4 = 0").select(c("l_orderkey").alias("h"), c("l_linenumber").alias("i"), F.row_number().over(w).alias("place"))


@query("A3_classify_pass", f"""WITH {LISTING}, now AS (SELECT dir, name, max(size) AS size FROM listing WHERE name NOT LIKE '.%' GROUP BY ALL), cache AS (SELECT dir, name, max(size) + CASE WHEN max(size) > 40 THEN 1 ELSE 0 END AS size FROM listing WHERE size <> 7 GROUP BY ALL)
SELECT n.dir, n.name, CASE WHEN lower(regexp_extract(n.name, '\\.([^.]+)$', 1)) = 'xmp' THEN 'sidecar' WHEN lower(regexp_extract(n.name, '\\.([^.]+)$', 1)) IN ('jpg', 'heic') THEN 'image' WHEN lower(regexp_extract(n.name, '\\.([^.]+)$', 1)) IN ('mov', 'mp4') THEN 'video' ELSE 'skipped' END AS kind,
 c.name IS NOT NULL AND c.size IS NOT DISTINCT FROM n.size AS unchanged FROM now n LEFT JOIN cache c USING (dir, name)""")
def a3(spark, d):
    """A listing without dot files, each entry with its kind and whether the cache has it with the same size."""
    from heliograph.operators import scan as S

    every = _listing(spark, d)
    now = every.where(~F.startswith("name", F.lit("."))).groupBy("dir", "name").agg(F.max("size").alias("size"))
    cache = every.where("size <> 7").groupBy("dir", "name").agg(F.max("size").alias("m")).select("dir", "name", (c("m") + F.when(c("m") > 40, 1).otherwise(0)).alias("cached"), F.lit(True).alias("known"))
    j = now.join(cache, ["dir", "name"], "left")
    return j.select("dir", "name", S.kind(c("name")).alias("kind"), (F.coalesce("known", F.lit(False)) & c("size").eqNullSafe(c("cached"))).alias("unchanged"))


SIDE = "cur AS (SELECT o_orderkey AS id, o_orderdate AS mtime, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS size FROM orders WHERE o_orderstatus <> 'P'), was AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS mtime, CASE WHEN o_custkey % 5 < 2 THEN NULL ELSE o_custkey END AS size FROM orders WHERE o_orderstatus <> 'F')"


def _side(spark, d):
    o, k = read_table(spark, d, "orders"), c("o_custkey")
    cur = o.where("o_orderstatus <> 'P'").select(c("o_orderkey").alias("id"), c("o_orderdate").alias("mtime"), F.when(k % 5 != 0, k).alias("size"))
    late = F.when(c("o_orderpriority") == "1-URGENT", c("o_orderdate") + F.make_dt_interval(days=F.lit(1))).otherwise(c("o_orderdate"))
    return cur, o.where("o_orderstatus <> 'F'").select(c("o_orderkey").alias("id"), late.alias("mtime"), F.when(k % 5 >= 2, k).alias("size"))


@query("A12_sidecar_match", f"WITH {SIDE} SELECT id, w.mtime IS NOT DISTINCT FROM c.mtime AND w.size IS NOT NULL AS matches FROM cur c JOIN was w USING (id)")
def a12(spark, d):
    """The modification time must match; any known size will do."""
    cur, was = _side(spark, d)
    j = cur.select("id", "mtime").join(was.select("id", c("mtime").alias("m"), "size"), "id")
    return j.select("id", (c("m").eqNullSafe(c("mtime")) & c("size").isNotNull()).alias("matches"))


@query("A41_sidecar_changes", f"WITH {SIDE} SELECT coalesce(c.id, w.id) AS id FROM cur c FULL JOIN was w ON c.id = w.id WHERE c.id IS NULL OR w.id IS NULL OR c.mtime IS DISTINCT FROM w.mtime OR c.size IS DISTINCT FROM w.size")
def a41(spark, d):
    from heliograph.operators import sets as P

    cur, was = _side(spark, d)
    return P.diff(was, cur, "id", ("mtime", "size")).where("change <> 'unchanged'").select("id")


@query("A32_sidecar_overlay", W + ", s AS (SELECT o_orderkey AS id, 'Side/' || o_custkey AS tag FROM orders WHERE o_orderstatus = 'F') SELECT p.id, CASE WHEN s.id IS NOT NULL THEN s.tag WHEN p.id % 3 = 0 THEN '' ELSE p.tags[1] END AS first_tag, CASE WHEN s.id IS NOT NULL THEN 'cached' WHEN p.id % 3 = 0 THEN 'absent' ELSE 'unknown' END AS status FROM photos p LEFT JOIN s USING (id)")
def a32(spark, d):
    """A cached sidecar replaces tags; one that was cached and is lost takes them back."""
    s = read_table(spark, d, "orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("id"), F.concat(F.lit("Side/"), c("o_custkey").cast("string")).alias("side"))
    j = photos(spark, d).select("id", "tags", F.when(c("id") % 3 == 0, "cached").otherwise("unknown").alias("was")).join(s, "id", "left")
    has, lost = c("side").isNotNull(), c("was") == "cached"
    tags = F.when(has, F.array("side")).when(lost, F.array().cast("array<string>")).otherwise(c("tags"))
    return j.select("id", F.coalesce(F.get(tags, F.lit(0)), F.lit("")).alias("first_tag"), F.when(has, "cached").when(lost, "absent").otherwise(c("was")).alias("status"))


@query("C2_carries", W + "SELECT id, list_contains(list_transform(tags, lambda t: lower(t)), 'objects/click') OR list_has_any(list_transform(tags, lambda t: lower(string_split(t, '/')[1] || '/' || string_split(t, '/')[2])), ['places/asia']) AS carries FROM photos")
def c2(spark, d):
    """A tag's key equals the query, or, for places, lies under it."""
    keys = F.transform("tags", F.lower)
    carries = lambda q, places: F.exists(keys, lambda k: (k == q) | F.lit(places) & F.startswith(k, F.lit(q + "/")))
    return photos(spark, d).select("id", (carries("objects/click", False) | carries("places/asia", True)).alias("carries"))


@query("C11_strict_prefix", W + ", t AS (SELECT DISTINCT tags[1] AS tag, country FROM photos), x AS (SELECT tag, country, string_split(lower(tag), '/') AS b, string_split(lower('Places/ASIA/' || country), '/') AS a FROM t) SELECT tag, len(b) > len(a) AND b[1:len(a)] = a AS extends FROM x")
def c11(spark, d):
    t = photos(spark, d).select(c("tags")[0].alias("tag"), "country").distinct()
    a, b = F.split(X.match_key(F.concat(F.lit("Places/ASIA/"), c("country"))), "/"), F.split(X.match_key(c("tag")), "/")
    t = t.withColumns({"a": a, "b": b})
    return t.select("tag", ((c("a")[0] == "places") & (F.size("b") > F.size("a")) & (F.slice("b", F.lit(1), F.size("a")) == c("a"))).alias("extends"))


@query("C15_named_region", "SELECT l_orderkey, min(l_linenumber)::INT AS region FROM lineitem WHERE l_suppkey % 4 = 1 GROUP BY 1 UNION ALL SELECT DISTINCT l_orderkey, NULL FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 4 = 1)")
def c15(spark, d):
    g = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (c("l_suppkey") % 4).alias("person")))).alias("rs"))
    first = F.get(F.filter("rs", lambda r: r["person"] == 1), F.lit(0))
    return g.select("l_orderkey", first["l_linenumber"].cast("int").alias("region"))


@query("C22_people_gap", f"WITH {VIEW} SELECT k, array_to_string(list_filter(list_transform(list_filter(tags_list, lambda t: t LIKE 'People/%'), lambda t: split_part(t, '/', 2)), lambda n: NOT list_contains(people, n)), '|') AS undetected FROM p")
def c22(spark, d):
    names = F.transform(F.filter("tags_list", lambda t: F.startswith(t, F.lit("People/"))), E.leaf)
    return _view(spark, d).select("k", _text(E.without(names, c("people"))).alias("undetected"))


@query("D2_person_keys", "SELECT lower(nfc_normalize(c_name)) AS key, min(c_custkey) AS person, bool_or(c_mktsegment = 'BUILDING') AS hidden FROM customer GROUP BY 1")
def d2(spark, d):
    t = read_table(spark, d, "customer").select(X.match_key(c("c_name")).alias("key"), "c_custkey", (c("c_mktsegment") == "BUILDING").alias("h"))
    return t.groupBy("key").agg(F.min("c_custkey").alias("person"), F.bool_or("h").alias("hidden"))


@query("D4_effective_contact", "SELECT c_custkey AS person, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN CASE WHEN s_suppkey IS NOT NULL THEN c_custkey % 200 END ELSE c_nationkey END::BIGINT AS contact FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 200")
def d4(spark, d):
    """Disabled and dangling links give none; a manual one wins over the automatic one."""
    j = read_table(spark, d, "customer").join(read_table(spark, d, "supplier").select("s_suppkey"), c("s_suppkey") == c("c_custkey") % 200, "left")
    manual = F.when(c("c_custkey") % 3 == 0, c("c_custkey") % 200)
    contact = F.when(c("c_custkey") % 7 == 0, None).when(manual.isNotNull(), F.when(c("s_suppkey").isNotNull(), manual)).otherwise(c("c_nationkey"))
    return j.select(c("c_custkey").alias("person"), contact.cast("long").alias("contact"))


@query("A50_geo_cache", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN round(s_acctbal, 2) END AS lat FROM supplier""")
def a50(spark, d):
    """A cache entry of the current version is read, one of another version counts as empty."""
    js = F.to_json(F.struct((c("s_suppkey") % 3).cast("int").alias("version"), c("s_acctbal").alias("lat")))
    t = read_table(spark, d, "supplier").select("s_suppkey", F.from_json(js, "version int, lat double").alias("e"))
    return t.select("s_suppkey", F.when(c("e.version") == 0, F.round("e.lat", 2)).alias("lat"))


@query("A45_sentinel_bag", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'b' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'a|x' ELSE '' END AS bag FROM customer")
def a45(spark, d):
    """Items of the first bag that isn't empty, under either prefix."""
    item = lambda *xs: F.concat(*[y for x in xs for y in (F.lit("<rdf:li>"), x, F.lit("</rdf:li>"))])
    bag = lambda prefix, inner: F.concat(F.lit(f"<{prefix}:subjects><rdf:Bag>"), inner, F.lit(f"</rdf:Bag></{prefix}:subjects>"))
    k, n = c("c_custkey") % 3, F.concat(F.lit(" b"), c("c_nationkey").cast("string"), F.lit(" "))
    xml = F.when(k == 0, F.concat(bag("photo-tools", item(F.lit(" "))), bag("phototools", item(n)))).when(k == 1, bag("photo-tools", item(F.lit("a"), F.lit("x")))).otherwise("<none/>")
    t = read_table(spark, d, "customer").select("c_custkey", xml.alias("xml"))
    items = lambda prefix: F.filter(F.transform(F.regexp_extract_all(F.regexp_extract("xml", f"(?s)<{prefix}:subjects(.*?)</{prefix}:subjects>", 1), F.lit("(?s)<rdf:li>(.*?)</rdf:li>"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    first, second = items("photo-tools"), items("phototools")
    return t.select("c_custkey", _text(F.when(F.size(first) > 0, first).otherwise(second)).alias("bag"))


@query("F2_undated_dedup", """WITH RECURSIVE p AS (SELECT user_id, event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS ts FROM events), e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM p WHERE ts IS NOT NULL),
k(user_id, event_id, rn, anchor, keep) AS (SELECT user_id, event_id, rn, ts, true FROM e WHERE rn = 1 UNION ALL
 SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.ts - k.anchor >= INTERVAL 6 HOUR THEN e.ts ELSE k.anchor END, e.ts - k.anchor >= INTERVAL 6 HOUR FROM k JOIN e ON e.user_id = k.user_id AND e.rn = k.rn + 1)
SELECT user_id, event_id FROM k WHERE keep UNION ALL SELECT user_id, event_id FROM p WHERE ts IS NULL""")
def f2(spark, d):
    """Rows without time always stay and don't move the anchor."""
    from heliograph.operators import sequences as S

    p = read_table(spark, d, "events").select("user_id", "event_id", F.when(c("event_id") % 9 != 0, c("ts")).alias("ts"))
    kept = S.dedup_anchored(p, "user_id", "ts", 6 * 3600)
    first = p.groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    return kept.join(first, ["user_id", "ts"]).select("user_id", "event_id").unionByName(p.where("ts is null").select("user_id", "event_id"))


@query("G1_library_order", W + "SELECT id, row_number() OVER (ORDER BY date_taken DESC NULLS LAST, nfc_normalize(path)) AS rank FROM photos")
def g1(spark, d):
    ensure_checkpoint_dir(spark)
    p = photos(spark, d).select("id", "date_taken", X.nfc(c("path")).alias("path"))
    return E.ranked(p, c("date_taken").desc_nulls_last(), c("path")).select("id", c("rank").cast("long").alias("rank"))
