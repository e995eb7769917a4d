"""The memory ladder as one plan, and its steps by the whole rule (inventory N4, N5, E12, E22, F3, F4, F6, G7)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from heliograph.operators import memories as M
from heliograph.plans.registry import query
from heliograph.session import ensure_checkpoint_dir, read_table
from heliograph.sources.adapters import PHOTOS, photos

c = F.col
RUN = M.Run(dt.datetime(2025, 1, 15, 12, 0), 3600, "2025-01-15", "People/User 7", ("People/User 3",), {"People/User 4": None, "People/User 5": "9"})


def _libraries(spark, d):
    """The photos as five libraries, each with every fifth user's; some lack a date or position."""
    p = photos(spark, d).withColumn("owner", (c("user_id") % 5).cast("long"))
    return p.withColumns({"date_taken": F.when(c("id") % 50 != 0, c("date_taken")), "gps_lat": F.when(c("id") % 11 != 0, c("gps_lat"))})


#: The same for DuckDB, with local time; only dated ones.
LIBRARIES = f"""{PHOTOS}, p AS (SELECT user_id % 5 AS owner, pos, id, date_taken AS t, date_taken + tz_offset_s * INTERVAL 1 SECOND AS lt, (date_taken + tz_offset_s * INTERVAL 1 SECOND)::DATE AS day,
  CASE WHEN id % 11 <> 0 THEN gps_lat END AS lat, gps_lon AS lon, country, folder, tags FROM photos WHERE id % 50 <> 0)"""


def _contacts(spark, d):
    k = c("c_custkey")
    return read_table(spark, d, "customer").select(k.cast("string").alias("contact"), F.lit("User").alias("given"), k.cast("string").alias("family"), (1 + k % 2).cast("int").alias("month"), (10 + k % 10).cast("int").alias("day"))


@query("N4_generate_memories")
def n4(spark, d):
    """The day's memories of each library. Its test holds it against a plain ladder."""
    p = _libraries(spark, d)
    seen = p.where("id % 97 = 0").select("owner", F.concat(F.lit("folder-"), "folder").alias("mid"), (c("date_taken") + F.make_dt_interval(days=F.lit(340))).alias("at"))
    surfaced = p.where("id % 89 = 0").select("owner", F.concat(F.lit("folder-"), "folder").alias("cluster"), (c("date_taken") + F.make_dt_interval(days=F.lit(360))).alias("at"))
    out = M.generate(p, RUN, _contacts(spark, d), seen, surfaced)
    return out.withColumn("photos", F.array_join("photos", ","))


#: The photos that a fold of 60 seconds keeps in each group of rows(g, t, pos), in SQL: kept(g, t, pos, i, n).
KEPT = """e AS (SELECT g, t, min(pos) AS pos, row_number() OVER (PARTITION BY g ORDER BY t) AS rn FROM rows GROUP BY g, t),
k(g, rn, t, pos, last, keep) AS (SELECT g, rn, t, pos, t, true FROM e WHERE rn = 1 UNION ALL SELECT e.g, e.rn, e.t, e.pos, CASE WHEN e.t - k.last >= INTERVAL 60 SECOND THEN e.t ELSE k.last END, e.t - k.last >= INTERVAL 60 SECOND FROM k JOIN e ON e.g = k.g AND e.rn = k.rn + 1),
kept AS (SELECT g, t, pos, row_number() OVER (PARTITION BY g ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM k WHERE keep)"""
#: Of n photos in order, whether the one at i stays in a sample of 75, and at which slot.
SLOT = "list_filter(range(0, 75), lambda s: floor(s::DOUBLE * (n::DOUBLE / 75.0::DOUBLE)) = i)"
DAYS = ", ".join(f"({i}, DATE '{RUN.today + dt.timedelta(days=i)}')" for i in range(1, 8))


@query("N5_scheduled_memories", f"""WITH RECURSIVE {LIBRARIES}, ahead(i, d) AS (VALUES {DAYS}), miles AS (SELECT unnest([0, {", ".join(map(str, M.MILESTONES))}]) AS m),
rows AS (SELECT {{'o': owner, 'm': m, 'd': ahead.d}} AS g, t, pos FROM p JOIN ahead ON month(day) = month(ahead.d) AND day(day) = day(ahead.d) JOIN miles ON CASE WHEN m = 0 THEN year(day) <> year(ahead.d) ELSE year(day) = year(ahead.d) - m END), {KEPT},
y AS (SELECT g, count(DISTINCT year(day)) AS years FROM kept JOIN p USING (pos) GROUP BY g),
s AS (SELECT g, n, min(t) AS first, max(t) AS last, string_agg(id, ',' ORDER BY i) FILTER (n <= 75 OR len({SLOT}) > 0) AS photos, max(id) FILTER (i = n // 2 AND (n <= 75 OR len({SLOT}) > 0)) AS own, max(id) FILTER (i = floor(37 * (n::DOUBLE / 75.0::DOUBLE))) AS mid FROM kept JOIN p USING (pos, t) GROUP BY g, n HAVING n >= 10)
SELECT g.o AS owner, (g.d::TIMESTAMP - INTERVAL 1 HOUR) AS valid_from, (g.d::TIMESTAMP + INTERVAL 23 HOUR) AS valid_to, CASE WHEN g.m = 0 THEN 'onThisDay-' || g.d ELSE 'yearsAgo-' || g.m || '-' || g.d END AS mid, CASE WHEN g.m = 0 THEN 'On this day' ELSE 'On this day in ' || (year(g.d) - g.m) END AS title,
  n, first, last, CASE WHEN g.m = 0 THEN 50 + 5 * years WHEN g.m >= 10 THEN 45 WHEN g.m >= 5 THEN 40 ELSE 35 END::DOUBLE AS score, CASE WHEN g.m > 0 THEN g.m END::INT AS years_ago, photos, coalesce(own, mid) AS cover
FROM s JOIN y USING (g) WHERE NOT (g.m = 1 AND g.d = DATE '2025-01-17')""")
def n5(spark, d):
    """The calendar's memories of the coming week, with the windows in which they are valid; one is hidden."""
    out = M.scheduled(_libraries(spark, d), RUN, hidden=("yearsAgo-1-2025-01-17",))
    return out.withColumn("photos", F.array_join("photos", ",")).drop("kind")


HOME = """geo AS (SELECT *, floor(lat / 0.1::DOUBLE)::BIGINT AS cy, floor(lon / 0.1::DOUBLE)::BIGINT AS cx FROM p WHERE lat IS NOT NULL AND owner IN (SELECT owner FROM p WHERE lat IS NOT NULL GROUP BY owner HAVING count(*) >= 5)),
need AS (SELECT owner, least(180, greatest(30, ((epoch_us(max(t)) - epoch_us(min(t))) // 86400000000) // 2)) AS s, least(30, greatest(10, count(DISTINCT day) // 4)) AS d FROM geo GROUP BY owner),
prim AS (SELECT owner, cy, cx FROM geo JOIN need USING (owner) GROUP BY owner, cy, cx, s, d HAVING (epoch_us(max(t)) - epoch_us(min(t))) // 86400000000 >= s AND count(DISTINCT day) >= d),
ring AS (SELECT DISTINCT owner, cy + a.i AS cy, cx + b.i AS cx FROM prim, range(-1, 2) AS a(i), range(-1, 2) AS b(i)),
med AS (SELECT owner, max(lat) FILTER (a = n // 2) AS mlat, max(lon) FILTER (b = n // 2) AS mlon FROM (SELECT owner, lat, lon, row_number() OVER (PARTITION BY owner ORDER BY lat) - 1 AS a, row_number() OVER (PARTITION BY owner ORDER BY lon) - 1 AS b, count(*) OVER (PARTITION BY owner) AS n FROM geo) GROUP BY owner),
away AS (SELECT geo.*, CASE WHEN owner IN (SELECT owner FROM prim) THEN ring.owner IS NOT NULL ELSE 2 * 6371.0 * atan2(sqrt(x), sqrt(1 - x)) <= 50 END AS home FROM
  (SELECT geo.*, pow(sin(radians(lat - mlat) / 2), 2) + cos(radians(mlat)) * cos(radians(lat)) * pow(sin(radians(lon - mlon) / 2), 2) AS x FROM geo JOIN med USING (owner)) geo LEFT JOIN ring USING (owner, cy, cx)),
cut AS (SELECT *, CASE WHEN coalesce(lag(home) OVER w, true) OR t - lag(t) OVER w > INTERVAL 48 HOUR THEN 1 ELSE 0 END AS f FROM away WINDOW w AS (PARTITION BY owner ORDER BY t, pos)),
runs AS (SELECT *, sum(f) OVER (PARTITION BY owner ORDER BY t, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM cut)"""


@query("F3_trip_runs", f"WITH {LIBRARIES}, {HOME} SELECT owner, run, count(*) AS n, min(t) AS first, max(t) AS last FROM runs WHERE NOT home GROUP BY owner, run")
def f3(spark, d):
    """Stretches away from home without a gap of more than 48 hours; home is found from the photos."""
    t = M.trips(M.dated(_libraries(spark, d)))
    return t.groupBy("owner", "run").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("F4_trips", f"""WITH RECURSIVE {LIBRARIES}, {HOME}, rows AS (SELECT {{'o': owner, 'r': run}} AS g, t, pos FROM runs WHERE NOT home), {KEPT},
a AS (SELECT g, count(*) AS n, min(t) AS first, max(t) AS last FROM kept GROUP BY g), l AS (SELECT a.g, a.n, first, last, lt FROM a JOIN kept ON kept.g = a.g AND kept.t = a.last JOIN p ON p.pos = kept.pos),
s AS (SELECT *, greatest(1, (epoch_us(last) - epoch_us(first)) // 86400000000) AS days FROM l WHERE n >= 15 AND date_trunc('month', lt) <> DATE '2024-02-01')
SELECT g.o AS owner, g.r AS run, n, days, 20 + 1.5::DOUBLE * days AS score FROM s""")
def f4(spark, d):
    """Trips with 15 photos after the fold (so before it, too) that don't end in the current month, here February 2024."""
    t = M.trips(M.dated(_libraries(spark, d))).checkpoint()
    k = M.folded(t.select("owner", c("run").alias("g"), "t", "pos", "id")).join(t.select("owner", "pos", "lt"), ["owner", "pos"])
    g = k.groupBy("owner", c("g").alias("run")).agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.max_by("lt", "t").alias("lt"))
    days = F.greatest(M.days_between(c("first"), c("last")), F.lit(1))
    g = g.where((c("n") >= M.LEAST) & (F.date_format("lt", "yyyy-MM") != "2024-02"))
    return g.select("owner", "run", "n", days.alias("days"), (F.lit(20.0) + F.lit(1.5) * days).alias("score"))


@query("E22_folder_events", f"""WITH RECURSIVE {LIBRARIES}, rows AS (SELECT {{'o': owner, 'f': folder}} AS g, t - (date_part('second', t) * (id % 2))::BIGINT * INTERVAL 1 SECOND AS t, pos FROM p), {KEPT},
a AS (SELECT g, count(*) AS n, min(t) AS first, max(t) AS last FROM kept GROUP BY g)
SELECT g.f AS folder, n, 10 + least((epoch_us(last) - epoch_us(first)) // 86400000000, 14)::DOUBLE AS score FROM a WHERE n >= 15 AND date_trunc('month', last) <> DATE '2024-02-01'""")
def e22(spark, d):
    """Folders with 15 photos after the fold whose last one is not of the current month; the score grows with whole days up to 14."""
    t = c("date_taken") - F.make_dt_interval(secs=(F.floor(F.date_format("date_taken", "s").cast("int")) * (c("id") % 2)).cast("int"))
    p = _libraries(spark, d).where("date_taken is not null").select("owner", c("folder").alias("g"), t.alias("t"), "pos", "id")
    g = M.folded(p).groupBy("owner", c("g").alias("folder")).agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")).where(c("n") >= M.LEAST)
    g = g.where(F.date_format("last", "yyyy-MM") != "2024-02")
    return g.select("folder", "n", (F.lit(10.0) + F.least(M.days_between(c("first"), c("last")), F.lit(14))).alias("score"))


#: Rows of trips for labels and parts: each library's weeks; in some weeks half of the photos lack a country, in some all.
TRIPS = """tr AS (SELECT owner, week(day)::BIGINT * 10 + id % 3 AS w, pos, t, CASE WHEN week(day) % 2 = 0 AND id % 2 = 0 OR week(day) = 3 THEN NULL WHEN id % 40 = 1 OR week(day) % 2 = 0 THEN country ELSE 'NATION_0' END AS country,
  [CASE WHEN week(day) % 2 = 1 THEN 'Places/One/Region ' || (week(day) // 2) || CASE WHEN id % 5 = 0 THEN '' ELSE '/Town ' || id % 4 END ELSE tags[1] END, tags[2]] AS tags FROM p WHERE id % 3 < 2)"""


def _trip_rows(spark, d):
    p = M.dated(_libraries(spark, d)).where("id % 3 < 2")
    week = F.weekofyear("day")
    country = F.when(((week % 2 == 0) & (c("id") % 2 == 0)) | (week == 3), None).when((c("id") % 40 == 1) | (week % 2 == 0), c("country")).otherwise("NATION_0")
    place = F.concat(F.lit("Places/One/Region "), F.expr("weekofyear(day) div 2").cast("string"), F.when(c("id") % 5 == 0, "").otherwise(F.concat(F.lit("/Town "), (c("id") % 4).cast("string"))))
    tags = F.array(F.when(week % 2 == 1, place).otherwise(c("tags")[0]), c("tags")[1])
    return p.select("owner", (week.cast("long") * 10 + c("id") % 3).alias("g"), F.lit("").alias("part"), "t", "pos", "id", country.alias("country"), tags.alias("tags"))


@query("E12_trip_labels", f"""WITH {LIBRARIES}, {TRIPS}, n AS (SELECT owner, w, country, count(*) AS n, min({{'t': t, 'p': pos}}) AS seen FROM tr WHERE country <> '' GROUP BY ALL),
a AS (SELECT owner, w, count(*) AS k, sum(n) AS s, max(n) AS m, arg_min(country, {{'o': -n, 's': seen}}) AS top, list(country ORDER BY n DESC, country) AS names FROM n GROUP BY ALL),
q AS (SELECT owner, w, t, pos, string_split(tags[1], '/')[2:] AS s FROM tr), first AS (SELECT owner, w, arg_min(s, {{'t': t, 'p': pos}}) AS s, count(*) AS n FROM q GROUP BY ALL),
l AS (SELECT owner, w, d, count(*) AS have, count(DISTINCT lower(s[d])) AS kinds FROM q, unnest(range(1, len(s) + 1)) AS u(d) GROUP BY ALL),
x AS (SELECT f.owner, f.w, any_value(f.s) AS s, coalesce(min(d) FILTER (have < n OR kinds > 1) - 1, max(d)) AS depth FROM first f JOIN l USING (owner, w) GROUP BY ALL)
SELECT x.owner, x.w AS trip, CASE WHEN m::DOUBLE / s2 >= 0.9 THEN CASE WHEN depth >= 2 THEN s[depth] ELSE top END WHEN k > 3 THEN k || ' countries' WHEN k = 3 THEN names[1] || ', ' || names[2] || ' & ' || names[3] WHEN k = 2 THEN names[1] || ' & ' || names[2]
  WHEN depth >= 1 THEN s[depth] ELSE top END AS label FROM x LEFT JOIN (SELECT owner, w, k, s AS s2, m, top, names FROM a) a USING (owner, w)""")
def e12(spark, d):
    """Where trips went: the deepest shared place below a country of nine tenths, the countries, or the deepest shared place."""
    return M.trip_labels(_trip_rows(spark, d)).select("owner", c("g").alias("trip"), "label")


@query("F6_place_segments", f"""WITH {LIBRARIES}, {TRIPS}, q AS (SELECT owner, w, t, pos, upper(country) AS code, string_split(tags[1], '/')[2:] AS s FROM tr),
b AS (SELECT owner, w, CASE WHEN count(DISTINCT code) >= 2 THEN 0 WHEN count(DISTINCT lower(s[2])) >= 2 THEN 1 WHEN count(DISTINCT lower(s[3])) >= 2 THEN 2 END AS lv FROM q GROUP BY ALL),
k AS (SELECT q.*, CASE WHEN lv = 0 THEN lower(code) WHEN len(s) > lv THEN lower(array_to_string(s[1:lv + 1], '-')) END AS key FROM q JOIN b USING (owner, w) WHERE lv IS NOT NULL),
f AS (SELECT *, CASE WHEN lag(pos) OVER v IS NULL OR lag(key) OVER v IS DISTINCT FROM key THEN 1 ELSE 0 END AS f FROM k WINDOW v AS (PARTITION BY owner, w ORDER BY t, pos)),
r AS (SELECT *, sum(f) OVER (PARTITION BY owner, w ORDER BY t, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM f)
SELECT owner, w AS trip, run, key, count(*) AS n, min(pos) AS first_pos FROM r WHERE key IS NOT NULL GROUP BY ALL""")
def f6(spark, d):
    """Stretches of one country where a trip has several, else of one place at the first depth with several."""
    p = M.trip_parts(_trip_rows(spark, d))
    return p.groupBy("owner", c("g").alias("trip"), "run", "key").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query("G7_sampled_memories", f"""WITH {PHOTOS}, r AS (SELECT country, id, row_number() OVER (PARTITION BY country ORDER BY date_taken, pos) - 1 AS i, count(*) OVER (PARTITION BY country) AS n FROM photos),
s AS (SELECT country, n, string_agg(id, ',' ORDER BY i) FILTER (n <= 75 OR len({SLOT}) > 0) AS photos, max(id) FILTER (i = n // 3 AND (n <= 75 OR len({SLOT}) > 0)) AS own, max(id) FILTER (i = floor(37 * (n::DOUBLE / 75.0::DOUBLE))) AS mid FROM r GROUP BY ALL)
SELECT country, n, photos, coalesce(own, mid) AS cover FROM s""")
def g7(spark, d):
    """At most 75 photos of each set, evenly spaced; the cover (a third into the set) moves to the middle of the sample if the sample lacks it."""
    ensure_checkpoint_dir(spark)
    rows = photos(spark, d).select(F.lit(0).alias("owner"), c("country").alias("g"), F.lit("").alias("part"), c("date_taken").alias("t"), "pos", "id")
    chosen = rows.groupBy("owner", "g", "part").agg(F.count("*").alias("n")).withColumn("kind", F.lit("folderEvent"))
    return M.sampled(rows, chosen).select(c("g").alias("country"), "n", F.array_join("photos", ",").alias("photos"), "cover")
