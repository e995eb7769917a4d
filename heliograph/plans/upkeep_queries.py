"""Upkeep by the whole rules (inventory A1, A16, A29, A30, A43, C6, C8, C21, D21, D23, E5, E11, E19, E23, F7, F8, F11, F12, G11, G12, H7, K6, K7, L6, M5, M8, M22, M26, O2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from heliograph.functions import text as X
from heliograph.operators import edits as E
from heliograph.operators import memories as M
from heliograph.operators import tags as T
from heliograph.operators import upkeep as U
from heliograph.plans.index_queries import WITH
from heliograph.plans.memory_queries import KEPT, LIBRARIES, RUN, TRIPS, _libraries, _trip_rows
from heliograph.plans.registry import query
from heliograph.plans.rules_queries import CLUSTERS, NORMAL, RAW, _clusters, _raw
from heliograph.plans.scan_queries import KIND, LISTING, _listing
from heliograph.plans.set_queue_queries import QUEUE, _queue
from heliograph.session import ensure_checkpoint_dir, read_table
from heliograph.sources.adapters import PHOTOS, photos

c = F.col
P = f"WITH {PHOTOS} "


@query("A1_scan", f"""WITH {LISTING}, now AS (SELECT dir, name, max(size) AS size, {KIND} AS kind, lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem FROM listing WHERE size % 7 <> 3 GROUP BY ALL),
ok AS (SELECT * FROM now WHERE kind <> 'skipped' AND dir NOT LIKE '/r/5/%'), was AS (SELECT dir, name, max(size) AS size FROM listing WHERE size % 5 <> 1 AND name NOT LIKE '.%' GROUP BY ALL),
v AS (SELECT dir, stem, min(name) AS live FROM ok WHERE kind = 'video' GROUP BY ALL), s AS (SELECT dir, stem, min(name) AS side FROM ok WHERE kind = 'sidecar' GROUP BY ALL),
j AS (SELECT coalesce(o.dir, w.dir) AS dir, coalesce(o.name, w.name) AS name, o.kind, o.stem, o.size, w.size AS was, o.name IS NOT NULL AS here, w.name IS NOT NULL AS cached FROM ok o FULL JOIN was w ON o.dir = w.dir AND o.name = w.name)
SELECT j.dir, j.name, {KIND.replace("name", "j.name")} AS kind, CASE WHEN j.kind = 'image' THEN live END AS live, CASE WHEN j.kind = 'image' THEN s.side END AS sidecar,
 CASE WHEN here AND cached THEN CASE WHEN size IS NOT DISTINCT FROM was THEN 'same' ELSE 'changed' END WHEN here THEN 'added' WHEN j.dir LIKE '/r/5/%' THEN 'carried' ELSE 'removed' END AS status
FROM j LEFT JOIN v ON v.dir = j.dir AND v.stem = j.stem LEFT JOIN s ON s.dir = j.dir AND s.stem = j.stem""")
def a1(spark, d):
    """Every file of a scan with its companions, and what became of those in the cache; some folders couldn't be read."""
    every = _listing(spark, d)
    largest = lambda df: df.groupBy("dir", "name").agg(F.max("size").alias("size"))
    now, was = largest(every.where("size % 7 <> 3")), largest(every.where("size % 5 <> 1 and name not like '.%'"))
    return U.scan(now, was, every.where("dir like '/r/5/%'").select("dir").distinct())


def _snapshots(spark, d):
    k = c("o_orderkey") % 5
    t = F.when(k == 0, '{"version": 19, "value": "old"}').when(k == 1, '{"version": 20, "val').when(k == 2, '{"value": {"k": 1}}').otherwise(F.concat(F.lit('{"version": 20, "value": {"k": '), c("o_custkey").cast("string"), F.lit("}}")))
    return read_table(spark, d, "orders").select("o_orderkey", t.alias("txt"))


@query("A43_snapshot_field", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 19 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 20 END::BIGINT AS version FROM orders")
def a43(spark, d):
    """The version alone; none of a text that is cut off or has none."""
    return _snapshots(spark, d).select("o_orderkey", U.snapshot_version(c("txt")).alias("version"))


@query("A16_snapshot_load", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'corrupt' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 5 > 2 THEN o_custkey END AS k FROM orders")
def a16(spark, d):
    """Another version is told apart from a text that can't be read."""
    return U.load_snapshot(_snapshots(spark, d), "txt", 20, "k long").select("o_orderkey", "status", c("value.k").alias("k"))


@query("A29_enrich", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'done' WHEN c_custkey IS NULL THEN 'unread' WHEN c_acctbal < 0 THEN 'failed' ELSE 'enriched' END AS outcome,
 CASE WHEN o_orderstatus <> 'P' AND c_acctbal >= 0 THEN CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END ELSE o_orderpriority END AS country, CASE WHEN o_orderstatus <> 'P' AND c_acctbal >= 0 THEN CASE WHEN c_custkey % 3 <> 0 THEN c_name END ELSE 'tag' END AS tags,
 CASE WHEN o_orderstatus = 'P' THEN o_orderdate WHEN c_custkey IS NOT NULL THEN TIMESTAMP '2024-02-10 00:00:00' END AS enriched_at FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING'""")
def a29(spark, d):
    """Rows that weren't enriched take what was read, also where it is nothing; a failed read changes no field, but isn't tried again."""
    k = c("c_custkey")
    read = read_table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(k.alias("by"), (c("c_acctbal") >= 0).alias("succeeded"), F.lit("2024-02-10 00:00:00").cast("timestamp_ntz").alias("at"), F.when(k % 4 != 0, c("c_mktsegment")).alias("country"), F.when(k % 3 != 0, c("c_name")).alias("tags"))
    o = read_table(spark, d, "orders")
    reads = o.select(c("o_orderkey").alias("id"), c("o_custkey").alias("by")).join(read, "by").drop("by")
    p = o.select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("country"), F.lit("tag").alias("tags"), F.when(c("o_orderstatus") == "P", c("o_orderdate")).alias("enriched_at"))
    return U.enrich(p, reads, ["country", "tags"]).select("id", "outcome", "country", "tags", "enriched_at")


@query("A30_enrich_fields", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END ELSE c_name END AS v FROM customer")
def a30(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", U.resolved(c("c_acctbal") > 0, F.when(c("c_custkey") % 4 != 0, c("c_mktsegment")), c("c_name")).alias("v"))


@query("C6_photos_for_tag", WITH + "SELECT id FROM keyed WHERE key = 'scenes/bright'")
def c6(spark, d):
    """By the tags themselves: no key is derived for photos that lack it."""
    return photos(spark, d).where(T.has_key(c("tags"), "scenes/bright")).select("id")


@query("C8_eligible", P + "SELECT id, NOT is_video AND (id % 4 <> 0 OR id % 8 = 0) AS eligible FROM photos")
def c8(spark, d):
    return photos(spark, d).select("id", U.ml_eligible(c("is_video"), c("id") % 4 == 0, c("id") % 8 == 0).alias("eligible"))


@query("C21_already_current", f"WITH {QUEUE} SELECT item, state <> 'stale' AND pack = 3 AS is_current, false AS forced FROM q UNION ALL SELECT item, false, true FROM q")
def c21(spark, d):
    q = _queue(spark, d)
    both = [q.select("item", U.already_current(c("state"), c("pack"), 3, f).alias("is_current"), F.lit(f).alias("forced")) for f in (False, True)]
    return both[0].unionByName(both[1])


@query("D21_clusters_named", f"WITH {CLUSTERS} SELECT name, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM cl WHERE state = 'named' GROUP BY name")
def d21(spark, d):
    """The named clusters of every person."""
    g = _clusters(spark, d).where("state = 'named'").groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    return g.select("name", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("D23_live_proposals", f"""WITH {CLUSTERS}, p AS (SELECT l_suppkey AS a, l_partkey % 40 AS b, max(l_discount) AS sim FROM lineitem WHERE l_suppkey <> l_partkey % 40 GROUP BY ALL),
live AS (SELECT * FROM p WHERE a IN (SELECT id FROM cl WHERE id % 3 <> 1) AND b IN (SELECT id FROM cl WHERE id % 3 <> 1)) SELECT a, b, sim, row_number() OVER (ORDER BY sim DESC, a, b) AS place FROM live""")
def d23(spark, d):
    """Proposals whose clusters both still exist, the most alike first."""
    ensure_checkpoint_dir(spark)
    ids = _clusters(spark, d).where("id % 3 <> 1").select("id")
    p = read_table(spark, d, "lineitem").where("l_suppkey <> l_partkey % 40").groupBy(c("l_suppkey").alias("a"), (c("l_partkey") % 40).alias("b")).agg(F.max("l_discount").alias("sim"))
    live = p.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return E.ranked(live, F.desc("sim"), c("a"), c("b")).select("a", "b", "sim", c("rank").cast("long").alias("place"))


@query("E5_event_folders", P + """, f AS (SELECT CASE WHEN id % 10 = 0 THEN regexp_replace(folder, '/[^/]*$', '') ELSE folder END AS folder, date_taken FROM photos), g AS (SELECT folder, count(*) AS n, max(date_taken) AS newest FROM f GROUP BY folder)
SELECT folder, n, newest, row_number() OVER (ORDER BY newest DESC, folder) AS place FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE starts_with(h.folder, g.folder || '/'))""")
def e5(spark, d):
    """Every tenth photo lies a level higher, in a folder that has others below it."""
    ensure_checkpoint_dir(spark)
    p = photos(spark, d).withColumn("folder", F.when(c("id") % 10 == 0, F.regexp_replace("folder", "/[^/]*$", "")).otherwise(c("folder")))
    return U.event_folders(p)


@query("E11_first_seen_counts", P + "SELECT country, count(*) AS n, row_number() OVER (ORDER BY min(pos)) AS seen FROM photos GROUP BY country")
def e11(spark, d):
    ensure_checkpoint_dir(spark)
    g = photos(spark, d).groupBy("country").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    return E.ranked(g, c("p")).select("country", "n", c("rank").cast("long").alias("seen"))


@query("E19_running_sums", "SELECT label, dim::INT AS dim, count(*) AS n, round(sum(x::DOUBLE), 6) AS s FROM (SELECT label, u.x, u.dim - 1 AS dim FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, dim)) GROUP BY label, dim")
def e19(spark, d):
    """The state of a running centroid, count and plain sums of all dimensions, of which parts add up."""
    x = read_table(spark, d, "embeddings").select("label", (c("vec_id") % 8).alias("part"), F.posexplode("embedding").alias("dim", "x"))
    part = x.groupBy("label", "part", "dim").agg(F.count("*").alias("n"), F.sum(c("x").cast("double")).alias("s"))
    return part.groupBy("label", "dim").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 6).alias("s"))


@query("E23_dated_rows", P + "SELECT id, date_taken, row_number() OVER (ORDER BY pos) AS place FROM photos WHERE id % 50 <> 0")
def e23(spark, d):
    """Photos with a date, in the order of the library."""
    ensure_checkpoint_dir(spark)
    p = photos(spark, d).withColumn("date_taken", F.when(c("id") % 50 != 0, c("date_taken"))).where("date_taken is not null")
    return E.ranked(p.select("id", "date_taken", "pos"), c("pos")).select("id", "date_taken", c("rank").cast("long").alias("place"))


@query("F7_segment_choice", f"""WITH {LIBRARIES}, {TRIPS}, q AS (SELECT owner, w, upper(country) AS code, string_split(tags[1], '/')[2:] AS s FROM tr)
SELECT owner, w AS trip, CASE WHEN count(DISTINCT code) >= 2 THEN 'countries' WHEN count(DISTINCT lower(s[2])) >= 2 THEN 'places 1' WHEN count(DISTINCT lower(s[3])) >= 2 THEN 'places 2' ELSE 'none' END AS split FROM q GROUP BY ALL""")
def f7(spark, d):
    """How each trip is split: by country, by the first depth with several places, or not at all."""
    by = M.part_depth(_trip_rows(spark, d))
    return by.select("owner", c("g").alias("trip"), F.when(c("by") == 0, "countries").when(c("by").isNull(), "none").otherwise(F.concat(F.lit("places "), c("by").cast("string"))).alias("split"))


@query("F8_on_this_day", f"""WITH RECURSIVE {LIBRARIES}, rows AS (SELECT {{'o': owner}} AS g, t, pos FROM p WHERE month(day) = 1 AND day(day) = 15 AND year(day) <> 2025), {KEPT}
SELECT g.o AS owner, count(*) AS n, count(DISTINCT year(day)) AS years, 50 + 5.0::DOUBLE * count(DISTINCT year(day)) AS score FROM kept JOIN p USING (pos) GROUP BY g HAVING count(*) >= 10""")
def f8(spark, d):
    """This day in other years: libraries with ten photos of it after the fold."""
    p = M.dated(_libraries(spark, d))
    k = M.folded(p.select("owner", F.explode(M.calendar_groups([dt.date(2025, 1, 15)])).alias("g"), "t", "pos", "id").where("g.kind = 'onThisDay'")).join(p.select("owner", "pos", "day"), ["owner", "pos"])
    g = k.groupBy("owner").agg(F.count("*").alias("n"), F.countDistinct(F.year("day")).alias("years")).where(c("n") >= M.LEAST_CALENDAR)
    return g.select("owner", "n", "years", (F.lit(50.0) + F.lit(5.0) * c("years")).alias("score"))


@query("F11_recent_people", """WITH p AS (SELECT 'P' || o_custkey AS person, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY 1), f AS (SELECT 'P' || c_custkey AS person, 1000 - c_custkey AS at_ FROM customer WHERE c_custkey % 97 = 5),
v AS (SELECT p.person, n, at_ FROM p LEFT JOIN f USING (person) WHERE p.person NOT LIKE '%3' AND (at_ IS NOT NULL OR latest >= TIMESTAMP '1998-01-01 00:00:00')), r AS (SELECT person, n, row_number() OVER (ORDER BY at_ NULLS LAST, n DESC, person) AS place FROM v) SELECT * FROM r WHERE place <= 20""")
def f11(spark, d):
    """Featured people, then those with a photo of the last two years by number, twenty in all."""
    ensure_checkpoint_dir(spark)
    name = lambda x: F.concat(F.lit("P"), c(x).cast("string"))
    people = read_table(spark, d, "orders").groupBy(name("o_custkey").alias("person")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    k = read_table(spark, d, "customer")
    featured = k.where("c_custkey % 97 = 5").select(name("c_custkey").alias("person"), (1000 - c("c_custkey")).alias("at"))
    hidden = k.where("c_custkey % 10 = 3").select(name("c_custkey").alias("person"))
    return U.visible_people(people, featured, hidden, dt.datetime(2000, 1, 1), 20)


@query("F12_featured_photo", P + """, t AS (SELECT id, CASE WHEN id % 9 <> 0 THEN date_taken END AS d, person, id % 3 <> 0 AS alone FROM photos UNION ALL SELECT id, CASE WHEN id % 9 <> 0 THEN date_taken END, 'User ' || (user_id + 1), false FROM photos WHERE id % 3 = 0),
pin AS (SELECT person, min(id) AS id FROM t WHERE id % 40 = 3 GROUP BY person) SELECT 'People/' || person AS person, arg_max(t.id, {'a': pin.id IS NOT NULL, 'b': alone, 'c': d IS NOT NULL, 'd': coalesce(d, TIMESTAMP '1900-01-01 00:00:00'), 'e': -t.id}) AS id FROM t LEFT JOIN pin USING (person, id) GROUP BY person""")
def f12(spark, d):
    """The pinned photo of each person, or the newest one without others, or the newest."""
    p = photos(spark, d).withColumn("date_taken", F.when(c("id") % 9 != 0, c("date_taken")))
    p = p.withColumn("tags", F.when(c("id") % 3 == 0, F.concat("tags", F.array(F.concat(F.lit("People/User "), (c("user_id") + 1).cast("string"))))).otherwise(c("tags")))
    of = p.where("id % 40 = 3").select("id", F.explode(F.filter("tags", lambda t: F.startswith(t, F.lit("People/")))).alias("person"))
    return U.featured_photo(p, of.groupBy("person").agg(F.min("id").alias("id")))


@query("G11_name_suggestions", """WITH q AS (SELECT unnest(['cust', '00', 'Person 1', '1']) AS q), lib AS (SELECT DISTINCT 'Person ' || c_custkey % 50 || ' Lee' AS name FROM customer), con AS (SELECT name FROM (SELECT c_name AS name FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT 'person ' || c_custkey || ' lee' FROM customer WHERE c_custkey < 60) WHERE lower(name) NOT IN (SELECT lower(name) FROM lib)),
j AS (SELECT q, name, of_, CASE WHEN starts_with(lower(name), lower(q)) THEN 300 WHEN contains(lower(name), ' ' || lower(q)) THEN 200 ELSE 50 END AS score FROM q, (SELECT name, 0 AS of_ FROM lib UNION ALL SELECT name, 1 FROM con) WHERE contains(lower(name), lower(q))),
r AS (SELECT q, name, score::INT AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, of_, lower(name), name)::INT AS place FROM j) SELECT q, place, name, score FROM r WHERE place <= 8""")
def g11(spark, d):
    """The eight best names for each of some typed texts; the library's before contacts that it doesn't have."""
    k = read_table(spark, d, "customer")
    library = k.select(F.concat(F.lit("Person "), (c("c_custkey") % 50).cast("string"), F.lit(" Lee")).alias("name")).distinct()
    contacts = k.select(c("c_name").alias("name"), (c("c_custkey") % 4 == 0).alias("linked")).unionByName(k.where("c_custkey < 60").select(F.concat(F.lit("person "), c("c_custkey").cast("string"), F.lit(" lee")).alias("name"), F.lit(False).alias("linked")))
    typed = spark.createDataFrame([("cust",), ("00",), ("Person 1",), ("1",)], "q string")
    return U.name_suggestions(typed, library, contacts)


@query("G12_biggest_first", "SELECT l_suppkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS place FROM lineitem GROUP BY 1")
def g12(spark, d):
    """All clusters, the biggest first."""
    ensure_checkpoint_dir(spark)
    g = read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return E.ranked(g, F.desc("n"), c("l_suppkey")).select("l_suppkey", "n", c("rank").cast("long").alias("place"))


@query("H7_normalize_tags", f"WITH {RAW}, {NORMAL}, g AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 6 ELSE 7 END AS residue, p_partkey // 60 AS k, tag FROM kept) SELECT residue, k, array_to_string(list_sort(list(DISTINCT tag)), '|') AS tags, count(*) <> count(tag) AS refused FROM g GROUP BY ALL".replace("array_to_string(list_sort(list(DISTINCT tag)), '|') AS tags", "CASE WHEN count(*) = count(tag) THEN array_to_string(list_sort(list(DISTINCT tag)), '|') END AS tags"))
def h7(spark, d):
    """Lists of tags of all parts; a list with a refused tag is refused."""
    residue = F.when(c("p_partkey") % 2 == 0, c("p_partkey") % 6).otherwise(7)
    g = _raw(spark, d).groupBy(residue.alias("residue"), F.expr("p_partkey div 60").alias("k")).agg(F.collect_list("tag").alias("tags"))
    out = g.select("residue", "k", X.normalize_tags(c("tags")).alias("t"))
    return out.select("residue", "k", F.array_join("t", "|").alias("tags"), c("t").isNull().alias("refused"))


DIMS = "SELECT cluster, u.dim::INT - 1 AS dim, avg(u.x::DOUBLE) AS x FROM {m}, unnest(embedding) WITH ORDINALITY AS u(x, dim) GROUP BY ALL"


def _members(spark, d):
    return read_table(spark, d, "embeddings").select(c("label").cast("long").alias("cluster"), c("vec_id").alias("picture"), "embedding")


@query("K6_merge_many", f"""WITH m AS (SELECT CASE WHEN label IN (2, 3) THEN 1 ELSE label END::BIGINT AS cluster, embedding FROM embeddings), x AS ({DIMS.format(m='m')}), n AS (SELECT cluster, count(*) AS n FROM m GROUP BY 1)
SELECT cluster, dim, n, round(x, 9) AS x, cluster = 1 OR cluster % 5 = 0 AS pinned, CASE WHEN cluster % 2 = 1 THEN 'N' || cluster END AS name FROM x JOIN n USING (cluster)""")
def k6(spark, d):
    """Clusters 2 and 3 go into 1: members move, centres are made anew in all dimensions, the survivor is pinned."""
    m = _members(spark, d)
    cl = m.select("cluster").distinct().select("cluster", F.when(c("cluster") % 2 == 1, F.concat(F.lit("N"), c("cluster").cast("string"))).alias("name"), (c("cluster") % 5 == 0).alias("pinned"))
    _, left, _ = U.merge_clusters(m, cl, 1, [2, 3], "embedding")
    return left.select("cluster", "dim", "n", F.round("x", 9).alias("x"), "pinned", "name")


@query("K6_retracted_names", "SELECT DISTINCT vec_id AS picture, 'N3' AS name FROM embeddings WHERE label = 3")
def k6b(spark, d):
    """The pictures whose sidecars lose a name by that merge; cluster 2 has none."""
    m = _members(spark, d)
    cl = m.select("cluster").distinct().select("cluster", F.when(c("cluster") % 2 == 1, F.concat(F.lit("N"), c("cluster").cast("string"))).alias("name"), (c("cluster") % 5 == 0).alias("pinned"))
    return U.merge_clusters(m, cl, 1, [2, 3, 1], "embedding")[2]


@query("K7_split", f"""WITH t AS (SELECT max(label) + 1 AS fresh FROM embeddings), m AS (SELECT CASE WHEN label = 1 AND vec_id % 3 = 0 THEN fresh ELSE label END::BIGINT AS cluster, embedding FROM embeddings, t), x AS ({DIMS.format(m='m')}), n AS (SELECT cluster, count(*) AS n FROM m GROUP BY 1)
SELECT cluster, dim, n, round(x, 9) AS x, cluster = fresh AS pinned FROM x JOIN n USING (cluster), t""")
def k7(spark, d):
    """A third of cluster 1's members become a new, pinned cluster with the next id; both centres are made anew."""
    m = _members(spark, d)
    fresh = m.agg(F.max("cluster")).first()[0] + 1
    _, out = U.split_cluster(m, 1, m.where("picture % 3 = 0").select("picture"), fresh, "embedding")
    return out.select("cluster", "dim", "n", F.round("x", 9).alias("x"), "pinned")


@query("L6_refresh_plan", "SELECT path, row_number() OVER (ORDER BY path) AS place FROM (SELECT DISTINCT '/p/' || o_custkey || '/' || o_orderpriority AS path FROM orders)")
def l6(spark, d):
    """The paths that were written, each once, in order."""
    ensure_checkpoint_dir(spark)
    return U.refresh_plan(read_table(spark, d, "orders").select(F.concat(F.lit("/p/"), c("o_custkey").cast("string"), F.lit("/"), "o_orderpriority").alias("path")), "path")


@query("M5_stale", f"WITH {QUEUE} SELECT item, CASE WHEN state = 'done' AND pack <> 3 THEN 'stale' ELSE state END AS state FROM q")
def m5(spark, d):
    """The queue after a new pack: what was done by another one is stale."""
    q = _queue(spark, d).withColumn("stat", F.lit(None).cast("string"))
    return U.mark_stale(q, pack=3).select("item", "state")


STAT = f"""{QUEUE}, d AS (SELECT item, any_value(state) AS state, CASE WHEN item % 13 <> 0 THEN 's' || item % 4 END AS stat FROM (SELECT DISTINCT item, state FROM q) GROUP BY item HAVING count(*) = 1), l AS (SELECT item, CASE WHEN item % 11 <> 0 THEN 's' || item % 6 END AS stat FROM d WHERE item % 5 <> 0)"""


@query("M8_restat", f"WITH {STAT} SELECT d.item, CASE WHEN state = 'done' AND l.item IS NOT NULL AND d.stat IS DISTINCT FROM l.stat THEN 'stale' ELSE state END AS state FROM d LEFT JOIN l USING (item)")
def m8(spark, d):
    """Done rows whose file has another stat now are stale; files that the listing lacks are left alone."""
    q = _queue(spark, d).select("item", "state", F.lit(0).alias("pack")).distinct()
    q = q.groupBy("item").agg(F.first("state").alias("state"), F.count("*").alias("n")).where("n = 1").select("item", "state", F.lit(0).alias("pack"), F.when(c("item") % 13 != 0, F.concat(F.lit("s"), (c("item") % 4).cast("string"))).alias("stat"))
    now = q.where("item % 5 <> 0").select("item", F.when(c("item") % 11 != 0, F.concat(F.lit("s"), (c("item") % 6).cast("string"))).alias("stat"))
    return U.mark_stale(q, listing=now).select("item", "state")


@query("M22_move_members", "SELECT l_partkey AS k, CASE WHEN l_suppkey IN (2, 3, 13) THEN 1 ELSE l_suppkey END AS cluster, count(*) AS n FROM lineitem GROUP BY ALL")
def m22(spark, d):
    m = read_table(spark, d, "lineitem").select(c("l_partkey").alias("k"), c("l_suppkey").alias("cluster"))
    return E.move(m, 1, [2, 3, 13]).groupBy("k", "cluster").agg(F.count("*").alias("n"))


@query("M26_reset_results", "SELECT t AS name, 0::BIGINT AS rows, (SELECT max(label) + 1 FROM embeddings)::BIGINT AS next_id FROM (SELECT unnest(['clusters', 'members']) AS t)")
def m26(spark, d):
    """All results go, but ids of clusters aren't given again."""
    m = _members(spark, d)
    tables, fresh = U.reset_results({"members": m, "clusters": m.select("cluster").distinct()}, 0, m.select(c("cluster").alias("id")))
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows", F.lit(fresh).cast("long").alias("next_id")) for n, t in tables.items()]
    return counts[0].unionByName(counts[1])


@query("O2_prompts", """WITH p AS (SELECT DISTINCT 'Objects/' || p_type || '/' || p_name AS path, lower(p_type) AS parent, lower(p_name) AS leaf FROM part UNION SELECT DISTINCT 'Scenes/' || p_brand || CASE WHEN p_size % 2 = 0 THEN '/Alone' ELSE '' END, CASE WHEN p_size % 2 = 0 THEN lower(p_brand) ELSE 'scenes' END, CASE WHEN p_size % 2 = 0 THEN 'alone' ELSE lower(p_brand) END FROM part),
n AS (SELECT leaf, count(*) > 1 AS twice FROM p GROUP BY leaf) SELECT path, CASE WHEN path = 'Objects/SMALL/red widget' THEN 'a red thing' ELSE 'a photo of ' || CASE WHEN leaf[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || leaf || CASE WHEN twice THEN ', a kind of ' || parent ELSE '' END END AS prompt FROM p JOIN n USING (leaf)""")
def o2(spark, d):
    """Prompts of labels; labels that end alike name their parent, and some have a text of their own."""
    p = read_table(spark, d, "part")
    paths = p.select(F.concat(F.lit("Objects/"), "p_type", F.lit("/"), "p_name").alias("path")).unionByName(p.select(F.concat(F.lit("Scenes/"), "p_brand", F.when(c("p_size") % 2 == 0, "/Alone").otherwise("")).alias("path")))
    return U.prompts(paths, spark.createDataFrame([("Objects/SMALL/red widget", "a red thing")], "path string, prompt string"))


def _encoded(spark, d):
    """Names as bytes: UTF-8, UTF-16 of both orders with a mark and of one without, cut within a character, and with half of a surrogate pair."""
    n, k = F.concat("c_name", F.lit(" é中😀")), c("c_custkey") % 6
    mark = lambda h, s: F.concat(F.unhex(F.lit(h)), F.encode(n, s))
    b = F.when(k == 0, F.encode(n, "UTF-8")).when(k == 1, mark("FFFE", "UTF-16LE")).when(k == 2, mark("FEFF", "UTF-16BE")).when(k == 3, F.encode(F.concat(F.lit("é"), n), "UTF-16BE"))
    b = b.when(k == 4, F.concat(mark("FFFE", "UTF-16LE"), F.unhex(F.lit("41")))).otherwise(F.concat(mark("FEFF", "UTF-16BE"), F.unhex(F.lit("D83D"))))
    return read_table(spark, d, "customer").select("c_custkey", b.alias("bytes"))


@query("A46_text_decode", "SELECT c_custkey, CASE WHEN c_custkey % 6 < 4 THEN CASE WHEN c_custkey % 6 = 3 THEN 'é' ELSE '' END || c_name || ' é中😀' END AS txt FROM customer")
def a46(spark, d):
    return _encoded(spark, d).select("c_custkey", X.decoded(c("bytes")).alias("txt"))


@query("F10_week_horizon", f"""WITH RECURSIVE {LIBRARIES}, ahead AS (SELECT k::INT AS ahead, DATE '2025-01-15' + k::INT AS d FROM range(1, 8) AS t(k)), rows AS (SELECT {{'o': owner, 'k': ahead, 'd': ahead.d}} AS g, t, pos FROM p JOIN ahead ON month(day) = month(ahead.d) AND day(day) = day(ahead.d) AND year(day) <> year(ahead.d)), {KEPT}
SELECT g.o AS owner, g.k AS ahead, count(*) AS n, g.d - INTERVAL 1 HOUR AS valid_from, g.d + INTERVAL 23 HOUR AS valid_to FROM kept GROUP BY g HAVING count(*) >= 10""")
def f10(spark, d):
    """The coming week's days with ten photos in other years, each valid from its local midnight to the next."""
    ahead = [RUN.today + dt.timedelta(days=i) for i in range(1, M.HORIZON + 1)]
    p = M.dated(_libraries(spark, d)).where(F.date_format("day", "MM-dd").isin([x.strftime("%m-%d") for x in ahead]))
    k = M.folded(p.select("owner", F.explode(M.calendar_groups(ahead)).alias("g"), "t", "pos", "id").where("g.kind = 'onThisDay'"))
    g = k.groupBy("owner", "g").agg(F.count("*").alias("n")).where(c("n") >= M.LEAST_CALENDAR)
    start = F.to_date("g.key").cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(RUN.offset_s))
    return g.select("owner", F.datediff(F.to_date("g.key"), F.lit(RUN.today)).cast("int").alias("ahead"), "n", start.alias("valid_from"), (start + F.make_dt_interval(days=F.lit(1))).alias("valid_to"))
