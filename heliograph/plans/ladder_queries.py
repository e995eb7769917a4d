"""Memory ladder, selection, statistics and matching by the reference rules' own thresholds (inventory A, C, D, E, F, G, K, M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heliograph.functions import text as X
from heliograph.operators import edits as E
from heliograph.operators import ladder as L
from heliograph.operators import spans as R
from heliograph.operators import tags as T
from heliograph.operators import vectors as V
from heliograph.plans.index_queries import WITH
from heliograph.plans.rules_queries import CLUSTERS, LOCAL_SQL, _clusters, local
from heliograph.plans.scan_queries import KIND, LISTING, _listing
from heliograph.plans.registry import query
from heliograph.plans.set_queue_queries import QUEUE, _queue
from heliograph.session import ensure_checkpoint_dir, read_table
from heliograph.sources.adapters import PHOTOS, photos

c = F.col
W = f"WITH {PHOTOS} "
TODAY = "2024-02-10"

#: A third of all photos on one day, so that some day is dense.
DAYS = f"dd AS (SELECT id, CASE WHEN id % 3 = 0 THEN DATE '2024-01-05' ELSE {LOCAL_SQL}::DATE END AS day FROM photos)"


@query("E10_density_days", f"WITH {PHOTOS}, {DAYS}, n AS (SELECT day, count(*) AS n FROM dd GROUP BY day), a AS (SELECT sum(n) AS s, count(*) AS d FROM n) SELECT day, n, 8.0::DOUBLE AS score FROM n, a WHERE n >= greatest(15, trunc(3.0::DOUBLE * (s::DOUBLE / d))) AND date_trunc('month', day) <> DATE '2024-02-01'")
def e10(spark, d):
    rows = photos(spark, d).select(F.when(c("id") % 3 == 0, F.lit("2024-01-05").cast("date")).otherwise(F.to_date(local())).alias("day"))
    return L.density_days(rows, "day", TODAY)


GEO = "g AS (SELECT CASE WHEN o_custkey % 4 = 0 THEN o_custkey % 20 ELSE o_custkey END AS cy, (o_custkey % 4)::BIGINT AS cx, o_orderdate::DATE AS day FROM orders)"


@query("E9_home_regions", f"""WITH {GEO}, r AS (SELECT cy, cx, count(DISTINCT day) AS days, (max(day) - min(day))::BIGINT AS span FROM g GROUP BY ALL), t AS (SELECT (max(day) - min(day))::BIGINT AS span, count(DISTINCT day) AS days FROM g),
home AS (SELECT r.* FROM r, t WHERE r.span >= least(180, greatest(30, t.span // 2)) AND r.days >= least(30, greatest(10, t.days // 4))) SELECT DISTINCT cy + i AS cy, cx + j AS cx FROM home, range(-1, 2) AS a(i), range(-1, 2) AS b(j)""")
def e9(spark, d):
    k = c("o_custkey")
    g = read_table(spark, d, "orders").select(F.when(k % 4 == 0, k % 20).otherwise(k).alias("cy"), (k % 4).cast("long").alias("cx"), F.to_date("o_orderdate").alias("day"))
    return L.home_regions(g)


@query("F15_valid_now", """WITH v AS (SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS pick FROM orders WHERE o_orderdate <= timestamp '1998-06-01 00:00:00' AND o_orderdate + INTERVAL 90 DAY > timestamp '1998-06-01 00:00:00' GROUP BY 1),
e AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT o_custkey, coalesce(pick, first) AS pick FROM v FULL JOIN e USING (o_custkey)""")
def f15(spark, d):
    """The valid memory of highest priority, or else the first evergreen one."""
    now = F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")
    valid = (c("o_orderdate") <= now) & (c("o_orderdate") + F.make_dt_interval(days=F.lit(90)) > now)
    best = F.max_by("o_orderkey", F.when(valid, F.struct("o_totalprice", (-c("o_orderkey")).alias("first"))))
    g = read_table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("best"), F.bool_or(valid).alias("any"), F.min(F.when(c("o_orderstatus") == "P", c("o_orderkey"))).alias("evergreen"))
    return g.select("o_custkey", F.when(c("any"), c("best")).otherwise(c("evergreen")).alias("pick")).where("pick is not null")


M = "18446744073709551616::UHUGEINT"


@query("G5_selection", f"""WITH p AS (SELECT p_partkey, p_brand, p_size, ({X.seed_state(TODAY)}::UHUGEINT + {int(X.GAMMA)}::UHUGEINT * (p_partkey + 1)::UHUGEINT) % {M} AS z0 FROM part), z1 AS (SELECT *, (xor(z0, z0 // 1073741824::UHUGEINT) * {int(X.MIX_A)}::UHUGEINT) % {M} AS z FROM p),
z2 AS (SELECT * REPLACE ((xor(z, z // 134217728::UHUGEINT) * {int(X.MIX_B)}::UHUGEINT) % {M} AS z) FROM z1), s AS (SELECT p_partkey, p_brand, p_size + 12.0::DOUBLE * ((xor(z, z // 2147483648::UHUGEINT) % 9007199254740992::UHUGEINT)::DOUBLE * 1.1102230246251565e-16::DOUBLE) AS s FROM z2),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_partkey) AS rn FROM s) SELECT p_partkey, p_brand, row_number() OVER (ORDER BY s DESC, p_partkey)::INT AS rank FROM b WHERE rn = 1 ORDER BY s DESC, p_partkey LIMIT 10""")
def g5(spark, d):
    """Candidates by score and the day's jitter (one draw a position), the best of each cluster, ten of them."""
    p = read_table(spark, d, "part").select("p_partkey", "p_brand", (c("p_size") + X.nth_draw(TODAY, c("p_partkey"), 12.0)).alias("s"))
    best = p.groupBy("p_brand").agg(F.max(F.struct("s", (-c("p_partkey")).alias("first"))).alias("b"))
    top = best.select((-c("b.first")).alias("p_partkey"), "p_brand", c("b.s").alias("s")).orderBy(F.desc("s"), "p_partkey").limit(10)
    return top.select("p_partkey", "p_brand", F.row_number().over(Window.orderBy(F.desc("s"), "p_partkey")).alias("rank"))  # ten rows


CENTRES = """x AS (SELECT label, u.dim AS dim, avg(u.x::DOUBLE) AS m FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, dim) GROUP BY ALL), cen AS (SELECT label, list(m ORDER BY dim) AS m, sqrt(sum(m * m)) AS n FROM x GROUP BY label)"""


@query("K1_incremental_assign", f"""WITH {CENTRES}, s AS (SELECT vec_id, c.label, list_dot_product(embedding::DOUBLE[], m) / n AS s FROM embeddings, cen c),
g AS (SELECT vec_id, max(s) FILTER (WHERE label % 2 = 0) AS sn, arg_max(label, (s, -label)) FILTER (WHERE label % 2 = 0) AS ln, max(s) FILTER (WHERE label % 2 = 1) AS so, arg_max(label, (s, -label)) FILTER (WHERE label % 2 = 1) AS lo FROM s GROUP BY vec_id)
SELECT vec_id, CASE WHEN sn >= 0.4 THEN 'auto' WHEN so >= 0.25 THEN 'join' ELSE 'seed' END AS tier, CASE WHEN sn >= 0.4 THEN ln WHEN so >= 0.25 THEN lo END AS cluster FROM g""")
def k1(spark, d):
    """Named clusters have even labels here."""
    e = read_table(spark, d, "embeddings")
    cen = V.unit_centroids(e, "label", "embedding").select("label", "centroid", (c("label") % 2 == 0).alias("named"))
    return L.assign(e.select("vec_id", "embedding"), cen, "vec_id", "embedding", 0.4, 0.25)


@query("E20_merge_groups", f"""WITH RECURSIVE {CENTRES}, e AS (SELECT a.label AS a, b.label AS b, list_dot_product(a.m, b.m) / a.n / b.n AS sim FROM cen a JOIN cen b ON a.label < b.label WHERE list_dot_product(a.m, b.m) / a.n / b.n >= 0.1),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, c) AS (SELECT a, a FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.id), m AS (SELECT id, min(c) AS component FROM r GROUP BY id),
t AS (SELECT component, round(max(sim), 6) AS sim FROM e JOIN m ON e.a = m.id GROUP BY component) SELECT id, component, sim FROM m JOIN t USING (component)""")
def e20(spark, d):
    """Groups of clusters that proposals connect, with each group's best similarity; over all proposals."""
    ensure_checkpoint_dir(spark)
    p = L.proposals(V.unit_centroids(read_table(spark, d, "embeddings"), "label", "embedding"), "label", "centroid", 0.1).checkpoint()
    m = V.components(p.select(F.explode(F.array("a", "b")).alias("id")).distinct(), p)
    best = p.join(m.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.round(F.max("sim"), 6).alias("sim"))
    return m.join(best, "component").select("id", "component", "sim")


@query("D11_merge_proposals", f"WITH {CENTRES} SELECT a.label AS a, b.label AS b, round(list_dot_product(a.m, b.m) / a.n / b.n, 6) AS sim FROM cen a JOIN cen b ON a.label < b.label WHERE list_dot_product(a.m, b.m) / a.n / b.n >= 0.1")
def d11(spark, d):
    ensure_checkpoint_dir(spark)
    p = L.proposals(V.unit_centroids(read_table(spark, d, "embeddings"), "label", "embedding"), "label", "centroid", 0.1)
    return p.select("a", "b", F.round("sim", 6).alias("sim"))


@query("M6_reclaim", f"WITH {QUEUE} SELECT CASE WHEN state = 'hashing' THEN 'pending' ELSE state END AS state, count(*) AS n FROM q GROUP BY 1")
def m6(spark, d):
    return _queue(spark, d).groupBy(E.reclaim(c("state")).alias("state")).agg(F.count("*").alias("n"))


@query("E15_queue_stats", f"""WITH {QUEUE} SELECT count(*) FILTER (WHERE state = 'done') AS done, count(*) FILTER (WHERE state IN ('pending', 'hashing', 'stale') OR state = 'failed' AND retries < 3) AS pending,
count(*) FILTER (WHERE state = 'failed' AND retries >= 3) AS failed, count(*) FILTER (WHERE state = 'skipped') AS skipped FROM q""")
def e15(spark, d):
    return E.queue_stats(_queue(spark, d), 3)


@query("M17_daily_gate", W + f", x AS (SELECT id, user_id, date_taken, {LOCAL_SQL}::DATE AS day FROM photos) SELECT id, day IS DISTINCT FROM lag(day) OVER (PARTITION BY user_id ORDER BY date_taken, id) AS regenerates FROM x")
def m17(spark, d):
    """The first event of a local day regenerates, the others find the day's result."""
    p = photos(spark, d).select("user_id", "id", "date_taken", F.to_date(local()).alias("day"))
    r = R.with_previous(p, "user_id", ["date_taken", "id"], ["day"])
    return r.select("id", (~c("day").eqNullSafe(c("__prev.day"))).alias("regenerates"))


BIND = """b AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_quantity) / 50 AS x, min(l_discount) * 10 AS y FROM lineitem GROUP BY ALL),
p AS (SELECT a.k, a.i AS claim, b.i AS box, greatest(0, 1 - abs(a.x - b.x)) * greatest(0, 1 - abs(a.y - b.y)) AS inter FROM b a JOIN b ON a.k = b.k AND a.i < b.i),
s AS (SELECT k, claim, box, round(inter / (2 - inter), 9) AS iou FROM p WHERE round(inter / (2 - inter), 9) > 0.5), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY iou DESC, claim, box) AS pos FROM s)"""


@query("D10_bind_claims", f"""WITH RECURSIVE {BIND}, f(k, pos, cs, bs, ok) AS (SELECT k, 1::BIGINT, [claim], [box], true FROM o WHERE pos = 1 UNION ALL
SELECT o.k, o.pos, CASE WHEN list_contains(cs, claim) OR list_contains(bs, box) THEN cs ELSE list_append(cs, claim) END, CASE WHEN list_contains(cs, claim) OR list_contains(bs, box) THEN bs ELSE list_append(bs, box) END, NOT (list_contains(cs, claim) OR list_contains(bs, box)) FROM f JOIN o ON o.k = f.k AND o.pos = f.pos + 1)
SELECT o.k, claim, box, iou FROM o JOIN f ON f.k = o.k AND f.pos = o.pos WHERE ok""")
def d10(spark, d):
    """Claims and boxes of a picture at more than half overlap, one to one, best first."""
    ensure_checkpoint_dir(spark)
    b = read_table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("k"), c("l_linenumber").alias("i")).agg((F.min("l_quantity") / 50).alias("x"), (F.min("l_discount") * 10).alias("y"))
    o = b.select("k", c("i").alias("box"), c("x").alias("bx"), c("y").alias("by"))
    p = b.withColumnRenamed("i", "claim").join(o, "k").where("claim < box")
    inter = F.greatest(F.lit(0.0), 1 - F.abs(c("x") - c("bx"))) * F.greatest(F.lit(0.0), 1 - F.abs(c("y") - c("by")))
    s = p.withColumn("inter", inter).select("k", "claim", "box", F.round(c("inter") / (2 - c("inter")), 9).alias("iou")).where("iou > 0.5")
    return E.greedy_pairs(s, "k", "claim", "box", "iou")


@query("G3_folder_orders", W + """, g AS (SELECT folder, max(date_taken) AS m, min(date_taken) AS k FROM photos GROUP BY folder) SELECT folder, row_number() OVER (ORDER BY folder) AS name_asc, row_number() OVER (ORDER BY folder DESC) AS name_desc, row_number() OVER (ORDER BY m, folder) AS modified_asc,
row_number() OVER (ORDER BY m DESC, folder) AS modified_desc, row_number() OVER (ORDER BY k, folder) AS created_asc, row_number() OVER (ORDER BY k DESC, folder) AS created_desc FROM g""")
def g3(spark, d):
    """The rank of each folder in six orders; folders without dates count as infinitely old."""
    ensure_checkpoint_dir(spark)
    old = F.lit("0001-01-01").cast("timestamp_ntz")
    g = photos(spark, d).groupBy("folder").agg(F.max("date_taken").alias("m"), F.min("date_taken").alias("k"))
    named = E.ranked(g, c("folder")).withColumnRenamed("rank", "name")
    us = lambda x: F.unix_micros(F.coalesce(x, old).cast("timestamp"))
    keys = {"name_asc": c("name"), "name_desc": -c("name"), "modified_asc": us(c("m")), "modified_desc": -us(c("m")), "created_asc": us(c("k")), "created_desc": -us(c("k"))}
    rows = named.select("folder", F.explode(F.array(*[F.struct(F.lit(k).alias("by"), v.cast("long").alias("v")) for k, v in keys.items()])).alias("o")).select("folder", "o.by", "o.v")
    r = E.ranked(rows, c("by"), c("v"), c("folder"))
    r = r.withColumn("rank", c("rank") - F.min("rank").over(Window.partitionBy("by")) + 1)
    return r.groupBy("folder").agg(*[F.max(F.when(c("by") == k, c("rank"))).cast("long").alias(k) for k in keys])


@query("A51_folder_catalog", W + "SELECT folder, max(date_taken) AS newest, array_to_string(list_filter(string_split(folder, '/'), lambda x: x <> ''), ' › ') AS crumbs, row_number() OVER (ORDER BY max(date_taken) DESC, folder) AS rank FROM photos GROUP BY folder")
def a51(spark, d):
    ensure_checkpoint_dir(spark)
    g = photos(spark, d).groupBy("folder").agg(F.max("date_taken").alias("newest"))
    r = E.ranked(g, c("newest").desc(), c("folder"))
    return r.select("folder", "newest", F.array_join(F.filter(F.split("folder", "/"), lambda x: x != ""), " › ").alias("crumbs"), c("rank").cast("long").alias("rank"))


@query("E2_suggestion_order", WITH + "SELECT key, n, row_number() OVER (ORDER BY n DESC, key) AS rank FROM (SELECT key, count(*) AS n FROM keyed GROUP BY key)")
def e2(spark, d):
    ensure_checkpoint_dir(spark)
    r = E.ranked(T.suggestions(photos(spark, d)).select("key", "n"), c("n").desc(), c("key"))
    return r.select("key", "n", c("rank").cast("long").alias("rank"))


@query("C4_suggestions_for_query", WITH + "SELECT key, count(*) AS n FROM keyed WHERE contains(key, 'nation_1') AND key NOT IN ('places/asia/nation_1', 'people/user 1') GROUP BY key ORDER BY n DESC, key LIMIT 6")
def c4(spark, d):
    """The six most frequent tags whose name or path has the query's text and which aren't active yet."""
    active = ["places/asia/nation_1", "people/user 1"]
    s = T.suggestions(photos(spark, d)).where(F.contains("key", F.lit("nation_1")) & ~c("key").isin(active))
    return s.select("key", "n").orderBy(F.desc("n"), "key").limit(6)


@query("C18_reviewable_clusters", f"WITH {CLUSTERS} SELECT id, size, row_number() OVER (ORDER BY size DESC, id) AS rank FROM cl WHERE state = 'unlabeled' AND size >= 20")
def c18(spark, d):
    ensure_checkpoint_dir(spark)
    r = E.ranked(_clusters(spark, d).where("state = 'unlabeled' and size >= 20").select("id", "size"), c("size").desc(), c("id"))
    return r.select("id", "size", c("rank").cast("long").alias("rank"))


@query("D18_distinct_keys", "SELECT DISTINCT l_suppkey % 5 AS cluster, l_partkey FROM lineitem")
def d18(spark, d):
    """The distinct pictures of each cluster, for all clusters."""
    return read_table(spark, d, "lineitem").select((c("l_suppkey") % 5).alias("cluster"), "l_partkey").distinct()


@query("A6_sidecars", f"""WITH {LISTING}, k AS (SELECT DISTINCT dir, name, {KIND} AS kind FROM listing), img AS (SELECT * FROM k WHERE kind = 'image'),
x AS (SELECT dir, lower(regexp_replace(name, '\\.[^.]*$', '')) AS base, min(name) AS name FROM (SELECT dir, name FROM k WHERE kind = 'sidecar' UNION ALL SELECT dir, name || '.XMP' FROM img WHERE length(name) % 2 = 0) GROUP BY ALL)
SELECT img.dir, img.name, coalesce(f.name, s.name) AS sidecar FROM img LEFT JOIN x f ON f.dir = img.dir AND f.base = lower(img.name) LEFT JOIN x s ON s.dir = img.dir AND s.base = lower(regexp_replace(img.name, '\\.[^.]*$', ''))""")
def a6(spark, d):
    """The sidecar of the whole file name, or else of its stem, whatever the case."""
    from heliograph.operators import scan as SC

    k = _listing(spark, d).select("dir", "name", SC.kind(c("name")).alias("kind")).distinct()
    img = k.where("kind = 'image'").select("dir", "name")
    side = k.where("kind = 'sidecar'").select("dir", "name").unionByName(img.where("length(name) % 2 = 0").select("dir", F.concat("name", F.lit(".XMP")).alias("name")))
    return L.sidecar_of(img, side)


@query("E13_top_people", W + """, g AS (SELECT country, person, count(*) AS n FROM photos WHERE person <> 'User 7' AND user_id % 10 <> 3 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, lower(person)) AS rn FROM g)
SELECT country, string_agg(person, ', ' ORDER BY rn) AS names FROM r WHERE rn <= 3 GROUP BY country""")
def e13(spark, d):
    """The three most frequent people of each country, without the user and the hidden ones."""
    g = photos(spark, d).where("person <> 'User 7' and user_id % 10 <> 3").groupBy("country", "person").agg(F.count("*").alias("n"))
    w = Window.partitionBy("country").orderBy(F.desc("n"), F.lower("person"))
    top = g.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return top.groupBy("country").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "person"))), lambda x: x["person"]), ", ").alias("names"))


@query("D12_cluster_top_faces", f"""WITH {CENTRES}, s AS (SELECT vec_id, e.label, round(list_dot_product(embedding::DOUBLE[], m) / n, 9) AS q FROM embeddings e JOIN cen USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY q DESC, vec_id)::INT AS place FROM s) SELECT label, vec_id, place FROM r WHERE place <= 4""")
def d12(spark, d):
    """The four members of each cluster nearest to its centre, by whole vectors."""
    e = read_table(spark, d, "embeddings")
    s = e.join(V.unit_centroids(e, "label", "embedding"), "label").select("label", "vec_id", F.round(V.dot(c("embedding"), c("centroid")), 9).alias("q"))
    w = Window.partitionBy("label").orderBy(F.desc("q"), "vec_id")
    return s.withColumn("place", F.row_number().over(w)).where("place <= 4").select("label", "vec_id", "place")


@query("O1_calibrate", f"""WITH {CENTRES}, s AS (SELECT e.label AS truth, cen.label, round(list_dot_product(embedding::DOUBLE[], m) / n, 9) AS q FROM embeddings e, cen), t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4])::DOUBLE AS least)
SELECT label, least, count(*) FILTER (WHERE q >= least) AS taken, count(*) FILTER (WHERE q >= least AND truth = label) AS right_ones, round(avg(q), 6) AS bias, max(q) AS best FROM s, t GROUP BY ALL""")
def o1(spark, d):
    """Per label and threshold of a grid: how many it takes, how many of them rightly, and the label's mean score as its bias."""
    e = read_table(spark, d, "embeddings")
    return L.calibrate(e.select(c("label").alias("truth"), "embedding"), V.unit_centroids(e, "label", "embedding"), [0.1, 0.2, 0.3, 0.4])
