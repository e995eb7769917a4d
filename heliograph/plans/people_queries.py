"""People, memory, plan and ordering queries (inventory C16-C25, D1-D6, D18-D23, E12-E22, F2-F15, G, L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heliograph.operators import people as P
from heliograph.plans.registry import query
from heliograph.session import read_table
from heliograph.sources.adapters import PHOTOS, photos

c = lambda x: F.col(x)


@query("D1_contact_links", """WITH p AS (SELECT 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') AS person, s_suppkey AS k FROM supplier), h AS (SELECT person FROM p WHERE k % 11 = 0),
l AS (SELECT person, CASE WHEN k % 5 = 0 THEN k + 1 WHEN k % 7 = 0 THEN -1 END AS manual, k % 13 = 0 AS disabled FROM p)
SELECT p.person, CASE WHEN l.disabled THEN NULL WHEN l.manual IS NOT NULL THEN m.c_custkey ELSE a.c_custkey END AS contact FROM p JOIN l USING (person) LEFT JOIN customer m ON m.c_custkey = l.manual LEFT JOIN customer a ON lower(a.c_name) = lower(p.person)
WHERE p.person NOT IN (SELECT person FROM h)""")
def d1(spark, d):
    k = c("s_suppkey")
    p = read_table(spark, d, "supplier").select(F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0")).alias("person"), k.alias("k"))
    links = p.select("person", F.when(c("k") % 5 == 0, c("k") + 1).when(c("k") % 7 == 0, F.lit(-1)).alias("contact"), (c("k") % 13 == 0).alias("disabled"))
    contacts = read_table(spark, d, "customer").select(c("c_custkey").alias("contact"), c("c_name").alias("name"))
    return P.link(p.select("person"), p.where("k % 11 = 0").select("person"), links, contacts)


@query("D3_contact_index", "SELECT lower(p_name) AS name, min(p_partkey) AS contact FROM part GROUP BY 1")
def d3(spark, d):
    return P.first_by(read_table(spark, d, "part").select(F.lower("p_name").alias("name"), c("p_partkey").alias("contact")), "name", "contact")


@query("D6_cache_retract", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def d6(spark, d):
    known = read_table(spark, d, "customer").where("c_acctbal > 0").select(c("c_custkey").alias("o_custkey"))
    return read_table(spark, d, "orders").join(known, "o_custkey", "left_semi").select("o_orderkey")


@query("D7_carry_forward", """WITH n AS (SELECT event_id AS id FROM events WHERE event_type <> 'view'), o AS (SELECT event_id AS id, event_type FROM events WHERE event_type IN ('view', 'click'))
SELECT id, 'new' AS origin FROM n UNION ALL SELECT id, 'old' FROM o WHERE id NOT IN (SELECT id FROM n)""")
def d7(spark, d):
    e = read_table(spark, d, "events").select(c("event_id").alias("id"), "event_type")
    new, old = e.where("event_type <> 'view'").select("id"), e.where("event_type in ('view', 'click')").select("id")
    return new.withColumn("origin", F.lit("new")).unionByName(old.join(new, "id", "left_anti").withColumn("origin", F.lit("old")))


@query("D22_member_vectors", "SELECT e.vec_id, e.label, n_name FROM embeddings e JOIN nation ON e.label = n_nationkey WHERE n_regionkey IN (0, 2)")
def d22(spark, d):
    n = read_table(spark, d, "nation").where("n_regionkey in (0, 2)")
    return read_table(spark, d, "embeddings").join(n, c("label") == c("n_nationkey")).select("vec_id", "label", "n_name")


@query("C16_best_person_match", """SELECT n_nationkey, coalesce(min(CASE WHEN lower(s_name) = 'supplier#' || lpad(n_nationkey::VARCHAR, 9, '0') THEN s_suppkey END), min(CASE WHEN lower(s_name) LIKE 'supplier#' || lpad(n_nationkey::VARCHAR, 8, '0') || '%' THEN s_suppkey END)) AS hit FROM nation, supplier GROUP BY 1""")
def c16(spark, d):
    """Equal name first, then a name that starts alike; each tier is one equi-join with the nations."""
    s = read_table(spark, d, "supplier").select("s_suppkey", F.lower("s_name").alias("s"))
    key = lambda w: F.concat(F.lit("supplier#"), F.lpad(c("n_nationkey").cast("string"), w, "0"))
    n = read_table(spark, d, "nation").select("n_nationkey", key(9).alias("full"), key(8).alias("part"))
    exact = s.groupBy(c("s").alias("full")).agg(F.min("s_suppkey").alias("a"))
    start = s.groupBy(F.substring("s", 1, 17).alias("part")).agg(F.min("s_suppkey").alias("b"))
    return n.join(exact, "full", "left").join(start, "part", "left").select("n_nationkey", F.coalesce("a", "b").alias("hit"))


@query("C25_changed_signatures", """WITH a AS (SELECT o_custkey, o_orderpriority, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_custkey, o_orderpriority, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders WHERE o_orderstatus <> 'F')
SELECT 'gone' AS what, x.* FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x UNION ALL SELECT 'new', y.* FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y""")
def c25(spark, d):
    """Both differences from one grouping."""
    o = read_table(spark, d, "orders")
    g = o.groupBy("o_custkey", "o_orderpriority", F.month("o_orderdate").cast("long").alias("m"), F.dayofmonth("o_orderdate").cast("long").alias("d")).agg(F.bool_or(c("o_orderstatus") != "P").alias("a"), F.bool_or(c("o_orderstatus") != "F").alias("b"))
    return g.where("a <> b").select(F.when(c("a"), "gone").otherwise("new").alias("what"), "o_custkey", "o_orderpriority", "m", "d")


@query("E16_library_stats", "SELECT l_returnflag AS state, count(*) AS rows, count(DISTINCT l_suppkey) AS clusters, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open FROM lineitem GROUP BY 1")
def e16(spark, d):
    return read_table(spark, d, "lineitem").groupBy(c("l_returnflag").alias("state")).agg(F.count("*").alias("rows"), F.countDistinct("l_suppkey").alias("clusters"), F.count_if(F.expr("l_linestatus = 'O'")).alias("open"))


@query("E21_merge_plans", """WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_suppkey // 10 AS grp, l_suppkey, n, row_number() OVER (PARTITION BY l_suppkey // 10 ORDER BY n DESC, l_suppkey) AS rn FROM s)
SELECT grp, max(CASE WHEN rn = 1 THEN l_suppkey END) AS survivor, sum(n)::BIGINT AS size FROM r GROUP BY grp""")
def e21(spark, d):
    s = read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return s.groupBy(F.expr("l_suppkey div 10").alias("grp")).agg(F.min_by("l_suppkey", F.struct((-c("n")).alias("o"), "l_suppkey")).alias("survivor"), F.sum("n").alias("size"))


@query("G2_natural_order", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rank FROM customer")
def g2(spark, d):
    """Names without padding, ordered naturally: the order of the numbers in them. Ranks by counts of range-partitioned rows."""
    n = read_table(spark, d, "customer").select("c_custkey", P.natural_key(F.concat(F.lit("Customer "), c("c_custkey").cast("string"))).alias("k"))
    return _ranked(n, "k", "c_custkey")


def _ranked(df, key: str, out: str):
    """Global ranks without one big window: sorted ranges, each numbered and moved by the counts of those before it."""
    from heliograph.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    rows = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - c("n")).alias("before"))  # a row per partition
    w = Window.partitionBy("part").orderBy(key)
    return rows.join(before, "part").select(out, (F.row_number().over(w) + c("before")).cast("long").alias("rank"))


@query("G4_recent_stills", f"WITH {PHOTOS} SELECT id, date_taken FROM photos WHERE NOT is_video ORDER BY date_taken DESC, id LIMIT 500")
def g4(spark, d):
    return photos(spark, d).where("not is_video").select("id", "date_taken").orderBy(F.desc("date_taken"), "id").limit(500)


@query("L5_places_plan", f"""WITH {PHOTOS} SELECT id, CASE WHEN value < 20 THEN 'build' WHEN value < 60 THEN 'upgrade' ELSE 'unchanged' END AS action FROM photos""")
def l5(spark, d):
    """No old path: build; a strict prefix of the new one: upgrade; else unchanged."""
    new = F.split(F.lower(c("tags")[0]), "/")
    old = F.when(c("value") < 20, None).when(c("value") < 60, F.slice(new, 1, 2)).otherwise(new)
    p = photos(spark, d).select("id", new.alias("new"), old.alias("old"))
    strict = (F.size("new") > F.size("old")) & (F.slice("new", F.lit(1), F.size("old")) == c("old"))
    return p.select("id", F.when(c("old").isNull(), "build").when(strict, "upgrade").otherwise("unchanged").alias("action"))


@query("M21_upsert_members", """WITH m AS (SELECT l_partkey AS k, l_suppkey AS cluster, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) SELECT k, arg_max(cluster, (seq, cluster)) AS cluster FROM m GROUP BY k""")
def m21(spark, d):
    m = read_table(spark, d, "lineitem").select(c("l_partkey").alias("k"), c("l_suppkey").alias("cluster"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"))
    return m.groupBy("k").agg(F.max_by("cluster", F.struct("seq", "cluster")).alias("cluster"))


@query("A9_rebuild_rows", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE least(o_orderdate + INTERVAL 2 DAY, o_orderdate + (o_custkey % 5) * INTERVAL 1 DAY) END AS taken, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS carried FROM orders""")
def a9(spark, d):
    day = lambda n: F.make_dt_interval(days=n)
    same = c("o_orderstatus") == "F"
    fresh = F.least(c("o_orderdate") + day(F.lit(2)), c("o_orderdate") + day((c("o_custkey") % 5).cast("int")))
    return read_table(spark, d, "orders").select("o_orderkey", F.when(same, c("o_orderdate")).otherwise(fresh).alias("taken"), F.when(same, c("o_orderpriority")).alias("carried"))


@query("A49_decisions", "SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'named' WHEN 1 THEN 'ignored' ELSE 'rejected' END AS decision, CASE WHEN s_nationkey % 3 = 0 THEN s_name END AS name FROM supplier")
def a49(spark, d):
    """Decision texts are made, then parsed back."""
    k = c("s_nationkey") % 3
    t = F.concat(F.lit("0.1,0.2,0.3,0.4 "), F.when(k == 0, F.concat(F.lit("named "), c("s_name"))).when(k == 1, "ignored").otherwise("rejected"))
    word = F.regexp_extract("t", r"^[0-9.,]+ (named|ignored|rejected)(?: |$)", 1)
    s = read_table(spark, d, "supplier").select("s_suppkey", t.alias("t"))
    return s.select("s_suppkey", F.nullif(word, F.lit("")).alias("decision"), F.when(word == "named", F.regexp_extract("t", r"^[0-9.,]+ named (.+)$", 1)).alias("name"))


@query("B13_box_area", """WITH b AS (SELECT l_orderkey, l_linenumber, least(l_quantity, l_tax * 500) / 50 AS x1, greatest(l_quantity, l_tax * 500) / 50 AS x2, l_discount AS y1, l_discount + l_tax AS y2 FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN x2 > x1 AND y2 > y1 THEN round((x1 + x2) / 2, 9) END AS cx, CASE WHEN x2 > x1 AND y2 > y1 THEN round((y1 + y2) / 2, 9) END AS cy FROM b""")
def b13(spark, d):
    """Corner boxes to centres; null when a side has no length."""
    x1, x2 = F.least("l_quantity", c("l_tax") * 500) / 50, F.greatest("l_quantity", c("l_tax") * 500) / 50
    y1, y2 = c("l_discount"), c("l_discount") + c("l_tax")
    ok = (x2 > x1) & (y2 > y1)
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(ok, F.round((x1 + x2) / 2, 9)).alias("cx"), F.when(ok, F.round((y1 + y2) / 2, 9)).alias("cy"))


@query("B7_people_without_box", f"WITH {PHOTOS} SELECT id, CASE WHEN person LIKE '%1' THEN '' ELSE person END AS people FROM photos")
def b7(spark, d):
    boxed = F.when(F.endswith("person", F.lit("1")), F.array(F.lower("person"))).otherwise(F.array().cast("array<string>"))
    names = F.transform(F.filter("tags", lambda t: F.startswith(t, F.lit("People/"))), lambda t: F.substring_index(t, "/", -1))
    p = photos(spark, d).select("id", names.alias("names"), boxed.alias("boxed"))
    return p.select("id", F.array_join(F.filter("names", lambda n: ~F.array_contains("boxed", F.lower(n))), "|").alias("people"))


@query("C17_visible_memories", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_custkey IN (SELECT c_custkey FROM customer) AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def c17(spark, d):
    li = read_table(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_returnflag")
    o = read_table(spark, d, "orders").join(li.where("l_returnflag = 'R'"), "o_orderkey", "left_anti").join(li, "o_orderkey", "left_semi")
    return o.join(read_table(spark, d, "customer").select(c("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("C19_named_without_box", "WITH n AS (SELECT l_suppkey AS k, l_partkey % 40 AS name, min(l_orderkey) AS first FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 40 AS name FROM lineitem WHERE l_returnflag = 'N') SELECT n.k, n.name, n.first FROM n LEFT JOIN b USING (k, name) WHERE b.k IS NULL")
def c19(spark, d):
    li = read_table(spark, d, "lineitem").select(c("l_suppkey").alias("k"), (c("l_partkey") % 40).alias("name"), "l_orderkey", "l_returnflag")
    g = li.groupBy("k", "name").agg(F.min(F.when(c("l_returnflag") == "A", c("l_orderkey"))).alias("first"), F.bool_or(c("l_returnflag") == "N").alias("boxed"))
    return g.where("first is not null and not boxed").select("k", "name", "first")


@query("M23_vector_lookup", "SELECT DISTINCT l_partkey, label FROM lineitem JOIN embeddings ON l_partkey = vec_id")
def m23(spark, d):
    k = read_table(spark, d, "lineitem").select("l_partkey").distinct()
    return k.join(read_table(spark, d, "embeddings").select(c("vec_id").alias("l_partkey"), "label"), "l_partkey")


@query("O3_reference_tagger", "SELECT vec_id, dim::INT AS dim FROM (SELECT vec_id, u.dim - 1 AS dim, row_number() OVER (PARTITION BY vec_id ORDER BY u.x DESC, u.dim) AS rn FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, dim) WHERE u.x >= 0.15::FLOAT) WHERE rn <= 6")
def o3(spark, d):
    """Dimensions as labels: those at or above the threshold, at most six, best first; sorted within each row."""
    scored = F.transform("embedding", lambda x, i: F.struct((-x).alias("s"), i.alias("dim"), x.alias("x")))
    top = F.slice(F.array_sort(F.filter(scored, lambda v: v["x"] >= F.lit(0.15).cast("float"))), 1, 6)
    return read_table(spark, d, "embeddings").select("vec_id", F.explode(top).alias("t")).select("vec_id", c("t.dim").alias("dim"))


@query("A13_sidecar_rows", "WITH o AS (SELECT o_orderkey AS id, o_custkey AS mtime, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS size FROM orders) SELECT id, CASE WHEN size IS NOT NULL AND mtime % 3 <> 0 THEN 'reused' ELSE 'new' END AS origin FROM o")
def a13(spark, d):
    """A cached row is reused if its time equals the listing's and it has any size."""
    o = read_table(spark, d, "orders")
    cached = o.select(c("o_orderkey").alias("id"), c("o_custkey").alias("cm"), F.when(c("o_orderpriority") != "5-LOW", c("o_totalprice")).alias("cs"))
    listed = o.select(c("o_orderkey").alias("id"), F.when(c("o_custkey") % 3 == 0, c("o_custkey") + 1).otherwise(c("o_custkey")).alias("mtime"))
    j = listed.join(cached, "id", "left")
    return j.select("id", F.when(c("mtime").eqNullSafe(c("cm")) & c("cs").isNotNull(), "reused").otherwise("new").alias("origin"))


@query("A33_patch_rows", "SELECT c_custkey AS id, coalesce(p.price, c_acctbal) AS value FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) p ON p.o_custkey = c_custkey")
def a33(spark, d):
    """The last patch of each row replaces its value."""
    p = read_table(spark, d, "orders").groupBy(c("o_custkey").alias("id")).agg(F.max_by("o_totalprice", "o_orderkey").alias("price"))
    return read_table(spark, d, "customer").select(c("c_custkey").alias("id"), "c_acctbal").join(p, "id", "left").select("id", F.coalesce("price", "c_acctbal").alias("value"))


@query("A52_label_rows", "SELECT label, count(*) AS n, count(DISTINCT vec_id) AS ids, bool_and(len(embedding) = 64) AS whole FROM embeddings GROUP BY label")
def a52(spark, d):
    """Checks of label vectors: duplicate ids and wrong lengths show as differences."""
    return read_table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.bool_and(F.size("embedding") == 64).alias("whole"))
