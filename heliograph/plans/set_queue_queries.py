"""Set plans, joins by difference and work-queue queries (inventory D, L, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.operators import sets as P
from heliograph.plans.registry import query
from heliograph.session import read_table

OLD = "old AS (SELECT o_orderkey AS id, o_custkey AS mtime, o_totalprice AS size FROM orders WHERE o_orderstatus <> 'P')"
NEW = "new AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey + 1 ELSE o_custkey END AS mtime, o_totalprice AS size FROM orders WHERE o_orderstatus <> 'F')"


def _old(spark, d):
    return read_table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("mtime"), F.col("o_totalprice").alias("size"))


def _new(spark, d):
    o = read_table(spark, d, "orders").where("o_orderstatus <> 'F'")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("mtime"), F.col("o_totalprice").alias("size"))


@query("D5_manifest_diff", f"""WITH {OLD}, {NEW} SELECT id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.mtime IS NOT DISTINCT FROM n.mtime AND o.size IS NOT DISTINCT FROM n.size THEN 'unchanged' ELSE 'modified' END AS change
FROM old o FULL JOIN new n USING (id)""")
def d5(spark, d):
    return P.diff(_old(spark, d), _new(spark, d), "id", ("mtime", "size"))


@query("A8_diff_counts", f"""WITH {OLD}, {NEW}, x AS (SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.mtime = n.mtime AND o.size = n.size THEN 'unchanged' ELSE 'modified' END AS change
FROM old o FULL JOIN new n USING (id)) SELECT change, count(*) AS n FROM x GROUP BY change""")
def a8(spark, d):
    return P.diff(_old(spark, d), _new(spark, d), "id", ("mtime", "size")).groupBy("change").agg(F.count("*").alias("n"))


@query("A18_same_content", """SELECT l_orderkey, l_linenumber, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a = b WHEN a IS NULL AND b IS NULL THEN l_tax = l_discount ELSE false END AS same
FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN l_partkey % 7 END AS a, CASE WHEN l_linestatus = 'F' THEN l_suppkey % 7 END AS b FROM lineitem)""")
def a18(spark, d):
    c = F.col
    li = read_table(spark, d, "lineitem").withColumns({"a": F.when(c("l_returnflag") == "A", c("l_partkey") % 7), "b": F.when(c("l_linestatus") == "F", c("l_suppkey") % 7)})
    return li.select("l_orderkey", "l_linenumber", P.same_content(c("a"), c("b"), c("l_tax"), c("l_discount")).alias("same"))


@query("D13_unassigned", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def d13(spark, d):
    return read_table(spark, d, "customer").select("c_custkey").join(read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("D14_unlabeled", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 2000)")
def d14(spark, d):
    named = read_table(spark, d, "lineitem").join(read_table(spark, d, "supplier").where("s_acctbal > 2000"), F.col("l_suppkey") == F.col("s_suppkey"))
    return read_table(spark, d, "part").select("p_partkey").join(named.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("D15_named_for_key", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'")
def d15(spark, d):
    o = read_table(spark, d, "orders").where("o_orderstatus = 'P'")
    return o.join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("D17_prune_pairs", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def d17(spark, d):
    p = read_table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    s = read_table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return read_table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(p, "l_partkey", "left_semi").join(s, "l_suppkey", "left_semi").distinct()


PLAN = """req AS (SELECT DISTINCT l_orderkey AS id, 'B' || (l_partkey % 9) AS v FROM lineitem WHERE l_returnflag = 'A'), owned AS (SELECT DISTINCT l_orderkey AS id, 'B' || (l_suppkey % 9) AS v FROM lineitem WHERE l_returnflag <> 'A'),
have AS (SELECT id, v FROM owned UNION SELECT DISTINCT l_orderkey, 'B' || (l_linenumber % 9) FROM lineitem),
k AS (SELECT * FROM req UNION SELECT * FROM owned UNION SELECT * FROM have),
f AS (SELECT k.id, k.v, r.id IS NOT NULL AS r, o.id IS NOT NULL AS o, h.id IS NOT NULL AS h FROM k LEFT JOIN req r USING (id, v) LEFT JOIN owned o USING (id, v) LEFT JOIN have h USING (id, v))"""


def _sets(spark, d):
    li, c = read_table(spark, d, "lineitem"), F.col
    value = lambda x: F.concat(F.lit("B"), (c(x) % 9).cast("string")).alias("v")
    req = li.where("l_returnflag = 'A'").select(c("l_orderkey").alias("id"), value("l_partkey"))
    owned = li.where("l_returnflag <> 'A'").select(c("l_orderkey").alias("id"), value("l_suppkey"))
    return req, owned, owned.unionByName(li.select(c("l_orderkey").alias("id"), value("l_linenumber")))


@query("L1_tag_plan", f"WITH {PLAN} SELECT id, v, CASE WHEN r AND NOT h THEN 'add' WHEN o AND NOT r THEN 'remove' ELSE 'keep' END AS action, (r AND (o OR NOT h)) AS owned_after FROM f")
def l1(spark, d):
    return P.ownership_plan(*_sets(spark, d))


QUEUE = """q AS (SELECT l_orderkey * 10 + l_linenumber AS item, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber % 5 = 4 THEN 'stale' ELSE 'done' END WHEN 'N' THEN CASE WHEN l_linenumber % 3 = 0 THEN 'hashing' ELSE 'pending' END ELSE CASE WHEN l_linenumber % 4 = 3 THEN 'skipped' ELSE 'failed' END END AS state, (l_partkey % 6) AS retries, l_shipdate AS updated, (l_suppkey % 4)::INT AS pack FROM lineitem)"""


def _queue(spark, d):
    c = F.col
    n = c("l_linenumber")
    state = F.when(c("l_returnflag") == "A", F.when(n % 5 == 4, "stale").otherwise("done")).when(c("l_returnflag") == "N", F.when(n % 3 == 0, "hashing").otherwise("pending")).otherwise(F.when(n % 4 == 3, "skipped").otherwise("failed"))
    return read_table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("item"), state.alias("state"), (c("l_partkey") % 6).alias("retries"), c("l_shipdate").alias("updated"), (c("l_suppkey") % 4).cast("int").alias("pack"))


@query("M2_claimable", f"WITH {QUEUE} SELECT item, updated FROM q WHERE state = 'pending' OR state = 'failed' AND retries < 3 ORDER BY updated, item LIMIT 200")
def m2(spark, d):
    return _queue(spark, d).where("state = 'pending' or state = 'failed' and retries < 3").select("item", "updated").orderBy("updated", "item").limit(200)


@query("M3_transitions", f"WITH {QUEUE} SELECT item, CASE WHEN state = 'pending' THEN 'hashing' WHEN state = 'failed' AND retries < 3 THEN 'hashing' WHEN state = 'done' AND pack <> 3 THEN 'stale' ELSE state END AS state FROM q")
def m3(spark, d):
    return P.advance(_queue(spark, d), pack=3, most_retries=3)


@query("M1_enqueue", f"WITH {QUEUE} SELECT item, state FROM q WHERE state = 'done' UNION ALL SELECT DISTINCT item, 'pending' FROM q WHERE item NOT IN (SELECT item FROM q WHERE state = 'done')")
def m1(spark, d):
    q = _queue(spark, d)
    return P.insert_if_absent(q.where("state = 'done'").select("item", "state"), q.select("item"), "item")


@query("I18_retry_backoff", f"WITH {QUEUE} SELECT item, least(16, 1 << retries)::BIGINT AS wait_s FROM q WHERE state = 'failed'")
def i18(spark, d):
    return _queue(spark, d).where("state = 'failed'").select("item", F.least(F.lit(16), F.expr("shiftleft(1, cast(retries as int))")).cast("long").alias("wait_s"))


@query("M16_scan_kind", "SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 48 HOUR THEN 'full' ELSE 'light' END AS kind FROM events")
def m16(spark, d):
    from heliograph.operators import spans as R

    e = R.with_previous(read_table(spark, d, "events").select("user_id", "ts"), "user_id", ["ts"], ["ts"])
    full = F.col("__prev").isNull() | R.gap_over("ts", F.col("__prev.ts"), 48 * 3600)
    return e.select("user_id", "ts", F.when(full, "full").otherwise("light").alias("kind"))


@query("M24_done_with_stat", f"WITH {QUEUE} SELECT item, pack FROM q WHERE state = 'done' AND updated IS NOT NULL")
def m24(spark, d):
    return _queue(spark, d).where("state = 'done' and updated is not null").select("item", "pack")
