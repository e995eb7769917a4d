"""Text and number scalars (inventory G, H, J) and prompts (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import text as X
from heliograph.plans.registry import query
from heliograph.session import read_table
from heliograph.sources.adapters import PHOTOS, photos


@query("H8_normalize_person", "SELECT c_custkey, regexp_replace(trim('  ' || replace(c_name, '#', '   ') || ' '), '\\s+', ' ', 'g') AS person FROM customer")
def h8(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", X.person(F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("   ")), F.lit(" "))).alias("person"))


@query("H9_tag_leaf_root", f"WITH {PHOTOS} SELECT DISTINCT tags[1] AS tag, list_last(string_split(tags[1], '/')) AS leaf, string_split(tags[1], '/')[1] AS root, replace(tags[1], '/', '|') AS piped FROM photos")
def h9(spark, d):
    t = photos(spark, d).select(F.col("tags")[0].alias("tag")).distinct()
    return t.select("tag", F.substring_index("tag", "/", -1).alias("leaf"), F.substring_index("tag", "/", 1).alias("root"), F.replace("tag", F.lit("/"), F.lit("|")).alias("piped"))


@query("H12_place_path", "SELECT s_suppkey, CASE WHEN r_name = n_name THEN 'Places/' || r_name ELSE 'Places/' || r_name || '/' || n_name END || CASE WHEN s_name IN (r_name, n_name) THEN '' ELSE '/' || s_name END AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def h12(spark, d):
    s, n, r = (read_table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    levels = F.array_distinct(F.filter(F.array("r_name", "n_name", "s_name"), lambda x: x.isNotNull() & (x != "")))
    return j.select("s_suppkey", F.concat(F.lit("Places/"), F.array_join(levels, "/")).alias("path"))


@query("H17_join_names", "WITH g AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1) SELECT n_regionkey, array_to_string(l[1:len(l)-1], ', ') || ' & ' || l[len(l)] AS names FROM g")
def h17(spark, d):
    g = read_table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return g.select("n_regionkey", X.join_names(F.col("l")).alias("names"))


@query("B12_cluster_key", "SELECT o_orderkey, 'trip-' || strftime(o_orderdate, '%Y-%-m-%-d') AS key FROM orders")
def b12(spark, d):
    sub = F.concat(F.lit("subtrip-"), F.date_format("o_orderdate", "yyyy-M-d"), F.lit("-2"))
    return read_table(spark, d, "orders").select("o_orderkey", sub.alias("m")).select("o_orderkey", X.cluster_key(F.col("m")).alias("key"))


@query("B11_claim_text", "SELECT l_orderkey, l_linenumber, printf('%.6f,%.6f,%.6f,%.6f', l_discount, l_tax, 0.1::DOUBLE, 0.2::DOUBLE) AS claim FROM lineitem")
def b11(spark, d):
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%.6f,%.6f,%.6f,%.6f", "l_discount", "l_tax", F.lit(0.1), F.lit(0.2)).alias("claim"))


