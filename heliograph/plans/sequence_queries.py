"""Window, sequence and calendar queries (inventory F, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.operators import sequences as S
from heliograph.operators import spans as R
from heliograph.plans.registry import query
from heliograph.session import read_table
from heliograph.sources.adapters import PHOTOS, photos

LOCAL_SQL = "(date_taken + tz_offset_s * INTERVAL 1 SECOND)"


def local():
    """A photo's wall clock."""
    return F.col("date_taken") + F.make_dt_interval(secs=F.col("tz_offset_s"))


@query("F1_anchored_dedup", """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE ts IS NOT NULL),
k(user_id, rn, ts, anchor, keep) AS (SELECT user_id, rn, ts, ts, true FROM e WHERE rn = 1 UNION ALL
 SELECT e.user_id, e.rn, e.ts, CASE WHEN e.ts - k.anchor >= INTERVAL 6 HOUR THEN e.ts ELSE k.anchor END, e.ts - k.anchor >= INTERVAL 6 HOUR FROM k JOIN e ON e.user_id = k.user_id AND e.rn = k.rn + 1)
SELECT user_id, ts FROM k WHERE keep""")
def f1(spark, d):
    return S.dedup_anchored(read_table(spark, d, "events"), "user_id", "ts", 6 * 3600)


@query("F5_role_segments", """WITH c AS (SELECT conv_id, turn, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 0 ELSE 1 END AS f FROM conversations),
r AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT conv_id, run::BIGINT AS run, min(role) AS role, count(*) AS n, min(turn) AS first_turn FROM r GROUP BY conv_id, run""")
def f5(spark, d):
    r = R.runs(read_table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], ["role"], lambda prev, first: first | ~prev("role").eqNullSafe(F.col("role")))
    return r.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("F9_years_ago", """SELECT m.m::INT AS years_ago, count(*) AS n, CASE WHEN m.m >= 10 THEN 45.0 WHEN m.m >= 5 THEN 40.0 ELSE 35.0 END::DOUBLE AS score FROM orders,
(VALUES (1), (2), (3), (5), (10), (15), (20)) AS m(m) WHERE o_orderdate = timestamp '2000-03-15 00:00:00' - m.m * INTERVAL 1 YEAR GROUP BY m.m""")
def f9(spark, d):
    o = read_table(spark, d, "orders")
    day = F.lit("2000-03-15 00:00:00").cast("timestamp")
    m = spark.createDataFrame([(x,) for x in (1, 2, 3, 5, 10, 15, 20)], "m int").withColumn("day", F.add_months(day, -12 * F.col("m")).cast("timestamp"))
    hit = o.join(F.broadcast(m), o["o_orderdate"] == m["day"])  # seven rows
    return hit.groupBy(F.col("m").alias("years_ago")).agg(F.count("*").alias("n")).select("years_ago", "n", _score(F.col("years_ago")).alias("score"))


def _score(m):
    return F.when(m >= 10, F.lit(45.0)).when(m >= 5, F.lit(40.0)).otherwise(F.lit(35.0))


@query("F13_admission_caps", f"""WITH RECURSIVE {PHOTOS}, e AS (SELECT user_id, id, file_size AS s, row_number() OVER (PARTITION BY user_id ORDER BY id) AS rn FROM photos),
k(user_id, rn, used, n, id, took) AS (SELECT user_id, 0::BIGINT, 0::BIGINT, 0, 0::BIGINT, false FROM (SELECT DISTINCT user_id FROM e) UNION ALL
 SELECT e.user_id, e.rn, CASE WHEN e.s <= 8000 AND k.used + e.s <= 60000 AND k.n < 20 THEN k.used + e.s ELSE k.used END, CASE WHEN e.s <= 8000 AND k.used + e.s <= 60000 AND k.n < 20 THEN k.n + 1 ELSE k.n END,
 e.id, e.s <= 8000 AND k.used + e.s <= 60000 AND k.n < 20 FROM k JOIN e ON e.user_id = k.user_id AND e.rn = k.rn + 1)
SELECT user_id, id FROM k WHERE took""")
def f13(spark, d):
    return S.admit(photos(spark, d).select("user_id", "id", "file_size"), "user_id", "id", "file_size", 20, 8000, 60000)


@query("I1_civil_fields", f"WITH {PHOTOS} SELECT id, year({LOCAL_SQL})::INT AS y, month({LOCAL_SQL})::INT AS m, day({LOCAL_SQL})::INT AS d, hour({LOCAL_SQL})::INT AS h FROM photos")
def i1(spark, d):
    return photos(spark, d).select("id", F.year(local()).alias("y"), F.month(local()).alias("m"), F.dayofmonth(local()).alias("d"), F.hour(local()).alias("h"))


@query("I2_start_of_day", f"WITH {PHOTOS} SELECT id, date_trunc('day', {LOCAL_SQL}) - tz_offset_s * INTERVAL 1 SECOND AS midnight FROM photos")
def i2(spark, d):
    return photos(spark, d).select("id", (F.date_trunc("day", local()) - F.make_dt_interval(secs=F.col("tz_offset_s"))).alias("midnight"))


@query("I4_add_months", "SELECT o_orderkey, (o_orderdate + INTERVAL 13 MONTH)::DATE AS later, (o_orderdate - INTERVAL 1 MONTH)::DATE AS earlier, day(last_day(o_orderdate))::INT AS month_days FROM orders")
def i4(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", F.add_months("o_orderdate", 13).alias("later"), F.add_months("o_orderdate", -1).alias("earlier"), F.dayofmonth(F.last_day("o_orderdate")).alias("month_days"))


@query("I5_day_difference", "SELECT event_id, floor((epoch_us(ts) - epoch_us(timestamp '2024-01-15 12:00:00')) / 86400000000.0)::BIGINT AS days FROM events")
def i5(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return read_table(spark, d, "events").select("event_id", F.floor(micros / F.lit(86_400_000_000.0)).alias("days"))


@query("I7_date_range_text", """WITH m AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN a = b THEN strftime(a, '%b %-d, %Y') ELSE strftime(a, '%b %-d, %Y') || ' – ' || strftime(b, '%b %-d, %Y') END AS txt FROM m""")
def i7(spark, d):
    m = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    t = lambda c: F.date_format(c, "MMM d, yyyy")
    return m.select("o_custkey", F.when(F.col("a") == F.col("b"), t("a")).otherwise(F.concat(t("a"), F.lit(" – "), t("b"))).alias("txt"))


@query("I13_month_day_key", "SELECT month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, count(*) AS n, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY ALL")
def i13(spark, d):
    return read_table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d")).agg(F.count("*").alias("n"), F.countDistinct(F.year("o_orderdate")).alias("years"))
