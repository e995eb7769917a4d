"""Stream operators over the events table (inventory M12-M14), as batches; tests run them as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.plans.registry import query
from heliograph.session import read_table
from heliograph.streaming import gates as G


@query("M13_debounce", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events WHERE ts IS NOT NULL),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, max(ts) + INTERVAL 6 HOUR AS fires, count(*) AS n FROM r GROUP BY user_id, run""")
def m13(spark, d):
    return G.debounce(read_table(spark, d, "events"), "user_id", "ts", "6 hours")


@query("M14_throttle", """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE ts IS NOT NULL),
k(user_id, rn, ts, anchor, keep) AS (SELECT user_id, rn, ts, ts, true FROM e WHERE rn = 1 UNION ALL
 SELECT e.user_id, e.rn, e.ts, CASE WHEN e.ts - k.anchor >= INTERVAL 1 DAY THEN e.ts ELSE k.anchor END, e.ts - k.anchor >= INTERVAL 1 DAY FROM k JOIN e ON e.user_id = k.user_id AND e.rn = k.rn + 1)
SELECT user_id, ts FROM k WHERE keep""")
def m14(spark, d):
    return G.throttle(read_table(spark, d, "events"), "user_id", "ts", 86400)


@query("M12_mute_gate", """WITH m AS (SELECT user_id, event_id, ts, coalesce(last_value(CASE event_type WHEN 'error' THEN true WHEN 'signup' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS muted FROM events)
SELECT user_id, event_id, NOT muted AS open, (NOT muted) AND coalesce(lag(muted) OVER (PARTITION BY user_id ORDER BY ts), false) AS flush FROM m""")
def m12(spark, d):
    kind = F.col("event_type")
    e = read_table(spark, d, "events").withColumn("m", F.when(kind == "error", True).when(kind == "signup", False))
    return G.mute_gate(e, "user_id", "ts", "m").select("user_id", "event_id", "open", "flush")


#: Order lines as a work queue's events: each line is seen, swept, claimed, ended or claimed again at its dates.
QUEUE_SQL = """SELECT l_orderkey AS item, l_shipdate + (l_linenumber % 3) * INTERVAL 1 HOUR AS t, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS seq,
  CASE WHEN l_linenumber = 1 THEN 'seen' ELSE ['sweep', 'claim', 'done', 'failed', 'claim', 'seen', 'skipped'][1 + l_suppkey % 7] END AS kind, 's' || l_partkey % 2 AS stat, l_suppkey % 3 AS decoder FROM lineitem"""


def _queue_events(spark, d):
    c = F.col
    kinds = F.array(*map(F.lit, ("sweep", "claim", "done", "failed", "claim", "seen", "skipped")))
    kind = F.when(c("l_linenumber") == 1, "seen").otherwise(F.get(kinds, (c("l_suppkey") % 7).cast("int")))
    at = c("l_shipdate") + F.make_dt_interval(hours=(c("l_linenumber") % 3).cast("int"))
    return read_table(spark, d, "lineitem").select(c("l_orderkey").alias("item"), at.alias("at"), ((c("l_linenumber") * 1000000 + c("l_partkey")).cast("long") * 100000 + c("l_suppkey")).alias("seq"), kind.alias("kind"), F.concat(F.lit("s"), (c("l_partkey") % 2).cast("string")).alias("stat"), (c("l_suppkey") % 3).cast("long").alias("decoder"))


QUEUE_STEP = """CASE x.kind WHEN 'seen' THEN CASE WHEN r.s IS NULL THEN {'s': 'pending', 'n': r.n, 'stat': x.stat, 'd': r.d, 'c': r.c} WHEN r.s = 'done' AND r.stat IS NULL THEN {'s': r.s, 'n': r.n, 'stat': x.stat, 'd': r.d, 'c': r.c}
  WHEN x.stat IS DISTINCT FROM r.stat THEN {'s': CASE WHEN r.s = 'done' THEN 'stale' ELSE r.s END, 'n': CASE WHEN r.s = 'failed' THEN 0 ELSE r.n END, 'stat': x.stat, 'd': r.d, 'c': r.c} ELSE r END
 WHEN 'sweep' THEN CASE WHEN r.s = 'hashing' THEN {'s': 'pending', 'n': r.n, 'stat': r.stat, 'd': r.d, 'c': r.c} WHEN r.s = 'skipped' AND r.d IS DISTINCT FROM x.decoder THEN {'s': 'pending', 'n': r.n, 'stat': r.stat, 'd': NULL, 'c': r.c} ELSE r END
 WHEN 'claim' THEN CASE WHEN r.s IN ('pending', 'stale') OR r.s = 'failed' AND r.n < 3 THEN {'s': 'hashing', 'n': r.n, 'stat': r.stat, 'd': r.d, 'c': r.c + 1} ELSE r END
 ELSE CASE WHEN r.s IS DISTINCT FROM 'hashing' THEN r WHEN x.kind = 'failed' THEN {'s': 'failed', 'n': r.n + 1, 'stat': r.stat, 'd': r.d, 'c': r.c}
  ELSE {'s': x.kind, 'n': CASE WHEN x.kind = 'done' THEN 0 ELSE r.n END, 'stat': r.stat, 'd': CASE WHEN x.kind = 'skipped' THEN x.decoder ELSE r.d END, 'c': r.c} END END"""


@query("M9_tagging_run", f"""WITH e AS (SELECT item, t, seq, any_value({{'kind': kind, 'stat': stat, 'decoder': decoder::BIGINT}}) AS ev FROM ({QUEUE_SQL}) GROUP BY item, t, seq),
f AS (SELECT item, list_reduce(list(ev ORDER BY t, seq), lambda r, x: {QUEUE_STEP}, {{'s': NULL::VARCHAR, 'n': 0::BIGINT, 'stat': NULL::VARCHAR, 'd': NULL::BIGINT, 'c': 0::BIGINT}}) AS q FROM e GROUP BY item)
SELECT item, q.s AS state, q.n AS retries, q.stat AS stat, q.c AS claims FROM f""")
def m9(spark, d):
    """The queue after all events of a run: reclaimed, reopened, re-stated and claimed, each event once."""
    from heliograph.streaming.ordered import run_queue

    return run_queue(_queue_events(spark, d))


@query("M18_superseded_results", """WITH e AS (SELECT DISTINCT o_custkey AS slot, o_orderdate AS t, o_orderkey AS seq, CASE WHEN o_orderkey % 5 < 2 THEN 'begin' ELSE 'result' END AS kind, year(o_orderdate) * 2 + o_orderkey % 3 AS epoch, o_totalprice AS value FROM orders)
SELECT slot, epoch, seq, value FROM e r WHERE kind = 'result' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.slot = r.slot AND b.kind = 'begin' AND b.epoch > r.epoch AND (b.t < r.t OR b.t = r.t AND b.seq < r.seq))""")
def m18(spark, d):
    """Orders as starts and results of a customer's runs: results of runs that a newer one had replaced are dropped."""
    from heliograph.streaming.ordered import fence

    c = F.col
    kind = F.when(c("o_orderkey") % 5 < 2, "begin").otherwise("result")
    o = read_table(spark, d, "orders").select(c("o_custkey").alias("slot"), c("o_orderdate").alias("at"), c("o_orderkey").alias("seq"), kind.alias("kind"), (F.year("o_orderdate") * 2 + c("o_orderkey") % 3).alias("epoch"), c("o_totalprice").alias("value"))
    return fence(o)
