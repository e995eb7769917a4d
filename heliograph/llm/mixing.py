"""Mixing sources to target weights, in DataFrame functions only.

Words are summed per source; each source's target is its share of all words by weight, held at
``most`` times its own size, and what is held back goes to the other sources by weight until none is above
its bound (water filling, solved by one sort of the sources, in whole numbers). A source's repetition
rate is target / size; each document is taken floor(rate) times, plus once more if a hash of
its id, as a number in [0, 1), lies below the rate's fraction. Reruns agree.

The texts are read once, to count words; the narrow (id, source, size) rows are checkpointed. Only the
table of sources is sorted in one task. It is checkpointed and counted: up to ``FEW_SOURCES`` rows it
is broadcast, beyond that it is joined by a shuffle, whose hot sources adaptive execution splits.

Nulls: a null text has size 0; a null source is a source of its own and the last one; null ids share one
draw. A source of size 0 has target 0 and its documents are taken 0 times. Repeated rows of one id share
their draw. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.session import ensure_checkpoint_dir, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
FEW_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target of each source of sizes(source, size)."""
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    s = s.withColumn("w", w.cast("long")).withColumn("bound", F.lit(most) * F.col("source_size"))
    upto = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("bounds", F.sum("bound").over(upto)).withColumn("ws", F.sum("w").over(upto))
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    full = (whole("bounds") - whole("total")) * whole("w") + whole("bound") * (whole("all_w") - whole("ws")) < 0
    s = s.withColumn("full", full)
    held = F.sum(F.when(F.col("full"), F.col("bound")).otherwise(0)).over(every)
    held_w = F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(every)
    free = ((F.col("total") - held) * F.col("w")).cast("double") / (F.col("all_w") - held_w).cast("double")
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("full"), F.col("bound").cast("double")).otherwise(F.least(free, F.col("bound").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def _counted(targets: DataFrame) -> DataFrame:
    """The targets, marked for broadcast if they are few."""
    targets = targets.checkpoint()
    return F.broadcast(targets) if targets.count() <= FEW_SOURCES else targets


def draw(key, seed: str):
    """A number in [0, 1) of the key, by MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_sources(documents: DataFrame, weights=WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies of each row of documents(doc_id, text, source)."""
    ensure_checkpoint_dir(documents.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size")).checkpoint()
    targets = _counted(source_targets(sizes, weights, most).withColumnRenamed("source", "of"))
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["of"])).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies")


def emit_copies(documents: DataFrame, weights=WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """Each row of documents as many times as the mix takes it, numbered from 0 in ``copy`` (``copy_`` where there is such a column, and so on)."""
    ensure_checkpoint_dir(documents.sparkSession)
    of, rate_of = unused(documents, "__of"), unused(documents, "__rate")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    targets = source_targets(documents.select("source", size.alias("size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = _counted(targets.select(F.col("source").alias(of), rate.alias(rate_of)))
    rows = documents.join(targets, documents["source"].eqNullSafe(targets[of]))
    copies = F.floor(rate_of) + F.when(draw(documents["doc_id"], seed) < F.col(rate_of) - F.floor(rate_of), 1).otherwise(0)
    copies = F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<long>"))
    return rows.select(*[documents[c] for c in documents.columns], F.explode(copies).alias(unused(documents, "copy")))


#: DuckDB SQL for the op6 query; {docs} stands for the table.
MIX_SQL = r"""
sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
per AS (SELECT source, sum(size)::BIGINT AS s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM sizes GROUP BY source),
run AS (SELECT *, 3 * s AS b, sum(3 * s) OVER o AS bs, sum(w) OVER o AS ws, sum(s) OVER () AS t, sum(w) OVER () AS aw FROM per
  WINDOW o AS (ORDER BY (3 * s)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
flagged AS (SELECT *, (bs - t) * w + b * (aw - ws) < 0 AS f FROM run),
level AS (SELECT *, sum(CASE WHEN f THEN b ELSE 0 END) OVER () AS hb, sum(CASE WHEN f THEN w ELSE 0 END) OVER () AS hw FROM flagged),
targets AS (SELECT source, s AS source_size, CASE WHEN s = 0 THEN 0.0 WHEN f THEN b::DOUBLE
  ELSE least(((t - hb) * w)::DOUBLE / (aw - hw)::DOUBLE, b::DOUBLE) END AS target FROM level),
rated AS (SELECT z.doc_id, z.size, z.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix:' || coalesce(z.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sizes z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
"""
