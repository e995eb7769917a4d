"""Geo, vector and clustering queries (inventory D8, E9, E18, E20, G8, J, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.operators import geo as G
from heliograph.operators import vectors as V
from heliograph.plans.registry import query
from heliograph.session import read_table
from heliograph.sources.adapters import PHOTOS, photos

HAVERSINE = "2 * 6371.0::DOUBLE * atan2(sqrt(a), sqrt(1 - a))"
SITES = "sites AS (SELECT s_suppkey AS place, ((s_suppkey * 41) % 170 - 85)::DOUBLE AS plat, ((s_suppkey * 59) % 360 - 180)::DOUBLE AS plon FROM supplier)"


def _sites(spark, d):
    s = read_table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("place"), ((F.col("s_suppkey") * 41) % 170 - 85).cast("double").alias("lat"), ((F.col("s_suppkey") * 59) % 360 - 180).cast("double").alias("lon"))


def _points(spark, d):
    return photos(spark, d).select("id", F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"))


@query("D8_nearest_place", f"""WITH {PHOTOS}, {SITES}, x AS (SELECT id, place, {HAVERSINE} AS d FROM (SELECT id, place,
 pow(sin(radians(plat - gps_lat) / 2), 2) + cos(radians(gps_lat)) * cos(radians(plat)) * pow(sin(radians(plon - gps_lon) / 2), 2) AS a FROM photos, sites)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, place) AS rn FROM x WHERE d < 150) SELECT id, place, round(d, 6) AS km FROM r WHERE rn = 1""")
def d8(spark, d):
    n = G.nearest(_points(spark, d), _sites(spark, d), 150.0)
    return n.select("id", "place", F.round("d", 6).alias("km"))


@query("J1_haversine", f"""WITH {PHOTOS}, x AS (SELECT id, pow(sin(radians(48.2 - gps_lat) / 2), 2) + cos(radians(gps_lat)) * cos(radians(48.2)) * pow(sin(radians(16.37 - gps_lon) / 2), 2) AS a FROM photos)
SELECT id, round({HAVERSINE}, 6) AS km FROM x""")
def j1(spark, d):
    return _points(spark, d).select("id", F.round(G.haversine(F.col("lat"), F.col("lon"), F.lit(48.2), F.lit(16.37)), 6).alias("km"))


@query("J3_grid_cells", f"WITH {PHOTOS} SELECT floor(gps_lat / 0.1::DOUBLE)::BIGINT AS cy, floor(gps_lon / 0.1::DOUBLE)::BIGINT AS cx, count(*) AS n FROM photos GROUP BY ALL")
def j3(spark, d):
    return photos(spark, d).groupBy(G.cell(F.col("gps_lat"), 0.1).alias("cy"), G.cell(F.col("gps_lon"), 0.1).alias("cx")).agg(F.count("*").alias("n"))


@query("E18_centroids", """WITH x AS (SELECT label, u.dim - 1 AS dim, u.x::DOUBLE AS x FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, dim)) SELECT label, dim::INT AS dim, round(avg(x), 9) AS mean FROM x GROUP BY ALL""")
def e18(spark, d):
    return V.centroids(read_table(spark, d, "embeddings"), "label", "embedding").select("label", "dim", F.round("mean", 9).alias("mean"))


@query("J4_cosine_to_centroid", """WITH x AS (SELECT label, u.dim AS dim, avg(u.x::DOUBLE) AS m FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, dim) GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY dim) AS m, sqrt(sum(m * m)) AS n FROM x GROUP BY label)
SELECT vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], c.m) / n, 6) AS score FROM embeddings e JOIN c USING (label)""")
def j4(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.join(V.unit_centroids(e, "label", "embedding"), "label").select("vec_id", "label", F.round(V.dot(F.col("embedding"), F.col("centroid")), 6).alias("score"))


@query("J5_vector_norms", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding)::INT AS dims FROM embeddings")
def j5(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dims"))


@query("G8_top_matches", """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
x AS (SELECT query_id, vec_id AS id, list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings WHERE query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x WHERE score >= 0.2) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 8""")
def g8(spark, d):
    """Queries: every row whose id is divisible by 50, against all rows."""
    e = read_table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.top_matches(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 8, 0.2).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("J6_iou", """WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 50) / 50.0::DOUBLE AS cx, (l_suppkey % 40) / 40.0::DOUBLE AS cy, l_quantity / 100 AS w, l_quantity / 80 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN iw <= 0 OR ih <= 0 THEN 0 ELSE iw * ih / (w * h + 0.25::DOUBLE * 0.25::DOUBLE - iw * ih) END, 6) AS iou FROM (SELECT *,
 least(cx + w / 2, 0.625::DOUBLE) - greatest(cx - w / 2, 0.375::DOUBLE) AS iw, least(cy + h / 2, 0.625::DOUBLE) - greatest(cy - h / 2, 0.375::DOUBLE) AS ih FROM b)""")
def j6(spark, d):
    c = F.col
    b = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") % 50 / F.lit(50.0)).alias("cx"), (c("l_suppkey") % 40 / F.lit(40.0)).alias("cy"), (c("l_quantity") / 100).alias("w"), (c("l_quantity") / 80).alias("h"))
    side = lambda x, s: F.least(c(x) + c(s) / 2, F.lit(0.625)) - F.greatest(c(x) - c(s) / 2, F.lit(0.375))
    b = b.withColumns({"iw": side("cx", "w"), "ih": side("cy", "h")})
    iou = F.when((c("iw") <= 0) | (c("ih") <= 0), F.lit(0.0)).otherwise(c("iw") * c("ih") / (c("w") * c("h") + F.lit(0.0625) - c("iw") * c("ih")))
    return b.select("l_orderkey", "l_linenumber", F.round(iou, 6).alias("iou"))
