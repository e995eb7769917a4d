"""Photo-library views over the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.session import read_table


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: pos, id, path, filename, file_size, date_taken, is_video, gps_lat, gps_lon, tz_offset_s, person, tags."""
    e, n, r = (read_table(spark, sf_dir, t) for t in ("events", "nation", "region"))
    kind = F.col("event_type")
    ext = F.when(kind == "view", "jpg").when(kind == "click", "HEIC").when(kind == "signup", "mov").when(kind == "purchase", "png").otherwise("txt")
    df = e.join(n, F.col("user_id") % 25 == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(F.lit("IMG_"), F.col("event_id").cast("string"), F.lit("."), ext)
    folder = F.concat(F.lit("/Library/"), kind, F.lit("/u"), F.col("user_id").cast("string"))
    tags = F.array(
        F.concat(F.lit("Places/"), F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit("/City "), F.col("user_id").cast("string")),
        F.concat(F.lit("People/User "), F.col("user_id").cast("string")),
        F.concat(F.lit("Objects/"), kind),
        F.when(F.col("value") > 50, F.lit("Scenes/Bright/Day")).otherwise(F.lit("Mood")),
    )
    return df.select(
        F.col("event_id").alias("pos"), F.col("event_id").alias("id"), folder.alias("folder"), F.concat(folder, F.lit("/"), name).alias("path"), name.alias("filename"),
        F.round(F.col("value") * 100).cast("long").alias("file_size"), F.col("ts").alias("date_taken"), (kind == "signup").alias("is_video"),
        ((F.col("user_id") * 37) % 180 - 90 + (F.col("event_id") % 7) * F.lit(0.01)).cast("double").alias("gps_lat"),
        ((F.col("user_id") * 53) % 360 - 180 + (F.col("event_id") % 5) * F.lit(0.01)).cast("double").alias("gps_lon"),
        ((F.col("user_id") % 5 - 2) * 3600).cast("int").alias("tz_offset_s"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("person"), F.col("user_id"), F.col("n_name").alias("country"), tags.alias("tags"), F.col("value"),
    )


#: The same view for DuckDB.
PHOTOS = """photos AS (SELECT event_id AS pos, event_id AS id, '/Library/' || event_type || '/u' || user_id AS folder,
  '/Library/' || event_type || '/u' || user_id || '/IMG_' || event_id || '.' || ext AS path, 'IMG_' || event_id || '.' || ext AS filename,
  round(value * 100)::BIGINT AS file_size, ts AS date_taken, event_type = 'signup' AS is_video,
  ((user_id * 37) % 180 - 90 + (event_id % 7) * 0.01::DOUBLE)::DOUBLE AS gps_lat, ((user_id * 53) % 360 - 180 + (event_id % 5) * 0.01::DOUBLE)::DOUBLE AS gps_lon,
  ((user_id % 5 - 2) * 3600)::INT AS tz_offset_s, 'User ' || user_id AS person, user_id, n_name AS country, value,
  ['Places/' || r_name || '/' || n_name || '/City ' || user_id, 'People/User ' || user_id, 'Objects/' || event_type,
   CASE WHEN value > 50 THEN 'Scenes/Bright/Day' ELSE 'Mood' END] AS tags
  FROM (SELECT *, CASE event_type WHEN 'view' THEN 'jpg' WHEN 'click' THEN 'HEIC' WHEN 'signup' THEN 'mov' WHEN 'purchase' THEN 'png' ELSE 'txt' END AS ext FROM events) e
  JOIN nation ON user_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
TAGS = """tagged AS (SELECT p.*, t.tag, t.tag_pos - 1 AS tag_pos FROM photos p, unnest(p.tags) WITH ORDINALITY AS t(tag, tag_pos))"""
