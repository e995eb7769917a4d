"""File listings: kinds, pairing keys, pairing, ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions by kind.
IMAGES = ("jpg", "jpeg", "heic", "heif", "png", "gif", "tiff", "webp", "dng")
VIDEOS = ("mov", "mp4", "m4v")
SIDECARS = ("xmp",)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def kind(name: Column) -> Column:
    """image, video, sidecar or skipped, by extension alone; hidden and extension-less names are skipped."""
    e = extension(name)
    k = F.when(e.isin(*IMAGES), "image").when(e.isin(*VIDEOS), "video").when(e.isin(*SIDECARS), "sidecar").otherwise("skipped")
    return F.when(F.startswith(name, F.lit(".")), "skipped").otherwise(k)


def stem(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))


def sidecar_path(path: Column) -> Column:
    """The path with its extension replaced by xmp; null for hidden or extension-less names and for sidecars."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ok = name.rlike(r"^[^.].*\.[^.]+$") & (extension(name) != "xmp")
    return F.when(ok, F.concat(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit(".xmp")))


def pair(listing: DataFrame) -> DataFrame:
    """dir, name, live: images with the first video of their stem, and videos that no image has, under their lower-cased name.

    listing(dir, name). One grouping per (dir, stem), so an image and its video meet without a join.
    """
    rows = listing.withColumns({"kind": kind(F.col("name")), "stem": stem(F.col("name"))}).where("kind in ('image', 'video')")
    by = rows.groupBy("dir", "stem").agg(F.collect_list(F.when(F.col("kind") == "image", F.col("name"))).alias("images"), F.collect_list(F.when(F.col("kind") == "video", F.col("name"))).alias("videos"))
    images = by.select("dir", F.explode("images").alias("name"), F.array_min("videos").alias("live"))
    alone = by.where(F.size("images") == 0).select("dir", F.explode("videos").alias("name")).select("dir", F.lower("name").alias("name"), F.lit(None).cast("string").alias("live"))
    return images.unionByName(alone)


def ancestors(path: Column) -> Column:
    """Every folder above a slash-separated path, the path itself included."""
    p = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(p, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>"))
