"""Distances on the sphere, grid cells, nearest place within a radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def nearest(points: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """id, place, distance: the nearest place closer than ``km`` for each of points(id, lat, lon); ties go to the least place id.

    An equi-join on grid cells: each point is in its own cell alone, each place in all cells that it may reach, as places are the fewer. Cells are
    one radius high in latitude; in longitude a place's reach widens towards the poles, so it is counted from its own latitude.
    """
    deg = km / 111.19
    wide = int(360 / deg)
    row, column = cell(F.col("lat"), deg), cell(F.col("lon") + 180, 360 / wide)
    reach = F.ceil(F.lit(1.0) / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("lat")) + deg, F.lit(89.9)))), F.lit(0.002))).cast("int")
    p = points.select("id", "lat", "lon", row.alias("cy"), F.pmod(column, F.lit(wide)).alias("cx"))
    q = places.withColumn("cy", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: row + i)))
    columns = F.array_distinct(F.transform(F.sequence(-reach - 1, reach + 1), lambda i: F.pmod(column + i, F.lit(wide))))
    q = q.select("place", F.col("lat").alias("plat"), F.col("lon").alias("plon"), "cy", F.explode(columns).alias("cx"))
    hit = p.join(q, ["cy", "cx"]).withColumn("d", haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).where(F.col("d") < km)
    return hit.groupBy("id").agg(F.min(F.struct("d", "place")).alias("best")).select("id", F.col("best.place").alias("place"), F.col("best.d").alias("d"))
