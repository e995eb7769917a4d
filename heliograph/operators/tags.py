"""Hierarchical tags: parts, index keys, buckets, suggestions, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXED = ("places", "objects", "scenes")


def parts(path: Column) -> Column:
    """The non-empty segments of a path, trimmed after empty ones are dropped."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.trim(x))


def namespace(path: Column) -> Column:
    """The first of several segments; null for a single one."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.element_at(p, 1))


def display_name(path: Column) -> Column:
    return F.try_element_at(parts(path), F.lit(-1))


def index_keys(path: Column) -> Column:
    """The lower-cased path and, in namespaces that match by prefix, its prefixes of two or more segments."""
    p = F.transform(parts(path), F.lower)
    more = F.when(
        (F.size(p) > 2) & F.element_at(p, 1).isin(*PREFIXED),
        F.transform(F.sequence(F.lit(2), F.size(p) - 1), lambda k: F.array_join(F.slice(p, 1, k), "/")),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.array_join(p, "/")), more)


def buckets(photos: DataFrame) -> DataFrame:
    """id, key: each photo once per key of its tags. One exploded pass, no join."""
    keys = F.array_distinct(F.flatten(F.transform("tags", index_keys)))
    return photos.select("id", "date_taken", F.explode(keys).alias("key"))


def suggestions(photos: DataFrame) -> DataFrame:
    """key, count, latest of every bucket.

    Photos of one event or folder carry the same tags, so equal lists are counted first and their keys are derived once per list, not per photo.
    """
    lists = photos.groupBy("tags").agg(F.count("*").alias("n"), F.max("date_taken").alias("latest"))
    keys = F.array_distinct(F.flatten(F.transform("tags", index_keys)))
    return lists.select("n", "latest", F.explode(keys).alias("key")).groupBy("key").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))


def corpus_terms(filename: Column, tags: Column) -> Column:
    """Lower-cased file name, then each tag's display name and path."""
    return F.concat(F.array(F.lower(filename)), F.flatten(F.transform(tags, lambda t: F.array(F.lower(display_name(t)), F.lower(t)))))


def carries(tags: Column, path: str) -> Column:
    """Whether a tag equals the path or, for a path in the namespace of places, lies beneath it."""
    q = path.lower()
    places = q.startswith("places/")
    return F.exists(tags, lambda t: (F.lower(t) == q) | (F.startswith(F.lower(t), F.lit(q + "/")) & F.lit(places)))


def has_key(tags: Column, key: str) -> Column:
    """Whether one of the tags has this (lower-case) key: its own path, or a prefix of two or more segments where those count."""
    under = F.lit("/" in key and key.split("/")[0] in PREFIXED)
    return F.exists(tags, lambda t: (F.lower(t) == key) | (under & F.startswith(F.lower(t), F.lit(key + "/"))))


def search(photos: DataFrame, text: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Photos with all required tags that carry the tag named by the text or, if no tag has that path, contain it.

    The tag branch is decided by a one-row existence test on the tags themselves, which ends at the first hit.
    """
    q = text.strip().lower()
    df = photos
    for r in required:
        df = df.where(carries(F.col("tags"), r))
    if not q:
        return df
    known = photos.where(has_key(F.col("tags"), q)).limit(1).agg(F.count("*").alias("__known"))
    df = df.crossJoin(F.broadcast(known))  # one row
    hit = F.contains(F.array_join(corpus_terms(F.col("filename"), F.col("tags")), "\n"), F.lit(q))
    return df.where(F.when(F.col("__known") > 0, carries(F.col("tags"), q)).otherwise(hit)).drop("__known")
