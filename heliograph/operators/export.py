"""Publishing several tables together: skipped when nothing changed, committed at once, never half seen.

A fingerprint doesn't depend on the order of rows: it is a sum of their hashes, so each partition adds up its own rows and nothing is sorted or gathered. An
export writes only the tables whose fingerprint changed, each to a folder of its own, and then one line per table to the manifest, in one write; readers go through
the manifest, so an export that was lost half-way isn't seen and the next one writes it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col
MOST_STILLS, MOST_REFS = 500, 12  #: fixed values of the rule: stills of an index, photos of an item
MANIFEST = "number long, name string, fingerprint string, folder string"
SLICES = (1, 16, 31, 46)  #: where the 15 hexadecimal digits start that are summed


def fingerprint(*columns: Column) -> Column:
    """An aggregate over rows: their number and four sums of 60 bits of their hashes. Equal for equal multisets of rows, in any order."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    line = F.sha2(F.concat(*parts), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring(line, k, 15), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string") for k in SLICES]
    return F.concat_ws("-", F.count("*").cast("string"), *sums)


def text_of(column: str, kind: str) -> Column:
    """A column as text, also where it holds arrays or structs."""
    return F.to_json(F.struct(C(column))) if kind.startswith(("array", "struct", "map")) else C(column).cast("string")


def table_fingerprint(df: DataFrame) -> str:
    names = dict(df.dtypes)
    return df.agg(fingerprint(*[text_of(c, names[c]) for c in sorted(names)]).alias("f")).first().f


def manifest(spark: SparkSession, path: str) -> dict[str, tuple[int, str, str]]:
    """Per table: number of its last export, fingerprint, folder. Lines are few: one per table and export."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return {}
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").groupBy("name").agg(F.max(F.struct("number", "fingerprint", "folder")).alias("m"))
    return {r["name"]: tuple(r.m) for r in rows.collect()}


def export(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Writes the tables (as JSON lines) that changed since the last export to this folder; their names."""
    spark = next(iter(tables.values())).sparkSession
    was = manifest(spark, path)
    prints = {n: table_fingerprint(df) for n, df in tables.items()}
    changed = [n for n in tables if n not in was or was[n][1] != prints[n]]
    if not changed:
        return []
    number = 1 + max((m[0] for m in was.values()), default=0)
    lines = []
    for n in changed:
        folder = f"{n}-{number:06d}-{uuid.uuid4().hex}"
        tables[n].write.option("ignoreNullFields", "false").json(f"{path}/{folder}")
        lines.append((number, n, prints[n], folder))
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return changed


def exported(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table as it was last exported."""
    return spark.read.schema(schema).json(f"{path}/{manifest(spark, path)[name][2]}")


def photo_index(photos: DataFrame, most: int = MOST_STILLS) -> DataFrame:
    """owner, place, id, folder, date_taken of each library's newest stills; undated ones come last. Each task keeps the best of its own first (a window group limit)."""
    w = Window.partitionBy("owner").orderBy(C("date_taken").desc_nulls_last(), "pos")
    return photos.where("not is_video").withColumn("place", F.row_number().over(w)).where(C("place") <= most).select("owner", "place", "id", "folder", "date_taken")


def memory_refs(items: DataFrame, photos: DataFrame, key: str = "item", most: int = MOST_REFS) -> DataFrame:
    """key, refs of items(key, owner, photos, cover): the cover, then the photos in order, each once, those that the library still has; items without any are left out."""
    every = items.select(key, "owner", F.posexplode(F.concat(F.array("cover"), "photos")).alias("i", "id")).groupBy(key, "owner", "id").agg(F.min("i").alias("i"))
    known = every.join(photos.select("owner", "id").distinct(), ["owner", "id"])
    refs = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "id"))).alias("r"))  # an item's photos are a bounded sample
    return refs.select(key, F.transform(F.slice("r", 1, most), lambda x: x["id"]).alias("refs"))


def memory_items(memories: DataFrame, scheduled: DataFrame, photos: DataFrame, start: Column, end: Column) -> DataFrame:
    """owner, place, mid, title, refs, valid_from, valid_to, priority: today's memories, valid today, and scheduled ones in their own windows, by priority.

    memories(owner, rank, mid, title, score, photos, cover); scheduled has valid_from and valid_to instead of rank. Of equal priority, today's come first.
    """
    cols = ["owner", "mid", "title", "score", "photos", "cover", "valid_from", "valid_to"]
    today = memories.withColumns({"valid_from": start, "valid_to": end}).select(*cols, F.struct(F.lit(0).alias("of"), C("rank").cast("string").alias("at"), "mid").alias("seq"))
    ahead = scheduled.select(*cols, F.struct(F.lit(1).alias("of"), C("valid_from").cast("string").alias("at"), "mid").alias("seq"))
    items = today.unionByName(ahead).withColumn("item", F.sha2(F.to_json(F.struct("owner", "seq")), 256))
    j = items.join(memory_refs(items, photos), "item").withColumn("priority", F.round("score").cast("int"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("priority"), C("seq.of"), F.lpad(C("seq.at"), 24, "0"), C("seq.mid")))  # a library's items
    return j.withColumn("place", place).select("owner", "place", "mid", "title", "refs", "valid_from", "valid_to", "priority")
