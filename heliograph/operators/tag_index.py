"""A stored tag index: postings by key, read by bucket, updated by what changed.

An index is a folder of generations. The first one is built from all photos, each later one holds only the changes: postings that came (sign 1) and
postings that went (sign -1). What holds now is the sum of the signs, so an update never reads or rewrites older generations, and a search adds up only the
bucket that it reads. A generation counts once its line in ``commits`` is written, so one that a lost driver left half-written is never seen.
``compacted`` writes an index of one generation again.

Tables of a generation: ``postings`` (bucket, key, id, taken, exact, sign), partitioned by bucket and sorted by key; ``terms`` (key, n, exact), the
counts by key; ``names`` (id, name, taken, sign). A key is a tag's lower-case path, or a prefix of it where its namespace matches by prefix.
A key that most photos carry is spread over several files of its bucket (rebalanced when written), so no task writes or reads it whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import tags as T

C = F.col
BUCKETS = 64
FEW_KEYS = 1000  #: so many keys of a text search are looked up by name; more are joined


def postings(photos: DataFrame, sign: int = 1) -> DataFrame:
    """key, id, taken, exact, sign of photos(id, date_taken, tags): each photo once per key; exact if one of its tags is the key itself."""
    keys = F.array_distinct(F.flatten(F.transform("tags", T.index_keys)))
    own = F.transform("tags", lambda t: F.array_join(F.transform(T.parts(t), F.lower), "/"))
    rows = photos.select("id", C("date_taken").alias("taken"), own.alias("own"), F.explode(keys).alias("key"))
    return rows.select("key", "id", "taken", F.array_contains("own", C("key")).alias("exact"), F.lit(sign).alias("sign"))


def names(photos: DataFrame, sign: int = 1) -> DataFrame:
    return photos.select("id", F.lower("filename").alias("name"), C("date_taken").alias("taken"), F.lit(sign).alias("sign"))


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _net(rows: DataFrame, *by: str) -> DataFrame:
    """Rows whose signs don't cancel each other."""
    return rows.groupBy(*by).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")


def _write(path: str, generation: int, buckets: int, post: DataFrame, name: DataFrame) -> None:
    spark, folder = post.sparkSession, f"gen-{generation:06d}-{uuid.uuid4().hex}"
    at = f"{path}/{folder}"
    post.withColumn("bucket", bucket_of("key", buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{at}/postings")
    stored = spark.read.schema(POSTINGS).parquet(f"{at}/postings")
    stored.groupBy("key").agg(F.sum("sign").alias("n"), F.sum(F.when(C("exact"), C("sign")).otherwise(0)).alias("exact")).write.parquet(f"{at}/terms")
    name.write.parquet(f"{at}/names")
    spark.createDataFrame([(generation, folder, buckets)], "generation long, folder string, buckets int").coalesce(1).write.mode("append").parquet(f"{path}/commits")


POSTINGS = "key string, id long, taken timestamp_ntz, exact boolean, sign int, bucket int"


def build(photos: DataFrame, path: str, buckets: int = BUCKETS) -> TagIndex:
    """Stores the index of photos(id, filename, date_taken, tags) in a new folder."""
    _write(path, 0, buckets, postings(photos), names(photos))
    return open_index(photos.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> TagIndex:
    """The index as it is committed now: a line per generation comes to the driver."""
    lines = sorted(tuple(r) for r in spark.read.parquet(f"{path}/commits").collect())
    return TagIndex(spark, path, [f"{path}/{folder}" for _, folder, _ in lines], lines[0][2], lines[-1][0])


@dataclass
class TagIndex:
    spark: SparkSession
    path: str
    folders: list[str]
    buckets: int
    generation: int

    def _stored(self) -> DataFrame:
        frames = [self.spark.read.schema(POSTINGS).parquet(f"{f}/postings") for f in self.folders]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _now(self, rows: DataFrame) -> DataFrame:
        return rows if len(self.folders) == 1 else _net(rows, "key", "id", "taken", "exact")

    def postings(self) -> DataFrame:
        """key, id, taken, exact of all buckets."""
        return self._now(self._stored().drop("bucket")).drop("sign")

    def photos_for(self, key: str) -> DataFrame:
        """id, taken, exact of a key's photos: one bucket of each generation is read."""
        k = key.strip().lower()
        bucket = self.spark.range(1).select(bucket_of(F.lit(k), self.buckets)).first()[0]
        return self._now(self._stored().where((C("bucket") == bucket) & (C("key") == k)).drop("bucket")).drop("key", "sign")

    def names(self) -> DataFrame:
        """id, name, taken of all photos."""
        rows = self.spark.read.parquet(*[f"{f}/names" for f in self.folders])
        return (rows if len(self.folders) == 1 else _net(rows, "id", "name", "taken")).drop("sign")

    def terms(self) -> DataFrame:
        """key, n, exact: how many photos carry a key, and how many by a tag of this very path."""
        rows = self.spark.read.parquet(*[f"{f}/terms" for f in self.folders])
        return rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum("exact").alias("exact")).where("n > 0")

    def suggestions(self) -> DataFrame:
        """key, n, latest of every key."""
        return self.postings().groupBy("key").agg(F.count("*").alias("n"), F.max("taken").alias("latest"))

    def update(self, before: DataFrame, after: DataFrame) -> TagIndex:
        """Commits a generation: before holds the changed and removed photos as they were, after the changed and added ones as they are."""
        post = _net(postings(before, -1).unionByName(postings(after)), "key", "id", "taken", "exact")
        name = _net(names(before, -1).unionByName(names(after)), "id", "name", "taken")
        _write(self.path, self.generation + 1, self.buckets, post, name)
        return open_index(self.spark, self.path)

    def compacted(self, path: str) -> TagIndex:
        """The same index in one generation, in a new folder."""
        _write(path, 0, self.buckets, self.postings().withColumn("sign", F.lit(1)), self.names().withColumn("sign", F.lit(1)))
        return open_index(self.spark, path)

    def _carrying(self, path: str) -> DataFrame:
        """id, taken of the photos with a tag of this path or, for places, beneath it."""
        p = path.strip().lower()
        return (self.photos_for(p) if p.startswith("places/") else self.photos_for(p).where("exact")).drop("exact")

    def _containing(self, text: str) -> DataFrame:
        """id, taken of the photos whose name, or one of whose tags, has the text."""
        keys = self.terms().where((C("exact") > 0) & F.contains("key", F.lit(text))).select("key")
        few = [r.key for r in keys.limit(FEW_KEYS + 1).collect()]
        stored = self._stored()
        if len(few) <= FEW_KEYS:
            where = self.spark.createDataFrame([(k,) for k in few], "key string").select(bucket_of("key", self.buckets).alias("b")).distinct().collect()
            rows = stored.where(C("bucket").isin([r.b for r in where]) & C("key").isin(few))
        else:
            rows = stored.join(keys, "key", "left_semi")
        tagged = self._now(rows.where("exact").drop("bucket")).select("id", "taken")
        return self.names().where(F.contains("name", F.lit(text))).select("id", "taken").unionByName(tagged).distinct()

    def search(self, text: str, required: tuple[str, ...] = ()) -> DataFrame:
        """id, taken of the photos with all required tags and the tag of this path or, if no photo has such a tag, the text in a name or tag.

        Whether there is such a tag is asked of the terms; then one bucket per tag is read.
        """
        q = text.strip().lower()
        found = None
        if q:
            known = not self.terms().where(C("key") == q).isEmpty()
            found = self._carrying(q) if known else self._containing(q)
        for r in required:
            carrying = self._carrying(r)
            found = carrying if found is None else found.join(carrying.select("id"), "id", "left_semi")
        return self.names().select("id", "taken") if found is None else found
