"""A corpus pipeline of five stages; each reads all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each stage's rows as Parquet to the shared
folder and reads them again for the next one. The last stage returns the columns of documents and the number of the copy.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.decontaminate import drop_contaminated
from heliograph.llm.mixing import emit_copies
from heliograph.llm.near_dedup import near_duplicates
from heliograph.llm.quality import keep_quality
from heliograph.llm.secrets import redact_secrets
from heliograph.session import read_table, shared_folder, shuffles_removed, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; null and wordless texts and rows without id are scored like others, or kept.

    Rows of equal id, language and text share their verdict.
    """
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id.

    Null and wordless texts are in no group and stay. Rows without id stay, exact copies too. Rows of equal id stay or go together.
    """
    name = unused(docs, "__gone")
    found = near_duplicates(docs)
    with shuffles_removed(spark):
        gone = found.where("not kept").select(F.col("doc_id").alias(name)).distinct().checkpoint()
        few = gone.count() <= 1_000_000
    if few:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null texts hold none; repeated rows share their verdict."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew where the text has changed; null texts stay null."""
    was = unused(docs, "__was")
    out = redact_secrets(docs.withColumn(was, F.length("text")))
    n = F.when(F.length("text").eqNullSafe(F.col(was)), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; null sources are one source, null texts have size 0."""
    return emit_copies(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]

#: The classifier and the near duplicates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder for the stages' rows in the one that the cluster shares."""
    return os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents"), _folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
