"""Helpers that every query shares: reading tables, checkpoint folder, shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: "weakref.WeakSet" = weakref.WeakSet()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder. The folder may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch where the context sets none: whole texts are far larger than the rows that Spark's default is made for.
BATCH_ROWS = "1000"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so Python tasks can import it anywhere, and bound Arrow batches."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.sql.execution.arrow.maxRecordsPerBatch") is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="heliograph-"), "heliograph.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    sc.addPyFile(out)
    _shipped.add(sc)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores after it as long as df has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where none is set and driver and executors share a machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="heliograph-checkpoint-")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder for checkpoints, unless one is set already."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


#: Spark's setting (4.1 on) that removes a query's shuffle files when the query ends; older versions keep them until they collect garbage.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames that are made within it leave no shuffle files once they have been run.

    For the steps of an operator, which are checkpointed and run once. A frame that is handed out is made outside: run
    twice, it would have to shuffle again.
    """
    was = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, was)


def settled(df: DataFrame) -> DataFrame:
    """df as checkpointed, without the shuffle files of its making: for a step of an operator that is run here and now."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()
