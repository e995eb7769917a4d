"""Exact similarity join of unit vectors, pruned by pivots.

The angle between two vectors is a metric, so a vector's angle to a pivot bounds its angle to everything whose angle to that pivot, or to another one, is known. Each
vector belongs to its nearest pivot and there to a ring of angles; two such cells can hold a pair only if the triangle inequality lets them. Which pivots
are taken (MOST_PIVOTS vectors of least hash) changes how much is skipped, never the result. Cells are dealt into chunks, so a cell that holds most
vectors is many tasks; a task holds two chunks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
MOST_PIVOTS, RINGS = 48, 12  #: so many cells at most that the driver may compare all of them
CHUNK = 4096  #: vectors
SLACK = 1e-9  #: angles are rounded; bounds give way by so much


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows(id, v) with their pivot, ring and angle to the pivot."""

    def run(batches):
        for b in batches:
            v = np.array(b.column("v").to_pylist(), dtype=float).reshape(b.num_rows, -1)
            cos = np.clip(v @ pivots.T, -1.0, 1.0) if len(v) else np.zeros((0, len(pivots)))
            best = cos.argmax(axis=1) if len(v) else np.zeros(0, dtype=int)
            angle = np.arccos(cos[np.arange(len(v)), best])
            ring = np.minimum(angle / math.pi * 2 * RINGS, 2 * RINGS - 1).astype(int)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(best * 2 * RINGS + ring, type=pa.int64()), pa.array(angle)], names=["id", "v", "cell", "angle"])

    return rows.mapInArrow(run, "id long, v array<double>, cell long, angle double")


def cell_pairs(cells: list[tuple[int, float, float]], pivots: np.ndarray, least: float) -> list[tuple[int, int]]:
    """The pairs of cells (cell, least angle, greatest angle) that may hold vectors whose cosine is at least ``least``."""
    most = math.acos(max(-1.0, min(1.0, least))) + SLACK
    between = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    at = np.array([c // (2 * RINGS) for c, _, _ in cells], dtype=int)
    lo, hi = (np.array([x[k] for x in cells], dtype=float) for k in (1, 2))
    d = between[np.ix_(at, at)]
    d[at[:, None] == at[None, :]] = 0.0
    bound = np.maximum(d - hi[:, None] - hi[None, :], np.maximum(lo[:, None] - hi[None, :], lo[None, :] - hi[:, None]) - d)
    i, j = np.nonzero(np.triu(bound <= most))
    return [(cells[a][0], cells[b][0]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def similar_pairs(rows: DataFrame, least: float, report: dict | None = None) -> DataFrame:
    """a, b, sim of all pairs a < b of rows(id long, v array<double>), unit vectors, whose cosine is at least ``least``. report takes the number of cell pairs and of those skipped."""
    spark = rows.sparkSession
    rows = rows.select("id", C("v").cast("array<double>").alias("v")).where("v is not null")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(MOST_PIVOTS).collect()  # a bounded choice
    if not some:
        return rows.select(C("id").alias("a"), C("id").alias("b"), F.lit(0.0).alias("sim"))
    pivots = np.array([r.v for r in some], dtype=float)
    dealt = _cells(rows, pivots).checkpoint()
    found = [tuple(r) for r in dealt.groupBy("cell").agg(F.min("angle"), F.max("angle"), F.count("*")).collect()]  # a row per cell
    pairs = cell_pairs([c[:3] for c in found], pivots, least)
    if report is not None:
        every = len(found) * (len(found) + 1) // 2
        report.update(cells=len(found), pairs=every, skipped=every - len(pairs))
    chunks = {cell: -(-n // CHUNK) for cell, _, _, n in found}
    table = spark.createDataFrame([(a, b, chunks[a], chunks[b]) for a, b in pairs], "cell long, other long, n long, m long")
    chunk = lambda n: F.pmod(F.xxhash64("id"), C(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), C(n) - 1))
    left = dealt.select("id", "v", "cell").join(F.broadcast(table), "cell").select("id", "v", "cell", "other", chunk("n").alias("i"), upto("m").alias("j"))
    right = dealt.select(C("id").alias("b_id"), C("v").alias("b_v"), C("cell").alias("b_other")).join(F.broadcast(table.select(C("cell").alias("b_cell"), C("other").alias("b_other"), C("n").alias("b_n"), C("m").alias("b_m"))), "b_other")
    right = right.select("b_id", "b_v", "b_cell", "b_other", upto("b_n").alias("b_i"), F.pmod(F.xxhash64("b_id"), C("b_m")).alias("b_j"))

    def meet(key, a, b):
        ids, others = np.array(a.column("id").to_pylist(), dtype=np.int64), np.array(b.column("b_id").to_pylist(), dtype=np.int64)
        if not len(ids) or not len(others):
            hit = (np.zeros(0, dtype=int), np.zeros(0, dtype=int))
            sim = np.zeros((0, 0))
        else:
            sim = np.array(a.column("v").to_pylist(), dtype=float) @ np.array(b.column("b_v").to_pylist(), dtype=float).T
            ok = sim >= least
            if key[0].as_py() == key[1].as_py():
                ok &= ids[:, None] < others[None, :]  # a cell with itself: each pair comes up twice
            else:
                ok &= ids[:, None] != others[None, :]
            hit = np.nonzero(ok)
        x, y = ids[hit[0]] if len(ids) else np.zeros(0, dtype=np.int64), others[hit[1]] if len(others) else np.zeros(0, dtype=np.int64)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "sim": sim[hit] if len(x) else np.zeros(0)})

    return left.groupBy("cell", "other", "i", "j").cogroup(right.groupBy("b_cell", "b_other", "b_i", "b_j")).applyInArrow(meet, "a long, b long, sim double")
