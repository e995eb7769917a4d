"""Sequence operators: the anchored fold, admission by caps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.session import settled, ship_package

SHORT = 64  #: instants that are looked at one by one; of more, the fold leaps by binary search


def _kept(t: np.ndarray, anchor: int | None, least: int) -> list[int]:
    """The places of t that a fold keeps behind the last instant kept, if there is one."""
    out = []
    if len(t) <= SHORT:
        for i, x in enumerate(t.tolist()):
            if anchor is None or x >= anchor + least:
                out.append(i)
                anchor = x
        return out
    at = 0 if anchor is None else int(np.searchsorted(t, anchor + least))
    while at < len(t):
        out.append(at)
        at = int(np.searchsorted(t, t[at] + least))
    return out


def _changes(a: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    null = a.is_null().to_numpy(zero_copy_only=False)
    out = null[1:] != null[:-1]
    if pa.types.is_struct(a.type):
        for x in a.flatten():
            out = out | _changes(x)
    elif pa.types.is_nested(a.type):
        v = a.to_pylist()
        out = out | np.array([x != y for x, y in zip(v[1:], v[:-1], strict=True)], dtype=bool)
    else:
        out = out | pc.fill_null(pc.not_equal(a[1:], a[:-1]), False).to_numpy(zero_copy_only=False)
    return out


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[tuple[int, int, bool]]]]:
    """Each batch of rows sorted by k and t with its times and, for each key, (first row, end, whether the batch before ended with that key). Holds one batch."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column("k")
        cut = [0, *(np.flatnonzero(_changes(k)) + 1).tolist(), b.num_rows]
        goes_on = last is not None and last == k[0].as_py()
        yield b, b.column("t").to_numpy(), [(x, y, goes_on and x == 0) for x, y in zip(cut, cut[1:], strict=False)]
        last = k[-1].as_py()


def _fold(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rows (k, t) that stay of a partition; ``anchor`` of its first row is the last instant kept of that key before it."""
    anchor, begun = None, False
    for b, t, pieces in _pieces(batches):
        stay = []
        for x, y, goes_on in pieces:
            anchor = anchor if goes_on else None if begun else b.column("anchor")[0].as_py()
            begun = True
            own = _kept(t[x:y], anchor, least)
            if own:
                anchor = int(t[x + own[-1]])
                stay += [x + i for i in own]
        yield b.select(["k", "t"]).take(pa.array(stay, type=pa.int64()))


def _borders(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of a partition's first key: its exits; of its last one: the last instant kept. Holds the times of the first key."""
    times, alone, part, head, own, fresh, anchor, kind = [], True, None, None, None, None, None, None
    for b, t, pieces in _pieces(batches):
        k = b.column("k")
        if kind is None:
            kind, part, head = k.type, b.column("part")[0].as_py(), k[0].as_py()
            own = head
        for x, y, goes_on in pieces:
            if not goes_on and (times or not alone):
                alone, anchor = False, None
            if not alone and y < b.num_rows:
                continue  # neither the first key nor what may be the last one
            if not goes_on:
                own = k[x].as_py()
            stay = _kept(t[x:y], anchor, least)
            anchor = int(t[x + stay[-1]]) if stay else anchor
            if alone:
                times.append(t[x:y])
                fresh = anchor
    if kind is None:
        return
    out = [(part, head, 0, alone, *_exits(np.concatenate(times), least), fresh)]
    if not alone:
        out.append((part, own, 1, False, [], [], anchor))
    long, longs = pa.int64(), pa.list_(pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, type=x) for c, x in zip(zip(*out, strict=True), [long, kind, long, pa.bool_(), longs, longs, long], strict=True)], names=["part", "k", "end", "whole", "first", "last", "fresh"])


def _exits(t: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """For each row that may be the first one kept behind an anchor: its time, and the last time kept if it is."""
    first = min(len(t), int(np.searchsorted(t, t[0] + least)) + 1)
    after = np.searchsorted(t, t + least)
    last = t.copy()
    for i in np.flatnonzero(after < len(t))[::-1].tolist():
        last[i] = last[after[i]]
    return t[:first].tolist(), last[:first].tolist()


def dedup_anchored(df: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """key, time of the rows that stay when, in time order, each row less than ``seconds`` after the last row kept is dropped.

    The anchor is the last kept row, not the row before, so this is a fold. Each instant of a key counts once. Rows are dealt by ranges of (key, time), so a
    key of any size is spread. Only a partition's first key may go on from the partition before: a first pass gives, for each row that may be the first
    one kept there, the last one that is then kept; these tables, whose size is what the clock can tell apart within ``seconds``, are chained per key and fix each
    partition's entry anchor; a second pass leaps from each kept row to the next by binary search. Both passes read a partition batch by batch, and keys stay in Arrow. Rows without time are left out.
    """
    ship_package(df.sparkSession)
    epoch = F.lit("1970-01-01 00:00:00").cast(df.schema[time].dataType)
    least = int(round(seconds * 1_000_000))
    rows = df.where(F.col(time).isNotNull()).select(F.struct(F.col(key).alias("v")).alias("k"), F.timestamp_diff("MICROSECOND", epoch, F.col(time)).alias("t")).distinct()
    dealt = settled(rows.repartitionByRange("k", "t").sortWithinPartitions("k", "t").select("k", "t", F.spark_partition_id().cast("long").alias("part")))
    long = pa.int64()

    def chain(key, table):
        anchor, out = None, []
        for r in sorted(table.to_pylist(), key=lambda r: (r["part"], r["end"])):
            if r["end"]:
                anchor = r["fresh"]
                continue
            out.append((r["part"], anchor))
            if anchor is None:
                anchor = r["fresh"]
            elif r["whole"]:
                i = int(np.searchsorted(np.array(r["first"]), anchor + least))
                anchor = r["last"][i] if i < len(r["first"]) else anchor
        return pa.table({"part": pa.array([p for p, _ in out], type=long), "anchor": pa.array([a for _, a in out], type=long)})

    shape = rows.schema["k"].dataType.simpleString()
    ends = dealt.mapInArrow(lambda batches: _borders(batches, least), f"part long, k {shape}, end long, whole boolean, first array<long>, last array<long>, fresh long")
    entries = settled(ends.groupBy("k").applyInArrow(chain, "part long, anchor long"))
    out = dealt.join(F.broadcast(entries), "part", "left").mapInArrow(lambda batches: _fold(batches, least), f"k {shape}, t long")  # a row per partition
    return out.select(F.col("k.v").alias(key), F.timestamp_add("MICROSECOND", F.col("t"), epoch).alias(time))


def admit(df: DataFrame, key: str, order: str, size: str, most_rows: int, most_size: int, budget: int) -> DataFrame:
    """key, order of the rows that are taken: in order until ``most_rows`` are; a row above ``most_size``, or that would exceed the budget, is skipped and uses none of it.

    Rows stream through their key's task sorted, so it holds a count and a sum, whatever number of rows a key has. key, order and size are whole numbers.
    """
    rows = df.where(F.col(size) <= F.least(F.lit(most_size), F.lit(budget))).select(F.struct(F.col(key).alias("v")).alias("k"), F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("s"))
    rows = rows.repartition("k").sortWithinPartitions("k", "o", "s")

    def run(batches):
        at, used, taken = None, 0, 0
        for b in batches:
            keep = []
            for i, (k, s) in enumerate(zip(b.column("k").to_pylist(), b.column("s").to_pylist(), strict=True)):
                if k != at:
                    at, used, taken = k, 0, 0
                if taken < most_rows and used + s <= budget:
                    used, taken = used + s, taken + 1
                    keep.append(i)
            yield b.take(pa.array(keep, type=pa.int64())).select(["k", "o"])

    out = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, o long")
    return out.select(F.col("k.v").alias(key), F.col("o").cast(df.schema[order].dataType).alias(order))
