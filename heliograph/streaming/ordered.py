"""Folds in event-time order on streams: a work queue as a state machine, and a fence against superseded results.

Both run on batches and on streams with a watermark. On a stream, events wait in their key's state until the watermark has passed them and are then taken in
the order of (time, seq), so the order of arrival doesn't matter up to the watermark's delay; an event that comes again, in whatever batch, is taken once. State is dropped when
nothing in it can matter any more.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_RETRIES = 3
#: What a queue's row is: its state, failed tries, the stat and decoder it was last done or skipped with, and how often it was claimed.
FRESH = {"state": None, "retries": 0, "stat": None, "decoder": None, "claims": 0}


def queue_step(row: dict, kind: str, stat: str | None, decoder: int | None) -> dict:
    """The row after an event.

    seen: enters, or becomes stale if it was done with another stat (one done without a stat takes it). sweep: what was begun and abandoned waits again, and what another decoder skipped too.
    claim: work that waits is begun; that which is begun, done or has failed for good is left alone. done, failed, skipped: end what was begun.
    """
    s = row["state"]
    if kind == "seen":
        if s is None:
            return row | {"state": "pending", "stat": stat}
        if s == "done" and row["stat"] is None:
            return row | {"stat": stat}
        if stat != row["stat"]:
            return row | {"stat": stat, "state": "stale" if s == "done" else s, "retries": 0 if s == "failed" else row["retries"]}
        return row
    if kind == "sweep":
        if s == "hashing":
            return row | {"state": "pending"}
        if s == "skipped" and row["decoder"] != decoder:
            return row | {"state": "pending", "decoder": None}
        return row
    if kind == "claim":
        if s in ("pending", "stale") or (s == "failed" and row["retries"] < MOST_RETRIES):
            return row | {"state": "hashing", "claims": row["claims"] + 1}
        return row
    if s != "hashing":
        return row
    if kind == "failed":
        return row | {"state": "failed", "retries": row["retries"] + 1}
    return row | {"state": kind, "retries": 0 if kind == "done" else row["retries"], "decoder": decoder if kind == "skipped" else row["decoder"]}


QUEUE = "item long, state string, retries long, stat string, claims long"
EVENT = ("at", "seq", "kind", "stat", "decoder")


def _queue_row(item: int, row: dict) -> tuple:
    return item, row["state"], row["retries"], row["stat"], row["claims"]


def run_queue(events: DataFrame) -> DataFrame:
    """QUEUE after all events(item, at, seq, kind, stat, decoder), on a batch.

    Events are dealt by item, sorted, and folded as they come: a task holds one row, whatever number of events an item has.
    """
    e = events.dropDuplicates(["item", "at", "seq"]).select("item", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "seq", "kind", "stat", F.col("decoder").cast("long").alias("decoder"))
    e = e.repartition("item").sortWithinPartitions("item", "at", "seq")
    names = [c.split(" ")[0] for c in QUEUE.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def fold(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("item", "kind", "stat", "decoder")), strict=True))
        out = []
        for item, own in groupby(rows, key=lambda r: r[0]):
            row = FRESH
            for _, kind, stat, decoder in own:
                row = queue_step(row, kind, stat, decoder)
            out.append(_queue_row(item, row))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return e.mapInArrow(fold, QUEUE)


def _in_order(fold: Callable[[dict, tuple], Iterator[tuple]], fresh: dict, columns: list[str], done: Callable[[dict], bool], fields: tuple[str, ...] = EVENT):
    """A state function: events (fields, the first two being at and seq) are folded in order once the watermark has passed them.

    fold(row, event) changes the row and yields output; done(row) tells whether a row may be forgotten when nothing waits.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row, last, waiting = (json.loads(x) for x in state.get) if state.exists else (dict(fresh), None, [])
        mark = state.getCurrentWatermarkMs() * 1000
        held = {tuple(w[:2]): w for w in waiting}
        for f in frames:
            at = f["at"].astype("datetime64[us]").astype("int64").tolist()
            rest = [[None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in f[c]] for c in fields[1:]]
            for e in zip(at, *rest, strict=True):
                if last is None or list(e[:2]) > last:
                    held.setdefault(tuple(e[:2]), list(e))
        out = []
        for e in sorted((w for w in held.values() if w[0] <= mark), key=lambda w: w[:2]):
            out += [(key[0], *o) for o in fold(row, tuple(e))]
            last = list(e[:2])
        waiting = sorted((w for w in held.values() if w[0] > mark), key=lambda w: w[:2])
        if waiting or not done(row):
            state.update((json.dumps(row), json.dumps(last), json.dumps(waiting)))
            if waiting:
                state.setTimeoutTimestamp(max(waiting[0][0], mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    return step


STATE = "row string, last string, waiting string"


def queue_stream(events: DataFrame) -> DataFrame:
    """The same on a stream with a watermark on ``at``: QUEUE and ``version`` whenever an item's row changes; the greatest version is the item's state.

    Rows stay in the state store: that is the queue.
    """

    def fold(row: dict, e: tuple) -> Iterator[tuple]:
        new = queue_step({k: row[k] for k in FRESH}, *e[2:])
        if new != {k: row[k] for k in FRESH}:
            row.update(new)
            row["version"] += 1
            yield (*_queue_row(0, new)[1:], row["version"])

    names = [c.split(" ")[0] for c in QUEUE.split(", ")] + ["version"]
    step = _in_order(fold, FRESH | {"version": 0}, names, lambda row: False)
    return events.groupBy("item").applyInPandasWithState(step, QUEUE + ", version long", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def fence(events: DataFrame) -> DataFrame:
    """slot, epoch, seq, value of the results that no newer epoch had superseded when they came; events(slot, at, seq, kind, epoch, value), on a batch.

    kind is ``begin`` (an epoch starts) or ``result``. For each epoch only the first start of any newer one matters, so results meet a row per epoch.
    """
    e = events.dropDuplicates(["slot", "at", "seq"])
    begun = e.where("kind = 'begin'").groupBy("slot", "epoch").agg(F.min(F.struct("at", "seq")).alias("begun"))
    results = e.where("kind = 'result'")
    epochs = begun.unionByName(results.select("slot", "epoch").distinct().withColumn("begun", F.lit(None).cast(begun.schema["begun"].dataType))).groupBy("slot", "epoch").agg(F.min("begun").alias("begun"))
    newer = Window.partitionBy("slot").orderBy(F.desc("epoch")).rowsBetween(Window.unboundedPreceding, -1)  # a row per epoch
    epochs = epochs.withColumn("until", F.min("begun").over(newer))
    j = results.join(epochs, ["slot", "epoch"])
    return j.where(F.col("until").isNull() | (F.struct("at", "seq") < F.col("until"))).select("slot", "epoch", "seq", "value")


def fence_stream(events: DataFrame, quiet: str = "1 hour") -> DataFrame:
    """The same on a stream with a watermark on ``at``. State holds a slot's highest epoch; it expires ``quiet`` after the slot's last event, when late events are dropped by the watermark anyway."""
    ms = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def fold(row: dict, e: tuple) -> Iterator[tuple]:
        at, seq, kind, epoch, value = e
        row["seen"] = at
        if kind == "begin":
            row["epoch"] = epoch if row["epoch"] is None else max(row["epoch"], epoch)
        elif row["epoch"] is None or epoch >= row["epoch"]:
            yield epoch, seq, value

    inner = _in_order(fold, {"epoch": None, "seen": 0}, ["slot", "epoch", "seq", "value"], lambda row: False, ("at", "seq", "kind", "epoch", "value"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from inner(key, frames, state)
        if state.exists:
            row, _, waiting = (json.loads(x) for x in state.get)
            over = row["seen"] // 1000 + ms
            if not waiting and over <= state.getCurrentWatermarkMs():
                state.remove()
            elif not waiting:
                state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs()) + 1)

    return events.groupBy("slot").applyInPandasWithState(step, "slot long, epoch long, seq long, value double", STATE, "append", GroupStateTimeout.EventTimeTimeout)
