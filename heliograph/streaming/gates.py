"""Stream operators: trailing debounce, leading throttle, mute gate. Each runs on streams and on batches alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, LongType, StructField, StructType, TimestampType

from heliograph.operators import spans as R


def debounce(events: DataFrame, key: str, time: str, quiet: str) -> DataFrame:
    """One firing per burst: key, fires, n, where each event resets the timer and it fires after ``quiet`` without one.

    A session window by event time: on a stream with a watermark it fires when the watermark passes the burst's end.
    """
    w = F.session_window(F.col(time), quiet)
    return events.groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.end").alias("fires"), "n")


def throttle_fold(micros: list[int], last: int | None, interval: int) -> tuple[list[int], int | None]:
    """The events that pass, in time order: those at least ``interval`` after the last that passed."""
    out = []
    for t in micros:
        if last is None or t - last >= interval:
            out.append(t)
            last = t
    return out, last


def throttle(events: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """key, time of the events that pass a leading-edge throttle, for batches: the anchored dedup."""
    from heliograph.operators.sequences import dedup_anchored

    return dedup_anchored(events, key, time, seconds)


def throttle_stream(events: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """The same on a stream with a watermark on ``time``.

    Events wait in their key's state until the watermark has passed them, so the order within and across batches doesn't matter up to the
    watermark's delay. A key's state is dropped once its interval after the last passed event is over and nothing waits.
    """
    interval = int(seconds * 1e6)
    out = StructType([StructField(key, LongType()), StructField(time, TimestampType())])
    kept = StructType([StructField("last", LongType()), StructField("waiting", ArrayType(LongType()))])

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        mark = state.getCurrentWatermarkMs() * 1000
        times = [*waiting, *(t for f in frames for t in f[time].astype("datetime64[us]").astype("int64").tolist())]
        passed, last = throttle_fold(sorted(t for t in times if t <= mark), last, interval)
        waiting = [t for t in times if t > mark]
        if waiting or last is not None and last + interval > mark:
            state.update((last, waiting))
            state.setTimeoutTimestamp(max(min(waiting, default=(last or 0) + interval), mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(passed), time: pd.to_datetime(passed, unit="us")})

    return events.groupBy(key).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def mute_gate(events: DataFrame, key: str, time: str, muting: str) -> DataFrame:
    """Events with ``open`` (not muted when they came) and ``flush``: the first event after a mute that remembered others.

    The column named by ``muting`` is true for an event that mutes, false for one that unmutes, null for others; it acts on what follows.
    """
    out = R.last_before(events, key, [time], muting, "__muted").withColumn("open", ~F.coalesce("__muted", F.lit(False))).drop("__muted")
    p = R.with_previous(out, key, [time], ["open"])
    return p.withColumn("flush", F.col("open") & F.coalesce(~F.col("__prev.open"), F.lit(False))).select(*out.columns, "flush")
